"""Sliding-window statistics over ``(t - w, t]`` as a sweep over arrivals and expiries.

Each row opens an interval ``[t, t + w)``. Sorting arrivals and expiries together turns a count, a
distinct count or a concentration measure into running sums, so a row costs O(log n) however many rows
share its window. Time is cut into chunks and a row is copied into every later chunk its longest
interval reaches; a hot key is therefore spread over many tasks and one shuffle serves all statistics
of a key space.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K


@dataclass(frozen=True)
class Count:
    """Rows of the key in the window."""

    name: str
    width_ms: int


@dataclass(frozen=True)
class Distinct:
    """Distinct values of ``member`` in the window."""

    name: str
    member: str
    width_ms: int


@dataclass(frozen=True)
class Concentration:
    """Sum of squared shares and Shannon entropy (natural log) of ``member`` in the window."""

    hhi: str
    entropy: str
    member: str
    width_ms: int


def _x_ln_x(n: Column) -> Column:
    return F.when(n > 0, n * F.ln(n.cast("double"))).otherwise(F.lit(0.0))


def add_window_stats(
    df: DataFrame,
    keys: list[str],
    stats: list,
    ts: str = "ingest_ms",
    seq: str = "seq",
    chunk_ms: int | None = None,
) -> DataFrame:
    """``df`` plus one column per statistic, current row included, ties taken in ``seq`` order."""
    if not stats:
        return df
    longest = max(s.width_ms for s in stats)
    span = int(chunk_ms or max(K.HOUR_MS, 4 * longest))
    columns = df.columns

    # Copy each row into the chunks its longest interval reaches, then shuffle once by key and chunk. A copy has only what the
    # sweep reads, and columns that nobody asks for later can be pruned.
    own = F.expr(f"`{ts}` div {span}")
    reach = F.expr(f"(`{ts}` + {longest - 1}) div {span}")
    halo = df.select(*columns, own.alias("_own"), F.explode(F.sequence(own, reach)).alias("_chunk"))
    read = {*keys, ts, seq, *(s.member for s in stats if not isinstance(s, Count))}
    emit = F.col("_own") == F.col("_chunk")
    halo = halo.select(*((F.col(c) if c in read else F.when(emit, F.col(c)).alias(c)) for c in columns), emit.alias("_emit"), "_chunk")
    by = [*keys, "_chunk"]
    halo = halo.repartition(*[F.col(c) for c in by])
    time, order = F.col(ts), F.col(seq)

    # Arrival and last-expiry flags per member: a member opens when it was absent for a whole width and
    # closes a width after its last sighting.
    concentrations = [s for s in stats if isinstance(s, Concentration)]
    covered = {(c.member, c.width_ms) for c in concentrations}
    flagged = [s for s in stats if isinstance(s, Distinct) and (s.member, s.width_ms) not in covered]
    for member in dict.fromkeys(s.member for s in flagged):
        near = Window.partitionBy(*by, member).orderBy(time, order)
        halo = halo.withColumns({f"_prev_{member}": F.lag(time).over(near), f"_next_{member}": F.lead(time).over(near)})

    def opens(s: Distinct) -> Column:
        prev = F.col(f"_prev_{s.member}")
        return F.when(prev.isNull() | (prev <= time - s.width_ms), 1).otherwise(0)

    def closes(s: Distinct) -> Column:
        following = F.col(f"_next_{s.member}")
        return F.when(following.isNull() | (following >= time + s.width_ms), -1).otherwise(0)

    widths = sorted({s.width_ms for s in stats})
    sums = [f"_n_{w}" for w in widths] + [f"_d_{i}" for i, _ in enumerate(flagged)]

    # The arrival event of a row has the width 0, its expiry events have theirs and no column but what the sweep reads.
    arrival = F.col("_width") == 0
    at = time + F.col("_width")
    kept = {*keys, seq, *(s.member for s in concentrations)}
    fields = [at.alias("_at"), arrival.cast("int").alias("_kind"), (arrival & F.col("_emit")).alias("_emit"), "_chunk"]
    fields += [F.col(c) if c in kept else F.when(arrival, F.col(c)).alias(c) for c in columns if c != ts]
    for w, name in zip(widths, sums):
        fields.append(F.when(arrival, 1).when(F.col("_width") == w, -1).otherwise(0).alias(name))
    for i, s in enumerate(flagged):
        fields.append(F.when(arrival, opens(s)).when(F.col("_width") == s.width_ms, closes(s)).otherwise(0).alias(f"_d_{i}"))
    for i, s in enumerate(concentrations):
        fields.append(F.when(arrival, 1).when(F.col("_width") == s.width_ms, -1).otherwise(0).alias(f"_c_{i}"))
    events = halo.select("*", F.explode(F.array(*(F.lit(w).cast("long") for w in (0, *widths)))).alias("_width"))
    events = events.filter(arrival | (at < (F.col("_chunk") + 1) * F.lit(span))).select(*fields)

    # Concentration: the running count per member gives the change of the sum of squares and of n ln n.
    running = []
    for i, s in enumerate(concentrations):
        per_member = (
            Window.partitionBy(*by, s.member)
            .orderBy("_at", "_kind", seq)
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        after = F.col(f"_after_{i}")
        before = after - F.col(f"_c_{i}")
        events = events.withColumn(f"_after_{i}", F.sum(f"_c_{i}").over(per_member))
        events = events.withColumns(
            {
                f"_sq_{i}": after * after - before * before,
                f"_xl_{i}": _x_ln_x(after) - _x_ln_x(before),
                f"_u_{i}": F.when((before == 0) & (after > 0), 1).when((before > 0) & (after == 0), -1).otherwise(0),
            }
        )
        running += [f"_sq_{i}", f"_xl_{i}", f"_u_{i}"]

    sweep = (
        Window.partitionBy(*by)
        .orderBy("_at", "_kind", seq)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    swept = events.withColumns({f"_s{n}": F.sum(n).over(sweep) for n in sums + running}).filter("_emit")

    out = [F.col("_at").alias(c) if c == ts else F.col(c) for c in columns]
    position = {(s.member, s.width_ms): i for i, s in enumerate(concentrations)}
    for s in stats:
        if isinstance(s, Count):
            out.append(F.col(f"_s_n_{s.width_ms}").cast("long").alias(s.name))
        elif isinstance(s, Distinct):
            i = position.get((s.member, s.width_ms))
            source = f"_s_u_{i}" if i is not None else f"_s_d_{flagged.index(s)}"
            out.append(F.col(source).cast("long").alias(s.name))
        else:
            i = position[(s.member, s.width_ms)]
            n = F.col(f"_s_n_{s.width_ms}").cast("double")
            single = F.col(f"_s_u_{i}") <= 1
            out.append((F.col(f"_s_sq_{i}") / (n * n)).alias(s.hhi))
            out.append(
                F.when(single, F.lit(0.0)).otherwise(F.ln(n) - F.col(f"_s_xl_{i}") / n).alias(s.entropy)
            )
    return swept.select(*out)


def sliding_distinct(df: DataFrame, keys: list[str], member: str, width_ms: int, name: str = "n_distinct", **kw):
    return add_window_stats(df, keys, [Distinct(name, member, width_ms)], **kw)


def sliding_concentration(
    df: DataFrame, keys: list[str], member: str, width_ms: int, hhi: str = "hhi", entropy: str = "entropy", **kw
):
    return add_window_stats(df, keys, [Concentration(hhi, entropy, member, width_ms)], **kw)


def max_sliding_distinct_per_key(df: DataFrame, keys: list[str], member: str, width_ms: int, **kw) -> DataFrame:
    """Peak sliding distinct count of each key."""
    return sliding_distinct(df, keys, member, width_ms, "n", **kw).groupBy(*keys).agg(F.max("n").alias("peak"))
