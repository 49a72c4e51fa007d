"""Running aggregates that stay parallel inside one key.

A plain ``Window.partitionBy(key)`` puts a whole key on one task. That is the plan used while no key is
large. Keys with more than ``hot_rows`` rows are cut into time chunks: every chunk is reduced to one row,
the short table of chunk rows is scanned per key, and the carried value is joined back and combined with a
window local to ``(key, chunk)``. The two passes read the input from the shared scratch folder, so a chain
of running aggregates costs one extra write per link and never recomputes its lineage.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.joins import join_groups
from riskloom.session import materialize

HOT_ROWS = 10_000_000
AUTO = "auto"

_COMBINE = {"sum": F.sum, "max": F.max, "min": F.min}


#: Buckets of keys that are counted first, by hash.
HOT_BUCKETS = 1 << 16


def find_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> DataFrame | None:
    """The keys with more than ``hot_rows`` rows, or None.

    At most ``rows / hot_rows`` keys qualify, which bounds what reaches the driver and the broadcast. Rows are
    always counted, with a map-side combine; null is a key like any other.
    """
    return hot_keys(df, [keys], hot_rows)[tuple(keys)]


def hot_keys(df: DataFrame, key_sets: list[list[str]], hot_rows: int = HOT_ROWS) -> dict:
    """``find_hot`` for several key sets, in one pass over ``df``. Count them on the base table and pass the result as
    ``hot``, so that a long chain of running aggregates is not evaluated just to count its rows.

    Buckets of keys are counted first, a number each; keys themselves are counted only where a bucket has enough rows."""
    bucket = lambda keys: F.pmod(F.xxhash64(*keys), F.lit(HOT_BUCKETS)).cast("int")
    marks = F.array(*(F.struct(F.lit(i).alias("_set"), bucket(keys).alias("_bucket")) for i, keys in enumerate(key_sets)))
    counts = df.select(F.explode(marks).alias("_k")).groupBy("_k").agg(F.count(F.lit(1)).alias("_rows"))
    full = counts.filter(F.col("_rows") > hot_rows).select("_k.*").collect()
    hot = {}
    for i, keys in enumerate(key_sets):
        buckets = [r["_bucket"] for r in full if r["_set"] == i]
        found = []
        if buckets:
            rows = df if len(buckets) > HOT_BUCKETS // 64 else df.filter(bucket(keys).isin(buckets))
            found = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).filter(F.col("_rows") > hot_rows).select(*keys).collect()
        hot[tuple(keys)] = df.sparkSession.createDataFrame(found, df.select(*keys).schema) if found else None
    return hot


def _resolve(df: DataFrame, keys: list[str], hot, hot_rows: int) -> DataFrame | None:
    if not isinstance(hot, dict):
        return find_hot(df, keys, hot_rows)
    if tuple(keys) in hot:
        return hot[tuple(keys)]
    if any(found is None and set(known) <= set(keys) for known, found in hot.items()):
        return None  # a part of a key that is not hot is not hot either
    return find_hot(df, keys, hot_rows)


def counted_once(df: DataFrame, keys: list[str], options: dict) -> dict:
    """Options for a chain of calls on ``keys``: the hot keys are looked up on ``df`` unless already given."""
    if isinstance(options.get("hot", AUTO), dict):
        return options
    return {**options, "hot": hot_keys(df, [keys], options.get("hot_rows", HOT_ROWS))}


def split_hot(df: DataFrame, keys: list[str], hot: DataFrame, ts: str, chunk_ms: int) -> DataFrame:
    """Adds ``_hot`` and ``_chunk``; ``_chunk`` is 0 unless the key is hot."""
    marked = join_groups(df, F.broadcast(hot.withColumn("_is_hot", F.lit(True))), keys, "left")
    is_hot = F.coalesce(F.col("_is_hot"), F.lit(False))
    return marked.select(
        *df.columns,
        is_hot.alias("_hot"),
        F.when(is_hot, F.expr(f"`{ts}` div {int(chunk_ms)}")).otherwise(F.lit(0).cast("long")).alias("_chunk"),
    )


def _merge(op: str, carried: Column, local: Column) -> Column:
    if op == "sum":
        return F.coalesce(carried, F.lit(0)) + F.coalesce(local, F.lit(0))
    return F.greatest(carried, local) if op == "max" else F.least(carried, local)


def _upto(window, measure: tuple):
    return window.rowsBetween(Window.unboundedPreceding, -1 if len(measure) > 2 else Window.currentRow)


def running(
    df: DataFrame,
    keys: list[str],
    measures: dict[str, tuple],
    ts: str = "ingest_ms",
    seq: str = "seq",
    chunk_ms: int = K.HOUR_MS,
    hot_rows: int = HOT_ROWS,
    hot=AUTO,
) -> DataFrame:
    """Running aggregates per key in ``(ts, seq)`` order.

    ``measures`` maps an output name to ``(op, column)`` or ``(op, column, "before")``; ``op`` is sum, max
    or min. ``before`` excludes the current row. ``hot`` may pass a result of ``hot_keys``.
    """
    inputs = {f"_v_{name}": spec[1] for name, spec in measures.items()}
    hot = _resolve(df, keys, hot, hot_rows)
    if hot is None:
        here = Window.partitionBy(*keys).orderBy(ts, seq)
        windows = {n: _COMBINE[m[0]](f"_v_{n}").over(_upto(here, m)) for n, m in measures.items()}
        filled = {n: F.coalesce(w, F.lit(0)) if measures[n][0] == "sum" else w for n, w in windows.items()}
        return df.withColumns(inputs).select(*df.columns, *[w.alias(n) for n, w in filled.items()])

    base = split_hot(materialize(df.withColumns(inputs), "running"), keys, hot, ts, chunk_ms)
    by = [*keys, "_chunk"]
    totals = base.filter("_hot").groupBy(*by).agg(
        *[_COMBINE[m[0]](f"_v_{n}").alias(f"_t_{n}") for n, m in measures.items()]
    )
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(*by, *[_COMBINE[m[0]](f"_t_{n}").over(earlier).alias(f"_o_{n}") for n, m in measures.items()])
    here = Window.partitionBy(*by).orderBy(ts, seq)
    local = base.withColumns({f"_l_{n}": _COMBINE[m[0]](f"_v_{n}").over(_upto(here, m)) for n, m in measures.items()})
    joined = join_groups(local, carried, by, "left")
    return joined.select(
        *df.columns, *[_merge(m[0], F.col(f"_o_{n}"), F.col(f"_l_{n}")).alias(n) for n, m in measures.items()]
    )


def reflected_walk(
    df: DataFrame,
    keys: list[str],
    increment: Column,
    name: str,
    ts: str = "ingest_ms",
    seq: str = "seq",
    chunk_ms: int = K.HOUR_MS,
    hot_rows: int = HOT_ROWS,
    hot=AUTO,
) -> DataFrame:
    """``S = max(0, S + increment)`` per key, through ``S_t = C_t - min(0, min C)`` on running sums ``C``."""
    hot = _resolve(df, keys, hot, hot_rows)
    stepped = df.withColumn("_inc", increment.cast("double"))
    zero = F.lit(0.0)
    if hot is None:
        here = Window.partitionBy(*keys).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        walked = stepped.withColumn("_c", F.sum("_inc").over(here)).withColumn("_low", F.min("_c").over(here))
        return walked.select(*df.columns, (F.col("_c") - F.least(zero, F.col("_low"))).alias(name))

    by = [*keys, "_chunk"]
    here = Window.partitionBy(*by).orderBy(ts, seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = (
        split_hot(materialize(stepped, "walk"), keys, hot, ts, chunk_ms)
        .withColumn("_c", F.sum("_inc").over(here))
        .withColumn("_low", F.min("_c").over(here))
    )
    totals = local.filter("_hot").groupBy(*by).agg(F.sum("_inc").alias("_total"), F.min("_c").alias("_dip"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.withColumn("_base", F.coalesce(F.sum("_total").over(earlier), zero))
    carried = carried.select(
        *by, "_base", F.coalesce(F.min(F.col("_base") + F.col("_dip")).over(earlier), zero).alias("_floor")
    )
    base = F.coalesce(F.col("_base"), zero)
    floor = F.least(zero, F.coalesce(F.col("_floor"), zero), base + F.col("_low"))
    return join_groups(local, carried, by, "left").select(*df.columns, (base + F.col("_c") - floor).alias(name))


def first_occurrence(
    df: DataFrame, keys: list[str], name: str, ts: str = "ingest_ms", seq: str = "seq"
) -> DataFrame:
    """Flags the earliest row of every distinct ``keys`` value, nulls included.

    The minimum is combined before the shuffle and joined back, so a value of very many rows stays on many tasks.
    """
    first = df.groupBy(*keys).agg(F.min(F.struct(ts, seq)).alias("_first"))
    first = first.select(*keys, F.col(f"_first.{ts}").alias(ts), F.col(f"_first.{seq}").alias(seq), F.lit(True).alias(name))
    on = list(dict.fromkeys([*keys, ts, seq]))
    return join_groups(df, first, on, "left").select(*df.columns, F.coalesce(F.col(name), F.lit(False)).alias(name))


def first_of_member(df: DataFrame, keys: list[str], member: str, name: str, hot: DataFrame | None, ts: str = "ingest_ms", seq: str = "seq", dealt: bool = False) -> DataFrame:
    """``first_occurrence`` of every ``member`` of a key, for a running aggregate over ``keys`` that follows.

    Where no key is hot (``hot`` is None) the rows are dealt once, by ``keys``, for both, or not at all if they are
    ``dealt`` like that already; else as in ``first_occurrence``.
    """
    if hot is not None:
        return first_occurrence(df, [*keys, member], name, ts, seq)
    rows = df if dealt else df.repartition(*[F.col(k) for k in keys])
    return rows.withColumn(name, F.rank().over(Window.partitionBy(*keys, member).orderBy(ts, seq)) == 1)


def running_distinct(
    df: DataFrame, keys: list[str], member: str, name: str, before: bool = False, ts: str = "ingest_ms",
    seq: str = "seq", hot_rows: int = HOT_ROWS, **kw,
) -> DataFrame:
    """Distinct ``member`` values seen so far per key."""
    found = _resolve(df, keys, kw.pop("hot", AUTO), hot_rows)
    flagged = first_of_member(df, keys, member, "_is_new", found, ts, seq)
    spec = ("sum", F.col("_is_new").cast("long")) + (("before",) if before else ())
    return running(flagged, keys, {name: spec}, ts, seq, hot_rows=hot_rows, hot={tuple(keys): found}, **kw).select(*df.columns, name)
