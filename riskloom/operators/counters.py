"""Expiring counters and idempotent acceptance."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as K
from riskloom.functions.joins import join_groups
from riskloom.operators.fold import sorted_runs
from riskloom.operators.prefix import AUTO, HOT_ROWS, _resolve, counted_once, running, running_distinct, split_hot
from riskloom.session import materialize


def _anchor_step(keys: list[str], ts: str, ttl_ms: int):
    """Batch iterator over rows sorted by key and time: the anchor each row counts from.

    Groups shorter than the TTL are resolved with array operations; only longer ones hop from anchor to
    anchor by binary search. The open group is carried over to the next batch. Groups start from the
    live anchor in ``_in_ms``, ``_in_uid`` and ``_in_rows`` (the rows it has counted), unless ``_in_ms`` is null.
    """

    def step(batches):
        carry_key, carry = None, None
        for pdf in batches:
            n = len(pdf)
            if n == 0:
                continue
            times, counts = pdf[ts].to_numpy(), pdf["_n"].to_numpy()
            change = np.zeros(n, dtype=bool)
            change[0] = True
            for k in keys:
                col, null = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
                change[1:] |= (null[1:] != null[:-1]) | (~null[1:] & (col[1:] != col[:-1]))
            starts = np.flatnonzero(change)
            ends = np.append(starts[1:], n)
            before_all = np.cumsum(counts) - counts
            index = np.repeat(starts, ends - starts)
            uids = pdf["_uid"].to_numpy()
            anchor_ms, anchor_uid = times[index], uids[index].copy()
            before = before_all - before_all[index]
            long_groups = list(np.flatnonzero(times[ends - 1] - times[starts] >= ttl_ms))
            resumed = carry_key is not None and _key_at(pdf, keys, 0) == carry_key
            given = {}
            firsts = pdf.iloc[starts]
            for g in np.flatnonzero(firsts["_in_ms"].notna().to_numpy()):
                given[int(g)] = tuple(firsts[c].iloc[g] for c in ("_in_ms", "_in_uid", "_in_rows"))
            if resumed:
                given[0] = carry
            for g in sorted({*long_groups, *given}):
                i, end = int(starts[g]), int(ends[g])
                held = given.get(g)
                while i < end:
                    if held is not None:
                        start_ms, start_uid, offset = int(held[0]), held[1], int(held[2])
                        held = None
                    else:
                        start_ms, start_uid, offset = times[i], uids[i], 0
                    j = i + int(np.searchsorted(times[i:end], start_ms + ttl_ms, side="left"))
                    anchor_ms[i:j], anchor_uid[i:j] = start_ms, start_uid
                    before[i:j] = offset + before_all[i:j] - (before_all[i] if j > i else 0)
                    i = j
            carry_key = _key_at(pdf, keys, n - 1)
            carry = (anchor_ms[n - 1], anchor_uid[n - 1], int(before[n - 1] + counts[n - 1]))
            out = pdf[[*keys, ts]].copy()
            out["anchor_ms"], out["anchor_uid"], out["_before"] = anchor_ms, anchor_uid, before
            yield out

    return step


def _key_at(pdf: pd.DataFrame, keys: list[str], row: int) -> tuple:
    return tuple(None if pd.isna(value := pdf[k].iloc[row]) else value for k in keys)


def _differs(column: pa.Array) -> np.ndarray:
    """Whether each value but the first is another than the one before; null is a value like any other."""
    was, now = column.slice(0, len(column) - 1), column.slice(1)
    empty = (pc.is_null(was, nan_is_null=True), pc.is_null(now, nan_is_null=True))
    apart = pc.fill_null(pc.not_equal(was, now), False).to_numpy(zero_copy_only=False)
    none, then = (e.to_numpy(zero_copy_only=False) for e in empty)
    return (none != then) | (~none & ~then & apart)


def _anchor_rows(keys: list[str], ts: str, ttl_ms: int, uid: str):
    """Batch iterator over rows sorted by key, time and order: each row with its anchor and its place after it.

    Rows stay in Arrow buffers. ``uid`` names the first row of each moment and is not passed on. Groups shorter than the TTL are
    resolved with array operations, longer ones hop from anchor to anchor by binary search; only the open group's anchor is carried
    over to the next batch. A key that begins with a row without a time has that row as its only anchor.
    """

    def step(batches):
        carried = None
        for batch in batches:
            n = batch.num_rows
            if n == 0:
                continue
            own = [batch.column(batch.schema.get_field_index(k)) for k in keys]
            at, names = (batch.column(batch.schema.get_field_index(c)) for c in (ts, uid))
            untimed, times = at.is_null().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy()
            opens = np.ones(n, dtype=bool)
            opens[1:] = np.logical_or.reduce([_differs(k) for k in own])
            starts = np.flatnonzero(opens)
            ends = np.append(starts[1:], n)
            anchor = np.repeat(starts, ends - starts)
            ms, none = times[anchor], untimed[anchor]
            ordinal = np.arange(n) - anchor + 1
            long_groups = np.flatnonzero((times[ends - 1] - times[starts] >= ttl_ms) & ~untimed[starts]).tolist()
            first = tuple(k[0].as_py() for k in own)
            held = carried[1:] if carried is not None and carried[0] == first else None
            for g in sorted({*long_groups, *([0] if held is not None else [])}):
                i, end = int(starts[g]), int(ends[g])
                if g == 0 and held is not None:
                    j = end if held[0] is None else i + int(np.searchsorted(times[i:end], held[0] + ttl_ms, side="left"))
                    anchor[i:j], ms[i:j], none[i:j] = n, held[0] or 0, held[0] is None
                    ordinal[i:j] = held[2] + 1 + np.arange(j - i)
                    i = j
                while i < end:
                    j = i + int(np.searchsorted(times[i:end], times[i] + ttl_ms, side="left"))
                    anchor[i:j], ms[i:j], none[i:j], ordinal[i:j] = i, times[i], False, 1 + np.arange(j - i)
                    i = j
            if held is not None:
                names = pa.concat_arrays([names, pa.array([held[1]], names.type)])
            who = names.take(pa.array(anchor))
            carried = (tuple(k[n - 1].as_py() for k in own), None if none[-1] else int(ms[-1]), who[n - 1].as_py(), int(ordinal[-1]))
            kept = [(c, batch.column(i)) for i, c in enumerate(batch.schema.names) if c != uid]
            made = [("anchor_ms", pa.array(ms, pa.int64(), mask=none)), ("anchor_uid", who), ("ordinal", pa.array(ordinal, pa.int64()))]
            yield pa.RecordBatch.from_arrays([v for _, v in (*kept, *made)], names=[c for c, _ in (*kept, *made)])

    return step


def _jumps(by: list[str], ts: str, ttl_ms: int):
    """Chunks of moments, one to a group, as maps from an expiry to the last anchor of the chunk, in pieces.

    A moment points to the first one ``ttl_ms`` later; the pointers are doubled until they leave the chunk. An expiry
    carried into the chunk anchors at the first moment at or after it, ``m``. Neighbouring moments with one last anchor are a
    ``flat`` piece; a run of adjoining milliseconds whose last anchors adjoin too is a sloped one, ``last + (m - from)``.
    """

    def step(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        times = np.sort(pdf[ts].to_numpy())
        n = len(times)
        at = np.arange(n)
        ahead = np.searchsorted(times, times + ttl_ms, side="left")
        jump = np.where(ahead < n, ahead, at)
        while not np.array_equal(doubled := jump[jump], jump):
            jump = doubled
        last = times[jump]
        apart, rise = np.diff(times), np.diff(last)
        kind = np.where(rise == 0, 0, np.where((apart == 1) & (rise == 1), 1, 2))
        opens = np.ones(n, dtype=bool)
        opens[1:] = kind == 2
        opens[2:] |= (kind[1:] != kind[:-1]) & (kind[:-1] != 2)
        starts = np.flatnonzero(opens)
        ends = np.append(starts[1:], n) - 1
        flat = np.ones(len(starts), dtype=bool)
        longer = ends > starts
        flat[longer] = kind[starts[longer]] == 0
        pieces = {c: [k] * len(starts) for c, k in zip(by, key)}
        return pd.DataFrame({**pieces, "_from": times[starts], "_to": times[ends], "_last": last[starts], "_flat": flat})

    return step


def _entries(keys: list[str], ttl_ms: int):
    """Batch iterator over pieces sorted by key, chunk and place: the last anchor before each chunk, null if there is none.

    Only one batch of pieces and the anchor are held, however many chunks a key has."""

    def run(batches):
        anchor, done, chunk = None, False, None
        for key, part, opens in sorted_runs(batches, keys):
            if opens:
                anchor, chunk = None, None
            numbers = part["_chunk"].to_numpy()
            cuts = np.flatnonzero(np.diff(numbers)) + 1
            found = []
            for i, j in zip([0, *cuts], [*cuts, len(numbers)]):
                if numbers[i] != chunk:
                    chunk, done = numbers[i], False
                    found.append([*key, chunk, anchor])
                if done:
                    continue
                begin, to = part["_from"].to_numpy()[i:j], part["_to"].to_numpy()[i:j]
                at = 0 if anchor is None else int(np.searchsorted(to, anchor + ttl_ms, side="left"))
                if at < j - i:
                    entry = begin[at] if anchor is None else max(int(begin[at]), anchor + ttl_ms)
                    last = int(part["_last"].iloc[i + at])
                    anchor, done = last if part["_flat"].iloc[i + at] else last + int(entry - begin[at]), True
            if found:
                out = pd.DataFrame(found, columns=[*keys, "_chunk", "_in_ms"])
                yield out.astype({"_in_ms": "Int64"})

    return run


def _entered(moments: DataFrame, keys: list[str], ttl_ms: int, ts: str) -> DataFrame:
    """Moments of hot keys, cut into chunks, with the live anchor each chunk starts from and the rows it has counted."""
    by = [*keys, "_chunk"]
    schema = moments.schema
    hot = moments.filter("_hot")
    pieces_schema = T.StructType(
        [
            *[schema[c] for c in by], T.StructField("_from", T.LongType()), T.StructField("_to", T.LongType()),
            T.StructField("_last", T.LongType()), T.StructField("_flat", T.BooleanType()),
        ]
    )
    pieces = hot.select(*by, ts).groupBy(*by).applyInPandas(_jumps(by, ts, ttl_ms), pieces_schema)
    entry_schema = T.StructType([*[schema[c] for c in by], T.StructField("_in_ms", T.LongType())])
    entries = pieces.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*by, "_from").mapInPandas(_entries(keys, ttl_ms), entry_schema)

    totals = hot.groupBy(*by).agg(F.sum("_n").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select(*by, F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_base"))
    entries = join_groups(bases, entries, by)
    # The anchor's own chunk says how many rows came before it there.
    anchors = entries.filter("_in_ms is not null").select(*keys, F.col("_in_ms").alias(ts)).distinct().withColumn("_is", F.lit(True))
    held = join_groups(hot, anchors, [*keys, ts], "left")
    local = Window.partitionBy(*by).orderBy(ts).rowsBetween(Window.unboundedPreceding, -1)
    held = held.withColumn("_earlier", F.coalesce(F.sum("_n").over(local), F.lit(0))).filter("_is")
    held = join_groups(held, bases, by).select(*keys, F.col(ts).alias("_in_ms"), F.col("_uid").alias("_in_uid"), (F.col("_base") + F.col("_earlier")).alias("_at"))
    entries = join_groups(entries, held, [*keys, "_in_ms"], "left")
    entries = entries.select(*by, "_in_ms", "_in_uid", (F.col("_base") - F.col("_at")).alias("_in_rows"))
    return join_groups(moments, entries, by, "left")


def anchored_ttl_counter(
    df: DataFrame, keys: list[str], ttl_ms: int, ts: str = "ingest_ms", seq: str = "seq", uid: str = "attempt_uid",
    chunk_ms: int = K.HOUR_MS, hot_rows: int = HOT_ROWS, hot=AUTO,
) -> DataFrame:
    """Counter that expires ``ttl_ms`` after its first row; adds ``anchor_ms``, ``anchor_uid`` and ``ordinal``.

    Null is a key like any other. Where no key is hot the rows are dealt and sorted by key once and counted on their way; all columns of
    ``df`` travel, so pass those that are needed. Else rows of one key and millisecond are combined before the shuffle, so copies of
    one key never travel as rows; the ordered pass sees one row per distinct millisecond. Keys above ``hot_rows`` rows are cut into
    chunks of ``chunk_ms``, at most one moment a millisecond: a chunk becomes a map from the expiry carried in to the anchor carried
    out, the maps are chained per key, and all chunks are then counted in parallel from the anchors they start with.
    """
    found = _resolve(df, keys, hot, hot_rows)
    if found is None:
        same = Window.partitionBy(*keys, ts).orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        named = F.first(F.when(F.col(seq).isNotNull(), F.struct(uid)), ignorenulls=True).over(same)[uid]
        dealt = df.repartition(*[F.col(k) for k in keys]).withColumn("_uid", named).sortWithinPartitions(*keys, ts, seq)
        added = [T.StructField("anchor_ms", T.LongType()), T.StructField("anchor_uid", df.schema[uid].dataType), T.StructField("ordinal", T.LongType())]
        return dealt.mapInArrow(_anchor_rows(keys, ts, ttl_ms, "_uid"), T.StructType([*df.schema.fields, *added]))
    moments = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"), F.min_by(uid, seq).alias("_uid"))
    fields = [df.schema[k] for k in keys] + [
        T.StructField("_chunk", T.LongType()),
        df.schema[ts],
        T.StructField("anchor_ms", T.LongType()),
        T.StructField("anchor_uid", df.schema[uid].dataType),
        T.StructField("_before", T.LongType()),
    ]
    by = [*keys, "_chunk"]
    moments = _entered(split_hot(materialize(moments, "moments"), keys, found, ts, chunk_ms), keys, ttl_ms, ts)
    anchored = (
        moments.repartition(*[F.col(k) for k in by])
        .sortWithinPartitions(*by, ts)
        .mapInPandas(_anchor_step(by, ts, ttl_ms), T.StructType(fields))
    )
    peers = Window.partitionBy(*keys, ts).orderBy(seq)
    joined = join_groups(df, anchored.drop("_chunk"), [*keys, ts])
    return joined.select(
        *df.columns, "anchor_ms", "anchor_uid", (F.col("_before") + F.row_number().over(peers)).cast("long").alias("ordinal")
    )


def refreshed_ttl_counter(
    df: DataFrame, keys: list[str], ttl_ms: int, name: str = "ordinal", ts: str = "ingest_ms", seq: str = "seq", **kw
) -> DataFrame:
    """Counter whose TTL restarts at every row: a gap of ``ttl_ms`` starts again at 1."""
    kw = counted_once(df, keys, kw)
    seen = running(
        df, keys, {"_prev": ("max", F.col(ts), "before"), "_n": ("sum", F.lit(1))}, ts, seq, **kw
    )
    fresh = F.col("_prev").isNull() | (F.col(ts) - F.col("_prev") >= ttl_ms)
    marked = running(seen, keys, {"_at": ("max", F.when(fresh, F.col("_n")))}, ts, seq, **kw)
    return marked.select(*df.columns, (F.col("_n") - F.col("_at") + 1).cast("long").alias(name))


def card_seen(df: DataFrame, ttl_ms: int = K.CARD_TTL_MS, mode: str = "anchored", name: str = "card_seen_24h", **kw):
    """Attempts with the card in its live counter, by first hit (``anchored``) or by latest hit (``refresh``)."""
    keys = ["merchant_id", "card_hash"]
    if mode == "refresh":
        return refreshed_ttl_counter(df, keys, ttl_ms, name, **kw)
    counted = anchored_ttl_counter(df, keys, ttl_ms, **kw)
    return counted.select(*df.columns, F.col("ordinal").alias(name))


def idempotent_accept(
    df: DataFrame, digest: str = "idem_digest", ttl_ms: int = K.IDEM_TTL_MS, namespace: str | None = None, **kw
) -> DataFrame:
    """First attempt of a digest within its TTL is accepted; a replay carries the accepted attempt's uid."""
    keys = ["merchant_id", *([namespace] if namespace else []), digest]
    counted = anchored_ttl_counter(df, keys, ttl_ms, **kw)
    return counted.select(
        *df.columns, (F.col("ordinal") == 1).alias("accepted"), F.col("anchor_uid").alias("stored_attempt_uid")
    )


def stored_decision_reply(accepted: DataFrame, decisions: DataFrame, uid: str = "attempt_uid") -> DataFrame:
    """Replays answered with the decision stored for the accepted attempt."""
    replays = accepted.filter(~F.col("accepted"))
    winner = decisions.select(F.col(uid).alias("stored_attempt_uid"), F.col("decision"))
    return replays.join(winner, "stored_attempt_uid", "left")


def event_id_reuse(df: DataFrame, payload: str = "payload_digest", name: str = "event_id_reuse_count", **kw) -> DataFrame:
    """Distinct payloads seen so far under one merchant event id; never expires."""
    return running_distinct(df, ["merchant_id", "event_id"], payload, name, **kw)


def shed_counter(df: DataFrame, ttl_ms: int = K.SHED_TTL_MS, name: str = "shed_count", **kw) -> DataFrame:
    counted = anchored_ttl_counter(df, ["merchant_id", "ip"], ttl_ms, **kw)
    return counted.select(*df.columns, F.col("ordinal").alias(name))


def shed_rung(df: DataFrame, threshold: int = K.RULES[0][1], ttl_ms: int = K.SHED_TTL_MS, **kw) -> DataFrame:
    """Over-budget attempts see the rate rule only; every other feature is 0."""
    counted = shed_counter(df, ttl_ms, **kw)
    return counted.withColumns(
        {
            "attempts_per_ip_60s": F.col("shed_count").cast("double"),
            "decision": F.when(F.col("shed_count") >= threshold, "throttle").otherwise("allow"),
            "degraded_reason": F.lit("shed"),
        }
    )
