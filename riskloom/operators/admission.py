"""Per-merchant admission and the fail-open availability alert."""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom import constants as K
from riskloom.functions.joins import join_groups
from riskloom.operators.fold import run_bounds, sorted_runs
from riskloom.operators.prefix import AUTO, HOT_ROWS, _resolve, split_hot
from riskloom.operators.sweep import Count, add_window_stats
from riskloom.session import materialize

#: Runs that are searched first for the next change of form; doubled until one is found.
LOOKAHEAD = 64


class Bucket:
    """A bucket of ``full`` units, ``scale`` of them a token, over runs: a refill of ``gains`` units, then ``counts`` attempts.

    Levels have two closed forms, each a running minimum. Until a run finds too few tokens, the deficit is a walk
    reflected at 0. Until the bucket is full again, no refill is in vain: of ``n`` attempts so far, with ``c`` tokens earned so
    far, ``n + min(0, min(c - n))`` have been admitted. The forms take turns, and two turns use up a whole bucket of attempts.
    """

    def __init__(self, scale: int, full: int):
        self.scale, self.full = scale, full

    def admitted(self, level: int, gains: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, int]:
        """The attempts admitted in each run, and the level after the last one."""
        out, at, form, other = counts.copy(), 0, self._lossless, self._thirsty
        while at < len(counts):
            ahead = LOOKAHEAD
            while at < len(counts):
                part = slice(at, at + ahead)
                level, done, ended = form(level, gains[part], counts[part], out[part])
                at, ahead = at + done, 2 * ahead
                if ended:
                    break
            form, other = other, form
        return out, level

    def _lossless(self, level: int, gains: np.ndarray, counts: np.ndarray, out: np.ndarray) -> tuple[int, int, bool]:
        """Goes up to the first run that loses attempts, and through it."""
        taken = counts * self.scale
        walk = self.full - level + np.cumsum(taken - gains) - taken
        deficit = walk - np.minimum(0, np.minimum.accumulate(walk))
        lost = np.flatnonzero(counts > (self.full - deficit) // self.scale)
        if len(lost) == 0:
            return int(self.full - deficit[-1] - taken[-1]), len(counts), False
        at = int(lost[0])
        out[at], left = divmod(int(self.full - deficit[at]), self.scale)
        return left, at + 1, True

    def _thirsty(self, level: int, gains: np.ndarray, counts: np.ndarray, out: np.ndarray) -> tuple[int, int, bool]:
        """Goes up to the first run that finds the bucket full, and not through it."""
        earned, total, found = self._unbounded(level, gains, counts)
        full = np.flatnonzero(found >= self.full)
        end = int(full[0]) if len(full) else len(counts)
        out[:end] = np.diff(total, prepend=0)[:end]
        return (int(earned[end - 1] - self.scale * total[end - 1]) if end else level), end, len(full) > 0

    def _unbounded(self, level: int, gains: np.ndarray, counts: np.ndarray):
        """Without an upper bound: units earned and attempts admitted up to each run, and the level each run finds."""
        earned, made = level + np.cumsum(gains), np.cumsum(counts)
        total = made + np.minimum(0, np.minimum.accumulate(earned // self.scale - made))
        return earned, total, earned - self.scale * np.append(0, total[:-1])

    def chunk_map(self, gains: np.ndarray, counts: np.ndarray) -> tuple[int, int, int, list[int], list[bool]]:
        """What the runs do to any level, as ``(brim, after, net, ends, filled)``; see ``through``.

        A level of at least ``brim`` is full at the run where refill less attempts peaks, whatever came before, so all of them end
        as ``after``. A lower level can only overflow after it has lost attempts. Then it has come down to its rest of a
        token, and so has every level with the same rest: ``ends`` tells how the rests end, ``filled`` whether they overflow.
        """
        made = np.cumsum(counts)
        net = np.cumsum(gains) - self.scale * (made - counts)
        brim = max(0, self.full - int(net.max()))
        after = self.admitted(self.full, gains, counts)[1]
        rests = range(min(self.scale, brim))
        ends = [self.admitted(rest, gains, counts)[1] for rest in rests]
        filled = [bool(np.any(self._unbounded(rest, gains, counts)[2] >= self.full)) for rest in rests]
        return brim, after, int(net[-1] - self.scale * counts[-1]), ends, filled

    def through(self, level: int, brim: int, after: int, net: int, ends: list[int], filled: list[bool]) -> int:
        if level >= brim:
            return after
        rest = level % self.scale
        return int(ends[rest]) if filled[rest] else max(level + net, int(ends[rest]))


def _gains(times: np.ndarray, since: int, rate: int) -> np.ndarray:
    return np.diff(times, prepend=since) * rate


def _admit(bucket: Bucket, keys: list[str], ts: str, rate: int, chunk_ms: int):
    """Batch iterator over runs sorted by key and time: adds ``_admit``, the attempts admitted in each run.

    Keys of at most a bucket of attempts in the batch need no walk. The level of the open key is carried to the next batch.
    """
    burst = bucket.full // bucket.scale

    def run(batches):
        previous, level, last = None, None, None
        for pdf in batches:
            if len(pdf) == 0:
                continue
            starts, ends, names = run_bounds(pdf, keys)
            times, counts = pdf[ts].to_numpy(), pdf["_n"].to_numpy()
            made = counts.copy()
            totals = np.add.reduceat(counts, starts)
            entry, cut = pdf["_level"].to_numpy(), pdf["_hot"].to_numpy()
            resumed = names[0] == previous
            walked = np.flatnonzero((totals > burst) | cut[starts])
            for g in sorted({*walked.tolist(), len(starts) - 1, *([0] if resumed else [])}):
                i, j = int(starts[g]), int(ends[g])
                if not (g == 0 and resumed):
                    level = int(entry[i])
                    last = int(pdf["_chunk"].iloc[i]) * chunk_ms if cut[i] else int(times[i])
                made[i:j], level = bucket.admitted(level, _gains(times[i:j], last, rate), counts[i:j])
                last = int(times[j - 1])
            previous = names[-1]
            out = pdf[[*keys, ts]].copy()
            out["_admit"] = made
            yield out

    return run


def _levels(df: DataFrame, keys: list[str], bucket: Bucket, ts: str, rate: int, chunk_ms: int) -> DataFrame:
    """The level of each hot key at the start of each of its chunks."""
    parts = {"_brim": T.LongType(), "_after": T.LongType(), "_net": T.LongType(), "_ends": T.ArrayType(T.LongType()), "_filled": T.ArrayType(T.BooleanType())}
    by = [*keys, "_chunk"]

    def reduce(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, begin = pdf.sort_values(ts), int(key[-1]) * chunk_ms
        gains = _gains(np.append(pdf[ts].to_numpy(), begin + chunk_ms), begin, rate)
        return pd.DataFrame([[*key, *bucket.chunk_map(gains, np.append(pdf["_n"].to_numpy(), 0))]], columns=[*by, *parts])

    def chain(batches):
        level, ended = bucket.full, None
        for key, part, opens in sorted_runs(batches, keys):
            if opens:
                level, ended = bucket.full, None
            found = []
            for chunk, *piece in part[["_chunk", *parts]].itertuples(index=False):
                if ended is not None:
                    level = min(bucket.full, level + (chunk - ended - 1) * chunk_ms * rate)
                found.append([*key, chunk, level])
                level, ended = bucket.through(level, *piece), chunk
            yield pd.DataFrame(found, columns=[*by, "_level"])

    fields = [df.schema[c] for c in by]
    maps = df.select(*by, ts, "_n").groupBy(*by).applyInPandas(reduce, T.StructType([*fields, *(T.StructField(p, kind) for p, kind in parts.items())]))
    chained = maps.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*by)
    return chained.mapInPandas(chain, T.StructType([*fields, T.StructField("_level", T.LongType())]))


def token_bucket(
    df: DataFrame, rate_per_s: int = K.ADMISSION["rate_per_s"], burst: int = K.ADMISSION["burst"],
    ts: str = "ingest_ms", seq: str = "seq", chunk_ms: int = K.HOUR_MS, hot_rows: int = HOT_ROWS, hot=AUTO,
) -> DataFrame:
    """Adds ``admitted``: a lazily refilled bucket per merchant, one token per attempt.

    Tokens are counted in units of ``1000 / gcd(rate, 1000)`` per token, so every level is an integer. Attempts of a merchant and
    millisecond are one run, admitted in ``seq`` order, combined before the shuffle. Merchants above ``hot_rows`` rows
    are cut into chunks of ``chunk_ms``; a chunk's map of levels has an entry for every rest of a token at most, the maps are
    chained, and all chunks are then walked in parallel. A null merchant is a merchant like any other.
    """
    keys = ["merchant_id"]
    scale = 1000 // gcd(int(rate_per_s), 1000)
    rate, bucket = int(rate_per_s) * scale // 1000, Bucket(scale, int(burst) * scale)
    found = _resolve(df, keys, hot, hot_rows)
    runs = df.groupBy(*keys, ts).agg(F.count(F.lit(1)).alias("_n"))
    full = F.lit(bucket.full).cast("long")
    if found is None:
        by, runs = keys, runs.select("*", F.lit(False).alias("_hot"), F.lit(0).cast("long").alias("_chunk"), full.alias("_level"))
    else:
        by = [*keys, "_chunk"]
        runs = split_hot(materialize(runs, "tokens"), keys, found, ts, chunk_ms)
        runs = join_groups(runs, _levels(runs.filter("_hot"), keys, bucket, ts, rate, chunk_ms), by, "left").withColumn("_level", F.coalesce("_level", full))
    schema = T.StructType([*(runs.schema[c] for c in by), df.schema[ts], T.StructField("_admit", T.LongType())])
    walked = runs.repartition(*[F.col(c) for c in by]).sortWithinPartitions(*by, ts).mapInPandas(_admit(bucket, by, ts, rate, chunk_ms), schema)
    place = F.row_number().over(Window.partitionBy(*keys, ts).orderBy(seq))
    joined = join_groups(df.withColumn("_place", place), walked.drop("_chunk"), [*keys, ts])
    return joined.select(*df.columns, (F.col("_place") <= F.col("_admit")).alias("admitted"))


def availability_alert(
    fail_opens: DataFrame, threshold: int = K.ADMISSION["alert_threshold"], window_ms: int = K.ADMISSION["alert_window_ms"],
    ts: str = "ingest_ms", seq: str = "seq",
) -> DataFrame:
    """Adds ``fail_opens``, ``alerting`` and ``alert_emitted`` (first alerting row of each clock window)."""
    counted = add_window_stats(fail_opens, ["merchant_id"], [Count("fail_opens", window_ms)], ts, seq)
    counted = counted.withColumns({"alerting": F.col("fail_opens") >= threshold, "_slot": F.expr(f"`{ts}` div {window_ms}")})
    first = (
        counted.filter("alerting").groupBy("merchant_id", "_slot").agg(F.min(F.struct(ts, seq)).alias("_first"))
    )
    joined = counted.join(first, ["merchant_id", "_slot"], "left")
    emitted = F.coalesce(F.struct(ts, seq) == F.col("_first"), F.lit(False))
    return joined.select(*fail_opens.columns, "fail_opens", "alerting", emitted.alias("alert_emitted"))
