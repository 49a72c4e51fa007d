"""Ordered passes over sorted batches: rows stream through Arrow batches, so no group is held in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def run_bounds(pdf: pd.DataFrame, by: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple]]:
    """Starts, ends and keys of the runs of equal ``by`` values in a sorted batch; null equals null."""
    n = len(pdf)
    change = np.zeros(n, dtype=bool)
    change[0] = True
    for k in by:
        col, null = pdf[k].to_numpy(), pdf[k].isna().to_numpy()
        change[1:] |= (null[1:] != null[:-1]) | (~null[1:] & (col[1:] != col[:-1]))
    starts = np.flatnonzero(change)
    keys = list(zip(*[[None if pd.isna(v) else v for v in pdf[k].to_numpy()[starts]] for k in by]))
    return starts, np.append(starts[1:], n), keys


def sorted_runs(batches: Iterator[pd.DataFrame], by: list[str]):
    """Cuts sorted batches into runs of equal ``by`` values: yields ``(key, frame, opens)``.

    A run that spans batches arrives in parts; ``opens`` marks its first part.
    """
    previous = None
    for pdf in batches:
        if len(pdf) == 0:
            continue
        for i, j, key in zip(*run_bounds(pdf, by)):
            yield key, pdf.iloc[i:j], key != previous
            previous = key


def ordered_fold(
    df: DataFrame, keys: list[str], order: list[str], start: Callable, step: Callable, schema: T.StructType
) -> DataFrame:
    """One ordered pass per key for rules without a finite state; ``df`` must already be reduced to a row
    count bounded by time (buckets), not by traffic.

    ``step(key, part, state)`` returns ``(output frame, state)``; ``start()`` gives the state of a new key.
    """

    def run(batches):
        state = None
        for key, part, opens in sorted_runs(batches, keys):
            if opens:
                state = start()
            out, state = step(key, part, state)
            yield out

    return (
        df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
    )
