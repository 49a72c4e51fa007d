"""Bounded samples for fitting."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct labels that a classifier may have.
MOST_LABELS = 1_000


def held_out(doc_id: str) -> Column:
    """True for the fifth of the documents that nothing is learned from, by crc32 of the id as text; true for null ids."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def labelled_sample(rows: DataFrame, label: str, key: str, per_label: int) -> tuple[DataFrame, dict]:
    """About ``per_label`` rows of every label, at most twice as many in all, picked by a hash of ``key``; and all labels' counts.

    Rows with a null label are left out. The counts cover all rows; they run as one job here.
    """
    rows = rows.filter(F.col(label).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().limit(MOST_LABELS + 1).collect()}
    if len(counts) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not counts:
        return rows.limit(0), counts
    share = F.create_map(*chain.from_iterable((F.lit(x), F.lit(per_label / n)) for x, n in counts.items()))
    draw = F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return rows.filter(draw < share[F.col(label)]).limit(2 * per_label * len(counts)), counts
