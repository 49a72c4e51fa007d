"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.rows import stored


def _fingerprint(links: DataFrame) -> tuple:
    """Number of links, which are distinct, and two digests that do not depend on their order."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """``id``, ``component`` (the smallest id reached) for every end of a link of ``a``, ``b``.

    Large-star and small-star steps in turn: each is a minimum by key, combined before the shuffle, and a join, so a node
    with very many links is no bottleneck. Every step is written to the shared folder. A step at least halves paths to
    the smallest id, so the rounds needed grow with the logarithm of the longest path.
    """
    links = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = _fingerprint(links)
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("k", "m").alias("m"))
        large = stored(both.join(least, both["a"] == least["k"]).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")), "large")
        least = large.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "k")
        small = large.join(least, large["a"] == least["k"]).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").filter("a <> b").distinct()
        links, before = stored(small, "small"), seen
        seen = _fingerprint(links)
        if seen == before:
            break
    else:
        raise RuntimeError("components did not settle")
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return ends.unionByName(links.select(F.col("b").alias("id"), F.col("b").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
