"""Cleans and encodes a corpus in stages; each stage reads what the one before it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm.byte_bpe import encode_texts
from riskloom.llm.decontaminate import decontaminate
from riskloom.llm.exact_dedup import exact_duplicates
from riskloom.llm.language_id import UNKNOWN, fit, identify
from riskloom.llm.near_dedup import PERCENT, near_duplicates
from riskloom.llm.rows import row_keys, scratch

KEY = "__key"


def _wrapped(docs: DataFrame) -> DataFrame:
    """The whole row beside id and text, so that no column of it can clash with a result's."""
    return docs.select("doc_id", "text", F.struct(*docs.columns).alias("row"))


def with_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language: null texts and texts without a letter.

    Where no document has a label to learn from, all others stay.
    """
    model = fit(docs)
    if model is None:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    marked = identify(_wrapped(docs), model, carry=["row"])
    return marked.filter(F.col("lang_pred") != UNKNOWN).select("row.*")


def _only(keyed: DataFrame, stays: DataFrame) -> DataFrame:
    """The rows whose key is in ``stays``."""
    return keyed.join(stays, KEY, "left_semi").drop(KEY)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts, also of repeated rows and of rows without an id."""
    keyed = row_keys(docs, "doc_id", KEY)
    return _only(keyed, exact_duplicates(keyed.select(KEY, "text"), doc_id=KEY, carry=[KEY]).filter("kept").select(KEY))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near duplicates: the one with the smallest id, null last.

    Rows that share an id, or have none, are documents of their own. The threshold is the operator's, 85 of 100.
    """
    keyed = row_keys(docs, "doc_id", KEY)
    return _only(keyed, near_duplicates(keyed.select(KEY, "text"), doc_id=KEY, percent=PERCENT).filter("kept").select(KEY))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold benchmark passages."""
    marked = decontaminate(_wrapped(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carry=["row"])
    return marked.filter("not contaminated").select("row.*")


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of what is left, as digests, with the decoded text's."""
    return encode_texts(docs, carry=["doc_id"])


STAGES = [("language", with_language), ("exact_dedup", without_copies), ("near_dedup", without_near_copies), ("decontamination", without_benchmark), ("encoding", encoded)]

#: Neither the language model nor the merge vocabulary can be stated in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies all stages to the documents table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
