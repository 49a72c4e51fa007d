import sys
from pathlib import Path

import pytest
from pyspark.sql import types as T

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_cases import HARD  # noqa: E402

#: As in the folder above: where both files are loaded, this one is found as ``conftest``.
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def hard(spark):
    """Documents with hard cases, in columns whose names clash with those of results."""
    clash = ["score", "kept", "keep_id", "component_id", "n_tokens", "n_words", "items", "row", "id", "digest", "lang_pred", "contaminated", "held_out"]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), *(T.StructField(c, T.StringType()) for c in clash)])
    return spark.createDataFrame([(*row, *(c for c in clash)) for row in HARD], schema)


@pytest.fixture(scope="session")
def none(hard):
    return hard.limit(0)

