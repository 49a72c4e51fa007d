"""Maps of states composed on the JVM against one row at a time."""

import itertools
import random

import brute
import pytest
from pyspark.sql import functions as F

from riskloom.operators.automaton import apply_map, compose, pack, state_before


def test_maps_compose(spark):
    maps = list(itertools.product(range(3), repeat=3))
    packed = lambda m: pack([F.lit(x) for x in m])
    some = random.Random(1).sample(list(itertools.product(maps, maps)), 40)
    row = spark.range(1).select(*(apply_map(compose(packed(a), packed(b), 3), F.lit(s)).alias(f"{i}_{s}") for i, (a, b) in enumerate(some) for s in range(3))).first()
    assert [row[f"{i}_{s}"] for i in range(len(some)) for s in range(3)] == [b[a[s]] for a, b in some for s in range(3)]


@pytest.mark.parametrize("plan", [{}, {"block": 3}, {"block": 4, "hot_rows": 5, "chunk_ms": 3_000}])
def test_state_before(spark, plan):
    rows = brute.stream(21, 300)
    for r in rows:
        r["ip"] = None if r["ip"].endswith("1") else r["ip"]
        r["m"] = [random.Random(r["seq"] * 7 + s).randrange(6) if s != r["seq"] % 6 else s for s in range(6)]
    schema = "attempt_uid string, seq long, ingest_ms long, ip string, m array<int>"
    df = spark.createDataFrame([(r["attempt_uid"], r["seq"], r["ingest_ms"], r["ip"], r["m"]) for r in rows], schema).repartition(3)
    got = state_before(df, ["ip"], pack([F.col("m")[s] for s in range(6)]), 6, "was", start=2, **plan)
    assert got.columns == [*df.columns, "was"] and "Python" not in got._jdf.queryExecution().executedPlan().toString()
    state, want = {}, {}
    for r in sorted(rows, key=lambda r: (r["ingest_ms"], r["seq"])):
        want[r["attempt_uid"]] = state.get(r["ip"], 2)
        state[r["ip"]] = r["m"][want[r["attempt_uid"]]]
    assert {r["attempt_uid"]: r["was"] for r in got.collect()} == want
