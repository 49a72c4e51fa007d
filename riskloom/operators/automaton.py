"""Finite-state rules as column functions: every row is a map of states, and maps compose.

A rule over at most seven states is, for one row, a map from the state before to the state after. Such a map is packed
into one integer, three bits a state. Rows of a key are put in order and packed in blocks of ``BLOCK`` rows; a block's map is
the composition of its rows' maps. Blocks start from the state that the maps before them lead to, and every row then finds
the state before it inside its block. Keys with very many rows are cut into time chunks first, which have maps too, so no
task needs a whole key and no row leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom import constants as K
from riskloom.functions.joins import join_groups
from riskloom.operators.prefix import AUTO, HOT_ROWS, _resolve, split_hot
from riskloom.session import materialize

#: Bits of a state in a packed map, and rows of a block.
BITS, BLOCK = 3, 1024


def pack(after: list[Column]) -> Column:
    """One map from the states after 0, 1, 2, ..."""
    total = F.lit(0)
    for state, value in enumerate(after):
        total = total + F.call_function("shiftleft", value.cast("int"), F.lit(BITS * state))
    return total


def apply_map(packed: Column, state: Column) -> Column:
    return F.call_function("shiftright", packed, state * BITS).bitwiseAND((1 << BITS) - 1)


def compose(first: Column, then: Column, states: int) -> Column:
    """The map that goes through ``first`` and then through ``then``."""
    return pack([apply_map(then, apply_map(first, F.lit(s))) for s in range(states)])


def _identity(states: int) -> int:
    return sum(s << (BITS * s) for s in range(states))


def _composed(maps: Column, states: int) -> Column:
    return F.aggregate(maps, F.lit(_identity(states)), lambda done, m: compose(done, m, states))


def _led_to(maps: Column, start: int) -> Column:
    """The state that a list of maps leads to; null and empty lists lead nowhere."""
    return F.coalesce(F.aggregate(maps, F.lit(start), lambda state, m: apply_map(m, state)), F.lit(start))


def state_before(
    df: DataFrame,
    keys: list[str],
    row_map: Column,
    states: int,
    name: str,
    start: int = 0,
    ts: str = "ingest_ms",
    seq: str = "seq",
    chunk_ms: int = K.HOUR_MS,
    hot_rows: int = HOT_ROWS,
    hot=AUTO,
    block: int = BLOCK,
) -> DataFrame:
    """Adds ``name``, the state of the key before each row, in ``(ts, seq)`` order from ``start``.

    ``row_map`` is the packed map of a row (see ``pack``). Null is a key like any other. Keys above ``hot_rows`` rows are cut
    into chunks of ``chunk_ms``; the rows are then read from the shared scratch folder.
    """
    hot = _resolve(df, keys, hot, hot_rows)
    marked = df.withColumn("_chunk", F.lit(0).cast("long")) if hot is None else split_hot(materialize(df, "automaton"), keys, hot, ts, chunk_ms)
    by = [*keys, "_chunk"]
    row = F.struct(row_map.alias("_m"), *(F.col(c) for c in df.columns))
    ordered = marked.withColumn("_row", row).withColumn("_nr", F.row_number().over(Window.partitionBy(*by).orderBy(ts, seq)))
    packed = ordered.groupBy(*by, F.floor((F.col("_nr") - 1) / block).alias("_block")).agg(F.array_sort(F.collect_list(F.struct("_nr", "_row")), lambda a, b: a["_nr"] - b["_nr"]).alias("_rows"))
    packed = packed.withColumn("_map", _composed(F.transform("_rows", lambda r: r["_row"]["_m"]), states))
    before = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    packed = packed.withColumn("_earlier", F.collect_list("_map").over(before))
    if hot is None:
        packed = packed.withColumn("_start", _led_to(F.col("_earlier"), start))
    else:
        whole = F.array_sort(F.collect_list(F.struct("_block", "_map")))
        chunks = packed.groupBy(*by).agg(_composed(F.transform(whole, lambda b: b["_map"]), states).alias("_whole"))
        past = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
        starts = chunks.select(*by, _led_to(F.collect_list("_whole").over(past), start).alias("_from"))
        packed = join_groups(packed, starts, by)
        packed = packed.withColumn("_start", F.aggregate("_earlier", F.col("_from"), lambda state, m: apply_map(m, state)))
    walk = F.aggregate(
        "_rows",
        F.struct(F.col("_start").alias("at"), F.array().cast("array<int>").alias("was")),
        lambda done, r: F.struct(apply_map(r["_row"]["_m"], done["at"]).alias("at"), F.concat(done["was"], F.array(done["at"])).alias("was")),
        lambda done: done["was"],
    )
    each = packed.select(F.explode(F.arrays_zip(F.col("_rows").alias("r"), walk.alias("was"))).alias("_e"))
    return each.select(*(F.col("_e.r._row")[c].alias(c) for c in df.columns), F.col("_e.was").alias(name))
