"""Equi-joins with a condition whose keys have many rows on both sides, dealt out by blocks of pairs."""

from __future__ import annotations

from functools import reduce
from math import ceil, isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Pairs that a block compares, and rows of one side that a block holds, on average at most.
PAIRS, ROWS = 1 << 24, 1 << 20


def block_join(left: DataFrame, right: DataFrame, on: list[str], condition: Column, pairs: int = PAIRS, rows: int = ROWS) -> DataFrame:
    """Pairs of rows that agree on the columns ``on`` and satisfy ``condition``; NULL keys join nothing.

    The rows of a key are counted on both sides. Where they make more than ``pairs`` pairs, the key is cut into
    blocks: rows of one side are dealt to parts by their hash (equal rows stay together) and go with every part
    of the other. There are as many tasks as blocks, so a task's work is bounded while their number grows with
    the pairs. Sides that make few pairs in all are left to the planner.
    """
    keyed = reduce(lambda a, b: a & b, (F.col(c).isNotNull() for c in on))
    left, right = left.where(keyed), right.where(keyed)
    counted = left.groupBy(*on).agg(F.count("*").alias("_n")).join(right.groupBy(*on).agg(F.count("*").alias("_m")), on)
    heavy = (F.col("_n") * F.col("_m") > pairs) | (F.col("_n") > rows) | (F.col("_m") > rows)
    # One row for each heavy key, which has 2 * sqrt(pairs) rows at least, and one for all others.
    census = counted.groupBy(F.when(heavy, F.struct(*on)).alias("key")).agg(F.sum(F.col("_n").cast("double") * F.col("_m")).alias("pairs"), F.sum("_n").alias("n"), F.sum("_m").alias("m")).collect()
    if sum(r["pairs"] for r in census) <= pairs and all(r["key"] is None for r in census):
        return left.join(right, on).where(condition)
    side, cuts, tasks = isqrt(pairs), [], 0
    for r in census:
        if r["key"] is None:
            tasks += ceil(r["pairs"] / pairs)
            continue
        a = max(ceil(r["pairs"] / pairs) if r["m"] < side else ceil(r["n"] / side), ceil(r["n"] / rows))
        b = max(ceil(r["pairs"] / pairs) if r["n"] < side else ceil(r["m"] / side), ceil(r["m"] / rows))
        cuts.append((*r["key"], a, b))
        tasks += a * b
    schema = T.StructType([*(left.schema[c] for c in on), T.StructField("_a", T.IntegerType()), T.StructField("_b", T.IntegerType())])
    table = left.sparkSession.createDataFrame(cuts, schema)
    tasks = max(tasks, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def dealt(df: DataFrame, own: str, other: str, part: str, copy: str) -> DataFrame:
        parts = lambda c: F.coalesce(F.col(c), F.lit(1))
        df = df.withColumn("_h", F.xxhash64(*df.columns)).join(F.broadcast(table), on, "left")
        df = df.withColumn(part, F.pmod("_h", parts(own)).cast("int")).withColumn(copy, F.explode(F.sequence(F.lit(0), parts(other) - 1)))
        return df.drop("_h", "_a", "_b").repartition(tasks, *on, "_i", "_j")

    x, y = dealt(left, "_a", "_b", "_i", "_j"), dealt(right, "_b", "_a", "_j", "_i")
    if sum(r["n"] for r in census) < sum(r["m"] for r in census):
        x = x.hint("shuffle_hash")
    else:
        y = y.hint("shuffle_hash")
    return x.join(y, [*on, "_i", "_j"]).where(condition).drop("_i", "_j")
