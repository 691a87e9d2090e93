import random

from pyspark.sql import functions as F

from brindle.operators import spatial_join
from brindle.operators.block_join import block_join


def test_blocks_hold_every_pair_once_and_bound_a_task(spark):
    r = random.Random(5)
    left = [(i, r.choice([1, 1, 1, 2, 3, None]), r.uniform(0, 9)) for i in range(600)] + [(600 + i, 4, 5.0) for i in range(3)]
    right = [(i, r.choice([1, 1, 1, 2, 5, None]), r.uniform(0, 9)) for i in range(900)] + [(900 + i, 4, float(i)) for i in range(700)]
    a, b = spark.createDataFrame(left, "x int, k int, v double"), spark.createDataFrame(right, "y int, k int, w double")
    held = sorted((x, y) for x, k, v in left for y, l, w in right if k is not None and k == l and v > w)
    joined = block_join(a, b, ["k"], F.col("v") > F.col("w"), pairs=10_000, rows=200)
    assert sorted((t["x"], t["y"]) for t in joined.select("x", "y").collect()) == held
    sizes = [t["count"] for t in joined.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 10 and max(sizes) < len(held) / 5
    assert sorted((t["x"], t["y"]) for t in block_join(a, b, ["k"], F.col("v") > F.col("w")).select("x", "y").collect()) == held
    assert block_join(a, b.where("k = 9"), ["k"], F.lit(True)).isEmpty()
    # A lone key with many rows on one side only is cut by rows.
    assert block_join(a.where("k = 4"), b, ["k"], F.lit(True), rows=100).count() == 2_100


def test_flat_boxes_meet_few_points(spark):
    """Boxes much wider than high: a cell is as flat as they are, so few points are compared with each."""
    r = random.Random(6)
    points = [(i, r.uniform(0, 1000), float(r.randrange(1000))) for i in range(2_000)]
    boxes = [(i, x, x + 100, y, y + 2) for i, x, y in ((i, r.uniform(0, 900), float(r.randrange(1000))) for i in range(200))]
    p, b = spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(boxes, "b int, x0 double, x1 double, y0 double, y1 double")
    seen = {}

    def counted(left, right, on, condition):
        seen["pairs"] = left.join(right, on).count()
        return block_join(left, right, on, condition, pairs=500)

    spatial_join.block_join, kept = counted, spatial_join.block_join
    try:
        found = sorted((t["p"], t["b"]) for t in spatial_join.points_in_boxes(p, b, 50.0).select("p", "b").collect())
    finally:
        spatial_join.block_join = kept
    assert found == sorted((i, j) for i, x, y in points for j, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
    assert seen["pairs"] < 4_000  # 200 boxes of 400 * 6.25 of a million, where cells of 100 x 100 held 200 * 2 * 20


def test_many_shapes_of_boxes(spark):
    """More pairs of levels than points are looked up at."""
    r = random.Random(7)
    points = [(i, r.uniform(-50, 50), r.uniform(-50, 50)) for i in range(60)]
    boxes = [(i, x, x + 10 ** r.uniform(-6, 6), y, y + 10 ** r.uniform(-6, 6)) for i, x, y in ((i, r.uniform(-60, 50), r.uniform(-60, 50)) for i in range(300))]
    boxes += [(300 + i, points[i][1], points[i][1], points[i][2], points[i][2]) for i in range(5)]
    p, b = spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(boxes, "b int, x0 double, x1 double, y0 double, y1 double")
    found = sorted((t["p"], t["b"]) for t in spatial_join.points_in_boxes(p, b, 1.0).select("p", "b").collect())
    assert found == sorted((i, j) for i, x, y in points for j, x0, x1, y0, y1 in boxes if x0 <= x <= x1 and y0 <= y <= y1)
