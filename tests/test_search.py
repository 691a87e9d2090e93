import random

import numpy as np
from pyspark.sql import functions as F

from brindle.operators import spatial_join, vector_search


def test_ivf_reads_only_probed_lists(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=8) + 6 * (i % 4)]) for i in range(400)] + [(400, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    queries = table.where("vec_id % 20 = 0")
    truth = vector_search.exact_knn(table, queries, 5, "l2")
    for code, least in (("flat", 0.95), ("sq8", 0.9), ("pq", 0.9), ("bits", 0.7)):
        index = vector_search.Ivf(table, 8, code, path=f"{tmp_path}/{code}")
        found = index.search(queries, 5, probes=4, keep=8)
        assert vector_search.recall(found, truth).first()["recall"] >= least
        assert found.groupBy("query").count().where("count <> 5").isEmpty()
    plan = index.rows.where(F.col("list").isin([1, 2]))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan


def test_ivf_over_nothing(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<double>")
    one = spark.createDataFrame([(1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert vector_search.Ivf(none, 4).search(one, 3).isEmpty() and vector_search.Ivf(one, 4).search(none, 3).isEmpty()


def test_boxes_of_all_sizes(spark):
    r = random.Random(3)
    points = [(i, r.uniform(-500, 500), r.uniform(-500, 500)) for i in range(200)] + [(200, None, 1.0), (201, 50.0, 50.0)]
    boxes = []
    for i in range(60):
        x, y, w, h = r.uniform(-500, 400), r.uniform(-500, 400), 10 ** r.uniform(-1, 3), 10 ** r.uniform(-1, 3)
        boxes.append((i, x, x + w, y, y + h))
    boxes += [(60, -1e300, 1e300, -1e300, 1e300), (61, float("-inf"), float("inf"), 0.0, 100.0), (62, 5.0, 1.0, 0.0, 9.0), (63, None, 1.0, 0.0, 9.0), (64, 50.0, 50.0, 50.0, 50.0), (65, 0.0, float("nan"), 0.0, 90.0)]
    found = spatial_join.points_in_boxes(spark.createDataFrame(points, "p int, x double, y double"), spark.createDataFrame(boxes, "b int, x0 double, x1 double, y0 double, y1 double"), 10.0)
    held = {(p, b) for p, x, y in points for b, x0, x1, y0, y1 in boxes if None not in (x, x0) and x0 <= x <= x1 and y0 <= y <= y1}
    rows = [(t["p"], t["b"]) for t in found.select("p", "b").collect()]
    assert len(rows) == len(set(rows)) and set(rows) == held
