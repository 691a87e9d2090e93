import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from brindle.operators import vector_search


def peak(scans, batch):
    tracemalloc.start()
    for scan in scans:
        for _ in scan(iter([batch])):
            pass
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return most / 1e6


@pytest.fixture
def scans(monkeypatch):
    """The functions that searches give to Python workers."""
    kept, given = DataFrame.mapInArrow, []

    def keep(self, f, schema, *rest):
        if f.__name__ == "scan":
            given.append(f)
        return kept(self, f, schema, *rest)

    monkeypatch.setattr(DataFrame, "mapInArrow", keep)
    return given


def vectors(n, seed):
    return np.random.default_rng(seed).normal(size=(n, 8))


def table(spark, x):
    return spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<double>")


BATCH = 10_000


def test_exact_search_holds_few_distances_at_once(spark, scans):
    x = vectors(BATCH, 1)
    q = table(spark, vectors(2_000, 2))
    vector_search.exact_knn(q, q, 5, "l2")
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(BATCH)), pa.array(list(x))], names=["id", "v"])
    assert len(scans) == 1 and peak(scans, batch) < 100  # all distances at once are 160 MB, and there were several such


@pytest.mark.parametrize("code", ["flat", "sq8", "pq", "bits"])
def test_inverted_files_hold_few_distances_at_once(spark, scans, code):
    x = vectors(BATCH, 1)
    q = table(spark, vectors(2_000, 2))
    vector_search.Ivf(q, 4, code).search(q, 10, probes=4, keep=12)
    batch = pa.RecordBatch.from_arrays([pa.array(np.zeros(BATCH, np.int32)), pa.array(np.arange(BATCH)), pa.array(list(x))], names=["list", "id", "v"])
    assert len(scans) == 1 and peak(scans, batch) < 150


def test_equal_vectors_are_equally_far(spark):
    """Far from the origin the square of a sum loses the digits that tell near vectors apart."""
    x = [[1e6 + i % 7 * 1e-3, 1e6] for i in range(70)]
    t = table(spark, np.array(x))
    found = vector_search.exact_knn(t, t.where("vec_id = 0"), 15, "l2").orderBy("rank")
    assert [r["id"] for r in found.collect()] == sorted(range(70), key=lambda i: (abs(x[i][0] - x[0][0]), i))[:15]
