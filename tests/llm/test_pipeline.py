import corpus_pipeline
from brindle.llm.queries import ORACLE_SQL, QUERIES


def test_stages_in_order(spark, sf):
    assert len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, ids = docs.columns, {r["doc_id"] for r in docs.collect()}
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        left = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert left <= ids
        if i < 4:
            assert docs.columns == columns
        if i in (3, 4):
            assert left == ids
        ids = left
    assert len(ids) > 100


def test_queries_are_registered():
    import __spark_entry__ as e

    assert [n for n in e.queries() if n.startswith("op")] == [f for f in QUERIES]
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 11))
    assert "pipeline" in e.queries() and set(ORACLE_SQL) == {"op4_warc", "op8_jaccard"}


def test_workers_keep_no_memory_between_stages():
    import subprocess
    import sys

    code = """
import re
import numpy as np, pyarrow as pa
from brindle.llm import _util
held = lambda: sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
def rows(batches):
    for b in batches:
        words = [str(i) * 4 for i in range(1_500_000)]
        yield pa.array(words)
list(map(len, _util.releasing(rows)([0])))
before = held()
list(map(len, _util.releasing(rows)([0, 0])))
print(held() - before < 30, held() < 150)
"""
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0]).stdout.split() == ["True", "True"]
    from brindle.llm import _util

    assert list(_util.releasing(lambda batches: (b + 1 for b in batches))([1, 2])) == [2, 3]
