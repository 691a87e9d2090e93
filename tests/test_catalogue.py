import pytest
from compare import connection, same

from brindle import plans

QUERIES, ORACLES = plans.queries(), plans.oracles()


@pytest.fixture(scope="module")
def con(sf):
    return connection(sf)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_duckdb(spark, sf, con, name):
    assert same(QUERIES[name](spark, sf), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.startswith("vec_ivf_")))
def test_recall(spark, sf, name):
    assert QUERIES[name](spark, sf).first()["recall"] >= 0.9


@pytest.mark.parametrize("name", ["ft_hybrid_rrf", "ft_hybrid_weighted", "ft_disjunction_max"])
def test_fusion_gives_distinct_documents(spark, sf, name):
    rows = QUERIES[name](spark, sf).collect()
    assert len({r["doc"] for r in rows}) == len(rows)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
