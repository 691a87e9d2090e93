import pytest
from pyspark.sql import functions as F

from brindle.operators import fulltext, mutation
from brindle.session import Session


@pytest.fixture()
def session(spark):
    s = Session(spark)
    s.register("t", spark.createDataFrame([(1, "a"), (2, None)], "id int, v string"))
    return s


def test_dml_and_versions(session):
    assert session.execute("INSERT INTO t (id, v) VALUES (3, 'c')") == 1
    assert session.execute("UPDATE t SET v = 'z' WHERE id = 2") == 1
    assert session.execute("DELETE FROM t WHERE id = 1") == 1
    assert sorted(tuple(r) for r in session.query("SELECT * FROM t").collect()) == [(2, "z"), (3, "c")]
    session.rollback("t")
    assert session.query("SELECT count(*) FROM t").first()[0] == 3


def test_parameters_show_and_udf(session):
    assert session.query("SELECT v FROM t WHERE id = ?", 1).first()[0] == "a"
    assert session.query("SHOW TABLES").count() == 1
    assert session.query("DESCRIBE t").count() == 2
    session.udf("twice", "x * 2", "x INT", "INT")
    assert session.query("SELECT twice(4)").first()[0] == 8


def test_check_option(session):
    session.checks["t"] = "id > 0"
    with pytest.raises(ValueError):
        session.execute("INSERT INTO t VALUES (-1, 'x')")


def test_generated_columns_need_an_order(spark):
    with pytest.raises(ValueError):
        mutation.generated(spark.range(1), {"a": "b + 1", "b": "a + 1"})


def test_fulltext_pieces(spark):
    df = spark.createDataFrame([(1, "The quick brown fox jumped"), (2, None)], "doc_id int, text string")
    row = df.select(fulltext.tokens(F.col("text")).alias("t"), fulltext.tokens(F.col("text"), True).alias("e"), fulltext.ngrams(F.col("text")).alias("n")).first()
    assert row["t"] == ["the", "quick", "brown", "fox", "jumped"] and row["e"][-1] == "jump" and "qui" in row["n"]
    assert [r["doc"] for r in fulltext.phrase(df, ["quick", "fox"], 1).collect()] == [1]
    assert fulltext.parse_query('+a -b "c d" e~1 f:g')["must"] == ["a"]
    assert df.select(fulltext.highlight(F.col("text"), ["fox"]).alias("h")).first()["h"] == "The quick brown <em>fox</em> jumped"


def test_sql_calls_the_library(session):
    row = session.query("""SELECT json_extract('{"k": [1, 2]}', '$.k[1]') AS j, st_x('POINT(3 4)') AS x, pmt(0.05, 10, 1000) AS p, gcd(12, 18) AS g, vec_l2_distance(array(0.0, 3.0), array(4.0, 0.0)) AS d,
      jaro_winkler('martha', 'marhta') AS w, stddev(v) AS s, concat('gcd(1, ', 'x)') AS text FROM (SELECT * FROM VALUES (1), (3) AS t(v)) GROUP BY 1 = 1""").first()
    assert (row["j"], row["x"], row["g"], row["d"], row["s"], row["text"]) == ("2", 3.0, 6, 5.0, 1.0, "gcd(1, x)")
    assert round(row["p"], 2) == -129.5 and round(row["w"], 4) == 0.9611
    assert session.query("SELECT iif(id > 1, upper('b'), 'c') FROM t ORDER BY id").columns == ["iif(id > 1, upper('b'), 'c')"]
    assert [r[0] for r in session.query("SELECT id FROM t WHERE gcd(id, 2) = 2 ORDER BY starts_with(v, 'a'), id").collect()] == [2]


def test_most_scalars_have_sql(session):
    from brindle import sqltext
    from brindle.functions.registry import BY_NAME, SCALAR

    parser, lost = session.spark._jsparkSession.sessionState().sqlParser(), []
    for name, build in SCALAR.items():
        mark = BY_NAME.set(True)
        try:
            for n in range(1, 6):
                try:
                    column = build(*[F.expr(f"a{i}") for i in range(n)])
                except (TypeError, ValueError):
                    continue
                try:
                    parser.parseExpression(sqltext.column_sql(column))
                except Exception:
                    lost.append(name)
                break
        finally:
            BY_NAME.reset(mark)
    assert lost == []


def test_session_functions_scopes_and_search(session):
    from brindle.functions import registry

    session.define("thrice", lambda x: F.expr("0") + x * 3 if not isinstance(x, int) else F.lit(3 * x))
    assert session.query("SELECT thrice(id) AS x FROM t ORDER BY id").first()[0] == 3
    registry.alias("my_gcd", "gcd")
    try:
        assert session.query("SELECT my_gcd(4, 6)").first()[0] == 2 and "my_gcd" in registry.search("gcd") and registry.describe("gcd")["category"] == "numeric"
    finally:
        del registry.SCALAR["my_gcd"]


def test_variables_hints_collations_and_bare_conditions(session):
    session.execute("SET @low = 1 + 1")
    assert [r[0] for r in session.query("SELECT id FROM t WHERE id >= @low").collect()] == [2]
    assert session.query("SELECT @@autocommit, @none, '@low'").first()[:] == (1, None, "@low")
    joined = session.query("SELECT /*+ HASH_JOIN(b), LEADING(a, b), STREAM_AGG */ count(*) FROM t a STRAIGHT_JOIN t b ON a.id = b.id")
    assert joined.first()[0] == 2 and "ShuffledHashJoin" in joined._jdf.queryExecution().executedPlan().toString()
    assert session.query("SELECT id FROM t WHERE v COLLATE utf8mb4_general_ci LIKE 'A%'").first()[0] == 1
    session.register("u", session.spark.createDataFrame([(0, True, "x"), (3, True, ""), (4, False, "y"), (5, True, "z"), (None, True, "z")], "n int, b boolean, s string"))
    assert [r[0] for r in session.query("SELECT n FROM u WHERE n AND (b AND u.s) AND n BETWEEN 1 AND 9").collect()] == [5]


def test_changes_with_order_limit_and_quotes(session):
    session.register("w", session.spark.createDataFrame([(1, "a"), (1, "a"), (1, "a"), (2, "b"), (3, None)], "id int, v string"))
    assert session.execute("UPDATE w SET v = 'x, y = where 1' ORDER BY id LIMIT 2") == 2
    assert sorted(r["v"] or "" for r in session.query("SELECT * FROM w").collect()) == ["", "a", "b", "x, y = where 1", "x, y = where 1"]
    assert session.execute("DELETE FROM w WHERE id < 9 ORDER BY id DESC LIMIT 1") == 1
    assert session.query("SELECT max(id) FROM w").first()[0] == 2


def test_views_check_what_is_written_through_them(session):
    session.execute("CREATE VIEW low AS SELECT * FROM t WHERE id < 10")
    session.execute("CREATE VIEW mid AS SELECT * FROM low WHERE id > 0 WITH CASCADED CHECK OPTION")
    session.execute("CREATE OR REPLACE VIEW own AS SELECT * FROM low WHERE id > 0 WITH LOCAL CHECK OPTION")
    with pytest.raises(ValueError):
        session.execute("INSERT INTO mid VALUES (11, 'x')")
    assert session.execute("INSERT INTO own VALUES (11, 'x')") == 1
    with pytest.raises(ValueError):
        session.execute("UPDATE own SET id = 0 - id")
    assert session.execute("UPDATE mid SET v = 'q'") == 2 and session.execute("DELETE FROM mid WHERE id = 1") == 1
    assert sorted(r[0] for r in session.query("SELECT id FROM t").collect()) == [2, 11]
    assert session.query("SELECT count(*) FROM mid").first()[0] == 1
