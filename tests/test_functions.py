import math

import pytest

from brindle.functions import AGGREGATE, SCALAR, call
from brindle.functions import documents as J
from brindle.functions import numeric, spatial, text

CASES = [
    ("substring", ("hello", 0, 2), ""), ("substring", ("hello", -3, 2), "ll"), ("lpad", ("hi", 5, "ab"), "abahi"), ("chr", (233,), "é"), ("ascii", ("é",), 195),
    ("concat", ("a", None, "b"), "ab"), ("concat_ws", ("-", "a", None, "b"), "a--b"), ("trim", ("\t a 　",), "a"), ("hash", ("abc",), -1792535898324117685),
    ("hamming", ("karolin", "kathrin"), 3), ("jaccard", ("night", "nacht"), 1 / 7), ("damerau_levenshtein", ("ca", "abc"), 3), ("icu_compare", ("a", "B"), -1),
    ("set_bit", (8, 0, 1), 9), ("hex", ("abc",), "616263"), ("bin", (-5,), "-101"), ("round", (2.5,), 3.0), ("round", (-2.5,), -3.0), ("truncate", (-1.259, 2), -1.25),
    ("gcd", (48, 18), 6), ("lcm", (4, 6), 12), ("even", (3.1,), 4.0), ("mod", (7, 0), None), ("factorial", (5,), 120), ("ipmt", (0.05, 1, 10, 1000), -50.0),
    ("ppmt", (0.05, 1, 10, 1000), -79.50457496545658), ("ddb", (1000, 100, 5, 2), 240.0), ("nper", (0.05, -100, 800), 10.469848430762866), ("irr", ("[-100,60,60]",), 0.13066238629180754),
    ("rate", (10, -100, 800), 0.042774978035111336), ("bond_yield", (1050, 1000, 0.05, 5, 2), 0.038899377086389304), ("round_banker", (2.5, 0), 2.0),
    ("age", ("2024-03-15", "2023-01-10"), "1 years 2 months 5 days"), ("extract", ("dow", "2024-01-01"), 1), ("julian_day", ("2024-01-01",), 2460310.5),
    ("json_extract", ('{"a":[1,2,{"b":"x"}]}', "$.a[last].b"), '"x"'), ("json_insert", ('{"a":1}', "$.a", "2"), '{"a":1}'), ("json_contains", ("[1,2]", "2"), 1),
    ("json_search", ('{"a":"abc"}', "one", "a%"), '"$.a"'), ("json_array_insert", ("[1,2]", "$[1]", "9"), "[1,9,2]"), ("json_unquote", ('"a\\"b"',), 'a"b'), ("json_valid", ("{",), 0),
    ("st_area", ("POLYGON((0 0,10 0,10 10,0 10,0 0),(2 2,4 2,4 4,2 4,2 2))",), 96.0), ("st_distance", ("POINT(0 0)", "LINESTRING(3 4,10 4)"), 5.0),
    ("st_touches", ("POLYGON((0 0,1 0,1 1,0 1,0 0))", "POLYGON((1 0,2 0,2 1,1 1,1 0))"), True), ("st_isvalid", ("POLYGON((0 0,1 0,1 1,0 0))",), True),
    ("st_srid", ("SRID=4326;POINT(1 2)",), 4326), ("st_geometrytype", ("POINT EMPTY",), "Point"), ("st_isempty", ("POINT EMPTY",), True), ("typeof", (1,), "INTEGER"),
    ("hmac_sha256", ("data", "key"), "5031fe3d989c6d1537a013fa6e739da23463fdaec3b70137d828e36ace221bd0"), ("weekday", ("2025-06-15",), 6), ("timestampdiff", ("month", "2025-01-15", "2025-06-15"), 5),
    ("sha512", ("abc",), "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f"),
    ("column_type", (1,), "int"), ("database", (), "default"), ("gcd", (None, 6), None), ("gcd", (0, 0), 0), ("lcm", (-4, 6), 12),
]


def test_values(spark):
    row = spark.range(1).select(*[call(n, *a).alias(str(i)) for i, (n, a, _) in enumerate(CASES)]).first()
    for got, (name, args, want) in zip(row, CASES):
        assert got == pytest.approx(want) if isinstance(want, float) else got == want, (name, args, got)


def test_all_names_are_there():
    assert len(SCALAR) + len(AGGREGATE) >= 299


def test_random_values(spark):
    row = spark.range(1).select(call("random").alias("r"), call("rand").alias("s"), call("uuid_short").alias("u"), call("user").alias("w"), call("uuid").alias("v")).first()
    assert 0 <= row["r"] < 1 and 0 <= row["s"] < 1 and len(row["u"]) == 12 and row["w"] and len(row["v"]) == 36


def test_query_strings(spark):
    from brindle.operators import fulltext

    docs = spark.createDataFrame([(1, "red fox runs"), (2, "red dog"), (3, "a fox and a dog"), (4, None), (5, "")], "doc_id long, text string")
    found = lambda q: sorted(r["doc"] for r in fulltext.run_query(docs, q).collect())
    assert found("+fox -red") == [3] and found("fox dog") == [1, 2, 3] and found('"red fox"') == [1] and found("foxx~1") == [1, 3] and found("doc_id:2") == [2]
    assert fulltext.parse_query("a^2.5 b")["boosts"] == [("a", 2.5)]
    assert sorted(r["doc"] for r in fulltext.match_against(docs, "runs").collect()) == [1]


def test_month_end_runs_on(spark):
    assert str(spark.range(1).select(call("date_add", "2024-01-31", 1, by="month").alias("v")).first()[0]) == "2024-03-02 00:00:00"


def test_null_arguments(spark):
    for name in ("upper", "levenshtein", "st_area", "json_depth", "sqrt", "year"):
        args = [spark.range(1).selectExpr("cast(null as string) v")["v"]] * (2 if name == "levenshtein" else 1)
        from pyspark.sql import functions as F

        assert spark.range(1).select(call(name, *[F.lit(None).cast("string") for _ in args]).alias("v")).first()[0] is None


def test_json_engine():
    assert J.path_steps('$."a b"[1 to last][*]') == [("key", "a b"), ("range", 1, -1), ("items",)]
    assert J.merge_patch({"a": 1, "b": 2}, {"a": None}) == {"b": 2}
    assert J.contains({"a": [1, 2]}, {"a": [2]})


def test_solver_and_geometry():
    assert numeric.irr([-100, 110]) == pytest.approx(0.1)
    assert numeric.solve(lambda x: x * x + 1) is None
    with pytest.raises(ValueError):
        spatial.parse("POINT(1")
    assert spatial.wkt(spatial.parse("multipoint((1 2), 3 4)")) == "MULTIPOINT((1 2), (3 4))"
    assert math.isclose(spatial.area(spatial.buffer(spatial.parse("POINT(0 0)"), 1)), 3.12, rel_tol=1e-2)
    assert text.osa("abcd", "acbd") == 1
