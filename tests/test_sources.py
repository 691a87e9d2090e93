import pytest

from brindle import sources
from brindle.streaming import windowed


def test_round_trips(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    for kind in ("csv", "jsonl", "parquet", "xml"):
        path = str(tmp_path / kind)
        sources.write(df, kind, path)
        back = sources.read(spark, kind, path)
        assert sorted((int(r["id"]), r["v"]) for r in back.collect()) == [(1, "a"), (2, "b")]


def test_headerless_csv_and_nested_json(spark, tmp_path):
    (tmp_path / "x.csv").write_text(" 1 , a\n2,\n")
    df = sources.read(spark, "csv", str(tmp_path / "x.csv"), header=False)
    assert df.columns == ["column_1", "column_2"] and df.where("column_2 is null").count() == 1
    (tmp_path / "x.json").write_text('{"data": [{"b": 1, "a": "x"}]}')
    assert sources.read(spark, "json", str(tmp_path / "x.json"), array_root="data").columns == ["a", "b"]


def test_bad_lines(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\n{bad\n')
    assert sources.read(spark, "jsonl", str(tmp_path / "x.jsonl"), skip_errors=True, schema="a int").count() == 1
    with pytest.raises(Exception):
        sources.read(spark, "jsonl", str(tmp_path / "x.jsonl"), schema="a int").collect()


def test_information_schema_and_unknown(spark):
    t = {"t": spark.range(1)}
    assert sources.read(spark, "information_schema", "columns", t).first()["column_name"] == "id"
    with pytest.raises(KeyError):
        sources.read(spark, "nothing")


def test_stream_equals_batch(spark, sf, tmp_path):
    batch = spark.read.parquet(f"{sf}/events.parquet")
    stream = spark.readStream.schema(batch.schema).parquet(f"{sf}/events.parquet*")
    q = windowed(stream, late="100000 hours").writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("counted").selectExpr("sum(n)").first()[0] == batch.count()
    assert windowed(batch).count() == spark.table("counted").count()
