"""Named readers and writers that give and take DataFrames."""

from __future__ import annotations

import importlib.util
import json
import urllib.parse
import urllib.request
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Reader = Callable[..., DataFrame]
READERS: dict[str, Reader] = {}
WRITERS: dict[str, Callable[..., None]] = {}


def reader(name: str):
    def put(f: Reader) -> Reader:
        READERS[name] = f
        return f

    return put


def writer(name: str):
    def put(f):
        WRITERS[name] = f
        return f

    return put


def read(spark: SparkSession, kind: str, *args, **options) -> DataFrame:
    if kind not in READERS:
        raise KeyError(f"no source {kind}; there are {sorted(READERS)}")
    return READERS[kind](spark, *args, **options)


def write(df: DataFrame, kind: str, *args, **options) -> None:
    if kind not in WRITERS:
        raise KeyError(f"no sink {kind}; there are {sorted(WRITERS)}")
    WRITERS[kind](df, *args, **options)


@reader("csv")
def read_csv(spark, path, delimiter=",", header=True, schema=None):
    """Cells are trimmed and empty ones NULL; without a header columns are column_1, column_2, ..."""
    r = spark.read.option("sep", delimiter).option("header", header).option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).option("nullValue", "")
    df = r.schema(schema).csv(path) if schema else r.option("inferSchema", True).csv(path)
    return df if header or schema else df.toDF(*(f"column_{i + 1}" for i in range(len(df.columns))))


@writer("csv")
def write_csv(df, path, delimiter=",", header=True, mode="errorifexists"):
    df.write.mode(mode).option("sep", delimiter).option("header", header).csv(path)


@reader("json")
def read_json(spark, path, array_root=None, schema=None):
    """A document with an array of records, at the top or under ``array_root``; columns by name."""
    r = spark.read.option("multiLine", True)
    df = r.schema(schema).json(path) if schema else r.json(path)
    if array_root:
        df = df.select(F.inline(F.col(array_root)))
    return df.select(*sorted(df.columns))


@writer("json")
def write_json(df, path, mode="errorifexists"):
    df.write.mode(mode).json(path)


@reader("jsonl")
def read_jsonl(spark, path, skip_errors=False, schema=None):
    r = spark.read.option("mode", "DROPMALFORMED" if skip_errors else "FAILFAST")
    return r.schema(schema).json(path) if schema else r.json(path)


WRITERS["jsonl"] = write_json


@reader("parquet")
def read_parquet(spark, path):
    return spark.read.parquet(path)


@writer("parquet")
def write_parquet(df, path, compression="snappy", mode="errorifexists", partition_by=()):
    w = df.write.mode(mode).option("compression", compression)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


@reader("xml")
def read_xml(spark, path, row_tag="row", charset="UTF-8", schema=None):
    r = spark.read.format("xml").option("rowTag", row_tag).option("charset", charset)
    return (r.schema(schema) if schema else r).load(path)


@writer("xml")
def write_xml(df, path, row_tag="row", root_tag="rows", mode="errorifexists"):
    df.write.format("xml").mode(mode).option("rowTag", row_tag).option("rootTag", root_tag).save(path)


@reader("slice")
def read_slice(spark, rows, schema=None):
    """Records held by the program."""
    return spark.createDataFrame(rows, schema)


@reader("excel")
def read_excel(spark, path, sheet_name=0):
    """One sheet, read in the driver; needs openpyxl."""
    if importlib.util.find_spec("openpyxl") is None:
        raise RuntimeError("reading Excel files needs openpyxl")
    import pandas as pd

    return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet_name))


@reader("jdbc")
def read_jdbc(spark, url, table, user=None, password=None, partition_column=None, lower=None, upper=None, parts=8, **options):
    """Filters, limits and aggregates are pushed down by Spark; ``partition_column`` splits the scan."""
    r = spark.read.format("jdbc").option("url", url).option("dbtable", table)
    for k, v in {"user": user, "password": password, **options}.items():
        if v is not None:
            r = r.option(k, v)
    if partition_column:
        r = r.option("partitionColumn", partition_column).option("lowerBound", lower).option("upperBound", upper).option("numPartitions", parts)
    return r.load()


READERS["mysql"] = lambda spark, host, database, table, **o: read_jdbc(spark, f"jdbc:mysql://{host}/{database}", table, **o)
READERS["postgresql"] = lambda spark, host, database, table, **o: read_jdbc(spark, f"jdbc:postgresql://{host}/{database}", table, **o)


@writer("jdbc")
def write_jdbc(df, url, table, mode="append", **options):
    w = df.write.format("jdbc").mode(mode).option("url", url).option("dbtable", table)
    for k, v in options.items():
        w = w.option(k, v)
    w.save()


@reader("http")
def read_http(spark, base, table, schema: str, page=10_000, pages=1, token=None, timeout=30):
    """Records of a REST source (``/_query/<table>`` with offset and limit), one task a page."""

    def fetch(batches):
        import pandas as pd

        for b in batches:
            for n in b["id"]:
                body = json.dumps({"offset": int(n) * page, "limit": page}).encode()
                request = urllib.request.Request(f"{base.rstrip('/')}/_query/{urllib.parse.quote(table)}", body, {"Content-Type": "application/json"})
                if token:
                    request.add_header("Authorization", f"Bearer {token}")
                with urllib.request.urlopen(request, timeout=timeout) as answer:
                    yield pd.DataFrame(json.load(answer)["rows"], columns=names)

    names = T.StructType.fromDDL(schema).names
    return spark.range(0, pages, 1, pages).mapInPandas(fetch, schema)


@reader("information_schema")
def read_information_schema(spark, view, tables: dict[str, DataFrame]):
    """``tables``, ``columns`` or ``schemata`` over the given DataFrames."""
    if view == "tables":
        return spark.createDataFrame([("default", n, "BASE TABLE") for n in sorted(tables)], "table_schema string, table_name string, table_type string")
    if view == "columns":
        rows = [("default", n, f.name, i, "YES" if f.nullable else "NO", f.dataType.simpleString()) for n, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields, 1)]
        return spark.createDataFrame(rows, "table_schema string, table_name string, column_name string, ordinal_position int, is_nullable string, data_type string")
    if view == "schemata":
        return spark.createDataFrame([(d.name,) for d in spark.catalog.listDatabases()], "schema_name string")
    raise KeyError(view)
