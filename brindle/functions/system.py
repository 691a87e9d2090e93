"""System functions."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from .registry import scalar

VERSION = "8.0.0-brindle"
# Names of types.
TYPES = (("int|bigint|smallint|tinyint", "INTEGER"), ("double|float|decimal.*", "DOUBLE"), ("string|char.*|varchar.*", "VARCHAR"), ("binary", "BLOB"), ("timestamp.*|date", "TIMESTAMP"), ("array.*", "LIST"), ("struct.*|map.*", "STRUCT"), ("void", "NULL"), ("boolean", "BOOLEAN"))


@scalar("typeof")
def typeof(x):
    name, out = F.typeof(x), F.upper(F.typeof(x))
    for pattern, kind in TYPES:
        out = F.when(name.rlike(f"^({pattern})$"), kind).otherwise(out)
    return F.when(x.isNull(), "NULL").otherwise(out)


scalar("version")(lambda: F.lit(VERSION))
scalar("current_database", "current_schema")(F.current_database)
scalar("uuid", "gen_random_uuid")(lambda: F.expr("uuid()"))


@scalar("setseed")
def setseed(seed):
    """Seeds are given to ``rand``; this is NULL."""
    return F.lit(None).cast("int")


@scalar("sleep")
def sleep(seconds):
    return F.lit(0)


def pause(seconds: float) -> int:
    """Wait in the driver, 300 seconds at most."""
    time.sleep(min(max(seconds, 0.0), 300.0))
    return 0
