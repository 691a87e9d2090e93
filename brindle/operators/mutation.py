"""INSERT, UPDATE, DELETE and upsert as new snapshots; generated columns; filters from records."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    """Columns by name; what ``rows`` lacks is NULL."""
    return table.unionByName(rows.select(*[c for c in table.columns if c in rows.columns]), allowMissingColumns=True)


def chosen(table: DataFrame, where: Column, order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    """The rows that a change with ORDER BY and LIMIT meets; ties go by all columns, so that the choice is one."""
    met = table.where(F.coalesce(where, F.lit(False)))
    if limit is None:
        return met
    keys = [F.expr(o) if not (m := re.search(r"\s+(asc|desc)\s*$", o, re.I)) else getattr(F.expr(o[: m.start()]), m[1].lower())() for o in order]
    return met.orderBy(*keys, *table.columns).limit(limit)


def _marked(table: DataFrame, where: Column, order: Sequence[str], limit: int) -> DataFrame:
    """``table`` with ``_hit``. Equal rows are numbered, as many of them hit as were chosen; the chosen ones are no more than ``limit``."""
    names = {c: f"_chosen_{i}" for i, c in enumerate(table.columns)}
    counts = chosen(table, where, order, limit).groupBy(*table.columns).agg(F.count("*").alias("_n")).withColumnsRenamed(names)
    both = table.join(counts, reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()]), "left").drop(*names.values())
    some = both.where("_n is not null").withColumn("_at", F.row_number().over(Window.partitionBy(*table.columns).orderBy("_n")))
    some = some.withColumn("_hit", F.col("_at") <= F.col("_n")).drop("_at", "_n")
    return both.where("_n is null").drop("_n").withColumn("_hit", F.lit(False)).unionByName(some)


def update(table: DataFrame, values: dict[str, Column], where: Column, order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    if limit is not None:
        return update(_marked(table, where, order, limit), values, F.col("_hit")).drop("_hit")
    hit = F.coalesce(where, F.lit(False))
    return table.withColumns({c: F.when(hit, v.cast(table.schema[c].dataType)).otherwise(F.col(c)) for c, v in values.items()})


def delete(table: DataFrame, where: Column, order: Sequence[str] = (), limit: int | None = None) -> DataFrame:
    if limit is not None:
        return _marked(table, where, order, limit).where("not _hit").drop("_hit")
    return table.where(~F.coalesce(where, F.lit(False)))


def upsert(table: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """Rows replace those with equal keys."""
    return table.join(rows.select(*keys), keys, "left_anti").select(*table.columns).unionByName(rows.select(*table.columns))


def generated(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Add columns given by SQL expressions, each after those that it uses."""
    waiting = dict(columns)
    while waiting:
        ready = [c for c, e in waiting.items() if not any(re.search(rf"\b{re.escape(o)}\b", e) for o in waiting if o != c)]
        if not ready:
            raise ValueError(f"generated columns depend on each other: {sorted(waiting)}")
        df = df.withColumns({c: F.expr(waiting.pop(c)) for c in ready})
    return df


# Comparison operators of filter records.
COMPARE = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<>": lambda c, v: c != v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v, ">": lambda c, v: c > v, ">=": lambda c, v: c >= v,
    "IN": lambda c, v: c.isin(*v), "NOT IN": lambda c, v: ~c.isin(*v), "BETWEEN": lambda c, v: c.between(*v), "NOT BETWEEN": lambda c, v: ~c.between(*v),
    "LIKE": lambda c, v: c.like(v), "NOT LIKE": lambda c, v: ~c.like(v), "IS NULL": lambda c, v: c.isNull(), "IS NOT NULL": lambda c, v: c.isNotNull(),
}


def predicate(record: dict) -> Column:
    """A predicate from {field, operator, value} or {logic: AND | OR | NOT, filters: [...]}."""
    if "filters" in record:
        parts = [predicate(r) for r in record["filters"]]
        logic = record.get("logic", "AND").upper()
        if logic == "NOT":
            return ~parts[0]
        return reduce((lambda a, b: a & b) if logic == "AND" else (lambda a, b: a | b), parts)
    return COMPARE[record["operator"].upper()](F.col(record["field"]), record.get("value"))


def select(df: DataFrame, filters: dict | None = None, columns: list[str] | None = None, order: str | None = None, descending: bool = False, limit: int | None = None, offset: int = 0) -> DataFrame:
    """A store-level query: filter, order by one column, offset and limit, columns."""
    if filters:
        df = df.where(predicate(filters))
    if order:
        df = df.orderBy(F.col(order).desc() if descending else F.col(order))
    if offset:
        df = df.offset(offset)
    if limit is not None and limit >= 0:
        df = df.limit(limit)
    return df.select(*columns) if columns else df
