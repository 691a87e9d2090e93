"""Aggregate functions. ``stddev`` and ``variance`` are those of the population."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import aggregate


def _truth(x: Column) -> Column:
    text = F.lower(x.cast("string"))
    return F.when(x.isNull(), None).otherwise(~text.isin("", "0", "0.0", "false"))


aggregate("count")(lambda *x: F.count("*") if not x else F.count(F.coalesce(*(c.cast("string") for c in x))))
aggregate("sum")(lambda x: F.sum(x.cast("double")))
aggregate("avg")(lambda x: F.avg(x))
aggregate("min")(F.min)
aggregate("max")(F.max)
aggregate("stddev", "stddev_pop")(F.stddev_pop)
aggregate("variance", "var_pop")(F.var_pop)
aggregate("stddev_samp")(F.stddev_samp)
aggregate("var_samp")(F.var_samp)


@aggregate("group_concat", "string_agg", "listagg")
def group_concat(x: Column, sep: str | Column = ",", order: Column | None = None) -> Column:
    """Joined texts in the order of ``order``, else of the texts themselves; NULLs are left out."""
    items = F.sort_array(F.collect_list(F.struct((x if order is None else order).alias("o"), x.cast("string").alias("v"))))
    kept = F.filter(F.transform(items, lambda i: i["v"]), lambda v: v.isNotNull())
    sep = sep if isinstance(sep, Column) else F.lit(sep)
    return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(None).cast("string"), lambda s, v: F.when(s.isNull(), v).otherwise(F.concat(s, sep, v))))


aggregate("count_if")(lambda x: F.count_if(F.coalesce(_truth(x), F.lit(False))))
aggregate("bool_and", "every")(lambda x: F.bool_and(_truth(x)))
aggregate("bool_or")(lambda x: F.bool_or(_truth(x)))
aggregate("median")(F.median)
aggregate("percentile_cont")(lambda p, x: F.percentile(x, p))


@aggregate("percentile_disc")
def percentile_disc(p: Column, x: Column) -> Column:
    items = F.sort_array(F.collect_list(x))
    return F.element_at(items, F.greatest(F.ceil(p * F.size(items)), F.lit(1)).cast("int"))


aggregate("array_agg", "list")(lambda x: F.transform(F.collect_list(F.struct(x.alias("v"))), lambda s: s["v"]))
aggregate("product")(F.product)
aggregate("corr")(F.corr)
aggregate("covar_pop")(F.covar_pop)
aggregate("covar_samp")(F.covar_samp)
aggregate("skewness")(lambda x: F.when(F.count(x) >= 3, F.when(F.stddev_pop(x) == 0, 0.0).otherwise(F.skewness(x))))
aggregate("kurtosis")(lambda x: F.when(F.count(x) >= 4, F.when(F.stddev_pop(x) == 0, 0.0).otherwise(F.kurtosis(x))))
aggregate("mode")(lambda x: F.mode(x.cast("string"), deterministic=True))
aggregate("approx_count_distinct")(F.count_distinct)


@aggregate("entropy")
def entropy(x: Column) -> Column:
    """Shannon entropy in bits, from the counts of distinct values."""
    items = F.collect_list(x)
    shares = F.transform(F.array_distinct(items), lambda v: F.size(F.filter(items, lambda w: w == v)) / F.size(items))
    return F.when(F.count(x) > 0, -F.aggregate(shares, F.lit(0.0), lambda s, p: s + p * F.log2(p)))


def entropy_by(df, keys: list[str], value: str, name: str = "entropy"):
    """The same in two aggregations, for large groups."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").cast("double").alias("_n"))
    return counts.groupBy(*keys).agg((F.log2(F.sum("_n")) - F.sum(F.col("_n") * F.log2("_n")) / F.sum("_n")).alias(name))
