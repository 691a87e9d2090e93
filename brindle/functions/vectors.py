"""Distances of vectors kept as arrays of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import scalar


def _same(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) == F.size(b), value).when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimension")).cast("double"))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


@scalar("vec_inner_product")
def inner_product(a, b):
    return _same(a, b, _dot(a, b))


@scalar("vec_l2_distance")
def l2(a, b):
    return _same(a, b, F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.lit(0.0), lambda s, v: s + v * v)))


@scalar("vec_cosine_distance", "vec_distance")
def cosine(a, b):
    """1 for a vector of length 0."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return _same(a, b, F.when(norms == 0, 1.0).otherwise(1 - _dot(a, b) / F.when(norms == 0, 1.0).otherwise(norms)))
