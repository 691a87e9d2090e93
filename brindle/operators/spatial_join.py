"""Joins of points with boxes through grid cells of several widths and heights, in place of an R-tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .block_join import block_join

#: Cells double in width from level to level, ``size`` at level 0; the last level is one cell, for boxes beyond all others.
LEAST, LEVELS = -20, 60
#: Pairs of levels of the two axes that points are looked up at, at most.
SHAPES = 64


def _cell(x: Column, size: float, level: Column) -> Column:
    return F.when(level < LEVELS, F.floor(x / (F.lit(float(size)) * F.pow(F.lit(2.0), level))).cast("long")).otherwise(F.lit(0).cast("long"))


def _step(shapes: list[tuple[int, int]]) -> int:
    """How many levels to take as one, so that at most ``SHAPES`` shapes remain."""
    step = 1
    while len({(-(-x // step), -(-y // step)) for x, y in shapes}) > SHAPES:
        step *= 2
    return step


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float) -> DataFrame:
    """Rows of ``points`` (x, y) joined with the rows of ``boxes`` (x0, y0, x1, y1) around them.

    On each axis a box goes to the level whose cells are as wide as the box or wider, so it meets two or three
    cells of an axis however large it is. A point has one cell for each pair of levels that boxes have, so no pair
    comes twice; if there are many such pairs, neighbouring levels are taken together. A cell with many points
    and boxes is compared in blocks by several tasks. A box with a NULL or NaN side, or with ends in the wrong
    order, holds no point.
    """
    b = boxes.where("x0 <= x1 AND y0 <= y1 AND NOT isnan(x1) AND NOT isnan(y1)")
    for axis in ("x", "y"):
        wide = (F.col(f"{axis}1") - F.col(f"{axis}0")).cast("double")
        exact = F.greatest(F.ceil(F.log2(wide / size)).cast("int"), F.lit(LEAST))
        b = b.withColumn(f"_l{axis}", F.when(wide <= size * 2.0**LEAST, LEAST).when(wide < size * 2.0 ** (LEVELS - 1), exact).otherwise(LEVELS))
    shapes = [(r[0], r[1]) for r in b.select("_lx", "_ly").distinct().collect()]  # (LEVELS - LEAST + 1) ** 2 at most
    step = _step(shapes)
    for axis in ("x", "y"):
        b = b.withColumn(f"_l{axis}", F.least(F.ceil(F.col(f"_l{axis}") / step).cast("int") * step, F.lit(LEVELS)))
        low, high = (_cell(F.col(f"{axis}{end}"), size, F.col(f"_l{axis}")) for end in (0, 1))
        b = b.withColumn(f"_c{axis}", F.explode(F.sequence(low, high)))
    shapes = sorted({tuple(min(-(-v // step) * step, LEVELS) for v in s) for s in shapes})
    pairs = F.array(*(F.struct(F.lit(x).alias("_lx"), F.lit(y).alias("_ly")) for x, y in shapes)).cast("array<struct<_lx:int,_ly:int>>")
    p = points.where("x is not null AND y is not null").withColumn("_l", F.explode(pairs)).select(*points.columns, "_l._lx", "_l._ly")
    p = p.withColumns({f"_c{axis}": _cell(F.col(axis), size, F.col(f"_l{axis}")) for axis in ("x", "y")})
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    cell = ["_lx", "_ly", "_cx", "_cy"]
    return block_join(p, b, cell, inside).drop(*cell)
