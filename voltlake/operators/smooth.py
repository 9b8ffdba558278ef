"""Smooth curves: exponentially weighted means and monotone cubic interpolation, with windows only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .interpolate import grid


def ewma(rows: DataFrame, keys: list[str], order: str, column: str, out: str, alpha: float | None = None, com: float | None = None) -> DataFrame:
    """Adds the exponentially weighted mean of column: weights (1 - alpha)^i of the i-th last row, divided by their sum.

    alpha, or the centre of mass com (alpha = 1 / (1 + com)). Weights below 1e-17 of the first do not reach
    a double and are left out, which bounds the frame. Nulls carry no weight.
    """
    keep = 1 - (alpha if alpha is not None else 1 / (1 + com))
    reach = max(1, math.ceil(-17 / math.log10(keep))) if keep > 0 else 0
    frame = W.partitionBy(*keys).orderBy(order).rowsBetween(-reach, 0)
    x = F.reverse(F.collect_list(F.struct(F.col(column).alias("x"))).over(frame))
    zero = F.struct(F.lit(0.0).alias("top"), F.lit(0.0).alias("low"), F.lit(1.0).alias("w"))

    def step(acc: Column, s: Column) -> Column:
        here = F.when(s["x"].isNotNull(), acc["w"]).otherwise(0.0)
        return F.struct((acc["top"] + here * F.coalesce(s["x"], F.lit(0.0))).alias("top"), (acc["low"] + here).alias("low"), (acc["w"] * keep).alias("w"))

    return rows.withColumn(out, F.aggregate(x, zero, step, lambda acc: F.try_divide(acc["top"], acc["low"])))


def monotone_cubic(knots: DataFrame, bounds: DataFrame, keys: list[str], x: str, y: str, n: int) -> DataFrame:
    """knots (keys, x, y; x distinct) at the grids of bounds (keys, lo, hi) by cubic pieces that keep monotone runs monotone.

    Slopes at inner knots are weighted harmonic means of the sides' slopes, 0 at extremes; at the ends they
    come from three points and are cut so as not to overshoot. Null outside of the knots.
    """
    w = W.partitionBy(*keys).orderBy(x)
    k = knots.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*keys, x, y)
    k = k.withColumns({"h": F.lead(x).over(w) - F.col(x), "s": (F.lead(y).over(w) - F.col(y)) / (F.lead(x).over(w) - F.col(x))})
    k = k.withColumns({"h0": F.lag("h").over(w), "s0": F.lag("s").over(w), "h2": F.lead("h").over(w), "s2": F.lead("s").over(w), "h00": F.lag("h", 2).over(w), "s00": F.lag("s", 2).over(w)})
    h, s, h0, s0 = (F.col(c) for c in ("h", "s", "h0", "s0"))

    def end(ha: Column, sa: Column, hb: Column, sb: Column) -> Column:
        d = ((2 * ha + hb) * sa - ha * sb) / (ha + hb)
        return F.when(sb.isNull(), sa).when(F.signum(d) != F.signum(sa), 0.0).when((F.signum(sa) != F.signum(sb)) & (F.abs(d) > 3 * F.abs(sa)), 3 * sa).otherwise(d)

    a, b = 2 * h + h0, h + 2 * h0
    inner = F.when(s0 * s <= 0, 0.0).otherwise((a + b) / (a / s0 + b / s))
    slope = F.when(h0.isNull(), end(h, s, F.col("h2"), F.col("s2"))).when(h.isNull(), end(h0, s0, F.col("h00"), F.col("s00"))).otherwise(inner)
    k = k.select(*keys, x, F.struct(F.col(x).alias("x"), F.col(y).alias("y"), slope.alias("d")).alias("k")).withColumn("_grid", F.lit(0))
    rows = k.unionByName(grid(bounds, keys, n, x).withColumn("_grid", F.lit(1)), allowMissingColumns=True)
    order = W.partitionBy(*keys).orderBy(x, "_grid")
    rows = rows.withColumns({"p": F.last("k", True).over(order.rowsBetween(W.unboundedPreceding, 0)), "q": F.first("k", True).over(order.rowsBetween(1, W.unboundedFollowing))}).where("_grid = 1")
    p, q = F.col("p"), F.col("q")
    g = q["x"] - p["x"]
    t = (F.col(x) - p["x"]) / g
    cubic = (1 + 2 * t) * (1 - t) * (1 - t) * p["y"] + t * (1 - t) * (1 - t) * g * p["d"] + t * t * (3 - 2 * t) * q["y"] + t * t * (t - 1) * g * q["d"]
    return rows.select(*keys, x, F.when(p["x"] == F.col(x), p["y"]).when(q.isNotNull(), cubic).alias(y))
