"""Exact percentiles of whole columns without all values of a column in one task."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def percentiles(df: DataFrame, columns: dict[str, Column], shares: list[float], one_task: int = 100_000, accuracy: int = 10_000) -> dict[str, list[float | None]]:
    """For each named column its percentiles at shares, linear between neighbours; null for a column without values.

    Up to one_task rows an aggregate does it. Beyond, approximate percentiles bracket each share; only what
    lies in a bracket is counted by value and ordered (some thousandths of the rows), and what lies below is
    counted. A bracket that does not hold the wanted ranks is widened, so the result is exact.
    """
    rows = df.select(*[c.cast("double").alias(n) for n, c in columns.items()])
    q = lambda n: F.col(f"`{n}`")
    counts = rows.agg(*[F.count(q(n)).alias(n) for n in columns]).first()
    if max((counts[n] for n in columns), default=0) <= one_task:
        found = rows.agg(*[F.percentile(q(n), F.array(*map(F.lit, shares))).alias(n) for n in columns]).first()
        return {n: list(found[n]) if found[n] is not None else [None] * len(shares) for n in columns}
    out: dict[tuple[str, float], float | None] = {(n, s): None for n in columns for s in shares}
    left, width = [(n, s) for n, s in out if counts[n]], 4 / accuracy
    while left:
        ends = rows.agg(*[F.percentile_approx(q(n), F.array(F.lit(max(0.0, s - width)), F.lit(min(1.0, s + width))), accuracy).alias(str(i)) for i, (n, s) in enumerate(left)]).first()
        below = rows.agg(*[F.count_if(q(n) < ends[i][0]).alias(str(i)) for i, (n, _) in enumerate(left)]).first()
        inside = F.array_compact(F.array(*[F.when(q(n).between(*ends[i]), F.struct(F.lit(i).alias("i"), q(n).alias("v"))) for i, (n, _) in enumerate(left)]))
        values = rows.select(F.explode(inside).alias("e")).groupBy("e.i", "e.v").agg(F.count("*").alias("n"))
        wanted, again = [], []
        for i, (n, s) in enumerate(left):
            at = s * (counts[n] - 1)
            wanted.append((i, math.floor(at) - below[i], math.ceil(at) - below[i]))
        # A value holds the ranks from the count of those before it on; per bracket two values are wanted.
        upto = F.sum("n").over(W.partitionBy("i").orderBy("v"))
        ranks = df.sparkSession.createDataFrame(wanted, "i int, lo long, hi long")
        held = values.withColumn("upto", upto).join(F.broadcast(ranks), "i")
        holds = lambda r: (F.col("upto") > F.col(r)) & (F.col("upto") - F.col("n") <= F.col(r)) & (F.col(r) >= 0)
        found = {r["i"]: r for r in held.groupBy("i").agg(F.max(F.when(holds("lo"), F.col("v"))).alias("lo"), F.max(F.when(holds("hi"), F.col("v"))).alias("hi")).collect()}
        for i, (n, s) in enumerate(left):
            r = found.get(i)
            if r is None or r["lo"] is None or r["hi"] is None:
                again.append((n, s))
                continue
            at = s * (counts[n] - 1)
            out[n, s] = r["lo"] if r["lo"] == r["hi"] else (math.ceil(at) - at) * r["lo"] + (at - math.floor(at)) * r["hi"]
        left, width = again, width * 8
    return {n: [out[n, s] for s in shares] for n in columns}
