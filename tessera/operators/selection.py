"""Exact percentiles of a whole table without a task that holds its distinct values.

Each pass counts the values between two bounds in equal buckets, with partial sums before the shuffle, and moves the bounds to
those of the bucket in which the wanted rank falls. A pass narrows a rank's range by BUCKETS, so few are needed; a range
of one value, or of so few rows that one task may sort them, ends the search.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 4096
#: Rows that one task may sort, and up to which Spark's own percentile is taken.
FEW_ROWS = 1_000_000


def order_statistics(df: DataFrame, value: Column | str, ranks: Sequence[int]) -> list[float]:
    """The values at ranks (from 0) of the values that aren't null; a rank beyond them is an error."""
    values = df.select(F.col(value).alias("v") if isinstance(value, str) else value.alias("v")).where(F.col("v").isNotNull()).select(F.col("v").cast("double").alias("v"))
    low, high, n = values.agg(F.min("v"), F.max("v"), F.count("*")).first()
    if any(not 0 <= r < n for r in ranks):
        raise ValueError(f"ranks {sorted(set(ranks))} of {n} values")
    # by rank: bounds (both inside), values below them, values between them
    at = {r: (low, high, 0, n) for r in set(ranks)}
    done: dict[int, float] = {}
    while len(done) < len(at):
        open_ = {r: x for r, x in at.items() if r not in done}
        for r, (a, b, below, k) in open_.items():
            if a == b:
                done[r] = a
            elif k <= FEW_ROWS:
                # a bounded number of rows
                top = values.where(F.col("v").between(a, b)).orderBy("v").limit(r - below + 1)
                done[r] = top.agg(F.max("v")).first()[0]
        open_ = {r: x for r, x in at.items() if r not in done}
        if not open_:
            break
        # halves first, so that the span of any two doubles is finite
        bucket = lambda a, b: F.least(F.lit(BUCKETS - 1), F.floor((F.col("v") / 2 - a / 2) / (b / 2 - a / 2) * BUCKETS)).cast("int")
        found = F.array_compact(F.array(*[F.when(F.col("v").between(a, b), F.struct(F.lit(r).alias("r"), bucket(a, b).alias("k"))) for r, (a, b, _, _) in open_.items()]))
        counts = values.select("v", F.explode(found).alias("x")).groupBy("x.r", "x.k").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        # a row for each bucket of each rank
        table: dict[int, list] = {r: [] for r in open_}
        for row in counts.collect():
            table[row.r].append(row)
        for r, (_, _, below, _) in open_.items():
            for row in sorted(table[r], key=lambda x: x.k):
                if r < below + row.n:
                    at[r] = (row.a, row.b, below, row.n)
                    break
                below += row.n
    return [done[r] for r in ranks]


def percentiles(df: DataFrame, value: Column | str, shares: Sequence[float]) -> list[float | None]:
    """Exact percentiles, linear between neighbours, of the values that aren't null; None without any."""
    column = F.col(value) if isinstance(value, str) else value
    n = df.select(column.alias("v")).where("v is not null").count()
    if n == 0:
        return [None] * len(shares)
    if n <= FEW_ROWS:
        return list(df.agg(*[F.percentile(column, s) for s in shares]).first())
    places = [s * (n - 1) for s in shares]
    ranks = sorted({int(f(p)) for p in places for f in (math.floor, math.ceil)})
    found = dict(zip(ranks, order_statistics(df, column, ranks), strict=True))
    out = []
    for p in places:
        i, j = math.floor(p), math.ceil(p)
        out.append(found[i] if i == j or found[i] == found[j] else (j - p) * found[i] + (p - i) * found[j])
    return out


def median(df: DataFrame, value: Column | str) -> float | None:
    return percentiles(df, value, [0.5])[0]
