"""Mergeable percentiles of very large numeric columns.

Values are counted in signed logarithmic buckets of fixed relative width. A
sketch is a plain table (one row per key and non-empty bucket: count, smallest
and largest value), so sketches of days, files or partitions are combined by
adding the counts of matching buckets, in any order, with the same result.

Guarantees, with ``alpha`` the relative accuracy:
    * relative value error of every percentile: at most ``alpha``
    * rank error: at most ``rank_error``, which is reported with each row
      (zero when the bucket holds one value, else its inner rows over all rows)

Defined results for odd input
    * null, NaN and infinite values: not counted
    * zero: a bucket of its own; negative values: mirrored buckets
    * null keys: a group of their own; empty table: no rows
    * one value, ties: the value itself
    * exact duplicate rows: the caller decides (``dropDuplicates`` before)
    * extra columns, whatever their names: ignored
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative accuracy. At 1e-4 a group whose values span nine decades has at most
#: about 104,000 buckets, however many rows it has.
ALPHA = 1e-4
_OFFSET = 1 << 23


def _log_gamma(alpha: float) -> float:
    return math.log((1 + alpha) / (1 - alpha))


def bucket_of(value: Column, alpha: float = ALPHA) -> Column:
    """Signed bucket number, in the order of the values."""
    i = F.ceil(F.log(F.abs(value)) / F.lit(_log_gamma(alpha))).cast("long") + F.lit(_OFFSET)
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, i).otherwise(-i)


def _centre(bucket: Column, alpha: float) -> Column:
    """The value with the least relative error for all values of a bucket."""
    size = F.exp((F.abs(bucket) - _OFFSET) * F.lit(_log_gamma(alpha))) * F.lit(1 - alpha)
    return F.when(bucket == 0, F.lit(0.0)).otherwise(F.signum(bucket.cast("double")) * size)


def sketch(df: DataFrame, value: Column | str, by: dict[str, Column | str], alpha: float = ALPHA) -> DataFrame:
    """Bucket counts per key: the ``by`` columns, bucket, n, low, high.

    One aggregation with map-side combine; a hot key is reduced to its buckets
    before the shuffle.
    """
    value = F.col(value) if isinstance(value, str) else value
    keys = [(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in by.items()]
    finite = F.col("__v").isNotNull() & ~F.isnan("__v") & (F.abs("__v") < F.lit(float("inf")))
    return (
        df.select(*keys, value.cast("double").alias("__v"))
        .where(finite)
        .withColumn("bucket", bucket_of(F.col("__v"), alpha))
        .groupBy(*by, "bucket")
        .agg(F.count(F.lit(1)).alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high"))
    )


def merge(sketches: Sequence[DataFrame], by: Sequence[str]) -> DataFrame:
    """Combine sketches of the same ``alpha``, keeping only the keys in ``by``."""
    rows = reduce(DataFrame.unionByName, [s.select(*by, "bucket", "n", "low", "high") for s in sketches])
    return rows.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def percentiles(sketched: DataFrame, by: Sequence[str], ps: dict[str, float], alpha: float = ALPHA) -> DataFrame:
    """Nearest-rank percentiles of a sketch: ``by``, n, one column per p, rank_error."""
    order = Window.partitionBy(*by).orderBy("bucket")
    whole = Window.partitionBy(*by)
    rows = sketched.withColumn("__to", F.sum("n").over(order)).withColumn("__all", F.sum("n").over(whole))
    centre = F.greatest(F.col("low"), F.least(F.col("high"), _centre(F.col("bucket"), alpha)))
    inner = F.when(F.col("low") == F.col("high"), F.lit(0.0)).otherwise(
        F.greatest(F.lit(0), F.col("n") - 2) / F.col("__all")
    )
    picks, errors = [], []
    for name, p in ps.items():
        # The tiny subtraction keeps 0.95 * 20 from being rounded up to rank 20.
        rank = F.greatest(F.lit(1), F.ceil(F.lit(p) * F.col("__all") - F.lit(1e-9)))
        here = (F.col("__to") >= rank) & (F.col("__to") - F.col("n") < rank)
        value = F.when(rank == F.col("__to") - F.col("n") + 1, F.col("low")).when(rank == F.col("__to"), F.col("high")).otherwise(centre)
        picks.append(F.max(F.when(here, value)).alias(name))
        ends = (rank == F.col("__to") - F.col("n") + 1) | (rank == F.col("__to"))
        errors.append(F.max(F.when(here, F.when(ends, F.lit(0.0)).otherwise(inner))))
    return rows.groupBy(*by).agg(F.max("__all").alias("n"), *picks, F.greatest(*errors, F.lit(0.0)).alias("rank_error"))


PS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}


def distinct_values(df: DataFrame, value: str, keep: Sequence[str]) -> DataFrame:
    """``keep`` and ``value`` of the distinct rows of ``df``, told apart by 128 bits of all
    columns, so that wide columns are not shuffled. Only flat columns are hashed so."""
    nulls = reduce(lambda a, b: a + b, [F.when(F.col(c).isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(df.columns)])
    row = df.select(*keep, value, F.xxhash64(nulls, *df.columns).alias("__h1"), F.xxhash64(F.lit(1), nulls, *df.columns).alias("__h2"))
    return row.dropDuplicates(["__h1", "__h2"]).drop("__h1", "__h2")


def search_percentiles(searches: DataFrame, bench: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """Latency percentiles per repo and month, and of p95_ms per scenario.

    Daily sketches are made first and combined to months, as separate days are.
    """
    month, day = F.date_format("searched_at", "yyyy-MM"), F.date_format("searched_at", "yyyy-MM-dd")
    counted = distinct_values(searches.where(F.col("ms") >= 0), "ms", ["repo", "searched_at"])
    daily = sketch(counted, "ms", {"grp": "repo", "month": month, "day": day}, alpha)
    by_month = percentiles(merge([daily], ["grp", "month"]), ["grp", "month"], PS, alpha)
    p95 = F.col("detail.p95_ms")
    runs = sketch(bench.dropDuplicates().where(p95 >= 0), p95, {"grp": "scenario"}, alpha)
    by_scenario = percentiles(runs, ["grp"], PS, alpha).withColumn("month", F.lit(None).cast("string"))
    return by_month.withColumn("source", F.lit("searches.ms")).unionByName(
        by_scenario.withColumn("source", F.lit("bench_baseline.p95_ms"))
    ).select("source", "grp", "month", "n", *PS, "rank_error")


def rank_errors(values: DataFrame, found: DataFrame, by: Sequence[str], value: str, ps: dict[str, float]) -> DataFrame:
    """(by, n, one column per p): how many ranks, as a share of n, a percentile lies off its rank in the exact values."""
    both = values.alias("v").join(found.select(*[F.col(c).alias(f"__{c}") for c in by], *ps), reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]))
    sides = [x for p in ps for x in (F.count(F.when(F.col(value) < F.col(p), 1)).alias(f"{p}_below"), F.count(F.when(F.col(value) <= F.col(p), 1)).alias(f"{p}_upto"))]
    counts = both.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *sides)
    rank = lambda q: F.greatest(F.lit(1), F.ceil(F.lit(q) * F.col("n") - F.lit(1e-9)))
    return counts.select(*by, "n", *[(F.greatest(F.lit(0), F.col(f"{p}_below") + 1 - rank(q), rank(q) - F.col(f"{p}_upto")) / F.col("n")).alias(p) for p, q in ps.items()])
