"""Column functions over vectors, ranks and samples."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine; a vector without length counts as length 1."""
    safe = lambda v: F.when(norm(v) == 0, F.lit(1.0)).otherwise(norm(v))
    return dot(a, b) / (safe(a) * safe(b))


def usable(vector: Column, dim: int) -> Column:
    """Vectors of the right width, finite and not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def reciprocal_rank(rank: Column, k: int = 60) -> Column:
    return F.lit(1.0) / (F.lit(k) + rank)


def mcnemar(b: Column, c: Column) -> Column:
    """Exact two-sided p value of b against c discordant pairs."""
    n, low = b + c, F.least(b, c)
    log_half = F.lit(0.5)
    # Binomial terms by the recurrence C(n, i) = C(n, i - 1) * (n - i + 1) / i.
    terms = F.aggregate(
        F.sequence(F.lit(1), F.greatest(low, F.lit(1))),
        F.struct(F.pow(log_half, n).alias("term"), F.pow(log_half, n).alias("total")),
        lambda s, i: F.struct(
            (s.term * (n - i + 1) / i).alias("term"),
            F.when(i <= low, s.total + s.term * (n - i + 1) / i).otherwise(s.total).alias("total"),
        ),
        lambda s: s.total,
    )
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.lit(2.0) * terms))
