"""The search log and evaluation: totals, percentiles, histograms, rank metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of latency buckets in milliseconds, of indexing in seconds.
BOUNDS = (5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0)
INDEX_BOUNDS = (0.5, 1.0, 5.0, 10.0, 30.0, 60.0, 300.0)
NOISE, FLOOR_SECONDS = 0.15, 0.10


def totals(searches: DataFrame) -> DataFrame:
    """One row: searches, the first, those without a hit, their rate."""
    empty = F.count(F.when(F.col("hits") == 0, 1))
    n = F.count(F.lit(1))
    return searches.agg(n.alias("searches"), F.min("searched_at").alias("first_at"), empty.alias("empty"), F.when(n == 0, F.lit(0.0)).otherwise(F.round(empty / n, 6)).alias("empty_rate"))


def most_asked(searches: DataFrame, top: int) -> DataFrame:
    return searches.groupBy("query_text").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "query_text").limit(top)


def weakest(searches: DataFrame, top: int) -> DataFrame:
    """Queries whose best score is lowest; ties by the query."""
    best = searches.where(F.col("top_score").isNotNull() & ~F.isnan("top_score")).groupBy("query_text").agg(F.max("top_score").alias("best"))
    return best.orderBy("best", "query_text").limit(top).select("query_text", F.round("best", 3).alias("best"))


def nearest_rank(df: DataFrame, by: Sequence[str], value: str, fractions: dict[str, float]) -> DataFrame:
    """Exact percentiles by rank min(floor(n * f), n - 1) from zero, two decimals.

    Equal values are counted once before they are ranked, so the sort holds the
    distinct values of a group. For columns too large for that, use a sketch.
    """
    counts = df.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(*by, value).agg(F.count(F.lit(1)).alias("c"))
    order = Window.partitionBy(*by).orderBy(value)
    rows = counts.withColumn("upto", F.sum("c").over(order)).withColumn("n", F.sum("c").over(Window.partitionBy(*by)))
    picks = []
    for name, f in fractions.items():
        rank = F.least(F.floor(F.col("n") * F.lit(f)), F.col("n") - 1)
        picks.append(F.round(F.max(F.when((F.col("upto") > rank) & (F.col("upto") - F.col("c") <= rank), F.col(value))), 2).alias(name))
    return rows.groupBy(*by).agg(F.max("n").alias("n"), *picks)


def histogram(df: DataFrame, by: Sequence[str], value: str, bounds: Sequence[float] = BOUNDS) -> DataFrame:
    """Cumulative buckets (le), the last without bound, with counts and sums; one pass."""
    v = F.col(value)
    counted = df.where(v.isNotNull() & ~F.isnan(value)).groupBy(*by).agg(
        *[F.count(F.when(v <= b, 1)).alias(f"le_{i}") for i, b in enumerate(bounds)], F.count(F.lit(1)).alias("le_inf"), F.round(F.sum(v), 4).alias("total")
    )
    entries = [F.struct(F.lit(float(b)).alias("le"), F.col(f"le_{i}").alias("n")) for i, b in enumerate(bounds)]
    entries.append(F.struct(F.lit(None).cast("double").alias("le"), F.col("le_inf").alias("n")))
    return counted.select(*by, "total", F.explode(F.array(*entries)).alias("x")).select(*by, "x.le", "x.n", "total")


def counters(df: DataFrame, by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))


def truth_ranks(hits: DataFrame, truths: DataFrame) -> DataFrame:
    """(query_id, rank): where the first right answer stands; null when it is missing.

    ``hits``: query_id, rank, repo, path. ``truths``: query_id, repo, path (several allowed).
    """
    right = hits.join(truths, ["query_id", "repo", "path"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("rank"))
    return truths.select("query_id").distinct().join(right, "query_id", "left")


def hit_rates(ranks: DataFrame, by: Sequence[str] = (), at: Sequence[int] = (1, 3, 10)) -> DataFrame:
    hits = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"hit_{k}") for k in at]
    return ranks.groupBy(*by).agg(F.count(F.lit(1)).alias("questions"), *hits)


def discordant(ours: DataFrame, theirs: DataFrame, at: int) -> DataFrame:
    """One row (only_ours, only_theirs): questions that one side answers within ``at``."""
    a = ours.select("query_id", (F.coalesce(F.col("rank") <= at, F.lit(False))).alias("a"))
    b = theirs.select("query_id", (F.coalesce(F.col("rank") <= at, F.lit(False))).alias("b"))
    both = a.join(b, "query_id")
    return both.agg(F.count(F.when(F.col("a") & ~F.col("b"), 1)).alias("only_ours"), F.count(F.when(~F.col("a") & F.col("b"), 1)).alias("only_theirs"))


def bench_verdict(now: Column, saved: Column) -> Column:
    """Against a saved run: within noise, slower or faster."""
    slack = F.greatest(saved * NOISE, F.lit(FLOOR_SECONDS))
    return F.when(now > saved + slack, "slower").when(now < saved - slack, "faster").otherwise("same")


def exposition(name: str, histograms: DataFrame, labels: Sequence[str], counters: DataFrame | None = None) -> list[str]:
    """Histograms (labels, le, n, total) and counters (labels, n) as lines of the text format that scrapers read.

    One line per label set and bucket reaches the driver.
    """
    quote = lambda v: str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    marks = lambda r, *more: ",".join([*(f'{c}="{quote(r[c])}"' for c in labels if r[c] is not None), *more])
    brace = lambda s: f"{{{s}}}" if s else ""
    out = [f"# TYPE {name} histogram"]
    for r in histograms.orderBy(*labels, F.asc_nulls_last("le")).collect():
        bound = "+Inf" if r["le"] is None else f"{r['le']:g}"
        out.append(f"{name}_bucket{brace(marks(r, f'le=\"{bound}\"'))} {r['n']}")
        if r["le"] is None:
            out += [f"{name}_sum{brace(marks(r))} {r['total']:g}", f"{name}_count{brace(marks(r))} {r['n']}"]
    if counters is not None:
        out.append(f"# TYPE {name}_total counter")
        out += [f"{name}_total{brace(marks(r))} {r['n']}" for r in counters.orderBy(*labels).collect()]
    return out
