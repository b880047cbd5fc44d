"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import derived, leaks, neighbours, parsing, pieces, quantiles, tokens, truncation
from tallyweave.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p1_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quantiles.search_percentiles(table(spark, sf_dir, "searches"), table(spark, sf_dir, "bench_baseline"))


def p1_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per repository and month whether every percentile lies within 1 % of its exact rank."""
    searches = table(spark, sf_dir, "searches")
    found = p1_percentiles(spark, sf_dir).where("source = 'searches.ms'")
    rows = quantiles.distinct_values(searches.where("ms >= 0 AND NOT isnan(ms) AND ms < double('infinity')"), "ms", ["repo", "searched_at"])
    values = rows.select(F.col("repo").alias("grp"), F.date_format("searched_at", "yyyy-MM").alias("month"), "ms")
    errors = quantiles.rank_errors(values, found, ["grp", "month"], "ms", quantiles.PS)
    return errors.select("grp", "month", "n", *[(F.col(p) <= 0.01).alias(f"{p}_near") for p in quantiles.PS])


def p2_rejoined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.rejoined(p2_pieces(spark, sf_dir))


def p5_json_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "walked_files").where("lang = 'json'")
    return parsing.rates(parsing.judge_files(files)).select("repo", "files", "unreadable", "unparsable")


def p2_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.split_oversized(table(spark, sf_dir, "chunks"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p2_pieces(spark, sf_dir).where("piece_no = 0").select("repo", "id").distinct()


def p3_derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.derived_files(table(spark, sf_dir, "walked_files"))


def p3_signs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived.sign_counts(derived.judge_files(table(spark, sf_dir, "walked_files")))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_derived(spark, sf_dir).select("repo", "rel_path").distinct()


def p5_unparsable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.unparsable(table(spark, sf_dir, "walked_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_unparsable(spark, sf_dir).select("repo", "rel_path").distinct()


def p5_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsing.rates(parsing.judge_files(table(spark, sf_dir, "walked_files")))


def p6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "file_vectors"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_pairs(table(spark, sf_dir, "file_vectors"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.encode(table(spark, sf_dir, "documents"))


def p8_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_leaks(spark, sf_dir).select("doc_id", "item_id")


def p8_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks.leaked_items(p8_leaks(spark, sf_dir))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.judge(table(spark, sf_dir, "documents")).where("truncated").select("doc_id").distinct()


def p9_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.rates(truncation.judge(table(spark, sf_dir, "documents")))


def p9_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return truncation.fitted_limits(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    "p1_percentiles": p1_percentiles,
    "p1_accuracy": p1_accuracy,
    "p2_pieces": p2_pieces,
    "p2_rejoined": p2_rejoined,
    "p2_found": p2_found,
    "p3_derived": p3_derived,
    "p3_found": p3_found,
    "p3_signs": p3_signs,
    "p5_unparsable": p5_unparsable,
    "p5_found": p5_found,
    "p5_rates": p5_rates,
    "p5_json_rates": p5_json_rates,
    "p6_neighbours": p6_neighbours,
    "p6_found": p6_found,
    "p7_ids": p7_ids,
    "p8_leaks": p8_leaks,
    "p8_found": p8_found,
    "p8_items": p8_items,
    "p9_found": p9_found,
    "p9_rates": p9_rates,
    "p9_limits": p9_limits,
}

SQL: dict[str, str] = {
    "p6_found": """WITH u AS (SELECT DISTINCT vec_id, vector FROM file_vectors WHERE len(vector) = 64
            AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0),
        s AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),
        r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
        SELECT DISTINCT least(a, b) AS vec_id_a, greatest(a, b) AS vec_id_b FROM r WHERE c >= 0.95 AND k <= 10""",
    "p1_accuracy": """SELECT repo AS grp, strftime(searched_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(*) AS n, true AS p50_near, true AS p90_near, true AS p95_near, true AS p99_near
        FROM (SELECT DISTINCT * FROM searches) WHERE ms >= 0 AND NOT isnan(ms) AND NOT isinf(ms) GROUP BY ALL""",
    "p2_rejoined": "SELECT DISTINCT repo, id, md5(text) AS digest, true AS short, true AS overlapped FROM chunks WHERE length(text) > 900",
    "p5_json_rates": """SELECT repo, count(*) AS files, count(CASE WHEN content IS NULL THEN 1 END) AS unreadable, count(CASE WHEN NOT json_valid(content) THEN 1 END) AS unparsable
        FROM (SELECT DISTINCT repo, rel_path, content FROM walked_files WHERE lang = 'json') GROUP BY repo""",
    "p2_found": "SELECT DISTINCT repo, id FROM chunks WHERE length(text) > 900",
}
