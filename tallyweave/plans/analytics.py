"""Duplicates, domains, co-change, the search log and its windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.operators import domains, duplicates, stats, store
from tallyweave.plans.registry import LIVE, query
from tallyweave.plans.retrieval import _COS, _USABLE, files
from tallyweave.session import table
from tallyweave.streaming import flows

_VALID = "ms IS NOT NULL AND NOT isnan(ms)"


@query("A01_totals", "SELECT count(*) AS searches, min(searched_at) AS first_at, count(CASE WHEN hits = 0 THEN 1 END) AS empty, round(count(CASE WHEN hits = 0 THEN 1 END) / count(*), 6) AS empty_rate FROM (SELECT DISTINCT * FROM searches)")
def totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.totals(table(spark, sf_dir, "searches").distinct())


@query("A02_most_asked", "SELECT query_text, count(*) AS n FROM (SELECT DISTINCT * FROM searches) GROUP BY query_text ORDER BY n DESC, query_text LIMIT 20")
def most_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.most_asked(table(spark, sf_dir, "searches").distinct(), 20)


@query("A03_weakest", "SELECT query_text, round(best, 3) AS best FROM (SELECT query_text, max(top_score) AS best FROM searches WHERE top_score IS NOT NULL AND NOT isnan(top_score) GROUP BY query_text ORDER BY best, query_text LIMIT 20)")
def weakest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.weakest(table(spark, sf_dir, "searches"), 20)


@query("A04_nearest_rank", f"""WITH s AS (SELECT repo, ms, row_number() OVER (PARTITION BY repo ORDER BY ms) - 1 AS r, count(*) OVER (PARTITION BY repo) AS n FROM (SELECT DISTINCT * FROM searches) WHERE {_VALID} AND ms >= 0)
    SELECT repo, max(n) AS n, round(max(CASE WHEN r = least(floor(n * 0.5), n - 1) THEN ms END), 2) AS p50, round(max(CASE WHEN r = least(floor(n * 0.95), n - 1) THEN ms END), 2) AS p95 FROM s GROUP BY repo""")
def nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.nearest_rank(table(spark, sf_dir, "searches").distinct().where("ms >= 0"), ["repo"], "ms", {"p50": 0.5, "p95": 0.95})


@query("A05_empty_rate", "SELECT repo, count(*) AS searches, round(count(CASE WHEN hits = 0 THEN 1 END) / count(*), 6) AS rate FROM (SELECT DISTINCT * FROM searches) GROUP BY repo")
def empty_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.count(F.lit(1))
    return table(spark, sf_dir, "searches").distinct().groupBy("repo").agg(n.alias("searches"), F.round(F.count(F.when(F.col("hits") == 0, 1)) / n, 6).alias("rate"))


@query("A18_histogram", f"""WITH s AS (SELECT reranked, ms FROM (SELECT DISTINCT * FROM searches) WHERE {_VALID} AND ms >= 0),
    b(le) AS (VALUES (5.0), (10.0), (25.0), (50.0), (100.0), (250.0), (500.0), (1000.0), (2500.0), (5000.0), (NULL)), t AS (SELECT reranked, round(sum(ms), 4) AS total FROM s GROUP BY reranked)
    SELECT s.reranked, CAST(b.le AS DOUBLE) AS le, count(CASE WHEN b.le IS NULL OR s.ms <= b.le THEN 1 END) AS n, any_value(t.total) AS total FROM s CROSS JOIN b JOIN t ON t.reranked IS NOT DISTINCT FROM s.reranked GROUP BY s.reranked, b.le""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram(table(spark, sf_dir, "searches").distinct().where("ms >= 0"), ["reranked"], "ms")


@query("A18_index_histogram", """WITH s AS (SELECT scenario, seconds FROM (SELECT DISTINCT scenario, repo, run_at, commit_sha, seconds FROM bench_baseline) WHERE seconds IS NOT NULL AND NOT isnan(seconds) AND seconds >= 0),
    b(le) AS (VALUES (0.5), (1.0), (5.0), (10.0), (30.0), (60.0), (300.0), (NULL)), t AS (SELECT scenario, round(sum(seconds), 4) AS total FROM s GROUP BY scenario)
    SELECT s.scenario, CAST(b.le AS DOUBLE) AS le, count(CASE WHEN b.le IS NULL OR s.seconds <= b.le THEN 1 END) AS n, any_value(t.total) AS total FROM s CROSS JOIN b JOIN t ON t.scenario IS NOT DISTINCT FROM s.scenario GROUP BY s.scenario, b.le""")
def index_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "bench_baseline").select("scenario", "repo", "run_at", "commit_sha", "seconds").distinct().where("seconds >= 0")
    return stats.histogram(rows, ["scenario"], "seconds", stats.INDEX_BOUNDS)


@query("A19_counters", "SELECT repo, reranked, k, count(*) AS n FROM (SELECT DISTINCT * FROM searches) GROUP BY ALL")
def counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.counters(table(spark, sf_dir, "searches").distinct(), ["repo", "reranked", "k"])


@query("A22_bench", """WITH r AS (SELECT DISTINCT run_at, commit_sha, scenario, repo, python, platform, embedder, seconds FROM bench_baseline WHERE seconds IS NOT NULL AND NOT isnan(seconds) AND seconds >= 0),
    n AS (SELECT *, row_number() OVER (PARTITION BY scenario, repo, embedder ORDER BY run_at DESC, commit_sha, seconds, python, platform NULLS FIRST) AS k FROM r)
    SELECT a.scenario, a.repo, a.embedder, round(a.seconds, 4) AS now, round(b.seconds, 4) AS saved, CASE WHEN a.seconds > b.seconds + greatest(b.seconds * 0.15, 0.1) THEN 'slower' WHEN a.seconds < b.seconds - greatest(b.seconds * 0.15, 0.1) THEN 'faster' ELSE 'same' END AS verdict
    FROM n a JOIN n b ON a.scenario = b.scenario AND a.repo = b.repo AND a.embedder = b.embedder AND a.k = 1 AND b.k = 2""")
def bench(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of every scenario against the one before."""
    from pyspark.sql import Window

    keys = ["scenario", "repo", "embedder"]
    runs = table(spark, sf_dir, "bench_baseline").where("seconds >= 0 AND NOT isnan(seconds)").select("run_at", "commit_sha", *keys, "python", "platform", "seconds").distinct()
    ranked = runs.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("run_at"), "commit_sha", "seconds", "python", "platform"))).where("k <= 2")
    both = ranked.groupBy(*keys).agg(F.max(F.when(F.col("k") == 1, F.col("seconds"))).alias("now"), F.max(F.when(F.col("k") == 2, F.col("seconds"))).alias("saved")).where("saved IS NOT NULL")
    return both.select(*keys, F.round("now", 4).alias("now"), F.round("saved", 4).alias("saved"), stats.bench_verdict(F.col("now"), F.col("saved")).alias("verdict"))


@query("R08_tumbling", "SELECT date_trunc('hour', searched_at) AS start, count(*) AS searches, count(CASE WHEN hits = 0 THEN 1 END) AS empty, round(avg(CASE WHEN ms >= 0 AND NOT isnan(ms) THEN ms END), 6) AS mean_ms FROM (SELECT DISTINCT * FROM searches) WHERE searched_at IS NOT NULL GROUP BY 1")
def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.tumbling(table(spark, sf_dir, "searches").distinct())


@query("R08_sliding", """WITH s AS (SELECT repo, epoch_us(searched_at) AS t FROM (SELECT DISTINCT * FROM searches) WHERE searched_at IS NOT NULL), w AS (SELECT repo, unnest([0, 1, 2, 3]) AS i, t FROM s)
    SELECT make_timestamptz((t // 21600000000 - i) * 21600000000) AS start, repo, count(*) AS searches FROM w GROUP BY ALL""")
def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.sliding(table(spark, sf_dir, "searches").distinct())


@query("R08_sessions", """WITH s AS (SELECT repo, searched_at AS t FROM (SELECT DISTINCT * FROM searches) WHERE searched_at IS NOT NULL),
    g AS (SELECT *, CASE WHEN t > lag(t) OVER (PARTITION BY repo ORDER BY t) + INTERVAL 30 MINUTE OR lag(t) OVER (PARTITION BY repo ORDER BY t) IS NULL THEN 1 ELSE 0 END AS fresh FROM s),
    n AS (SELECT *, sum(fresh) OVER (PARTITION BY repo ORDER BY t ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT repo, min(t) AS start, max(t) + INTERVAL 30 MINUTE AS "end", count(*) AS searches FROM n GROUP BY repo, session""")
def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flows.sessions(table(spark, sf_dir, "searches").distinct())


@query("R08_events", "SELECT event_type, date_trunc('day', ts) AS start, count(*) AS n, round(sum(value), 4) AS total, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.count_distinct("user_id").alias("users"))
    return rows.select("event_type", F.col("w.start").alias("start"), "n", "total", "users")


_NOT_CODE = "^\\s*(//|#|\\*|/\\*|--|;|import\\b|from\\b|require\\b|use\\b|package\\b)"
_PRINTS = f"""{LIVE}, named AS (SELECT repo, id, path, regexp_extract_all(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '{_NOT_CODE}')), chr(10)), '[A-Za-z_][A-Za-z0-9_]*') AS names FROM live WHERE kind = 'code'),
    prints AS (SELECT repo, id, path, list_distinct(list_transform(range(1, len(names) - 3), lambda i: array_to_string(names[i:i + 4], ' '))) AS s FROM named WHERE len(names) >= 60),
    cls AS (SELECT list_sort(s) AS s, min((repo, id)) AS rep, count(DISTINCT (repo, path)) > 1 AS spread FROM prints GROUP BY list_sort(s)),
    mem AS (SELECT p.repo, p.id, p.path, c.s, c.rep, c.spread FROM prints p JOIN cls c ON list_sort(p.s) = c.s), reps AS (SELECT * FROM mem WHERE (repo, id) = rep),
    posts AS (SELECT repo, id, unnest(s) AS sh FROM reps),
    proposed AS (SELECT DISTINCT a.repo AS repo_a, a.id AS id_a, b.repo AS repo_b, b.id AS id_b FROM posts a JOIN posts b USING (sh) WHERE (a.repo, a.id) < (b.repo, b.id)),
    scored AS (SELECT p.*, x.path AS path_a, y.path AS path_b, len(list_intersect(x.s, y.s)) AS i, len(x.s) AS na, len(y.s) AS nb, x.spread OR y.spread AS spread FROM proposed p JOIN reps x ON x.repo = repo_a AND x.id = id_a JOIN reps y ON y.repo = repo_b AND y.id = id_b),
    pairs AS (SELECT repo_a, id_a, path_a, repo_b, id_b, path_b, i / (na + nb - i) AS j FROM scored WHERE i / (na + nb - i) >= 0.45 AND (repo_a <> repo_b OR path_a <> path_b OR spread)
        UNION ALL SELECT r.repo, r.id, r.path, m.repo, m.id, m.path, 1.0 FROM mem m JOIN reps r ON r.rep = m.rep WHERE m.spread AND (m.repo, m.id) <> m.rep)"""


def prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.fingerprints(store.live(table(spark, sf_dir, "chunks")))


@query("X07_fingerprints", f"WITH {_PRINTS} SELECT repo, id, CAST(len(s) AS INTEGER) AS shingles FROM prints")
def fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prints(spark, sf_dir).select("repo", "id", F.size("shingles").alias("shingles"))


@query("J10_duplicate_pairs", f"WITH {_PRINTS} SELECT repo_a, id_a, repo_b, id_b, round_even(j, 3) AS jaccard FROM pairs")
def duplicate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.pairs(prints(spark, sf_dir)).select("repo_a", "id_a", "repo_b", "id_b", "jaccard")


@query("A10_duplicate_folders", f"""WITH {_PRINTS}, p AS (SELECT repo_a || ':' || regexp_replace(path_a, '/?[^/]*$', '') AS a, repo_b || ':' || regexp_replace(path_b, '/?[^/]*$', '') AS b, repo_a || ':' || path_a AS fa, repo_b || ':' || path_b AS fb, repo_a <> repo_b AS cross_repo FROM pairs)
    SELECT least(a, b) AS "left", greatest(a, b) AS "right", count(*) AS pairs, count(DISTINCT CASE WHEN a > b THEN fb ELSE fa END) AS left_files, bool_or(cross_repo) AS cross_repo, count(*) >= 10 AS wholesale, least(a, b) = greatest(a, b) AS within FROM p GROUP BY least(a, b), greatest(a, b)""")
def duplicate_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates.folder_groups(duplicates.pairs(prints(spark, sf_dir)))


@query("A06_centroids", f"""WITH {_USABLE}, flat AS (SELECT repo, package, unnest(range(64)) AS pos, unnest(vector) AS x FROM usable), m AS (SELECT repo, package, pos, avg(CAST(x AS DOUBLE)) AS x FROM flat GROUP BY ALL),
    n AS (SELECT repo, package, sqrt(sum(x * x)) AS size FROM m GROUP BY ALL)
    SELECT repo, package, round(max(CASE WHEN pos = 0 THEN x END) / max(CASE WHEN size = 0 THEN 1 ELSE size END), 6) AS first, round(max(CASE WHEN pos = 63 THEN x END) / max(CASE WHEN size = 0 THEN 1 ELSE size END), 6) AS last FROM m JOIN n USING (repo, package) GROUP BY repo, package""")
def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = domains.centroids(files(spark, sf_dir), ["repo", "package"])
    return made.select("repo", "package", F.round(F.col("vector")[0], 6).alias("first"), F.round(F.col("vector")[63], 6).alias("last"))


_NEAR = f"""{_USABLE}, one AS (SELECT vec_id, any_value(repo) AS repo, any_value(path) AS path, any_value(package) AS package, any_value(vector) AS vector FROM usable GROUP BY vec_id),
    sims AS (SELECT a.vec_id, b.vec_id AS other_id, {_COS.format(a='a.vector', b='b.vector')} AS similarity, a.repo, a.path, a.package, b.package AS other_package, b.path AS other_path FROM one a JOIN one b ON a.repo = b.repo AND a.vec_id <> b.vec_id),
    near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY similarity DESC, other_path DESC, other_id) AS rank FROM sims) WHERE rank <= 5)"""


@query("J15_neighbours", f"WITH {_NEAR} SELECT vec_id, other_id, similarity, rank FROM near")
def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.neighbours(files(spark, sf_dir))


@query("A08_agreement", f"""WITH {_NEAR}, s AS (SELECT repo, vec_id, sum(CASE WHEN package = other_package THEN 1 ELSE 0 END) / 5.0 AS share FROM near GROUP BY ALL), c AS (SELECT repo, count(DISTINCT vec_id) AS files, count(DISTINCT package) AS packages FROM one GROUP BY repo), m AS (SELECT repo, avg(share) AS mean_share FROM s GROUP BY repo)
    SELECT c.repo, files, packages, round(mean_share, 3) AS agreement, round(1.0 / packages, 3) AS baseline FROM c LEFT JOIN m USING (repo)""")
def agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return domains.agreement(f, domains.neighbours(f))


@query("T07_strangers", f"WITH {_NEAR} SELECT vec_id, repo, path, package, string_agg(other_path, ',' ORDER BY rank) AS neighbours, round(max(similarity), 3) AS similarity, row_number() OVER (PARTITION BY repo ORDER BY round(max(similarity), 3) DESC, path, vec_id) AS place FROM near GROUP BY vec_id, repo, path, package HAVING max(CASE WHEN package = other_package THEN 1 ELSE 0 END) = 0")
def strangers(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return domains.strangers(f, domains.neighbours(f))


@query("J16_co_change", """WITH r AS (SELECT DISTINCT o_custkey AS sha, CAST(l_partkey AS VARCHAR) AS path FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
    SELECT 'orders' AS repo, a.path AS left_path, b.path AS right_path, count(*) AS commits FROM r a JOIN r b ON a.sha = b.sha AND a.path < b.path GROUP BY a.path, b.path HAVING count(*) >= 4""")
def co_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts bought by at least four of the same customers: a customer is a commit, a part a file."""
    bought = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("o_orderkey") == F.col("l_orderkey"))
    return domains.co_change(bought.select(F.lit("orders").alias("repo"), F.col("o_custkey").alias("sha"), F.col("l_partkey").cast("string").alias("path")))


@query("A09_coupled", f"""WITH {_USABLE}, one AS (SELECT repo, path, min_by(package, vec_id) AS package, min_by(vector, vec_id) AS vector FROM usable GROUP BY repo, path),
    p AS (SELECT DISTINCT repo, left_path, right_path, commits FROM coupled WHERE commits >= 4),
    x AS (SELECT p.*, round(list_cosine_similarity(CAST(a.vector AS DOUBLE[]), CAST(b.vector AS DOUBLE[])), 3) AS similarity FROM p JOIN one a ON a.repo = p.repo AND a.path = p.left_path JOIN one b ON b.repo = p.repo AND b.path = p.right_path WHERE a.package <> b.package)
    SELECT *, row_number() OVER (PARTITION BY repo ORDER BY commits DESC, similarity, left_path, right_path) AS place FROM x""")
def coupled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of an earlier report that still change together across packages, the loudest first."""
    one = files(spark, sf_dir).groupBy("repo", "path").agg(F.min_by("package", "vec_id").alias("package"), F.min_by("vector", "vec_id").alias("vector"))
    pairs = table(spark, sf_dir, "coupled").select("repo", "left_path", "right_path", "commits").distinct().where(F.col("commits") >= domains.LEAST_COMMITS)
    return domains.coupled(pairs, one)


@query("A07_packages", f"WITH {_USABLE} SELECT repo, package, count(DISTINCT path) AS files FROM usable GROUP BY ALL")
def packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files(spark, sf_dir).groupBy("repo", "package").agg(F.count_distinct("path").alias("files"))


@query("X22_package_of", "SELECT DISTINCT path, CASE WHEN len(string_split(path, '/')) = 1 THEN '(root)' ELSE array_to_string(string_split(path, '/')[1:least(len(string_split(path, '/')) - 1, 2)], '/') END AS package FROM chunks WHERE path IS NOT NULL")
def package_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("path IS NOT NULL").select("path", T.package_of(F.col("path"), 2).alias("package")).distinct()


_PARTS = """f AS (SELECT DISTINCT repo, rel_path AS path FROM walked_files WHERE rel_path IS NOT NULL), p AS (SELECT repo, path, string_split(path, '/') AS parts FROM f),
    x AS (SELECT repo, path, unnest(range(len(parts) - 1)) AS level, unnest(parts[1:len(parts) - 1]) AS name FROM p)"""


@query("X21_branching_depth", f"WITH {_PARTS}, n AS (SELECT repo, level, count(DISTINCT name) AS names FROM x GROUP BY ALL) SELECT repo, CAST(least(coalesce(min(CASE WHEN names <> 1 THEN level + 1 END), max(level + 1)), 8) AS INTEGER) AS depth FROM n GROUP BY repo")
def branching_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.branching_depth(table(spark, sf_dir, "walked_files").where("rel_path IS NOT NULL").select("repo", F.col("rel_path").alias("path")).distinct())


_ASIDE = ", ".join(f"'{d}'" for d in domains.ASIDE)
_ASIDE_TOP = ", ".join(f"'{d}'" for d in domains.ASIDE_TOP)


@query("X20_source_prefix", f"""WITH f AS (SELECT DISTINCT repo, rel_path AS path FROM walked_files WHERE rel_path IS NOT NULL), p AS (SELECT repo, path, string_split(path, '/') AS parts FROM f),
    k AS (SELECT * FROM p WHERE parts[1] NOT IN ({_ASIDE_TOP}) AND len(list_filter(parts[1:len(parts) - 1], lambda d: d IN ({_ASIDE}))) = 0), t AS (SELECT repo, count(*) AS n FROM k GROUP BY repo),
    x AS (SELECT repo, path, unnest(range(len(parts) - 1)) AS level, unnest(parts[1:len(parts) - 1]) AS name FROM k),
    l AS (SELECT x.repo, level, count(DISTINCT name) = 1 AND count(*) = any_value(t.n) AS ok, min(name) AS name FROM x JOIN t USING (repo) GROUP BY x.repo, level),
    r AS (SELECT *, bool_and(ok) OVER (PARTITION BY repo ORDER BY level) AS all_ok FROM l), s AS (SELECT repo, string_agg(name, '/' ORDER BY level) || '/' AS prefix FROM r WHERE all_ok GROUP BY repo)
    SELECT d.repo, coalesce(prefix, '') AS prefix FROM (SELECT DISTINCT repo FROM f) d LEFT JOIN s USING (repo)""")
def source_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return domains.source_prefix(table(spark, sf_dir, "walked_files").where("rel_path IS NOT NULL").select("repo", F.col("rel_path").alias("path")).distinct())
