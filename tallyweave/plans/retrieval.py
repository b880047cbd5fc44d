"""Search, filters, fusion, budgets and their evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.functions import numbers as N
from tallyweave.functions import text as T
from tallyweave.operators import search, stats, store
from tallyweave.plans.registry import LIVE, query
from tallyweave.session import cut, shared_folder, table

#: The questions that the search queries answer: the words of the path, and the vector, of
#: every file whose vec_id is divisible by 50.
_USABLE = """usable AS (SELECT DISTINCT vec_id, repo, path, package, vector FROM file_vectors WHERE len(vector) = 64
    AND len(list_filter(vector, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(vector, lambda x: x <> 0)) > 0)"""
_Q = r"q AS (SELECT vec_id AS query_id, trim(regexp_replace(path, '[/_.\-]+', ' ', 'g')) AS query_text, vector FROM usable WHERE vec_id % 50 = 0)"
_COS = "round(list_cosine_similarity(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), 6)"


def live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live(table(spark, sf_dir, "chunks"))


def lexical(spark: SparkSession, sf_dir: str, queries: DataFrame, k: int) -> DataFrame:
    """The lexical arm over the live chunks; their terms are counted before any shuffle."""
    rows = table(spark, sf_dir, "chunks").select("repo", "id", "kind", "path", "start_line", "indexed_at", "deleted_at", "text")
    return search.lexical(rows, queries, k, store.live)


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "file_vectors").select("vec_id", "repo", "path", "package", "vector").where(N.usable(F.col("vector"), 64)).distinct()


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = files(spark, sf_dir).where(F.col("vec_id") % 50 == 0)
    return asked.select(F.col("vec_id").alias("query_id"), T.words(F.col("path")).alias("query_text"), "vector")


_BM25 = f"""{LIVE}, {_USABLE}, {_Q},
    docs AS (SELECT repo, id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS words FROM live WHERE kind <> 'commit'),
    stats AS (SELECT count(*) AS docs, avg(len(words)) AS mean_length FROM docs),
    terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM q),
    flat AS (SELECT repo, id, len(words) AS length, unnest(words) AS term FROM docs),
    hits AS (SELECT term, repo, id, length, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
    bm AS (SELECT query_id, repo, id, round(sum(ln(1.0 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))), 6) AS score
        FROM hits JOIN df USING (term) CROSS JOIN stats JOIN terms USING (term) GROUP BY ALL),
    lex AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, id) AS rank FROM bm)"""
_VEC = f"""fileone AS (SELECT repo, path, min_by(vector, vec_id) AS vector FROM usable GROUP BY repo, path),
    vsim AS (SELECT q.query_id, l.repo, l.id, {_COS.format(a='f.vector', b='q.vector')} AS score
        FROM q CROSS JOIN live l JOIN fileone f ON f.repo = l.repo AND f.path = l.path),
    vec AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, id) AS rank FROM vsim)"""


def vector_arm(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """Chunks by the similarity of their file's centroid to the question's vector.

    The k best chunks lie in the k best of the files that have chunks, ties kept; only
    those files meet their chunks.
    """
    one = files(spark, sf_dir).groupBy("repo", "path").agg(F.min_by("vector", "vec_id").alias("vector"), F.min("vec_id").alias("row_id"))
    held = narrow(spark, sf_dir).select("repo", "path", "id")
    rows = one.join(held.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    near = search.nearest(questions(spark, sf_dir).select("query_id", "vector"), rows.select("row_id", "vector"), k, 64, skip_self=False, ties=True)
    best = near.select("query_id", "row_id", F.col("similarity").alias("score")).join(one.select("row_id", "repo", "path"), "row_id")
    scored = best.join(held, ["repo", "path"]).select("query_id", "repo", "id", "score")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "repo", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@query("T02_bm25", f"WITH {_BM25} SELECT query_id, repo, id, score, rank FROM lex WHERE rank <= 20")
def bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical(spark, sf_dir, questions(spark, sf_dir), 20)


@query("S14_vector_arm", f"WITH {LIVE}, {_USABLE}, {_Q}, {_VEC} SELECT query_id, repo, id, score, rank FROM vec WHERE rank <= 20")
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_arm(spark, sf_dir, 20)


_FUSED = f"""{_BM25}, {_VEC},
    arms AS (SELECT query_id, repo, id, score, rank, 0 AS arm FROM vec WHERE rank <= 60 UNION ALL SELECT query_id, repo, id, score, rank, 1 AS arm FROM lex WHERE rank <= 200),
    sums AS (SELECT query_id, repo, id, round(sum(1.0 / (60 + rank)), 9) AS fused, min_by(score, arm * 100000 + rank) AS score, min(arm * 100000 + rank) AS seen, count(DISTINCT arm) AS found_by FROM arms GROUP BY ALL),
    fused AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fused DESC, seen, repo, id) AS rank FROM sums)"""


def fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.fuse(vector_arm(spark, sf_dir, 60), lexical(spark, sf_dir, questions(spark, sf_dir), 200))


@query("A16_rrf", f"WITH {_FUSED} SELECT query_id, repo, id, fused, score, found_by, rank FROM fused")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused(spark, sf_dir)


_QUOTA = f"""{_FUSED}, kinded AS (SELECT f.query_id, f.repo, f.id, f.fused, f.found_by, f.rank, l.kind, l.text FROM fused f JOIN live l USING (repo, id)),
    late AS (SELECT *, CASE WHEN kind = 'commit' AND sum(CASE WHEN kind = 'commit' THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) > 2 THEN 1 ELSE 0 END AS late FROM kinded),
    placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY late, rank) AS place FROM late)"""


def narrow(spark: SparkSession, sf_dir: str, *more: Column) -> DataFrame:
    """The live chunks without their texts; what is made of a text (``more``) is made before the shuffle."""
    return store.live(table(spark, sf_dir, "chunks").select("repo", "id", "kind", "path", "start_line", "indexed_at", "deleted_at", *more))


def answers(spark: SparkSession, sf_dir: str, *more: Column, k: int = 10) -> DataFrame:
    ranked = fused(spark, sf_dir).join(narrow(spark, sf_dir, *more).drop("start_line", "indexed_at", "deleted_at"), ["repo", "id"])
    return search.within_quota(ranked, k)


@query("W02_quota", f"WITH {_QUOTA} SELECT query_id, repo, id, kind, place FROM placed WHERE place <= 10")
def quota(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers(spark, sf_dir).select("query_id", "repo", "id", "kind", "place")


@query("M07_search", f"WITH {_QUOTA} SELECT query_id, place, repo, id, round(fused, 6) AS fused, found_by FROM placed WHERE place <= 10")
def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: both arms, fusion, quota, first ten."""
    return answers(spark, sf_dir).select("query_id", "place", "repo", "id", F.round("fused", 6).alias("fused"), "found_by")


@query("F12_fit", f"""WITH {_QUOTA}, spent AS (SELECT query_id, repo, id, place, sum(CAST(ceil(length(text) / 3.0) AS BIGINT)) OVER (PARTITION BY query_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS spent FROM placed WHERE place <= 10)
    SELECT query_id, repo, id, place, CAST(spent AS BIGINT) AS spent FROM spent WHERE spent <= 1500""")
def fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = answers(spark, sf_dir, T.token_cost(F.col("text")).alias("cost")).withColumn("rank", F.col("place"))
    return search.fit(ranked, 1500, F.col("cost")).select("query_id", "repo", "id", "place", "spent")


@query("F11_json", f"""WITH {_QUOTA} SELECT query_id, place, '{{"repo":"' || p.repo || '","path":"' || l.path || '","kind":"' || l.kind || '","score":' || CAST(CAST(round(p.fused * 10000) AS BIGINT) AS VARCHAR) || '}}' AS hit
    FROM placed p JOIN live l USING (repo, id) WHERE place <= 10""")
def hit_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits as JSON; the score in ten-thousandths, so that both engines print it alike."""
    shape = F.struct("repo", "path", "kind", F.round(F.col("fused") * 10000).cast("bigint").alias("score"))
    return answers(spark, sf_dir).select("query_id", "place", F.to_json(shape).alias("hit"))


@query("M08_rerank")
def reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 12 k candidates scored again and fused with their former order."""
    base = cut(fused(spark, sf_dir).where(F.col("rank") <= 120).select("query_id", "repo", "id", "score", "rank"))
    texts = live(spark, sf_dir).select("repo", "id", "text")
    # The questions come first, so that the texts are not shuffled once more.
    asked = base.select("query_id", "repo", "id").join(questions(spark, sf_dir).select("query_id", "query_text"), "query_id")
    scored = search.rerank(asked.join(texts, ["repo", "id"]), search.OverlapReranker())
    return search.fuse(base, scored).select("query_id", "repo", "id", "rank", "found_by")


@query("M06_rewrite")
def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rewording answered in one lexical pass, then fused per question."""
    forms = search.rewritings(questions(spark, sf_dir)).withColumn("form_id", F.col("query_id") * 100 + F.col("n"))
    hits = lexical(spark, sf_dir, forms.select(F.col("form_id").alias("query_id"), "query_text"), 50)
    per_question = hits.withColumn("arm", F.col("query_id") % 100).withColumn("query_id", F.floor(F.col("query_id") / 100))
    sums = per_question.groupBy("query_id", "repo", "id").agg(F.round(F.sum(N.reciprocal_rank(F.col("rank"))), 9).alias("fused"))
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "repo", "id")
    return sums.withColumn("rank", F.row_number().over(order)).where("rank <= 20")


@query("M02_embed")
def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors only for the chunks that are new: the additions of the last half-year."""
    rows = live(spark, sf_dir)
    old = rows.where(F.col("indexed_at") < F.lit("2025-07-01").cast("timestamp"))
    return search.embed(store.additions(rows, old).select("repo", "id", "text"), "text", search.SeededEmbedder()).select("repo", "id", "vector")


_KNN = f"""WITH {_USABLE}, sims AS (SELECT a.vec_id AS query_id, b.vec_id AS row_id, {_COS.format(a='a.vector', b='b.vector')} AS similarity FROM usable a JOIN usable b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0 {{where}})
    SELECT query_id, row_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, row_id) AS rank FROM sims) WHERE rank <= 10"""


def _knn(f: DataFrame, rows: DataFrame) -> DataFrame:
    asked = f.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return search.nearest(asked, rows.select(F.col("vec_id").alias("row_id"), "vector"), 10, 64)


@query("T01_knn", _KNN.format(where=""))
def knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = files(spark, sf_dir)
    return _knn(f, f)


@query("F06_prefilter_knn", _KNN.format(where="AND b.path LIKE 'src/%' ESCAPE '\\'"))
def prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filter first, then the nearest of what is left."""
    f = files(spark, sf_dir)
    return _knn(f, f.where(T.matches_glob(F.col("path"), "src/**")))


@query("W03_top_per_repo", f"""WITH {_USABLE}, sims AS (SELECT a.vec_id AS query_id, b.repo, b.vec_id AS row_id, {_COS.format(a='a.vector', b='b.vector')} AS similarity FROM usable a CROSS JOIN usable b WHERE a.vec_id % 50 = 0)
    SELECT query_id, repo, row_id, similarity, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, repo ORDER BY similarity DESC, row_id) AS rank FROM sims) WHERE rank <= 5""")
def top_per_repo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest files of every repository to every file asked."""
    f = files(spark, sf_dir)
    asked = f.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("query_id"), "vector")
    return search.nearest(asked, f.select(F.col("vec_id").alias("row_id"), "repo", "vector"), 5, 64, per="repo", skip_self=False)


@query("K08_stored_index", f"WITH {_BM25} SELECT query_id, repo, id, score, rank FROM lex WHERE rank <= 20")
def stored_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexical index written to the shared folder once, and searched by its terms."""
    path = shared_folder(spark, "lexical")
    # In ranges of the repositories, which the choice of the live rows keeps, a block of the index is long.
    rows = table(spark, sf_dir, "chunks").select("repo", "id", "kind", "path", "start_line", "indexed_at", "deleted_at", "text").repartitionByRange("repo", "id")
    search.store_index(store.live(rows), path)
    return search.lexical_stored(spark, path, questions(spark, sf_dir), 20)


@query("F01_lang_kind", f"WITH {LIVE} SELECT repo, id FROM live WHERE lang IN ('python', 'go') AND kind IN ('code')")
def lang_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).where(store.SearchFilter(lang=("python", "go"), kind=("code",)).predicate()).select("repo", "id")


@query("F02_path_glob", f"WITH {LIVE} SELECT repo, id, path FROM live WHERE path LIKE 'src/%\\_%.p_' ESCAPE '\\' OR path LIKE '%.md' ESCAPE '\\'")
def path_glob(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).where(store.SearchFilter(path=("src/**_*.p?", "*.md")).predicate()).select("repo", "id", "path")


@query("F03_symbol", f"WITH {LIVE} SELECT repo, id, symbol FROM live WHERE symbol LIKE '%window%' ESCAPE '\\'")
def symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).where(store.SearchFilter(symbol=("window",)).predicate()).select("repo", "id", "symbol")


@query("F05_no_history", f"WITH {LIVE} SELECT repo, count(*) AS n FROM live WHERE kind <> 'commit' GROUP BY repo")
def no_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return live(spark, sf_dir).where("kind <> 'commit'").groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query("F09_retrieval_text", f"""WITH {LIVE} SELECT repo, id, md5(CASE WHEN kind = 'commit' THEN text ELSE trim(regexp_replace(concat_ws(' ', symbol, path), '[/_.\\-]+', ' ', 'g'), ' ') || chr(10) || text END) AS digest FROM live""")
def retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = T.retrieval_text(F.col("kind"), F.col("path"), F.col("symbol"), F.col("text"))
    return live(spark, sf_dir).select("repo", "id", F.md5(F.encode(made, "UTF-8")).alias("digest"))


@query("F13_covering", f"""WITH {LIVE} SELECT repo, id, start_line, end_line, row_number() OVER (ORDER BY end_line - start_line, symbol IS NULL, repo, id) AS rank FROM live
    WHERE path = 'src/throttle_symbol/build_canvas.go' AND start_line <= 20 AND end_line >= 20""")
def covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.covering(live(spark, sf_dir), "src/throttle_symbol/build_canvas.go", 20).select("repo", "id", "start_line", "end_line", "rank")


@query("A15_corpus_stats", f"""WITH {LIVE}, docs AS (SELECT repo, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS words FROM live WHERE kind <> 'commit')
    SELECT repo, count(*) AS docs, CAST(sum(len(words)) AS BIGINT) AS words, round(avg(len(words)), 6) AS mean_length FROM docs GROUP BY repo""")
def corpus_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = live(spark, sf_dir).where("kind <> 'commit'").select("repo", F.size(T.tokens(F.col("text"))).alias("n"))
    return docs.groupBy("repo").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("words"), F.round(F.avg("n"), 6).alias("mean_length"))


@query("K08_postings", f"""WITH {LIVE}, flat AS (SELECT repo, id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM live WHERE kind <> 'commit')
    SELECT term, count(DISTINCT (repo, id)) AS df, count(*) AS tf FROM flat GROUP BY term""")
def term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document and collection frequency of every term of the index."""
    return search.postings(live(spark, sf_dir)).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("tf"))


_EVAL = f"""WITH {LIVE}, e AS (SELECT item_id AS query_id, suite, text AS query_text, regexp_extract(answer_path, '^([^/]+)/', 1) AS repo, regexp_extract(answer_path, '^[^/]+/(.*)$', 1) AS path FROM eval_items),
    docs AS (SELECT repo, id, path, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+') AS words FROM live WHERE kind <> 'commit'),
    stats AS (SELECT count(*) AS docs, avg(len(words)) AS mean_length FROM docs),
    terms AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query_text), '[\\p{{L}}\\p{{N}}_]+')) AS term FROM e),
    flat AS (SELECT repo, id, len(words) AS length, unnest(words) AS term FROM docs),
    hits AS (SELECT term, repo, id, length, count(*) AS tf FROM flat WHERE term IN (SELECT term FROM terms) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
    bm AS (SELECT query_id, repo, id, round(sum(ln(1.0 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / mean_length)))), 6) AS score FROM hits JOIN df USING (term) CROSS JOIN stats JOIN terms USING (term) GROUP BY ALL),
    lex AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, repo, id) AS rank FROM bm) WHERE rank <= 50),
    r AS (SELECT e.query_id, e.suite, min(lex.rank) AS rank FROM e LEFT JOIN (SELECT lex.query_id, lex.rank, l.repo, l.path FROM lex JOIN live l USING (repo, id)) lex ON lex.query_id = e.query_id AND lex.repo = e.repo AND lex.path = e.path GROUP BY ALL)"""


def _evaluated(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "eval_items")
    asked = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query_text"))
    truths = items.select(
        F.col("item_id").alias("query_id"), F.regexp_extract("answer_path", "^([^/]+)/", 1).alias("repo"), F.regexp_extract("answer_path", "^[^/]+/(.*)$", 1).alias("path")
    )
    rows = live(spark, sf_dir)
    hits = search.lexical(rows, asked, 50).join(rows.select("repo", "id", "path"), ["repo", "id"])
    return stats.truth_ranks(hits, truths).join(items.select(F.col("item_id").alias("query_id"), "suite"), "query_id")


@query("A20_hit_rates", _EVAL + """ SELECT suite, count(*) AS questions, count(CASE WHEN rank <= 1 THEN 1 END) AS hit_1, count(CASE WHEN rank <= 3 THEN 1 END) AS hit_3, count(CASE WHEN rank <= 10 THEN 1 END) AS hit_10 FROM r GROUP BY suite""")
def hit_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.hit_rates(_evaluated(spark, sf_dir), ["suite"])


@query("A21_mcnemar")
def mcnemar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lexical search against itself with every other word only: discordant pairs and their p value."""
    items = table(spark, sf_dir, "eval_items")
    ours = _evaluated(spark, sf_dir)
    rows = live(spark, sf_dir)
    short = items.select(F.col("item_id").alias("query_id"), F.array_join(F.filter(F.split("text", " "), lambda w, i: i % 2 == 0), " ").alias("query_text"))
    truths = items.select(F.col("item_id").alias("query_id"), F.regexp_extract("answer_path", "^([^/]+)/", 1).alias("repo"), F.regexp_extract("answer_path", "^[^/]+/(.*)$", 1).alias("path"))
    theirs = stats.truth_ranks(search.lexical(rows, short, 50).join(rows.select("repo", "id", "path"), ["repo", "id"]), truths)
    return stats.discordant(ours, theirs, 10).select("*", F.round(N.mcnemar(F.col("only_ours"), F.col("only_theirs")), 9).alias("p"))
