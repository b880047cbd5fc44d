"""Batched retrieval: lexical arm, vector arm, rank fusion, quota, budget.

Every function takes a table of queries, so one plan answers many queries.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tallyweave.functions import numbers as N
from tallyweave.functions import text as T
from tallyweave.session import cut

#: Okapi parameters and the constant of reciprocal rank fusion.
K1, B, RRF_K = 1.2, 0.75, 60
#: Up to so many query terms, and pairs of a query and a term, are sent to every executor;
#: up to so many terms are named in the filter of a stored index.
MOST_TERMS, MOST_CELLS, MOST_NAMED = 200_000, 2_000_000, 5_000
#: Documents that are packed into a row, that one task scores, and whose scores of a query are
#: summed at once; sets of terms that are scored in one pass over the documents.
BLOCK_DOCS, SLAB_DOCS, WIDE_DOCS, MOST_SETS = 1 << 14, 1 << 18, 1 << 15, 1 << 15
#: At most this share of an answer is history.
COMMIT_SHARE = 0.2


def postings(chunks: DataFrame) -> DataFrame:
    """(repo, id, term, tf, length) of all chunks but commits."""
    words = chunks.where(F.col("kind") != "commit").select("repo", "id", T.tokens(F.col("text")).alias("words"))
    return (
        words.select("repo", "id", F.size("words").alias("length"), F.explode("words").alias("term"))
        .groupBy("repo", "id", "length", "term")
        .agg(F.count(F.lit(1)).alias("tf"))
    )


#: The words of the lexical index, as ``T.tokens`` finds them in lower-case text.
_WORDS = re.compile(r"\w+")


def _counted(terms: list[str], kept: list[str]):
    """Batches with a text to the kept columns with its length in words and the wanted terms, by number, with their counts."""
    number = {t: n for n, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, ts, tfs = [], [], []
            for text in batch.column("text").to_pylist():
                words = _WORDS.findall(text.lower()) if text is not None else []
                found = Counter(n for n in map(number.get, words) if n is not None)
                lengths.append(None if text is None else len(words))
                ts.append(list(found.keys()))
                tfs.append(list(found.values()))
            made = [pa.array(lengths, pa.int32()), pa.array(ts, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], names=[*kept, "length", "t", "tf"])

    return run


#: A row per block: how many documents and words it has; the documents that hold asked terms; and
#: the postings: numbers of terms, places of documents within the block, counts.
_BLOCK = "docs bigint, measured bigint, words bigint, repo array<string>, id array<string>, length array<int>, t array<int>, d array<int>, tf array<int>"


def _packed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(repo, id, length, t, tf) to blocks."""
    for whole in batches:
        for at in range(0, len(whole), BLOCK_DOCS):
            pdf = whole.iloc[at : at + BLOCK_DOCS]
            sizes = pdf["t"].map(len).to_numpy()
            held = pdf[sizes > 0]
            none = np.zeros(0, dtype=np.int32)
            t, tf = (np.concatenate(held[c].to_numpy()) if len(held) else none for c in ("t", "tf"))
            yield pd.DataFrame(
                {"docs": [len(pdf)], "measured": [int(pdf["length"].count())], "words": [int(pdf["length"].sum())]}
                | {c: [held[c].to_numpy()] for c in ("repo", "id")}
                | {"length": [held["length"].to_numpy(np.int32)], "t": [t], "d": [np.repeat(np.arange(len(held), dtype=np.int32), sizes[sizes > 0])], "tf": [tf]}
            )


def _top(sims: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k largest per row above ``least``, with all ties of the k-th."""
    width = sims.shape[1]
    kth = np.partition(sims, width - k, axis=1)[:, width - k] if k < width else np.full(len(sims), -np.inf)
    return np.nonzero((sims >= kth[:, None] - 1e-9) & (sims > least))


def _scored(sets: list[np.ndarray], first: int, idf: np.ndarray, mean: float, k: int):
    """BM25 of every set of terms, numbered from ``first``, over the blocks of a partition: of
    the whole partition exactly the k best of every set leave, by score, repository and id."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        blocks = [x for pdf in batches for x in pdf.itertuples() if len(x.id)]
        if not blocks:
            return
        repo, name, length = (np.concatenate([getattr(x, c) for x in blocks]) for c in ("repo", "id", "length"))
        n = len(name)
        order = np.array(sorted(range(n), key=lambda i: (repo[i], name[i])), dtype=np.int64)
        place = np.empty(n, dtype=np.int64)
        place[order] = np.arange(n)
        starts = np.cumsum([0, *(len(x.id) for x in blocks)])
        doc = np.concatenate([place[at + x.d] for at, x in zip(starts, blocks, strict=False)])
        t, tf = (np.concatenate([getattr(x, c) for x in blocks]).astype(np.int64) for c in ("t", "tf"))
        gain = idf[t] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length[order][doc] / mean)))
        key = t * n + doc
        by = np.argsort(key)
        key, doc, gain = key[by], doc[by], gain[by]
        none = np.zeros(0), np.zeros(0, dtype=np.int64)
        best, least = [none] * len(sets), np.full(len(sets), -1.0)
        every = np.arange(len(idf)) * n
        for at in range(0, n, WIDE_DOCS):
            wide = min(WIDE_DOCS, n - at)
            begin, end = np.searchsorted(key, every + at).tolist(), np.searchsorted(key, every + at + wide).tolist()
            for g, terms in enumerate(sets):
                runs = [(begin[x], end[x]) for x in terms if begin[x] < end[x]]
                if not runs:
                    continue
                sums = np.bincount(np.concatenate([doc[a:b] for a, b in runs]) - at, np.concatenate([gain[a:b] for a, b in runs]), wide)
                some = np.flatnonzero(sums > max(0.0, least[g] - 1e-6))
                scores = np.round(sums[some], 6)
                # Later documents have later names, so an equal score comes too late.
                better = scores > least[g]
                if better.any():
                    scores, docs = np.concatenate([best[g][0], scores[better]]), np.concatenate([best[g][1], some[better] + at])
                    if len(scores) >= k:
                        top = np.lexsort((docs, -scores))[:k]
                        scores, docs = scores[top], docs[top]
                        least[g] = scores[-1]
                    best[g] = scores, docs
        for at in range(0, len(sets), 512):
            part = best[at : at + 512]
            docs = order[np.concatenate([d for _, d in part])]
            numbers = np.repeat(np.arange(first + at, first + at + len(part)), [len(d) for _, d in part])
            yield pd.DataFrame({"g": numbers, "repo": repo[docs], "id": name[docs], "score": np.concatenate([x for x, _ in part])})

    return run


def lexical(chunks: DataFrame, queries: DataFrame, k: int, current: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """BM25 top k per query: (query_id, repo, id, score, rank), over all chunks but commits.

    ``current`` picks the rows that count; it sees them with their terms counted in
    place of the text, so that no text is shuffled. A batch of queries of at most
    MOST_TERMS terms and MOST_CELLS pairs is scored where the documents lie; a larger
    one meets them in a shuffle.
    """
    terms = _terms(queries)
    pairs = _few(terms)
    if pairs is None:
        rows = current(chunks) if current else chunks
        return _lexical_joined(rows.where(F.col("kind") != "commit").select("repo", "id", T.tokens(F.col("text")).alias("words")), terms, k)
    wanted = sorted(pairs["term"].unique())
    kept = [c for c in chunks.columns if c != "text"] if current else ["repo", "id", "kind"]
    schema = StructType([*(chunks.schema[c] for c in kept), *StructType.fromDDL("length int, t array<int>, tf array<int>")])
    counted = chunks.select(*kept, "text").mapInArrow(_counted(wanted, kept), schema)
    counted = (current(counted) if current else counted).where(F.col("kind") != "commit").select("repo", "id", "length", "t", "tf")
    return _best(cut(counted.mapInPandas(_packed, _BLOCK)), pairs, wanted, k)


def _terms(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("query_text")))).alias("term")).distinct()


def _few(terms: DataFrame) -> pd.DataFrame | None:
    """The pairs of queries and terms, null if there are too many to send them around."""
    bound = terms.agg(F.count_distinct("term").alias("terms"), F.count(F.lit(1)).alias("pairs")).first()
    return None if bound.terms > MOST_TERMS or bound.pairs > MOST_CELLS else terms.toPandas()


def _best(blocks: DataFrame, pairs: pd.DataFrame, wanted: list[str], k: int, stats: DataFrame | None = None) -> DataFrame:
    """The k best of every query from checkpointed blocks; queries of the same terms are scored once."""
    spark = blocks.sparkSession
    total = (blocks if stats is None else stats).agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("measured")).alias("mean")).first()
    df = np.zeros(len(wanted))
    for t, n in blocks.select(F.explode("t").alias("t")).groupBy("t").count().toLocalIterator():
        df[t] = n
    idf = np.log(1.0 + ((total.docs or 0) - df + 0.5) / (df + 0.5))
    number = {t: n for n, t in enumerate(wanted)}
    numbers = pairs["term"].map(number).to_numpy(np.int64)
    found = pairs.assign(t=numbers)[df[numbers] > 0].sort_values("t")
    groups: dict[tuple, list[int]] = {}
    for q, ts in found.groupby("query_id")["t"]:
        groups.setdefault(tuple(ts), []).append(q)
    sets = [np.array(ts) for ts in groups]
    # Checkpointed partitions are read together, without a shuffle.
    slabs = blocks.coalesce(max(spark.sparkContext.defaultParallelism, -(-(total.docs or 0) // SLAB_DOCS)))
    scored = None
    for at in range(0, max(1, len(sets)), MOST_SETS):
        part = slabs.mapInPandas(_scored(sets[at : at + MOST_SETS], at, idf, total.mean or 1.0, k), "g bigint, repo string, id string, score double")
        scored = part if scored is None else scored.unionByName(part)
    order = Window.partitionBy("g").orderBy(F.desc("score"), "repo", "id")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    asked = pd.DataFrame([(g, int(q)) for g, qs in enumerate(groups.values()) for q in qs], columns=["g", "query_id"], dtype="int64")
    return ranked.join(F.broadcast(spark.createDataFrame(asked, "g bigint, query_id bigint")), "g").select("query_id", "repo", "id", "score", "rank")


def _lexical_joined(docs: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """The same for any number of terms: postings of the asked terms meet the queries in joins."""
    docs = docs.withColumn("length", F.size("words"))
    stats = docs.agg(F.count(F.lit(1)).alias("docs"), F.avg("length").alias("mean_length"))
    found = docs.select("repo", "id", "length", F.explode("words").alias("term")).join(terms.select("term").distinct(), "term", "left_semi")
    return _ranked(found.groupBy("term", "repo", "id", "length").agg(F.count(F.lit(1)).alias("tf")), stats, terms, k)


def _ranked(hits: DataFrame, stats: DataFrame, terms: DataFrame, k: int) -> DataFrame:
    """Scores of postings (term, repo, id, length, tf) of the asked terms."""
    hits = cut(hits)
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(F.lit(1.0) + (F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    gain = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.col("mean_length")))
    scored = (
        hits.join(df, "term").crossJoin(F.broadcast(stats)).withColumn("gain", idf * gain)  # stats: one row
        .join(terms, "term")
        .groupBy("query_id", "repo", "id")
        .agg(F.round(F.sum("gain"), 6).alias("score"))
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "repo", "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


#: Bytes of a row group of the stored index: the unit that is read or skipped.
INDEX_GROUP = 8 << 20


_STORED = "block string, term string, doc array<int>, tf array<int>, id array<string>, length array<int>, repo string"


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(repo, id, text) in the order of the repositories to rows of the stored index, see ``store_index``."""
    whole, words, numbers = pa.string(), pa.list_(pa.string()), pa.list_(pa.int32())

    def rows(repo: str, ids: list[str], texts: list[str | None]) -> pa.RecordBatch:
        docs, counts, lengths = defaultdict(list), defaultdict(list), []
        for at, text in enumerate(texts):
            found = _WORDS.findall(text.lower()) if text is not None else []
            lengths.append(None if text is None else len(found))
            for term, tf in Counter(found).items():
                docs[term].append(at)
                counts[term].append(tf)
        blank, size = [None] * len(docs), len(docs) + 1
        columns = [([uuid.uuid4().hex] * size, whole), ([None, *docs], whole), ([None, *docs.values()], numbers), ([None, *counts.values()], numbers), ([ids, *blank], words), ([lengths, *blank], numbers), ([repo] * size, whole)]
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in columns], names=[c.split()[0] for c in _STORED.split(", ")])

    repo, ids, texts = None, [], []
    for batch in batches:
        for r, i, t in zip(*(batch.column(c).to_pylist() for c in ("repo", "id", "text")), strict=True):
            if ids and (r != repo or len(ids) == BLOCK_DOCS):
                yield rows(repo, ids, texts)
                ids, texts = [], []
            repo = r
            ids.append(i)
            texts.append(t)
    if ids:
        yield rows(repo, ids, texts)


def store_index(chunks: DataFrame, path: str) -> None:
    """Write the lexical index of chunks by repository, every file in the order of its terms and
    with a Bloom filter over them, and the statistics of every repository. A row holds the
    postings of a term in a block of documents: their places in the block, and counts; the row
    without a term holds the ids and lengths of the block. Nothing is shuffled, so chunks of many
    repositories should come in ranges of them. Repositories that are not among the chunks stay."""
    replace = lambda df: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo")
    docs = chunks.where(F.col("kind") != "commit").select("repo", "id", "text").sortWithinPartitions("repo", "id")
    rows = docs.mapInArrow(_indexed, _STORED).sortWithinPartitions("repo", "term")
    replace(rows).option("parquet.block.size", INDEX_GROUP).option("parquet.bloom.filter.enabled#term", "true").parquet(f"{path}/postings")
    stored = stored_postings(chunks.sparkSession, path, [])
    sizes = stored.select("repo", F.size("id").alias("docs"), F.filter("length", lambda x: x.isNotNull()).alias("x"))
    sums = sizes.select("repo", "docs", F.size("x").alias("measured"), F.aggregate("x", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("words"))
    replace(sums.groupBy("repo").agg(*(F.sum(c).alias(c) for c in ("docs", "measured", "words")))).parquet(f"{path}/stats")


def stored_postings(spark: SparkSession, path: str, terms: list[str] | None, repo: str | None = None) -> DataFrame:
    """Rows of the named terms (null: all), and of the documents: files of other repositories are not
    opened, row groups without the terms, by their bounds and Bloom filters, not read."""
    rows = spark.read.schema(_STORED).parquet(f"{path}/postings")
    if repo is not None:
        rows = rows.where(F.col("repo") == repo)
    return rows if terms is None else rows.where(F.col("term").isNull() | F.col("term").isin(terms) if terms else F.col("term").isNull())


def _asked(terms: list[str]):
    """The rows of a block of the stored index to a block for scoring."""
    number = {t: n for n, t in enumerate(terms)}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        docs = pdf[pdf["term"].isna()].iloc[0]
        found = pdf[pdf["term"].isin(number)]
        none = np.zeros(0, dtype=np.int32)
        d, tf = (np.concatenate(found[c].to_numpy()).astype(np.int32) if len(found) else none for c in ("doc", "tf"))
        t = np.repeat(found["term"].map(number).to_numpy(np.int32), found["doc"].map(len).to_numpy(int)) if len(found) else none
        held, d = np.unique(d, return_inverse=True)
        lengths = np.array([0 if x is None or x != x else x for x in docs["length"]], dtype=np.int32)
        return pd.DataFrame({"docs": [0], "measured": [0], "words": [0], "repo": [[docs["repo"]] * len(held)], "id": [np.asarray(docs["id"], dtype=object)[held]], "length": [lengths[held]], "t": [t], "d": [d.astype(np.int32)], "tf": [tf]})

    return run


def lexical_stored(spark: SparkSession, path: str, queries: DataFrame, k: int, repo: str | None = None) -> DataFrame:
    """BM25 from a stored index, over all repositories or one."""
    terms = _terms(queries)
    # The schema keeps names of repositories strings, whatever they look like.
    stats = spark.read.schema("docs bigint, measured bigint, words bigint, repo string").parquet(f"{path}/stats")
    stats = stats if repo is None else stats.where(F.col("repo") == repo)
    pairs = _few(terms)
    if pairs is None:
        rows = stored_postings(spark, path, None, repo)
        held = rows.where(F.col("term").isNotNull()).join(terms.select("term").distinct(), "term", "left_semi")
        flat = held.select("repo", "block", "term", F.explode(F.arrays_zip("doc", "tf")).alias("x")).select("repo", "block", "term", F.col("x.doc").alias("doc"), F.col("x.tf").alias("tf"))
        docs = rows.where(F.col("term").isNull()).select("repo", "block", F.posexplode(F.arrays_zip("id", "length")).alias("doc", "x")).select("repo", "block", "doc", F.col("x.id").alias("id"), F.col("x.length").alias("length"))
        whole = stats.agg(F.sum("docs").alias("docs"), (F.sum("words") / F.sum("measured")).alias("mean_length"))
        return _ranked(flat.join(docs, ["repo", "block", "doc"]).select("term", "repo", "id", "length", "tf"), whole, terms, k)
    wanted = sorted(pairs["term"].unique())
    rows = stored_postings(spark, path, wanted if len(wanted) <= MOST_NAMED else None, repo)
    if len(wanted) > MOST_NAMED:
        asked = terms.select("term").distinct()
        rows = rows.where(F.col("term").isNull()).unionByName(rows.join(asked, "term", "left_semi"))
    return _best(cut(rows.groupBy("repo", "block").applyInPandas(_asked(wanted), _BLOCK)), pairs, wanted, k, stats)


def _block_search(k: int, dim: int, skip_self: bool, per: str | None):
    def run(key, queries: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        columns = ["query_id", "row_id", *([per] if per else [])]
        if not len(queries) or not len(rows):
            none = {"query_id": queries["query_id"].iloc[:0], "row_id": rows["row_id"].iloc[:0], **({per: rows[per].iloc[:0]} if per else {})}
            return pd.DataFrame({**none, "similarity": np.zeros(0)})
        q = np.stack(queries["vector"].to_numpy()).astype(np.float64)
        r = np.stack(rows["vector"].to_numpy()).astype(np.float64)
        q /= np.linalg.norm(q, axis=1, keepdims=True)
        r /= np.linalg.norm(r, axis=1, keepdims=True)
        owners, ids = queries["query_id"].to_numpy(), rows["row_id"].to_numpy()
        groups = [g.to_numpy() for _, g in pd.Series(np.arange(len(rows))).groupby(rows[per].to_numpy(), dropna=False)] if per else [np.arange(len(rows))]
        out = []
        for at in range(0, len(q), 512):
            sims = q[at : at + 512] @ r.T
            if skip_self:
                sims[owners[at : at + 512, None] == ids[None, :]] = -np.inf
            for g in groups:
                # All ties of the k-th place stay, so that the merge can order them.
                i, j = _top(sims[:, g], k, -np.inf)
                out.append(pd.DataFrame({"query_id": owners[at + i], "row_id": ids[g[j]], **({per: rows[per].to_numpy()[g[j]]} if per else {}), "similarity": sims[i, g[j]]}))
        return pd.concat(out)[[*columns, "similarity"]]

    return run


def nearest(
    queries: DataFrame, rows: DataFrame, k: int, dim: int, block_rows: int = 8192, within: str | None = None, per: str | None = None, skip_self: bool = True, ties: bool = False
) -> DataFrame:
    """Exact cosine top k per query: (query_id, row_id, similarity, rank).

    Both sides (query_id / row_id, vector) are cut into blocks of bounded size;
    each pair of blocks is one matrix product, and k per query and block move on.
    A query does not find itself unless ``skip_self`` is off. ``within`` restricts
    both sides to equal values of a column, whose groups are cut into blocks alike;
    ``per`` gives the k best for every value of a column of the rows. With ``ties``
    all rows as similar as the k-th are kept and ``rank`` has gaps.
    """
    by = [within] if within else []
    kept = [per] if per else []
    # Fresh names keep both sides apart when they come from one table.
    fresh = lambda *c: [F.col(x).alias(x) for x in c]
    q = queries.where(N.usable(F.col("vector"), dim)).dropDuplicates(["query_id"]).select(*fresh("query_id", *by, "vector"))
    r = rows.where(N.usable(F.col("vector"), dim)).dropDuplicates(["row_id"]).select(*fresh("row_id", *by, *kept, "vector"))
    rb = max(1, -(-r.count() // block_rows))
    qb = max(1, -(-q.count() // block_rows))
    q = q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(qb))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(rb - 1))))
    r = r.withColumn("rb", F.pmod(F.xxhash64("row_id"), F.lit(rb)).cast("int")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(qb - 1)))).withColumn("qb", F.col("qb").cast("bigint"))
    kind = lambda df, c: df.schema[c].dataType.simpleString()
    schema = f"query_id {kind(queries, 'query_id')}, row_id {kind(rows, 'row_id')}, " + (f"{per} {kind(rows, per)}, " if per else "") + "similarity double"
    found = q.groupBy(*by, "qb", "rb").cogroup(r.groupBy(*by, "qb", "rb")).applyInPandas(_block_search(k, dim, skip_self, per), schema).withColumn("similarity", F.round("similarity", 6))
    order = Window.partitionBy("query_id", *kept).orderBy(F.desc("similarity"), *([] if ties else ["row_id"]))
    return found.withColumn("rank", (F.rank() if ties else F.row_number()).over(order)).where(F.col("rank") <= k)


def fuse(*arms: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of (query_id, repo, id, score, rank) lists.

    The score and place of the first arm that saw a hit are kept; equal sums keep
    the order in which the hits were first seen.
    """
    rows = None
    for n, arm in enumerate(arms):
        part = arm.select("query_id", "repo", "id", "score", "rank", F.lit(n).alias("arm"))
        rows = part if rows is None else rows.unionByName(part)
    seen = F.struct("arm", "rank")
    fused = rows.groupBy("query_id", "repo", "id").agg(
        F.round(F.sum(N.reciprocal_rank(F.col("rank"), k)), 9).alias("fused"),
        F.min_by("score", seen).alias("score"),
        F.min(seen).alias("seen"),
        F.count_distinct("arm").alias("found_by"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("fused"), "seen", "repo", "id")
    return fused.withColumn("rank", F.row_number().over(order)).drop("seen")


def within_quota(ranked: DataFrame, k: int, share: float = COMMIT_SHARE) -> DataFrame:
    """The first k of each query with at most max(1, k * share) commits among them.

    ``ranked`` has query_id, rank and kind; what the quota puts back fills up the
    places that are left.
    """
    most = max(1, int(k * share))
    commit = (F.col("kind") == "commit").cast("int")
    nth = F.sum(commit).over(Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
    rows = ranked.withColumn("__late", ((commit == 1) & (nth > most)).cast("int"))
    order = Window.partitionBy("query_id").orderBy("__late", "rank")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("__late")


def fit(ranked: DataFrame, budget: int, cost: Column | None = None) -> DataFrame:
    """The longest prefix of each answer whose token costs (null: those of its text) stay within the budget."""
    order = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    spent = ranked.withColumn("spent", F.sum(T.token_cost(F.col("text")) if cost is None else cost).over(order))
    return spent.where(F.col("spent") <= budget)


class Reranker:
    """Scores (query, text) pairs; subclass and set ``score``."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        raise NotImplementedError


class OverlapReranker(Reranker):
    """Share of the query's words that a text holds; needs no model."""

    def score(self, query: str, texts: list[str]) -> list[float]:
        wanted = set(query.lower().split())
        return [len(wanted & set(t.lower().split())) / max(1, len(wanted)) for t in texts]


def rerank(candidates: DataFrame, ranker: Reranker) -> DataFrame:
    """Score the (already cut) candidates (query_id, query_text, repo, id, text) in batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (qid, query), part in pdf.groupby(["query_id", "query_text"], sort=False):
                yield pd.DataFrame({"query_id": qid, "repo": part["repo"], "id": part["id"], "score": ranker.score(query, part["text"].tolist())})

    scored = candidates.select("query_id", "query_text", "repo", "id", "text").mapInPandas(run, "query_id bigint, repo string, id string, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "repo", "id")
    return scored.withColumn("rank", F.row_number().over(order))


class Embedder:
    """Turns texts into vectors; subclass and set ``dim`` and ``embed``."""

    dim = 8

    def embed(self, texts: list[str]) -> list[list[float]]:
        raise NotImplementedError


class SeededEmbedder(Embedder):
    """Normal numbers seeded by a hash of the text: the same text, the same vector."""

    def __init__(self, dim: int = 8) -> None:
        self.dim = dim

    def embed(self, texts: list[str]) -> list[list[float]]:
        import hashlib

        out = []
        for t in texts:
            seed = int.from_bytes(hashlib.sha256(t.encode("utf-8", "surrogatepass")).digest()[:8], "big")
            out.append(np.random.default_rng(seed).normal(size=self.dim).tolist())
        return out


class LastTexts(Embedder):
    """Another embedder whose last answer is kept: the same question asked again costs nothing."""

    def __init__(self, inner: Embedder) -> None:
        self.inner, self.dim = inner, inner.dim
        self.last: tuple[list[str], list[list[float]]] | None = None

    def embed(self, texts: list[str]) -> list[list[float]]:
        if self.last is None or self.last[0] != texts:
            self.last = (list(texts), self.inner.embed(texts))
        return self.last[1]


def embed(rows: DataFrame, column: str, embedder: Embedder) -> DataFrame:
    """Add a ``vector`` column; run after every filter that can drop rows."""

    @F.pandas_udf("array<double>")
    def vectors(texts: pd.Series) -> pd.Series:
        return pd.Series(embedder.embed(texts.tolist()))

    return rows.withColumn("vector", vectors(F.col(column)))


def rewritings(queries: DataFrame, count: int = 3) -> DataFrame:
    """The query itself and rewordings made of its words: (query_id, n, query_text)."""
    words = F.filter(F.split(F.lower("query_text"), r"\s+"), lambda w: F.length(w) >= 3)
    forms = F.array(F.col("query_text"), F.array_join(words, " "), F.array_join(F.reverse(words), " "), F.array_join(words, "_"))
    return queries.select("query_id", F.posexplode(F.array_distinct(F.slice(forms, 1, count + 1))).alias("n", "query_text"))
