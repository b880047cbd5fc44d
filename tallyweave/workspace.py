"""The engine as one object: index repositories, ask questions, read reports.

Tables live as parquet folders under the store; every method returns a DataFrame.
A pass replaces the partitions of the repositories it read and no others.
"""

from __future__ import annotations

import json
import time
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.config import Config
from tallyweave.functions import text as T
from tallyweave.operators import chunking, duplicates, links, search, stats, store
from tallyweave.session import cut
from tallyweave.sources import files, git, manifests
from tallyweave.streaming.flows import full_pass_reason

SEARCHES = "searched_at timestamp, query_text string, k int, repo string, hits int, top_score double, ms double, reranked boolean"


class Workspace:
    def __init__(self, spark: SparkSession, config: Config, embedder: search.Embedder | None = None, reranker: search.Reranker | None = None) -> None:
        self.spark, self.config = spark, config
        self.embedder, self.reranker = search.LastTexts(embedder or search.SeededEmbedder()), reranker

    # -- tables ---------------------------------------------------------
    def _path(self, name: str) -> str:
        return f"{self.config.store}/{name}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self._path(name))

    def _fs(self, path: str):
        here = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return here.getFileSystem(self.spark._jsc.hadoopConfiguration()), here

    def _replace(self, name: str, rows: DataFrame, repo: str) -> None:
        """Replace the partition of a repository; one without rows goes."""
        rows = cut(rows)
        if not rows.take(1):
            fs, here = self._fs(f"{self._path(name)}/repo={repo}")
            fs.delete(here, True)
            return
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("repo").parquet(self._path(name))

    def _state(self) -> dict:
        fs, here = self._fs(self._path("state.json"))
        if not fs.exists(here):
            return {}
        return json.loads("\n".join(r.value for r in self.spark.read.text(self._path("state.json")).collect()))

    def _save_state(self, state: dict) -> None:
        fs, fresh = self._fs(self._path("state.json.tmp"))
        out = fs.create(fresh, True)
        out.write(json.dumps(state, sort_keys=True).encode())
        out.close()
        _, here = self._fs(self._path("state.json"))
        fs.delete(here, False)
        fs.rename(fresh, here)

    # -- index ------------------------------------------------------------
    def index(self) -> DataFrame:
        """Read what changed and renew its chunks and links; (repo, reason, read, embedded, chunks) per repository read.

        One pass at a time: while another one runs this is refused, not queued.
        """
        fs, lock = self._fs(self._path("writer.lock"))
        if not fs.createNewFile(lock):
            raise RuntimeError(f"another pass writes {self.config.store}; remove {lock} if none does")
        try:
            return self._index()
        finally:
            fs.delete(lock, False)

    def _index(self) -> DataFrame:
        state, done = self._state(), []
        git.register(self.spark)
        for r in self.config.repositories:
            head, dirty = git.head(r.path), git.is_dirty(r.path)
            saved = state.get(r.id, {})
            reason = full_pass_reason(saved.get("commit"), saved.get("markup"), r.markup_key, dirty)
            if reason is None and saved["commit"] == head:
                continue
            if reason is None and not git.knows(r.path, saved["commit"]):
                reason = "history rewritten"
            read, embedded = self._index_one(r, None if reason else saved["commit"])
            done.append((r.id, reason or "new commits", read, embedded))
            if not dirty:
                state[r.id] = {"commit": head, "markup": r.markup_key}
                self._save_state(state)
        report = self.spark.createDataFrame(done, "repo string, reason string, read bigint, embedded bigint")
        return report.join(self.table("chunks").groupBy("repo").agg(F.count(F.lit(1)).alias("chunks")), "repo", "left") if done else report.withColumn("chunks", F.lit(0).cast("bigint"))

    def _stored(self, name: str, repo: str) -> DataFrame | None:
        fs, here = self._fs(f"{self._path(name)}/repo={repo}")
        return self.table(name).where(F.col("repo") == repo) if fs.exists(here) else None

    def _index_one(self, r, since: str | None) -> tuple[int, int]:
        """Renew one repository from a commit on, or whole; files read and chunks embedded.

        From a commit on only the files that changed are opened; their chunks and links
        and those of deleted files leave, new ones join, and only texts that are not
        stored are embedded.
        """
        repos, begun = json.dumps({r.id: r.path}), json.dumps({r.id: since} if since else {})
        read = lambda t: self.spark.read.format("git").option("repos", repos).option("since", begun).option("table", t).load()
        listed = cut(read("files"))
        changed = listed.where("change = 'changed'").select("rel_path").distinct()
        old = self._stored("chunks", r.id) if since else None
        walked = files.examine(files.read_folder(self.spark, r.path, r.id, changed if since else None).join(changed, "rel_path", "left_semi"), r.ignore, r.formats)
        kept = cut(walked.where("skip IS NULL").withColumn("lang", F.col("found_lang")).withColumn("kind", F.col("found_kind")))
        code = chunking.chunk_files(kept)
        history = cut(chunking.commit_chunks(read("commits").dropDuplicates(["sha"])))
        fresh = code.unionByName(history).dropDuplicates(["repo", "id"]).withColumn("indexed_at", F.current_timestamp()).withColumn("deleted_at", F.lit(None).cast("timestamp"))
        fresh = cut(fresh)
        touched = listed.select(F.lit(r.id).alias("repo"), F.col("rel_path").alias("path")).distinct()
        if old is None:
            stay, known = None, None
        else:
            stay = old.join(touched, ["repo", "path"], "left_anti").join(fresh.select("repo", "id"), ["repo", "id"], "left_anti")
            known = fresh.join(old.select("repo", "id", "vector").dropDuplicates(["repo", "id"]), ["repo", "id"])
        added = cut(fresh if old is None else store.additions(fresh, old))
        made = search.embed(added, "text", self.embedder)
        whole = made
        for part in (known, stay):
            whole = whole if part is None else whole.unionByName(part.select(made.columns))
        self._replace("chunks", whole, r.id)
        self._renew_links(r, read, kept, fresh, history, touched, old is not None)
        search.store_index(self.table("chunks").where(F.col("repo") == r.id), self._path("lexical"))
        return kept.count(), added.count()

    def _renew_links(self, r, read, kept: DataFrame, fresh: DataFrame, history: DataFrame, touched: DataFrame, partial: bool) -> None:
        wide = lambda d: d.select("repo", "src_chunk_id", "kind", "name", "line", *[(F.col(c) if c in d.columns else F.lit(None).cast("string")).alias(c) for c in ("dst_chunk_id", "url", "via", "norm", "path")])
        shas = read("commits").select("repo", "sha").distinct()
        commits = self.table("chunks").where((F.col("repo") == r.id) & (F.col("kind") == "commit")).select("repo", "id", F.col("symbol").alias("__s"))
        blamed = read("blame")
        known = blamed.select("repo", "sha").unionByName(shas).distinct().join(commits, ["repo"]).where(F.substring("sha", 1, 7) == F.col("__s")).select("repo", "sha", "id")
        blame = links.blame_links(fresh, blamed, known)
        old = self._stored("links", r.id) if partial else None
        # Manifests speak for the whole repository, so all of them are read when one has changed.
        renewed = not partial or bool(touched.where(manifests.is_manifest(F.col("path"))).take(1))
        parts = [links.symbol_links(fresh), links.declared_keys(fresh), links.read_ports(fresh), blame]
        if renewed:
            every = kept if not partial else files.examine(files.read_folder(self.spark, r.path, r.id).where(manifests.is_manifest(F.col("rel_path"))), r.ignore, r.formats).where("skip IS NULL")
            parts.append(manifests.manifest_links(every).withColumn("line", F.lit(0)))
        for prefix, url in self.config.references:
            found = fresh.select("repo", "path", F.col("id").alias("src_chunk_id"), F.col("start_line").alias("line"), F.explode(T.tickets(F.col("text"), prefix, url)).alias("t"))
            parts.append(found.select("repo", "path", "src_chunk_id", "line", F.lit("references").alias("kind"), F.col("t.name").alias("name"), F.col("t.url").alias("url")))
        rows = reduce(DataFrame.unionByName, [wide(p) for p in parts]).withColumn("norm", F.coalesce("norm", T.normalised(F.col("name")))).withColumn("indexed_at", F.current_timestamp())
        if old is not None:
            stay = old.join(touched, ["repo", "path"], "left_anti")
            if renewed:
                stay = stay.where(~F.col("src_chunk_id").startswith("manifest:"))
            rows = rows.unionByName(stay.select(rows.columns))
        self._replace("links", links.current(rows), r.id)

    # -- questions -----------------------------------------------------------
    def search(self, query: str, k: int = 20, repo: str | None = None, filters: store.SearchFilter | None = None, rewordings: int = 0) -> DataFrame:
        """The answer to one query, logged; see ``search_many`` for batches."""
        began = time.perf_counter()
        rows = cut(self.search_many([query], k, repo, filters, rewordings))
        took = (time.perf_counter() - began) * 1000
        best = rows.agg(F.count(F.lit(1)).alias("n"), F.max("score").alias("top")).first()
        entry = (datetime.now(timezone.utc).replace(tzinfo=None), query, k, repo, int(best.n), best.top, took, self.reranker is not None)
        self.spark.createDataFrame([entry], SEARCHES).write.mode("append").parquet(self._path("searches"))
        return rows

    def search_many(self, queries: list[str], k: int = 20, repo: str | None = None, filters: store.SearchFilter | None = None, rewordings: int = 0) -> DataFrame:
        """(query_id, place, repo, id, path, lines, score, found_by, text) for all queries in one plan."""
        if repo is not None and repo not in {r.id for r in self.config.repositories}:
            raise ValueError(f"unknown repository {repo!r}")
        chunks = store.live(self.table("chunks")).where((filters or store.SearchFilter()).predicate())
        if repo is not None:
            chunks = chunks.where(F.col("repo") == repo)
        asked = self.spark.createDataFrame(list(enumerate(queries)), "query_id bigint, query_text string")
        forms = search.rewritings(asked, rewordings) if rewordings else asked.withColumn("n", F.lit(0))
        fused = []
        for n in range(rewordings + 1):
            some = forms.where(F.col("n") == n).select("query_id", "query_text")
            # Questions are few and are embedded here, where the last answer is remembered.
            texts = some.orderBy("query_id").collect()
            vectors = self.embedder.embed([t.query_text for t in texts])
            wanted = self.spark.createDataFrame([(t.query_id, v) for t, v in zip(texts, vectors, strict=True)], "query_id bigint, vector array<double>")
            # One string stands for (repo, id); query keys begin with a line feed, which no repository does.
            pool = chunks.select(F.concat_ws("\t", "repo", "id").alias("row_id"), "vector")
            near = search.nearest(wanted.withColumn("query_id", F.concat(F.lit("\n"), F.col("query_id").cast("string"))), pool, 6 * k, self.embedder.dim)
            key = F.split("row_id", "\t")
            arm = near.select(F.substring("query_id", 2, 20).cast("bigint").alias("query_id"), key[0].alias("repo"), key[1].alias("id"), F.col("similarity").alias("score"), "rank")
            # The stored index answers for whole repositories; other choices of chunks are read.
            words = search.lexical_stored(self.spark, self._path("lexical"), some, 20 * k, repo) if filters is None else search.lexical(chunks, some, 20 * k)
            both = search.fuse(arm, words)
            fused.append(both.select("query_id", "repo", "id", "score", "rank"))
        ranked = search.fuse(*fused) if len(fused) > 1 else search.fuse(fused[0])
        rows = chunks.select("repo", "id", "path", "lang", "kind", "symbol", "start_line", "end_line", "text")
        if self.reranker is not None:
            few = ranked.where(F.col("rank") <= 12 * k).select("query_id", "repo", "id", "score", "rank")
            scored = search.rerank(few.join(rows.select("repo", "id", "text"), ["repo", "id"]).join(asked, "query_id"), self.reranker)
            ranked = search.fuse(few, scored)
        return search.within_quota(ranked.join(rows, ["repo", "id"]), k)

    def references(self, *names: str) -> DataFrame:
        """Edges of the names in any spelling, then lines of text that no edge covers."""
        wanted = self.spark.createDataFrame(list(enumerate(names)), "query_id bigint, name string")
        stored = links.references(links.current(self.table("links")), wanted)
        said = links.text_mentions(store.live(self.table("chunks")), wanted, stored)
        return links.shown_order(stored).select("query_id", "kind", "name", "repo", "path", "line", "via", "shown").unionByName(
            said.select("query_id", F.lit("text").alias("kind"), "name", "repo", "path", "line", F.lit(None).cast("string").alias("via"), F.lit(None).cast("int").alias("shown"))
        )

    def why(self, target: str, limit: int = 3) -> DataFrame:
        """The commits behind ``path:line`` or a symbol."""
        chunks = store.live(self.table("chunks"))
        path, _, line = target.rpartition(":")
        if path and line.isdigit():
            picked = store.covering(chunks, path, int(line)).where(F.col("rank") <= limit)
        else:
            picked = chunks.where(T.symbol_contains(F.col("symbol"), target)).orderBy("repo", "path", "start_line").limit(limit)
        return links.why(links.current(self.table("links")), chunks, picked)

    # -- reports -------------------------------------------------------------------
    def drift(self) -> DataFrame:
        return links.drift(links.current(self.table("links")))

    def dupes(self, minimum: float = duplicates.LEAST_JACCARD) -> DataFrame:
        return duplicates.folder_groups(duplicates.pairs(duplicates.fingerprints(store.live(self.table("chunks"))), minimum))

    def deps(self) -> DataFrame:
        return links.dependency_report(links.current(self.table("links")))

    def stats(self) -> DataFrame:
        return stats.totals(self.table("searches"))

    def forget(self) -> int:
        """Empty the log of searches; how many it held."""
        held = self.table("searches").count()
        self.spark.createDataFrame([], SEARCHES).write.mode("overwrite").parquet(self._path("searches"))
        return held

    def explain(self, repo: str) -> DataFrame:
        """Every file of a repository with the reason it is not indexed."""
        r = next(x for x in self.config.repositories if x.id == repo)
        return files.examine(files.read_folder(self.spark, r.path, r.id), r.ignore, r.formats).select("rel_path", "found_lang", "found_kind", "skip")

    def unsearched(self) -> list[str]:
        """Configured repositories that hold no chunks, in the order of the configuration."""
        known = {r.repo for r in store.datasets(self.table("chunks")).collect()}
        return [r.id for r in self.config.repositories if r.id not in known]

    def compact(self, table: str = "chunks", files_: int = 1) -> tuple[int, int]:
        return store.compact(self.spark, self._path(table), files_)
