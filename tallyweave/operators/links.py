"""Names and edges between chunks: look-ups, drift, pruning, authorship, dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import text as T

KEY = ("repo", "src_chunk_id", "kind", "name", "line")
ANCHORS = ("defines", "declares")
#: Order of how a name is used: the first is the most telling.
OCCURRENCES = ("call", "code", "import", "string", "comment")
#: Order in which kinds of reference are shown.
SHOWN = ("defines", "declares", "provides", "reads_key", "depends_on", "mentions", "references", "blamed_by")
#: A used dependency shares at least so many names.
LEAST_NAMES = 2


def rank_of(column: str, order: tuple[str, ...]):
    out = F.lit(len(order))
    for i, v in reversed(list(enumerate(order))):
        out = F.when(F.col(column) == v, F.lit(i)).otherwise(out)
    return out


def current(links: DataFrame) -> DataFrame:
    """One row per key, the first written."""
    first = Window.partitionBy(*KEY).orderBy("indexed_at", F.asc_nulls_last("norm"), F.asc_nulls_last("dst_chunk_id"), F.asc_nulls_last("via"), F.asc_nulls_last("path"))
    return links.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def insert(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh links whose key is not stored yet; null-safe, first writer wins."""
    keys = stored.select(*[F.col(c).alias(f"__{c}") for c in KEY]).distinct()
    same = None
    for c in KEY:
        one = F.col(c).eqNullSafe(F.col(f"__{c}"))
        same = one if same is None else same & one
    return current(fresh).join(keys, same, "left_anti")


def references(links: DataFrame, names: DataFrame) -> DataFrame:
    """Edges that carry a wanted name in any spelling: the batch form of a look-up.

    ``names`` has query_id and name. A link counts by its norm or by the very name.
    The exact spelling comes first, then repo, path, line.
    """
    wanted = names.select("query_id", F.col("name").alias("wanted"), T.normalised(F.col("name")).alias("norm"))
    by_norm = links.where(F.col("norm").isNotNull()).join(wanted, "norm")
    other = F.col("norm").isNull() | (F.col("norm") != F.col("__norm"))
    by_name = links.join(wanted.withColumnRenamed("norm", "__norm"), F.col("name") == F.col("wanted")).where(other).drop("__norm")
    rows = by_norm.unionByName(by_name)
    order = Window.partitionBy("query_id").orderBy((F.col("name") != F.col("wanted")).cast("int"), F.asc_nulls_last("repo"), F.asc_nulls_last("path"), F.asc_nulls_last("line"), "kind", F.asc_nulls_last("src_chunk_id"), F.asc_nulls_last("name"))
    return rows.withColumn("rank", F.row_number().over(order))


def shown_order(rows: DataFrame) -> DataFrame:
    """Display order: kind, exact spelling, occurrence, place."""
    order = Window.partitionBy("query_id").orderBy(rank_of("kind", SHOWN), (F.col("name") != F.col("wanted")).cast("int"), rank_of("via", OCCURRENCES), "rank")
    return rows.withColumn("shown", F.row_number().over(order))


def drift(links: DataFrame) -> DataFrame:
    """Keys that code reads and no configuration declares under the same name."""
    declared = links.where(F.col("kind") == "declares").select("name").distinct()
    return links.where(F.col("kind") == "reads_key").join(declared, "name", "left_anti")


def anchor_names(links: DataFrame) -> DataFrame:
    return links.where(F.col("kind").isin(*ANCHORS) & F.col("norm").isNotNull()).select("norm").distinct()


def prune(links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, pruned names): mentions that nothing anchors leave, rows without a norm stay."""
    mentions = F.coalesce((F.col("kind") == "mentions") & F.col("norm").isNotNull(), F.lit(False))
    loose = links.where(mentions)
    anchors = anchor_names(links)
    kept = links.where(~mentions).unionByName(loose.join(anchors, "norm", "left_semi").select(links.columns))
    gone = loose.join(anchors, "norm", "left_anti").select("norm").distinct()
    return kept, gone


def rescued(pruned: DataFrame, anchors: DataFrame) -> DataFrame:
    """Pruned names that an anchor has turned up for."""
    return pruned.join(anchors, "norm", "left_semi")


def out_of(links: DataFrame, chunks: DataFrame, kind: str) -> DataFrame:
    ids = chunks.select("repo", F.col("id").alias("src_chunk_id")).distinct()
    return links.where(F.col("kind") == kind).join(ids, ["repo", "src_chunk_id"], "left_semi")


def why(links: DataFrame, chunks: DataFrame, targets: DataFrame) -> DataFrame:
    """Who wrote the targets and why: target chunk, its commit's message, the commit's references."""
    start = targets.select("repo", F.col("id").alias("src_chunk_id")).distinct()
    blamed = links.where(F.col("kind") == "blamed_by").select("repo", "src_chunk_id", "line", F.col("name").alias("sha"), F.col("dst_chunk_id").alias("commit_id"))
    commits = chunks.where(F.col("kind") == "commit").select("repo", F.col("id").alias("commit_id"), F.col("text").alias("message"))
    refs = (
        links.where(F.col("kind") == "references")
        .groupBy("repo", F.col("src_chunk_id").alias("commit_id"))
        .agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("refs"))
    )
    return (
        start.join(blamed, ["repo", "src_chunk_id"])
        .join(commits, ["repo", "commit_id"], "left")
        .join(refs, ["repo", "commit_id"], "left")
        .select("repo", "src_chunk_id", "line", "sha", "commit_id", T.without_trailers(F.col("message")).alias("reason"), "refs")
        .distinct()
    )


def blame_links(chunks: DataFrame, blame: DataFrame, commits: DataFrame) -> DataFrame:
    """One edge per chunk and commit that wrote a line of it, at the first such line.

    ``blame``: repo, path, line, sha. ``commits``: repo, sha, id. The join is an
    equi-join on the file with the line range as its residual condition.
    """
    spans = chunks.where(F.col("kind") != "commit").select("repo", "path", "id", "start_line", "end_line")
    hit = spans.join(blame, ["repo", "path"]).where((F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line")))
    first = hit.groupBy("repo", "path", F.col("id").alias("src_chunk_id"), "sha").agg(F.min("line").alias("line"))
    known = commits.select("repo", F.substring("sha", 1, 7).alias("name"), F.col("id").alias("dst_chunk_id"))
    named = first.withColumn("name", F.substring("sha", 1, 7)).drop("sha")
    return named.join(known, ["repo", "name"], "left").withColumn("kind", F.lit("blamed_by"))


def symbol_links(chunks: DataFrame) -> DataFrame:
    """Definitions by symbol, and the best mention of every compound name in code.

    Best: the most telling occurrence, then the first line.
    """
    code = chunks.where(F.col("kind") == "code")
    bare = F.regexp_replace("symbol", r"^.*\.", "")
    defines = code.where(F.col("symbol").isNotNull() & (F.length(bare) >= 4)).select(
        "repo", "path", F.col("id").alias("src_chunk_id"), F.lit("defines").alias("kind"), bare.alias("name"), F.col("start_line").alias("line"), F.lit(None).cast("string").alias("via")
    )
    at = code.select("repo", "path", "id", "start_line", "symbol", F.posexplode(T.lines(F.col("text"))).alias("n", "content"))
    names = at.select("*", F.explode(F.array_distinct(T.identifiers(F.col("content")))).alias("name")).where(T.is_compound(F.col("name")))
    names = names.where(F.col("symbol").isNull() | (F.col("name") != F.regexp_replace("symbol", r"^.*\.", "")))
    via = (
        F.when(F.col("content").rlike(r"^\s*(#|//|\*|/\*|--)"), F.lit("comment"))
        .when(F.col("content").rlike(r"^\s*(import|from|use|using|require|include)\b"), F.lit("import"))
        .when(F.expr(r"""content rlike concat('["\'`][^"\'`]*\\b', name, '\\b[^"\'`]*["\'`]')"""), F.lit("string"))
        .when(F.expr(r"content rlike concat('\\b', name, '\\s*\\(')"), F.lit("call"))
        .otherwise(F.lit("code"))
    )
    ranked = names.withColumn("via", via).withColumn("line", F.col("start_line") + F.col("n"))
    best = ranked.groupBy("repo", "path", F.col("id").alias("src_chunk_id"), "name").agg(F.min(F.struct(rank_of("via", OCCURRENCES).alias("o"), "line", "via")).alias("b"))
    mentions = best.select("repo", "path", "src_chunk_id", F.lit("mentions").alias("kind"), "name", F.col("b.line").alias("line"), F.col("b.via").alias("via"))
    return defines.unionByName(mentions).withColumn("norm", T.normalised(F.col("name")))


def declared_keys(chunks: DataFrame) -> DataFrame:
    """Keys that configuration declares: key, its last dotted part, ports it publishes."""
    at = chunks.where(F.col("kind") == "config").select("repo", "path", "id", "start_line", F.posexplode(T.lines(F.col("text"))).alias("n", "content"))
    key = F.regexp_extract("content", r"""^\s*(?:export\s+)?["']?([A-Za-z_][A-Za-z0-9_.\-]*)["']?\s*[:=]""", 1)
    tail = F.when(key.contains("."), F.regexp_extract(key, r"([^.]+)$", 1))
    host_port = F.nullif(F.regexp_extract("content", r"""["']?\b([0-9]{2,5}):[0-9]{2,5}\b""", 1), F.lit(""))
    port = F.nullif(F.regexp_extract("content", r"""(?i)port["']?\s*[:=]\s*["']?([0-9]{2,5})\b""", 1), F.lit(""))
    found = at.select("repo", "path", F.col("id").alias("src_chunk_id"), (F.col("start_line") + F.col("n")).alias("line"), F.explode(F.array_distinct(F.array_compact(F.array(F.nullif(key, F.lit("")), tail, host_port, port)))).alias("name"))
    return found.where(F.length("name") >= 3).withColumn("kind", F.lit("declares")).withColumn("norm", T.normalised(F.col("name")))


def read_ports(chunks: DataFrame) -> DataFrame:
    rows = chunks.where(F.col("kind") == "code").select("repo", "path", F.col("id").alias("src_chunk_id"), F.col("start_line").alias("line"), F.explode(T.ports_read(F.col("text"))).alias("name"))
    return rows.withColumn("kind", F.lit("reads_key")).withColumn("norm", F.col("name"))


def text_mentions(chunks: DataFrame, names: DataFrame, stored: DataFrame) -> DataFrame:
    """Lines that hold a wanted name as a whole word and have no stored edge.

    ``names``: query_id, name. A name of any form counts as it was recorded: 8080,
    PROJ-412, dotted, dashed, beyond ASCII. Names meet the texts through an
    equi-join of their first word with the words of each line; the whole name must
    then stand there between word borders. Names without any word match nothing.
    """
    first = F.regexp_extract("name", f"({T.WORD})", 1)
    wanted = names.select("query_id", "name", first.alias("__word")).where(F.col("__word") != "")
    at = chunks.select("repo", "path", "start_line", F.posexplode(T.lines(F.col("text"))).alias("n", "content"))
    words = F.array_distinct(F.regexp_extract_all(F.col("content"), F.lit(f"({T.WORD})"), 1))
    held = at.select("repo", "path", (F.col("start_line") + F.col("n")).alias("line"), "content", F.explode(words).alias("__word")).join(wanted, "__word")
    seen = held.where(T.holds_name(F.col("content"), F.col("name"))).select("name", "repo", "path", "line", "query_id").distinct()
    return seen.join(stored.select("repo", "path", "line", "query_id").distinct(), ["repo", "path", "line", "query_id"], "left_anti")


def declared_dependencies(links: DataFrame) -> DataFrame:
    """(user, owner): a repository depends on a package that another provides."""
    provides = links.where(F.col("kind") == "provides").select(F.col("repo").alias("owner"), "name").distinct()
    needs = links.where(F.col("kind") == "depends_on").select(F.col("repo").alias("user"), "name").distinct()
    return needs.join(provides, "name").where(F.col("user") != F.col("owner")).select("user", "owner").distinct()


def shared_names(links: DataFrame) -> DataFrame:
    """(user, owner, norm, spelling): names that one repository anchors and another only mentions."""
    anchored = links.where(F.col("kind").isin(*ANCHORS) & F.col("norm").isNotNull())
    owners = anchored.groupBy("norm", F.col("repo").alias("owner")).agg(F.min("name").alias("spelling"))
    uses = links.where(F.col("kind").isin("mentions", "reads_key") & F.col("norm").isNotNull()).select("norm", F.col("repo").alias("user")).distinct()
    strangers = uses.join(owners.select("norm", F.col("owner").alias("user")), ["norm", "user"], "left_anti")
    return strangers.join(owners, "norm")


def dependency_report(links: DataFrame, least: int = LEAST_NAMES) -> DataFrame:
    """Declared against used: (status, user, owner, names, examples, place), many names first.

    status is ``used`` (declared and sharing names), ``undeclared`` (sharing at
    least ``least`` names, declared in neither direction) or ``unused`` (declared,
    no shared name).
    """
    declared = declared_dependencies(links)
    shared = shared_names(links)
    counts = shared.groupBy("user", "owner").agg(
        F.count_distinct("norm").alias("names"), F.array_join(F.slice(F.array_sort(F.collect_set("spelling")), 1, 5), ",").alias("examples")
    )
    either = declared.unionByName(declared.select(F.col("owner").alias("user"), F.col("user").alias("owner"))).distinct()
    used = counts.where(F.col("names") >= least).join(declared, ["user", "owner"], "left_semi").withColumn("status", F.lit("used"))
    undeclared = counts.where(F.col("names") >= least).join(either, ["user", "owner"], "left_anti").withColumn("status", F.lit("undeclared"))
    idle = declared.join(counts, ["user", "owner"], "left_anti").select("user", "owner", F.lit(0).cast("bigint").alias("names"), F.lit("").alias("examples"), F.lit("unused").alias("status"))
    cols = ["status", "user", "owner", "names", "examples"]
    rows = used.select(cols).unionByName(undeclared.select(cols)).unionByName(idle.select(cols))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("status").orderBy(F.desc("names"), "user", "owner")))
