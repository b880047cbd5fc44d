"""Names, edges and dependencies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.operators import links, store
from tallyweave.plans.registry import CURRENT, LIVE, query
from tallyweave.session import table

#: The names asked for: every name that a link declares, and four that are given. A name is its own key.
WANTED = ("lumen_docs", "zephyrProxy", "8080", "measureSocket")
_W = "w AS (SELECT name AS query_id, name AS wanted FROM (SELECT name FROM links WHERE kind = 'declares' AND name IS NOT NULL UNION VALUES " + ", ".join(f"('{n}')" for n in WANTED) + "))"
_NORM = "lower(regexp_replace({0}, '[_.\\-]', '', 'g'))"


def current(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.current(table(spark, sf_dir, "links"))


def wanted(spark: SparkSession, sf_dir: str) -> DataFrame:
    declared = table(spark, sf_dir, "links").where("kind = 'declares' AND name IS NOT NULL").select("name")
    given = spark.createDataFrame([(n,) for n in WANTED], "name string")
    return declared.unionByName(given).distinct().select(F.col("name").alias("query_id"), "name")


_REFS = f"""{CURRENT}, {_W}, hit AS (SELECT w.query_id, w.wanted, c.* FROM cur c JOIN w ON (c.norm IS NOT NULL AND c.norm = {_NORM.format('w.wanted')}) OR c.name = w.wanted),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY name <> wanted, repo NULLS LAST, path NULLS LAST, line NULLS LAST, kind NULLS FIRST, src_chunk_id NULLS LAST, name NULLS LAST) AS rank FROM hit)"""


@query("J01_refs", f"WITH {_REFS} SELECT query_id, repo, src_chunk_id, kind, name, line, path, rank FROM ranked")
def refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.references(current(spark, sf_dir), wanted(spark, sf_dir)).select("query_id", "repo", "src_chunk_id", "kind", "name", "line", "path", "rank")


@query("T06_shown_order", f"""WITH {_REFS} SELECT query_id, repo, src_chunk_id, kind, name, line, row_number() OVER (PARTITION BY query_id ORDER BY
    CASE kind WHEN 'defines' THEN 0 WHEN 'declares' THEN 1 WHEN 'provides' THEN 2 WHEN 'reads_key' THEN 3 WHEN 'depends_on' THEN 4 WHEN 'mentions' THEN 5 WHEN 'references' THEN 6 WHEN 'blamed_by' THEN 7 ELSE 8 END,
    name <> wanted, CASE via WHEN 'call' THEN 0 WHEN 'code' THEN 1 WHEN 'import' THEN 2 WHEN 'string' THEN 3 WHEN 'comment' THEN 4 ELSE 5 END, rank) AS shown FROM ranked""")
def shown(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = links.references(current(spark, sf_dir), wanted(spark, sf_dir))
    return links.shown_order(rows).select("query_id", "repo", "src_chunk_id", "kind", "name", "line", "shown")


@query("J02_drift", f"WITH {CURRENT} SELECT repo, src_chunk_id, name, line, path FROM cur r WHERE kind = 'reads_key' AND NOT EXISTS (SELECT 1 FROM cur d WHERE d.kind = 'declares' AND d.name = r.name)")
def drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.drift(current(spark, sf_dir)).select("repo", "src_chunk_id", "name", "line", "path")


_ANCHOR = "anchor AS (SELECT DISTINCT norm FROM cur WHERE kind IN ('defines', 'declares') AND norm IS NOT NULL)"


@query("J03_prune", f"WITH {CURRENT}, {_ANCHOR} SELECT kind, count(*) AS kept FROM cur WHERE NOT (coalesce(kind = 'mentions', false) AND norm IS NOT NULL) OR norm IN (SELECT norm FROM anchor) GROUP BY kind")
def prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, _ = links.prune(current(spark, sf_dir))
    return kept.groupBy("kind").agg(F.count(F.lit(1)).alias("kept"))


@query("K06_pruned_names", f"WITH {CURRENT}, {_ANCHOR} SELECT DISTINCT norm FROM cur WHERE kind = 'mentions' AND norm IS NOT NULL AND norm NOT IN (SELECT norm FROM anchor)")
def pruned_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, gone = links.prune(current(spark, sf_dir))
    return gone


_EARLY = "indexed_at < TIMESTAMPTZ '2025-07-01 00:00:00+00'"


@query("J04_rescued", f"""WITH {CURRENT}, early AS (SELECT * FROM cur WHERE {_EARLY}), was AS (SELECT DISTINCT norm FROM early WHERE kind IN ('defines', 'declares') AND norm IS NOT NULL),
    gone AS (SELECT DISTINCT norm FROM early WHERE kind = 'mentions' AND norm IS NOT NULL AND norm NOT IN (SELECT norm FROM was)), {_ANCHOR}
    SELECT norm FROM gone WHERE norm IN (SELECT norm FROM anchor)""")
def rescued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names pruned by midsummer for which an anchor turned up later."""
    rows = current(spark, sf_dir)
    _, gone = links.prune(rows.where(F.col("indexed_at") < F.lit("2025-07-01").cast("timestamp")))
    return links.rescued(gone, links.anchor_names(rows))


@query("A14_anchor_names", f"WITH {CURRENT} SELECT DISTINCT norm FROM cur WHERE kind IN ('defines', 'declares') AND norm IS NOT NULL")
def anchor_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.anchor_names(current(spark, sf_dir))


@query("S19_every", f"WITH {CURRENT} SELECT kind, name, norm, repo, count(*) AS n FROM cur WHERE kind IN ('provides', 'depends_on') GROUP BY ALL")
def every(spark: SparkSession, sf_dir: str) -> DataFrame:
    return current(spark, sf_dir).where(F.col("kind").isin("provides", "depends_on")).groupBy("kind", "name", "norm", "repo").agg(F.count(F.lit(1)).alias("n"))


@query("K04_insert_links", f"""WITH fresh AS (SELECT * FROM links WHERE NOT {_EARLY}), stored AS (SELECT DISTINCT repo, src_chunk_id, kind, name, line FROM links WHERE {_EARLY})
    SELECT repo, src_chunk_id, kind, name, line FROM (SELECT DISTINCT repo, src_chunk_id, kind, name, line FROM fresh) f WHERE NOT EXISTS (SELECT 1 FROM stored s
    WHERE s.repo IS NOT DISTINCT FROM f.repo AND s.src_chunk_id IS NOT DISTINCT FROM f.src_chunk_id AND s.kind IS NOT DISTINCT FROM f.kind AND s.name IS NOT DISTINCT FROM f.name AND s.line IS NOT DISTINCT FROM f.line)""")
def insert_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "links")
    early = F.col("indexed_at") < F.lit("2025-07-01").cast("timestamp")
    return links.insert(rows.where(early), rows.where(~early)).select("repo", "src_chunk_id", "kind", "name", "line")


@query("K05_cascade_delete", f"""WITH {CURRENT} SELECT kind, count(*) AS kept FROM cur l WHERE NOT EXISTS (SELECT 1 FROM chunks c WHERE c.deleted_at IS NOT NULL AND c.repo = l.repo AND c.id = l.src_chunk_id) GROUP BY kind""")
def cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links left when those of deleted chunks have gone."""
    gone = table(spark, sf_dir, "chunks").where("deleted_at IS NOT NULL").select("repo", F.col("id").alias("src_chunk_id")).distinct()
    return current(spark, sf_dir).join(gone, ["repo", "src_chunk_id"], "left_anti").groupBy("kind").agg(F.count(F.lit(1)).alias("kept"))


@query("J07_why", f"""WITH {LIVE}, {CURRENT},
    b AS (SELECT c.repo, c.src_chunk_id, c.line, c.name AS sha, c.dst_chunk_id AS commit_id FROM cur c WHERE kind = 'blamed_by' AND EXISTS (SELECT 1 FROM live l WHERE l.repo = c.repo AND l.id = c.src_chunk_id AND l.kind = 'code')),
    m AS (SELECT repo, id AS commit_id, text AS message FROM live WHERE kind = 'commit'),
    r AS (SELECT repo, src_chunk_id AS commit_id, string_agg(DISTINCT name, ',' ORDER BY name) AS refs FROM cur WHERE kind = 'references' GROUP BY ALL)
    SELECT DISTINCT b.repo, b.src_chunk_id, b.line, b.sha, b.commit_id,
        trim(array_to_string(list_filter(string_split(m.message, chr(10)), lambda x: NOT regexp_matches(x, '^[A-Z][A-Za-z-]+: ')), chr(10)), ' ') AS reason, r.refs
    FROM b LEFT JOIN m ON m.repo = b.repo AND m.commit_id = b.commit_id LEFT JOIN r ON r.repo = b.repo AND r.commit_id = b.commit_id""")
def why(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = store.live(table(spark, sf_dir, "chunks"))
    return links.why(current(spark, sf_dir), rows, rows.where("kind = 'code'"))


@query("J08_blame_range", f"""WITH {LIVE}, {CURRENT}, blame AS (SELECT DISTINCT repo, path, line, name AS sha FROM cur WHERE kind = 'blamed_by'),
    first AS (SELECT l.repo, l.path, l.id AS src_chunk_id, b.sha, min(b.line) AS line FROM live l JOIN blame b ON b.repo = l.repo AND b.path = l.path AND b.line BETWEEN l.start_line AND l.end_line WHERE l.kind <> 'commit' GROUP BY ALL)
    SELECT repo, path, src_chunk_id, substr(sha, 1, 7) AS name, line FROM first""")
def blame_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blamed lines joined to the chunks whose span holds them."""
    rows = store.live(table(spark, sf_dir, "chunks"))
    blame = current(spark, sf_dir).where("kind = 'blamed_by'").select("repo", "path", "line", F.col("name").alias("sha")).distinct()
    none = spark.createDataFrame([], "repo string, sha string, id string")
    return links.blame_links(rows, blame, none).select("repo", "path", "src_chunk_id", "name", "line")


_DEPS = f"""WITH {CURRENT}, p AS (SELECT repo AS owner, name FROM cur WHERE kind = 'provides' UNION SELECT repo, repo FROM cur WHERE repo IS NOT NULL), n AS (SELECT DISTINCT repo AS "user", name FROM cur WHERE kind = 'depends_on'),
    declared AS (SELECT DISTINCT "user", owner FROM n JOIN p USING (name) WHERE "user" <> owner),
    owners AS (SELECT norm, repo AS owner, min(name) AS spelling FROM cur WHERE kind IN ('defines', 'declares') AND norm IS NOT NULL GROUP BY ALL),
    uses AS (SELECT DISTINCT norm, repo AS "user" FROM cur WHERE kind IN ('mentions', 'reads_key') AND norm IS NOT NULL),
    shared AS (SELECT u."user", o.owner, o.norm, o.spelling FROM uses u JOIN owners o USING (norm) WHERE NOT EXISTS (SELECT 1 FROM owners x WHERE x.norm = u.norm AND x.owner = u."user")),
    counts AS (SELECT "user", owner, count(DISTINCT norm) AS names, array_to_string(list_sort(list_distinct(list(spelling)))[1:5], ',') AS examples FROM shared GROUP BY ALL)"""


def packaged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The current links, in which every repository provides the package of its own name."""
    rows = current(spark, sf_dir)
    own = rows.where("repo IS NOT NULL").select("repo").distinct()
    made = own.select(*[(F.lit("provides") if c == "kind" else F.col("repo") if c in ("repo", "name") else F.lit(None).cast(rows.schema[c].dataType)).alias(c) for c in rows.columns])
    return rows.unionByName(made)


@query("J11_declared", _DEPS + ' SELECT "user", owner FROM declared')
def declared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.declared_dependencies(packaged(spark, sf_dir))


@query("J12_shared_names", _DEPS + ' SELECT "user", owner, norm, spelling FROM shared')
def shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.shared_names(current(spark, sf_dir)).select("user", "owner", "norm", "spelling")


@query("J14_dependency_report", _DEPS + """, u AS (SELECT 'used' AS status, c."user", c.owner, names, examples FROM counts c WHERE names >= 2 AND EXISTS (SELECT 1 FROM declared d WHERE d."user" = c."user" AND d.owner = c.owner)
    UNION ALL SELECT 'undeclared', c."user", c.owner, names, examples FROM counts c WHERE names >= 2 AND NOT EXISTS (SELECT 1 FROM declared d WHERE (d."user" = c."user" AND d.owner = c.owner) OR (d."user" = c.owner AND d.owner = c."user"))
    UNION ALL SELECT 'unused', d."user", d.owner, 0, '' FROM declared d WHERE NOT EXISTS (SELECT 1 FROM counts c WHERE d."user" = c."user" AND d.owner = c.owner))
    SELECT *, row_number() OVER (PARTITION BY status ORDER BY names DESC, "user", owner) AS place FROM u""")
def dependency_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.dependency_report(packaged(spark, sf_dir))


@query("J19_text_mentions", f"""WITH {LIVE}, {_REFS}, ln AS (SELECT repo, path, start_line, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM live),
    n AS (SELECT repo, path, start_line + unnest(range(len(ls))) AS line, unnest(ls) AS content FROM ln), t AS (SELECT repo, path, line, content, unnest(list_distinct(regexp_extract_all(content, '[\\p{{L}}\\p{{N}}_]+'))) AS word FROM n),
    h AS (SELECT DISTINCT w.query_id, w.wanted AS name, t.repo, t.path, CAST(t.line AS INTEGER) AS line FROM t JOIN w ON t.word = regexp_extract(w.wanted, '[\\p{{L}}\\p{{N}}_]+')
        WHERE regexp_matches(t.content, '(^|[^\\p{{L}}\\p{{N}}_])' || regexp_replace(w.wanted, '([^\\p{{L}}\\p{{N}}_])', '\\\\\\1', 'g') || '($|[^\\p{{L}}\\p{{N}}_])'))
    SELECT * FROM h WHERE NOT EXISTS (SELECT 1 FROM ranked r WHERE r.repo = h.repo AND r.path = h.path AND r.line = h.line AND r.query_id = h.query_id)""")
def text_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-word lines of the wanted names that no stored edge covers."""
    stored = links.references(current(spark, sf_dir), wanted(spark, sf_dir))
    return links.text_mentions(store.live(table(spark, sf_dir, "chunks")), wanted(spark, sf_dir), stored)


@query("X11_symbol_links")
def symbol_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.symbol_links(store.live(table(spark, sf_dir, "chunks")))


@query("X13_declared_keys", f"""WITH {LIVE}, l AS (SELECT repo, path, id, start_line, regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]') AS ls FROM live WHERE kind = 'config'),
    n AS (SELECT repo, path, id, start_line + unnest(range(len(ls))) AS line, unnest(ls) AS content FROM l),
    k AS (SELECT *, regexp_extract(content, '^\\s*(?:export\\s+)?["'']?([A-Za-z_][A-Za-z0-9_.\\-]*)["'']?\\s*[:=]', 1) AS key, regexp_extract(content, '["'']?\\b([0-9]{{2,5}}):[0-9]{{2,5}}\\b', 1) AS host, regexp_extract(content, '(?i)port["'']?\\s*[:=]\\s*["'']?([0-9]{{2,5}})\\b', 1) AS port FROM n),
    u AS (SELECT DISTINCT repo, path, id AS src_chunk_id, CAST(line AS INTEGER) AS line, unnest([key, CASE WHEN contains(key, '.') THEN regexp_extract(key, '([^.]+)$', 1) END, host, port]) AS name FROM k)
    SELECT repo, path, src_chunk_id, line, name, 'declares' AS kind, {_NORM.format('name')} AS norm FROM u WHERE length(name) >= 3""")
def declared_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.declared_keys(store.live(table(spark, sf_dir, "chunks")))


_ADDRESSED = "text || chr(10) || 'base = \"http://' || repo || '.example:' || CAST(8000 + start_line % 50 AS VARCHAR) || '/x\"'"


@query("X12_ports_read", f"""WITH {LIVE}, f AS (SELECT DISTINCT repo, path, id AS src_chunk_id, start_line AS line, unnest(regexp_extract_all({_ADDRESSED}, 'https?://[A-Za-z0-9_.\\-]+:([0-9]{{2,5}})', 1)) AS name FROM live WHERE kind = 'code')
    SELECT repo, path, src_chunk_id, line, name FROM f""")
def ports_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ports that code points at, in texts that end with an address of their repository."""
    base = F.concat("text", F.lit('\nbase = "http://'), "repo", F.lit(".example:"), (F.lit(8000) + F.col("start_line") % 50).cast("string"), F.lit('/x"'))
    return links.read_ports(store.live(table(spark, sf_dir, "chunks")).withColumn("text", base)).select("repo", "path", "src_chunk_id", "line", "name")


@query("X02_normalised", f"SELECT DISTINCT name, {_NORM.format('name')} AS norm FROM links WHERE name IS NOT NULL")
def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "links").where("name IS NOT NULL").select("name", T.normalised(F.col("name")).alias("norm")).distinct()


@query("X08_compound", "SELECT DISTINCT name FROM links WHERE length(name) >= 4 AND regexp_matches(name, '[a-z0-9][A-Z]|[A-Za-z0-9]_[A-Za-z0-9]')")
def compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "links").where(T.is_compound(F.col("name"))).select("name").distinct()


@query("X26_spellings", r"""WITH n AS (SELECT DISTINCT name FROM links WHERE kind = 'defines'), p AS (SELECT name, list_filter(string_split_regex(lower(name), '[_.\-]+'), lambda x: x <> '') AS parts FROM n),
    c AS (SELECT name, parts, array_to_string(list_transform(parts, lambda x: upper(x[1]) || x[2:]), '') AS pascal FROM p)
    SELECT DISTINCT name, unnest([name, pascal, lower(pascal[1]) || pascal[2:], upper(array_to_string(parts, '_'))]) AS spelling FROM c""")
def spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "links").where("kind = 'defines'").select("name").distinct().select("name", F.explode(T.spellings(F.col("name"))).alias("spelling"))
