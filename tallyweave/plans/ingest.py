"""Files to chunks, identity, and the life of the store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.operators import chunking, store
from tallyweave.plans.registry import LIVE, query
from tallyweave.session import table
from tallyweave.sources import connectors, files, manifests

_MID = "TIMESTAMPTZ '2025-07-01 00:00:00+00'"


def _mid():
    return F.lit("2025-07-01").cast("timestamp")


@query("X01_chunk_id", f"""WITH {LIVE} SELECT repo, id, sha256(encode(text) || unhex(printf('%016x', length(text))) || encode(path) || unhex(printf('%016x', length(path)))) AS made FROM live WHERE path IS NOT NULL""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live(table(spark, sf_dir, "chunks")).where("path IS NOT NULL").select("repo", "id", T.chunk_id(F.col("text"), F.col("path")).alias("made"))


@query("X05_identifiers", f"WITH {LIVE} SELECT repo, id, CAST(len(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS INTEGER) AS names FROM live")
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live(table(spark, sf_dir, "chunks")).select("repo", "id", F.size(T.identifiers(F.col("text"))).alias("names"))


@query("X03_words", "SELECT DISTINCT path, trim(regexp_replace(path, '[/_.\\-]+', ' ', 'g'), ' ') AS words FROM chunks WHERE path IS NOT NULL")
def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "chunks").where("path IS NOT NULL").select("path", T.words(F.col("path")).alias("words")).distinct()


@query("X24_token_cost", f"WITH {LIVE} SELECT repo, kind, CAST(sum(CAST(ceil(length(text) / 3.0) AS BIGINT)) AS BIGINT) AS tokens FROM live GROUP BY ALL")
def token_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live(table(spark, sf_dir, "chunks")).groupBy("repo", "kind").agg(F.sum(T.token_cost(F.col("text"))).alias("tokens"))


@query("X27_reason", f"""WITH {LIVE} SELECT repo, id, trim(array_to_string(list_filter(string_split(text, chr(10)), lambda x: NOT regexp_matches(x, '^[A-Z][A-Za-z-]+: ')), chr(10)), ' ') AS reason FROM live WHERE kind = 'commit'""")
def reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live(table(spark, sf_dir, "chunks")).where("kind = 'commit'").select("repo", "id", T.without_trailers(F.col("text")).alias("reason"))


@query("X14_urls", r"""SELECT doc_id, url FROM (SELECT DISTINCT doc_id, regexp_replace(unnest(regexp_extract_all(text, '(https?://[^ \t\r\n<>"''`]+)', 1)), '[.,;:!?)\]}]+$', '') AS url FROM documents)""")
def urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(T.urls(F.col("text"))).alias("url")).distinct()


@query("X14_tickets", r"""SELECT doc_id, x AS name, 'https://tracker.example/browse/' || x AS url FROM (SELECT DISTINCT doc_id, unnest(regexp_extract_all(text, '\b(TRK-[0-9]+)\b', 1)) AS x FROM documents)""")
def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.tickets(F.col("text"), "TRK-", "https://tracker.example/browse/{key}")
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(found).alias("t")).select("doc_id", "t.name", "t.url")


_PATHS = r"""u AS (SELECT doc_id, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?', '') AS bare FROM documents WHERE url IS NOT NULL),
    s AS (SELECT doc_id, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), ':([0-9]+)$', '-\1') AS host, regexp_extract(bare, '^[^/?]*([^?]*)', 1) AS path, regexp_replace(regexp_extract(bare, '\?(.*)$', 1), '[^A-Za-z0-9._=\-]', '_', 'g') AS query FROM u),
    p AS (SELECT *, list_filter(list_transform(string_split(path, '/'), lambda x: regexp_replace(regexp_replace(x, '[^A-Za-z0-9._=\-]', '_', 'g'), '^\.+$', '')), lambda x: x <> '') AS parts FROM s),
    n AS (SELECT *, CASE WHEN query = '' THEN parts WHEN len(parts) = 0 THEN [query] ELSE list_concat(parts[1:len(parts) - 1], [parts[len(parts)] || '-' || query]) END AS named FROM p),
    o AS (SELECT doc_id, array_to_string(list_concat([CASE WHEN host = '' THEN 'unknown-host' ELSE regexp_replace(host, '[^A-Za-z0-9._=\-]', '_', 'g') END], CASE WHEN len(named) = 0 OR path LIKE '%/' THEN list_concat(named, ['index']) ELSE named END), '/') AS path FROM n),
    paths AS (SELECT doc_id, CASE WHEN path LIKE '%.md' THEN path ELSE path || '.md' END AS path FROM o)"""


@query("X18_document_path", f"WITH {_PATHS} SELECT doc_id, path FROM paths")
def document_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("url IS NOT NULL").select("doc_id", T.document_path(F.col("url")).alias("path"))


@query("S13_route", """SELECT connector, count(*) AS n FROM (SELECT CASE WHEN url LIKE 'https://docs.example/adr%' THEN 'adr' WHEN url LIKE 'https://docs.example/%' THEN 'http' WHEN url LIKE 'https://%' THEN 'web' END AS connector FROM documents) GROUP BY connector""")
def route(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = (("https://docs.example/adr*", "adr"), ("https://docs.example/*", "http"), ("https://*", "web"))
    return table(spark, sf_dir, "documents").select(connectors.route(F.col("url"), rules).alias("connector")).groupBy("connector").agg(F.count(F.lit(1)).alias("n"))


@query("X19_render", f"""WITH {_PATHS}, d AS (SELECT doc_id, url, regexp_extract(text, '^#+\\s*([^\\r\\n\\x{{85}}\\x{{2028}}\\x{{2029}}]*)', 1) AS title, text FROM documents WHERE url IS NOT NULL AND text IS NOT NULL)
    SELECT p.path, md5('---' || chr(10) || 'url: ' || to_json(url) || chr(10) || 'title: ' || to_json(title) || chr(10) || '---' || chr(10) || text || chr(10)) AS digest FROM d JOIN paths p USING (doc_id)""")
def render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where("url IS NOT NULL AND text IS NOT NULL")
    made = connectors.render(docs.select("url", F.regexp_extract("text", r"^#+\s*(.*)", 1).alias("title"), "text"))
    return made.select("path", F.md5(F.encode("markdown", "UTF-8")).alias("digest"))


_EXAMINED = """f AS (SELECT DISTINCT repo, rel_path, size_bytes, content FROM walked_files),
    e AS (SELECT *, lower(regexp_extract(regexp_extract(rel_path, '([^/]*)$', 1), '\\.([^.]+)$', 1)) AS suffix, string_split(regexp_replace(rel_path, '/?[^/]*$', ''), '/') AS folders FROM f),
    examined AS (SELECT repo, rel_path, suffix, CASE WHEN len(list_filter(folders, lambda d: (d LIKE '.%' AND length(d) > 1) OR d IN ('node_modules', 'target', '__pycache__', 'dist', 'build', 'out', 'coverage', 'htmlcov'))) > 0 THEN 'hidden or artefact folder'
        WHEN rel_path LIKE 'tests/%' THEN 'ignored'
        WHEN suffix NOT IN ('py','ts','js','jsx','mjs','go','rs','java','toml','yaml','yml','json','md') THEN 'unknown format'
        WHEN size_bytes > 1048576 THEN 'too large' WHEN content IS NULL THEN 'unreadable' WHEN instr(substr(content, 1, 8192), chr(0)) > 0 THEN 'binary' END AS skip FROM e)"""


def examined(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "walked_files").select("repo", "rel_path", "size_bytes", "content").distinct()
    return files.examine(rows, ignore=("tests/*",))


@query("S04_examine", f"WITH {_EXAMINED} SELECT repo, rel_path, skip FROM examined")
def examine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return examined(spark, sf_dir).select("repo", "rel_path", "skip")


@query("A13_run_report", f"""WITH {_EXAMINED}, r AS (SELECT repo, count(CASE WHEN skip IS NULL THEN 1 END) AS files, count(CASE WHEN skip = 'unreadable' THEN 1 END) AS unreadable, count(CASE WHEN skip = 'unknown format' THEN 1 END) AS unclaimed FROM examined GROUP BY repo)
    SELECT *, files + unclaimed AS candidates, unclaimed > (files + unclaimed) * 0.1 AS mostly_unclaimed FROM r""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.run_report(examined(spark, sf_dir))


@query("A12_unclaimed", f"WITH {_EXAMINED} SELECT CASE WHEN suffix = '' THEN '' ELSE '.' || suffix END AS suffix, count(*) AS files FROM examined WHERE skip = 'unknown format' GROUP BY 1")
def unclaimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.unclaimed_suffixes(examined(spark, sf_dir))


@query("S06_language", "SELECT lang, kind, count(*) AS n FROM (SELECT DISTINCT repo, rel_path, CASE suffix WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' WHEN 'jsx' THEN 'javascript' WHEN 'mjs' THEN 'javascript' WHEN 'go' THEN 'go' WHEN 'rs' THEN 'rust' WHEN 'java' THEN 'java' WHEN 'toml' THEN 'toml' WHEN 'yaml' THEN 'yaml' WHEN 'yml' THEN 'yaml' WHEN 'json' THEN 'json' WHEN 'md' THEN 'markdown' END AS lang, CASE WHEN suffix IN ('toml','yaml','yml','json') THEN 'config' WHEN suffix = 'md' THEN 'doc' WHEN suffix IN ('py','ts','js','jsx','mjs','go','rs','java') THEN 'code' END AS kind FROM (SELECT *, lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) AS suffix FROM walked_files)) GROUP BY lang, kind")
def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang, kind = files.language(F.col("rel_path"))
    return table(spark, sf_dir, "walked_files").select("repo", "rel_path").distinct().groupBy(lang.alias("lang"), kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query("A12_skip_tallies", """SELECT suffix, count(*) AS n FROM (SELECT DISTINCT repo, rel_path, lower(regexp_extract(rel_path, '\\.([^./]+)$', 1)) AS suffix FROM walked_files) GROUP BY suffix""")
def suffix_tallies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "walked_files").select("repo", "rel_path").distinct().groupBy(F.lower(F.regexp_extract("rel_path", r"\.([^./]+)$", 1)).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@query("S10_manifests", """WITH d AS (SELECT DISTINCT repo, name FROM links WHERE kind = 'depends_on' AND repo IS NOT NULL AND name IS NOT NULL)
    SELECT DISTINCT repo, 'manifest:' || repo AS src_chunk_id, 'provides' AS kind, repo AS name, 'package.json' AS path FROM d
    UNION ALL SELECT repo, 'manifest:' || repo, 'depends_on', name, 'package.json' FROM d WHERE name <> repo""")
def manifest_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of the manifests that the stored dependencies would have been read from."""
    needs = table(spark, sf_dir, "links").where("kind = 'depends_on' AND repo IS NOT NULL AND name IS NOT NULL").select("repo", "name").distinct()
    asked = F.map_from_entries(F.collect_list(F.struct("name", F.lit("1"))))
    made = needs.groupBy("repo").agg(asked.alias("dependencies")).select("repo", F.lit("package.json").alias("rel_path"), F.to_json(F.struct(F.col("repo").alias("name"), "dependencies")).alias("content"))
    return manifests.manifest_links(made)


@query("C02_markdown", r"""WITH f AS (SELECT repo, rel_path AS path, min_by(content, (-epoch_us(walked_at), content)) AS content FROM walked_files WHERE lang = 'markdown' AND content IS NOT NULL GROUP BY ALL),
    l AS (SELECT repo, path, regexp_split_to_array(content, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]') AS lines FROM f),
    k AS (SELECT repo, path, CASE WHEN lines[len(lines)] = '' THEN lines[1:len(lines) - 1] ELSE lines END AS lines FROM l),
    numbered AS (SELECT repo, path, unnest(range(len(lines))) AS n, unnest(lines) AS line FROM k),
    fe AS (SELECT *, sum(CASE WHEN starts_with(line, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY n ROWS UNBOUNDED PRECEDING) AS fences FROM numbered),
    se AS (SELECT *, sum(CASE WHEN starts_with(line, '#') AND fences % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY n ROWS UNBOUNDED PRECEDING) AS section FROM fe)
    SELECT repo, path, CAST(min(n) + 1 AS INTEGER) AS start_line, CAST(max(n) + 1 AS INTEGER) AS end_line, CASE WHEN section > 0 THEN trim(regexp_replace(min_by(line, n), '^#+', ''), ' ') END AS symbol
    FROM se GROUP BY repo, path, section HAVING max(CASE WHEN trim(line, ' ') <> '' THEN 1 ELSE 0 END) = 1""")
def markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.markdown_sections(table(spark, sf_dir, "walked_files"))


@query("C03_chunk_files")
def chunk_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.chunk_files(table(spark, sf_dir, "walked_files"))


@query("C15_commit_chunks", """WITH c AS (SELECT DISTINCT repo, id, text, path FROM chunks WHERE kind = 'commit' AND deleted_at IS NULL)
    SELECT repo, 'commits/' || substr(d, 1, 10) || '-' || substr(id, 1, 7) AS path, substr(id, 1, 7) AS symbol, md5(text) AS digest FROM (SELECT *, '2025-01-01T00:00:00Z' AS d FROM c) WHERE trim(text, ' ') <> ''""")
def commit_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits = table(spark, sf_dir, "chunks").where("kind = 'commit' AND deleted_at IS NULL").select("repo", "id", "text", "path").distinct()
    rows = commits.select("repo", F.col("id").alias("sha"), F.lit("2025-01-01T00:00:00Z").alias("author_date"), F.col("text").alias("message"))
    return chunking.commit_chunks(rows).select("repo", "path", "symbol", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("S14_metadata", f"WITH {LIVE} SELECT repo, id, path, start_line, end_line, kind FROM live WHERE kind = 'code'")
def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.live(table(spark, sf_dir, "chunks")).where("kind = 'code'").select("repo", "id", "path", "start_line", "end_line", "kind")


@query("S16_texts", f"""WITH {LIVE} SELECT l.repo, l.id, md5(l.text) AS digest FROM live l WHERE EXISTS (SELECT 1 FROM links x WHERE x.kind = 'defines' AND x.repo = l.repo AND x.src_chunk_id = l.id)""")
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of the chunks that define something: a point look-up by a table of ids."""
    ids = table(spark, sf_dir, "links").where("kind = 'defines'").select("repo", F.col("src_chunk_id").alias("id")).distinct()
    return store.live(table(spark, sf_dir, "chunks")).join(ids, ["repo", "id"], "left_semi").select("repo", "id", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("S18_datasets", "SELECT DISTINCT repo FROM chunks WHERE repo IS NOT NULL")
def datasets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.datasets(table(spark, sf_dir, "chunks"))


@query("U05_unsearched", "SELECT DISTINCT repo FROM (SELECT repo FROM documents UNION SELECT source FROM documents) WHERE repo IS NOT NULL AND repo NOT IN (SELECT repo FROM chunks WHERE repo IS NOT NULL)")
def unsearched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the repositories and sources that documents name, those that hold no chunks."""
    docs = table(spark, sf_dir, "documents")
    named = docs.select("repo").unionByName(docs.select(F.col("source").alias("repo"))).where("repo IS NOT NULL").distinct()
    return named.join(store.datasets(table(spark, sf_dir, "chunks")), "repo", "left_anti")


@query("K01_additions", f"WITH {LIVE} SELECT repo, count(*) AS n FROM live l WHERE indexed_at >= {_MID} AND NOT EXISTS (SELECT 1 FROM chunks o WHERE o.indexed_at < {_MID} AND o.repo = l.repo AND o.id = l.id) GROUP BY repo")
def additions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks")
    fresh = store.live(rows).where(F.col("indexed_at") >= _mid())
    return store.additions(fresh, rows.where(F.col("indexed_at") < _mid())).groupBy("repo").agg(F.count(F.lit(1)).alias("n"))


@query("K03_stale", f"""WITH {LIVE}, stored AS (SELECT DISTINCT repo, id, path FROM chunks WHERE indexed_at < {_MID} AND repo IS NOT NULL AND id IS NOT NULL)
    SELECT DISTINCT repo, id FROM stored s WHERE NOT EXISTS (SELECT 1 FROM live l WHERE l.repo = s.repo AND l.id = s.id)""")
def stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks")
    stored = rows.where(F.col("indexed_at") < _mid()).where("repo IS NOT NULL AND id IS NOT NULL")
    return store.stale(stored, store.live(rows)).select("repo", "id").distinct()


@query("K02_remove", f"""WITH {LIVE} SELECT repo, count(*) AS kept FROM live l WHERE NOT EXISTS (SELECT 1 FROM chunks d WHERE d.deleted_at IS NOT NULL AND d.repo = l.repo AND d.id = l.id) GROUP BY repo""")
def remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "chunks")
    return store.remove(store.live(rows), rows.where("deleted_at IS NOT NULL").select("repo", "id").where("repo IS NOT NULL AND id IS NOT NULL")).groupBy("repo").agg(F.count(F.lit(1)).alias("kept"))


@query("J05_moved", f"""WITH {LIVE} SELECT repo, id, start_line, start_line + 2 AS new_start FROM live WHERE path LIKE 'src/%'""")
def moved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose lines went stale: the same content, two lines added above it in the files of one folder."""
    old = store.live(table(spark, sf_dir, "chunks"))
    by = F.when(F.col("path").startswith("src/"), 2).otherwise(0)
    fresh = old.withColumn("start_line", F.col("start_line") + by).withColumn("end_line", F.col("end_line") + by)
    return store.moved(old, fresh).select("repo", "id", "start_line", "new_start")


@query("X16_html_text", r"""SELECT coalesce(url, '') AS url, coalesce(doc_kind, 'none') AS title, array_to_string(list_filter(list_transform(list_concat([coalesce(doc_kind, 'none')], string_split(text, chr(10))),
    lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'), ' ')), lambda x: x <> ''), chr(10)) AS text FROM documents WHERE text IS NOT NULL""")
def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as the readable part of pages with scripts, styles, comments, lists and entities."""
    safe = F.replace(F.replace(F.replace(F.col("text"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    kind = F.coalesce("doc_kind", F.lit("none"))
    head = F.concat(F.lit("<!doctype html><html><head><title> "), kind, F.lit("</title><style>p { color: red }</style></head><body><!-- <p>no</p> --><SCRIPT>var a = '<p>';</SCRIPT><h1 class='x'>"), kind, F.lit("</h1><ul><li>"))
    html = F.concat(head, F.replace(safe, F.lit("\n"), F.lit("</li>\t<li>")), F.lit("</li></ul><br/></body></html>"))
    pages = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(F.coalesce("url", F.lit("")).alias("url"), html.alias("html"))
    return connectors.pages_to_documents(pages).select("url", "title", "text")


@query("X25_search_terms", r"""WITH w AS (SELECT item_id, text, list_filter(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'), lambda x: lower(x) NOT IN ({stop})) AS said FROM eval_items),
    o AS (SELECT item_id, list_concat(list_transform(regexp_extract_all(text, '[`"'']([^`"'']{{3,60}})[`"'']', 1), lambda x: trim(x, ' ')), list_filter(said, lambda x: contains(x, '_') OR regexp_matches(x, '[a-z][A-Z]'))) AS first,
        list_transform(list_sort(list_filter(list_transform(range(1, len(said) + 1), lambda i: {{'size': -length(said[i]), 'i': i, 'word': said[i]}}), lambda x: x.size <= -6)), lambda x: x.word) AS long FROM w),
    a AS (SELECT item_id, list_concat(first, long) AS every FROM o),
    f AS (SELECT item_id, unnest(every) AS term, unnest(range(len(every))) AS pos FROM a), g AS (SELECT item_id, term, min(pos) AS pos FROM f GROUP BY ALL),
    r AS (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS place FROM g)
    SELECT item_id, term, CAST(place AS INTEGER) AS place FROM r WHERE place <= 8""".replace("{stop}", ", ".join(f"'{w}'" for w in T.STOP_WORDS)).replace("{{", "{").replace("}}", "}"))
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The terms one would look for by hand in every question."""
    found = table(spark, sf_dir, "eval_items").select("item_id", F.posexplode(T.search_terms(F.col("text"))).alias("at", "term"))
    return found.select("item_id", "term", (F.col("at") + 1).alias("place"))
