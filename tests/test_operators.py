from pyspark.sql import functions as F

from tallyweave.operators import chunking, domains, duplicates, links, search, stats, store

LINK = "src_chunk_id string, kind string, name string, line int, repo string, path string"


def link_rows(spark, rows):
    from tallyweave.functions import text as T

    df = spark.createDataFrame(rows, LINK)
    return df.withColumn("norm", T.normalised(F.col("name"))).withColumn("dst_chunk_id", F.lit(None).cast("string")).withColumn("via", F.lit(None).cast("string")).withColumn("indexed_at", F.current_timestamp())


def report(spark, rows):
    return {(r.status, r.user, r.owner, r.names, r.examples) for r in links.dependency_report(link_rows(spark, rows)).collect()}


BASE = [("w", "provides", "web", 1, "web", "m"), ("w", "mentions", "RetryPolicy", 1, "web", "a"), ("w", "mentions", "BackoffWindow", 2, "web", "a"),
        ("c", "provides", "core", 1, "core", "m"), ("c", "defines", "RetryPolicy", 1, "core", "b"), ("c", "defines", "BackoffWindow", 2, "core", "b")]


def test_dependencies(spark):
    assert report(spark, BASE) == {("undeclared", "web", "core", 2, "BackoffWindow,RetryPolicy")}
    assert report(spark, [*BASE, ("w", "depends_on", "core", 9, "web", "m")]) == {("used", "web", "core", 2, "BackoffWindow,RetryPolicy")}
    # Either direction of a declaration connects two repositories.
    assert report(spark, [*BASE, ("c", "depends_on", "web", 9, "core", "m")]) == {("unused", "core", "web", 0, "")}
    # One shared name is not enough, and a declared pair without any is idle.
    few = [BASE[0], BASE[1], BASE[3], BASE[4]]
    assert report(spark, few) == set()
    assert report(spark, [BASE[0], BASE[3], ("w", "depends_on", "core", 9, "web", "m")]) == {("unused", "web", "core", 0, "")}
    bridged = [("w", "mentions", "MaxRetries", 1, "web", "a"), ("w", "mentions", "ReadTimeout", 2, "web", "a"), ("c", "declares", "max_retries", 1, "core", "b"), ("c", "declares", "read_timeout", 2, "core", "b")]
    assert report(spark, bridged) == {("undeclared", "web", "core", 2, "max_retries,read_timeout")}


def test_prune_and_rescue(spark):
    rows = link_rows(spark, [("a", "mentions", "Lonely", 1, "r", "p"), ("a", "mentions", "MaxRetries", 2, "r", "p"), ("b", "declares", "max_retries", 1, "r", "q"), ("a", "reads_key", "8080", 3, "r", "p")])
    kept, gone = links.prune(rows)
    assert {r.name for r in kept.collect()} == {"MaxRetries", "max_retries", "8080"}
    assert [r.norm for r in gone.collect()] == ["lonely"]
    assert [r.norm for r in links.rescued(gone, spark.createDataFrame([("lonely",)], "norm string")).collect()] == ["lonely"]
    assert {r.name for r in links.drift(rows).collect()} == {"8080"}


def test_references_prefer_the_exact_spelling(spark):
    rows = link_rows(spark, [("a", "mentions", "maxRetries", 1, "a", "p"), ("b", "defines", "max_retries", 5, "z", "p")])
    found = links.references(rows, spark.createDataFrame([(1, "max_retries")], "query_id bigint, name string")).orderBy("rank").collect()
    assert [r.name for r in found] == ["max_retries", "maxRetries"]


def test_text_mentions_of_names_in_any_form(spark):
    text = "port = 8080\nport = 18080\nsee PROJ-412, not PROJ-4123\nPROJ-4123\na.b-c d\naxb-c\nUseGröße(größe)\nx8080 8080_\nmax_retries\nxmax_retries 8080.\nlist[0](x)\n"
    chunks = spark.createDataFrame([("r", "p", 11, text)], "repo string, path string, start_line int, text string")
    names = spark.createDataFrame(list(enumerate(["8080", "PROJ-412", "a.b-c", "größe", "max_retries", "[0](x", "--", ""])), "query_id bigint, name string")
    stored = spark.createDataFrame([("r", "p", 11, 4)], "repo string, path string, line int, query_id bigint")
    got = {(r.name, r.line) for r in links.text_mentions(chunks, names, stored).collect()}
    assert got == {("8080", 11), ("8080", 20), ("PROJ-412", 13), ("a.b-c", 15), ("größe", 17), ("max_retries", 19)}


def test_blame_takes_the_first_line_in_range(spark):
    chunks = spark.createDataFrame([("r", "p", "c1", "code", 1, 5), ("r", "p", "c2", "code", 4, 9)], "repo string, path string, id string, kind string, start_line int, end_line int")
    blame = spark.createDataFrame([("r", "p", i, "aaaaaaaa" if i < 5 else "bbbbbbbb") for i in range(1, 9)], "repo string, path string, line int, sha string")
    commits = spark.createDataFrame([("r", "aaaaaaaa", "commit-a")], "repo string, sha string, id string")
    got = {(r.src_chunk_id, r.name, r.line, r.dst_chunk_id) for r in links.blame_links(chunks, blame, commits).collect()}
    assert got == {("c1", "aaaaaaa", 1, "commit-a"), ("c1", "bbbbbbb", 5, None), ("c2", "aaaaaaa", 4, "commit-a"), ("c2", "bbbbbbb", 5, None)}


def test_fusion_keeps_the_first_arm_and_counts_arms(spark):
    schema = "query_id bigint, repo string, id string, score double, rank int"
    a = spark.createDataFrame([(1, "r", "x", 0.9, 1), (1, "r", "y", 0.8, 2)], schema)
    b = spark.createDataFrame([(1, "r", "y", 7.0, 1), (1, "r", "z", 6.0, 2)], schema)
    rows = search.fuse(a, b).orderBy("rank").collect()
    assert [(r.id, r.found_by, r.score) for r in rows] == [("y", 2, 0.8), ("x", 1, 0.9), ("z", 1, 6.0)]


def test_quota_and_budget(spark):
    rows = [(1, i, "commit" if i <= 4 else "code", f"c{i}", "x" * 30) for i in range(1, 9)]
    df = spark.createDataFrame(rows, "query_id bigint, rank int, kind string, id string, text string")
    assert [r.id for r in search.within_quota(df, 5).orderBy("place").collect()] == ["c1", "c5", "c6", "c7", "c8"]
    assert [r.id for r in search.fit(df, 35).orderBy("rank").collect()] == ["c1", "c2", "c3"]


def test_nearest_equals_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(120, 8))
    df = spark.createDataFrame([(i, m[i].tolist()) for i in range(120)] + [(500, [0.0] * 8), (501, [1.0] * 7), (502, [float("nan")] * 8), (503, None)], "id bigint, vector array<double>")
    got = search.nearest(df.select(F.col("id").alias("query_id"), "vector"), df.select(F.col("id").alias("row_id"), "vector"), 3, 8, block_rows=50)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    sims = unit @ unit.T
    np.fill_diagonal(sims, -2)
    want = {(i, int(j)) for i in range(120) for j in np.argsort(-sims[i])[:3]}
    assert {(r.query_id, r.row_id) for r in got.collect()} == want


def test_duplicate_code(spark):
    def body(seed, n=15):
        return "\n".join([f"def f_{seed}(a):"] + [f"    v{seed}_{i} = call_{i}(a, b{i % 4}, c{seed}_{i % 3}, d{i})" for i in range(n)])

    rows = [("r", f"v{i}", f"vendor/lib/m{i}.py", "code", body(i)) for i in range(12)]
    rows += [("r", f"t{i}", f"third_party/lib/m{i}.py", "code", body(i)) for i in range(12)]
    rows += [("r", "h1", "app/report.py", "code", body(99)), ("r", "h2", "app/summary.py", "code", body(99) + "\n    extra = 1"), ("r", "u", "app/unrelated.py", "code", "x = 1")]
    df = spark.createDataFrame(rows, "repo string, id string, path string, kind string, text string").withColumn("start_line", F.lit(1)).withColumn("end_line", F.lit(15))
    found = duplicates.pairs(duplicates.fingerprints(df), minimum=0.8)
    assert {(r.id_a, r.id_b) for r in found.collect()} == {("h1", "h2"), *{(f"t{i}", f"v{i}") for i in range(12)}}
    groups = {(r.left, r.right, r.pairs, r.left_files, r.wholesale, r.within) for r in duplicates.folder_groups(found).collect()}
    assert groups == {("r:app", "r:app", 1, 1, False, True), ("r:third_party/lib", "r:vendor/lib", 12, 12, True, False)}


def test_co_change_of_a_huge_commit(spark):
    rows = [("r", "big", f"f{i:02d}") for i in range(12)] + [("r", s, f) for s in ("s1", "s2") for f in ("f00", "f01")]
    df = spark.createDataFrame(rows, "repo string, sha string, path string")
    whole = {tuple(r) for r in domains.co_change(df, least=1).collect()}
    sliced = {tuple(r) for r in domains.co_change(df, least=1, most_files=5).collect()}
    assert whole == sliced and len(whole) == 66 and ("r", "f00", "f01", 3) in whole


def test_depth_and_prefix(spark):
    df = spark.createDataFrame([("r", "src/app/a/x.py"), ("r", "src/app/b/y.py"), ("r", "tests/t.py"), ("q", "one.py")], "repo string, path string")
    assert {tuple(r) for r in domains.source_prefix(df).collect()} == {("r", "src/app/"), ("q", "")}
    deep = spark.createDataFrame([("r", "src/test/a.java"), ("r", "src/main/b.java"), ("r", "src/main/tools/c.java"), ("r", "tools/d.py"), ("t", "tests/x.py")], "repo string, path string")
    assert {tuple(r) for r in domains.source_prefix(deep).collect()} == {("r", "src/main/"), ("t", "")}
    only = df.where("path like 'src/%'")
    assert {tuple(r) for r in domains.branching_depth(only).collect()} == {("r", 3)}


def test_percentiles_by_rank(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (10, 20, 30, 40, 100)], "g string, v double")
    r = stats.nearest_rank(df, ["g"], "v", {"p50": 0.5, "p95": 0.95}).first()
    assert (r.n, r.p50, r.p95) == (5, 30.0, 100.0)
    log = spark.createDataFrame([("q1", 3), ("q1", 0)], "query_text string, hits int").withColumn("searched_at", F.current_timestamp())
    assert stats.totals(log).select("empty", "empty_rate").first()[:] == (1, 0.5)


def test_windows_and_sections():
    lines = [f"line {i}" for i in range(1, 101)]
    assert [(a, b) for a, b, *_ in chunking.windows(lines)] == [(1, 40), (31, 70), (61, 100)]
    assert chunking.windows(["", ""]) == []
    text = "intro line\n# One\nbody a\n## Two\nbody b\n".splitlines()
    assert [(a, b, s) for a, b, s, _ in chunking.markdown_spans(text)] == [(1, 1, None), (2, 3, "One"), (4, 5, "Two")]
    fenced = "# Real\n```\n# not a header\n```\ntail".splitlines()
    assert [(a, b, s) for a, b, s, _ in chunking.markdown_spans(fenced)] == [(1, 5, "Real")]
    long = ["x" * 2000, "y"]
    assert [(a, b) for a, b, *_ in chunking.windows(long)] == [(1, 1), (2, 2)]


def test_every_filled_line_is_covered():
    text = "import os\n\nX = 1\n\n@dec\ndef f():\n    return 1\n\nclass A:\n    y = 2\n\n    def m(self):\n        pass\n"
    spans = chunking.spans_of(text, "python", "code")
    held = {i for a, b, *_ in spans for i in range(a, b + 1)}
    assert {i for i, line in enumerate(text.splitlines(), 1) if line.strip()} <= held
    assert {"f", "A", "A.m"} <= {s for _, _, s, _ in spans}
    go = "package a\n\nfunc (s *Store) Get(k string) int {\n\treturn 1\n}\n\ntype T struct {\n\tx int\n}\n"
    assert {s for _, _, s, _ in chunking.spans_of(go, "go", "code")} >= {"Store.Get", "T"}
    assert chunking.spans_of("def broken(:\n", "python", "code")[0][3] == "parse-error"


def test_every_filled_line_of_a_component_is_covered():
    vue = "<!-- <script> -->\n<template>\n  <div v-if=\"a > b\">\n    <template #head>\n      <b>x</b>\n    </template>\n    <template #none />\n    <i>after</i>\n  </div>\n</template>\n\n<script lang=\"ts\">\nexport function f(a: number) {\n  return a\n}\n</script>\n<style>p { a: b }</style>\n<i18n>\n{}\n</i18n>\n"
    svelte = "<script>\n  let n = 1\n</script>\n\n<h1>{n}</h1>\n{#if n}\n  <p>text</p>\n{/if}\n"
    for lang, text in (("vue", vue), ("vue", vue.replace("\n", "\r\n")), ("svelte", svelte), ("svelte", "<script>\nlet open\n<p>x</p>\n"), ("vue", "<template>\n\n</template>")):
        spans = chunking.spans_of(text, lang, "code")
        held = {i for a, b, *_ in spans for i in range(a, b + 1)}
        lines = text.splitlines()
        assert {i for i, line in enumerate(lines, 1) if line.strip()} <= held <= set(range(1, len(lines) + 1)), (lang, text, spans)
    assert (13, 15, "f", "function_declaration") in chunking.spans_of(vue, "vue", "code")
    inner = {lang: (first, part) for lang, first, part in chunking.container_sections(vue)}
    assert set(inner) == {"html", "typescript", "css"} and inner["html"][0] == 2 and "after" in inner["html"][1] and inner["typescript"][0] == 12


def test_markdown_by_window_functions_equals_the_scan(spark):
    texts = ["intro\n# One\nx\n## Two\ny\n", "# A\n```\n# no\n```\nt", "\n\n# One\nbody", "", "\n\n", "plain"]
    df = spark.createDataFrame([("r", f"p{i}", "markdown", t) for i, t in enumerate(texts)], "repo string, rel_path string, lang string, content string")
    got = {(r.path, r.start_line, r.end_line, r.symbol) for r in chunking.markdown_sections(df).collect()}
    want = {(f"p{i}", a, b, s) for i, t in enumerate(texts) for a, b, s, _ in chunking.markdown_spans(t.splitlines())}
    assert got == want


def test_store_life(spark):
    schema = "repo string, id string, path string, start_line int, end_line int"
    old = spark.createDataFrame([("r", "a", "p", 1, 2), ("r", "b", "p", 3, 4), ("q", "a", "p", 1, 2)], schema)
    new = spark.createDataFrame([("r", "a", "p", 5, 6), ("r", "c", "p", 1, 2), ("r", "c", "p", 1, 2)], schema)
    assert [(r.repo, r.id) for r in store.additions(new, old).collect()] == [("r", "c")]
    assert {(r.repo, r.id) for r in store.stale(old, new).collect()} == {("r", "b"), ("q", "a")}
    assert [(r.id, r.new_start) for r in store.moved(old, new).collect()] == [("a", 5)]
    assert {(r.repo, r.id) for r in store.remove(old, new).collect()} == {("r", "b"), ("q", "a")}


def test_copies_past_any_number_keep_their_links(spark):
    """Fifty copies, a near copy of them and a stranger: no shingle is too common to count."""
    body = lambda salt: [f"name_{salt}_{i}" for i in range(70)]
    near = body("a")[:60] + [f"other_{i}" for i in range(10)]
    texts = [("r", f"c{i:02d}", f"f{i}/x.py", body("a")) for i in range(50)] + [("r", "near", "n.py", near), ("r", "far", "z.py", body("b")), ("r", "zz", "f0/x.py", body("a"))]
    rows = spark.createDataFrame([(r, i, p, 1, 9, "code", "\n".join(t)) for r, i, p, t in texts], "repo string, id string, path string, start_line int, end_line int, kind string, text string")
    found = duplicates.pairs(duplicates.fingerprints(rows)).collect()
    assert {(r.id_a, r.id_b) for r in found if r.jaccard == 1.0} == {("c00", f"c{i:02d}") for i in range(1, 50)} | {("c00", "zz")}
    assert [(r.id_a, r.id_b) for r in found if r.jaccard < 1.0] == [("c00", "near")]


def test_prefix_filter_is_exact(spark):
    import random

    rng = random.Random(5)
    sets = {i: sorted({int(rng.expovariate(0.05)) for _ in range(rng.randint(1, 40))}) for i in range(120)}
    df = spark.createDataFrame(list(sets.items()), "key bigint, shingles array<bigint>")
    want = {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) >= 0.45 * len(set(sets[a]) | set(sets[b]))}
    assert {(r.a, r.b) for r in duplicates.similar(df).collect()} == want and want


def test_run_report_and_forgotten_log(spark, tmp_path):
    from tallyweave.sources import files

    rows = [("r", f"a{i}.py", 1, "x") for i in range(9)] + [("r", "b.zzz", 1, "x"), ("r", "c.zzz", 1, "x"), ("r", ".git/d.zzz", 1, "x"), ("q", "e.py", 1, None)]
    seen = files.examine(spark.createDataFrame(rows, "repo string, rel_path string, size_bytes bigint, content string"))
    got = {r.repo: (r.files, r.unreadable, r.unclaimed, r.candidates, r.mostly_unclaimed) for r in files.run_report(seen).collect()}
    assert got == {"r": (9, 0, 2, 11, True), "q": (0, 1, 0, 0, False)}
    assert [tuple(r) for r in files.unclaimed_suffixes(seen).collect()] == [(".zzz", 2)]


def test_stored_index_reads_only_the_asked_terms(spark, tmp_path):
    texts = [("r", f"c{i}", "code", f"alpha beta word{i} " + "gamma " * (i % 5)) for i in range(60)] + [("r", "k", "commit", "alpha")]
    chunks = spark.createDataFrame(texts, "repo string, id string, kind string, text string")
    asked = spark.createDataFrame([(1, "gamma word7"), (2, "nothing here"), (3, "")], "query_id bigint, query_text string")
    want = {tuple(r) for r in search.lexical(chunks, asked, 5).collect()}
    search.store_index(chunks, str(tmp_path / "ix"))
    found = search.lexical_stored(spark, str(tmp_path / "ix"), asked, 5)
    assert {tuple(r) for r in found.collect()} == want and len(want) == 5
    old = search.MOST_CELLS
    search.MOST_CELLS = 1
    try:
        assert {tuple(r) for r in search.lexical(chunks, asked, 5).collect()} == want
    finally:
        search.MOST_CELLS = old
    plan = search.stored_postings(spark, str(tmp_path / "ix"), ["gamma", "word7"], "r")._jdf.queryExecution().toString()
    assert "In(term, [gamma,word7])" in plan and "(repo" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_metrics_as_text(spark):
    df = spark.createDataFrame([("a", 3.0), ("a", 30.0), ('q"', 9000.0)], "repo string, ms double")
    text = stats.exposition("search_ms", stats.histogram(df, ["repo"], "ms", (5.0, 50.0)), ["repo"], stats.counters(df, ["repo"]))
    assert text[0] == "# TYPE search_ms histogram" and 'search_ms_bucket{repo="a",le="5"} 1' in text and 'search_ms_bucket{repo="a",le="+Inf"} 2' in text
    assert 'search_ms_count{repo="a"} 2' in text and 'search_ms_sum{repo="a"} 33' in text and 'search_ms_total{repo="q\\""} 1' in text


def test_last_texts_are_remembered():
    class Counting(search.SeededEmbedder):
        calls = 0

        def embed(self, texts):
            Counting.calls += 1
            return super().embed(texts)

    e = search.LastTexts(Counting())
    assert e.embed(["a"]) == e.embed(["a"]) and Counting.calls == 1 and e.embed(["b"]) != e.embed(["a"])


def test_lexical_search_keeps_only_the_best_of_each_task(spark):
    """Many blocks and equal scores: exactly k of every query leave a partition, the first by repository and id."""
    texts = [("r" if i % 3 else "q", f"c{i * 7919 % 1000:03}", "code", f"alpha {'beta ' * (i % 4)}{'gamma ' * (i % 2)}") for i in range(1000)] + [("r", "none", "code", None)]
    chunks = spark.createDataFrame(texts, "repo string, id string, kind string, text string").repartition(8)
    asked = spark.createDataFrame([(1, "alpha beta"), (2, "beta ALPHA"), (3, "gamma"), (4, "delta")], "query_id bigint, query_text string")
    terms = search._terms(asked)
    docs = chunks.select("repo", "id", search.T.tokens(F.col("text")).alias("words"))
    want = sorted(map(tuple, search._lexical_joined(docs, terms, 5).collect()))
    wide, search.WIDE_DOCS, block, search.BLOCK_DOCS = search.WIDE_DOCS, 100, search.BLOCK_DOCS, 30
    try:
        got = sorted(map(tuple, search.lexical(chunks, asked, 5).collect()))
        pairs = search._few(terms)
        numbered = {t: i for i, t in enumerate(sorted(pairs["term"].unique()))}
        rows = chunks.where("text IS NOT NULL").select("repo", "id", "kind", "text").toPandas()
        counted = next(search._counted(list(numbered), ["repo", "id"])(iter([search.pa.RecordBatch.from_pandas(rows)]))).to_pandas()
        blocks = list(search._packed(iter([counted])))
        left = search.pd.concat(search._scored([search.np.array([numbered["alpha"]])], 0, search.np.ones(len(numbered)), 3.0, 5)(iter(blocks)))
    finally:
        search.WIDE_DOCS, search.BLOCK_DOCS = wide, block
    assert [tuple(r)[:3] for r in got] == [tuple(r)[:3] for r in want] and all(abs(a[3] - b[3]) < 2e-6 and a[4] == b[4] for a, b in zip(got, want, strict=True)) and len(got) == 15
    assert len(blocks) > 30 and len(left) == 5


def test_stored_index_packs_the_postings_of_a_block(spark, tmp_path):
    texts = [("r", f"c{i:03}", "code", f"alpha word{i % 9} " + "gamma " * (i % 5)) for i in range(300)] + [("s", "x", "code", None), ("s", "y", "code", "Alpha")]
    chunks = spark.createDataFrame(texts, "repo string, id string, kind string, text string").coalesce(1)
    search.store_index(chunks, str(tmp_path / "ix"))
    rows = search.stored_postings(spark, str(tmp_path / "ix"), ["alpha"]).where("term IS NOT NULL").collect()
    assert sorted((r.repo, len(r.doc), sum(r.tf)) for r in rows) == [("r", 300, 300), ("s", 1, 1)]
    asked = spark.createDataFrame([(1, "gamma word7"), (2, "alpha")], "query_id bigint, query_text string")
    want = [tuple(r) for r in search.lexical(chunks, asked, 5).orderBy("query_id", "rank").collect()]
    cells, named = search.MOST_CELLS, search.MOST_NAMED
    try:
        for search.MOST_CELLS, search.MOST_NAMED in ((cells, named), (cells, 1), (1, named)):
            assert [tuple(r) for r in search.lexical_stored(spark, str(tmp_path / "ix"), asked, 5).orderBy("query_id", "rank").collect()] == want
    finally:
        search.MOST_CELLS, search.MOST_NAMED = cells, named
    assert len(want) == 10
