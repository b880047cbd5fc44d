import json
import subprocess

import pytest
from pyspark.sql import functions as F

from tallyweave.sources import connectors, files, git, manifests
from tallyweave.streaming import flows


@pytest.fixture
def repo(tmp_path):
    root = tmp_path / "repo"
    root.mkdir()

    def run(*a):
        subprocess.run(["git", "-C", str(root), "-c", "user.name=t", "-c", "user.email=t@example.org", *a], check=True, capture_output=True)

    run("init", "-q")
    (root / "a.py").write_text("def f():\n    return 1\n")
    (root / "README.md").write_text("# Title\nalpha\n## Sub\nbeta\n")
    run("add", ".")
    run("commit", "-qm", "first\n\nRefs: TRK-1")
    return root, run


def test_git_tables(spark, repo):
    root, run = repo
    git.register(spark)
    repos = json.dumps({"r": str(root)})
    read = lambda t, **o: spark.read.format("git").option("repos", repos).option("table", t).options(**o).load()
    assert {(r.rel_path, r.change) for r in read("files").collect()} == {("a.py", "changed"), ("README.md", "changed")}
    first = git.head(str(root))
    (root / "b.py").write_text("x = 1\n")
    run("mv", "a.py", "c.py")
    run("add", ".")
    run("commit", "-qm", "second")
    got = {(r.rel_path, r.change) for r in read("files", since=json.dumps({"r": first})).collect()}
    assert got == {("b.py", "changed"), ("c.py", "changed"), ("a.py", "deleted")}
    assert [r.message.split("\n")[0] for r in read("commits").collect()] == ["second", "first"]
    assert {r.sha for r in read("blame").where("path = 'c.py'").collect()} == {first}
    assert read("commit_files").where("path = 'b.py'").count() == 1


def test_git_stream_moves_only_on_a_clean_tree(repo):
    root, _ = repo
    reader = git._StreamReader({"repos": json.dumps({"r": str(root)}), "table": "commits"})
    start = reader.initialOffset()
    end = reader.latestOffset()
    assert [len(list(reader.read(p))) for p in reader.partitions(start, end)] == [1]
    (root / "a.py").write_text("changed\n")
    assert reader.latestOffset() == end and reader.partitions(end, end) == []
    assert flows.full_pass_reason(None, None, "m", False) == "never indexed"
    assert flows.full_pass_reason("s", "m", "m", True) == "uncommitted changes"
    assert flows.full_pass_reason("s", "m", "m", False) is None


def test_name_status():
    raw = b"M\0a\0D\0b\0R100\0old\0new\0C75\0x\0y\0T\0t\0"
    assert git.name_status(raw) == (["a", "new", "y", "t"], ["b", "old"])
    with pytest.raises(ValueError):
        git.name_status(b"X\0a\0")


def test_file_policy(spark):
    rows = [("a.py", 10, "x"), (".git/x.py", 1, "x"), ("node_modules/a.js", 1, "x"), ("docs/skip.md", 1, "x"), ("a.bin", 1, "x"), ("big.py", 1 << 21, "x"), ("none.py", 5, None), ("nul.py", 3, "a\0b"), ("Dockerfile", 3, "FROM x")]
    df = spark.createDataFrame(rows, "rel_path string, size_bytes bigint, content string")
    got = {r.rel_path: r.skip for r in files.examine(df, ignore=("docs/*",)).collect()}
    assert got == {"a.py": None, ".git/x.py": "hidden or artefact folder", "node_modules/a.js": "hidden or artefact folder", "docs/skip.md": "ignored", "a.bin": "unknown format", "big.py": "too large", "none.py": "unreadable", "nul.py": "binary", "Dockerfile": None}
    own = files.examine(df, formats={".bin": ("text", "doc")}).where("rel_path = 'a.bin'").first()
    assert (own.found_lang, own.found_kind, own.skip) == ("text", "doc", None)


def test_read_folder(spark, repo):
    root, _ = repo
    got = {(r.rel_path, r.lang) for r in files.read_folder(spark, str(root), "r").where("NOT rel_path LIKE '.git/%'").collect()}
    assert got == {("a.py", "python"), ("README.md", "markdown")}


def test_manifests(spark):
    assert manifests.read_manifest("package.json", '{"name": "web", "dependencies": {"core": "1", "web": "2"}}') == ({"web"}, {"core"})
    assert manifests.read_manifest("pyproject.toml", '[project]\nname = "a"\ndependencies = ["b>=1", "c[x]"]') == ({"a"}, {"b", "c"})
    assert manifests.read_manifest("go.mod", "module example.org/a\n\nrequire (\n\texample.org/b v1.0.0\n)\n") == ({"example.org/a"}, {"example.org/b"})
    assert manifests.read_manifest("package.json", "{broken") == (set(), set())
    df = spark.createDataFrame([("r", "package.json", '{"name": "w", "dependencies": {"c": "1"}}'), ("r", "a/b/c/d/package.json", '{"name": "deep"}')], "repo string, rel_path string, content string")
    assert {(r.kind, r.name) for r in manifests.manifest_links(df).collect()} == {("provides", "w"), ("depends_on", "c")}


def test_documents_and_snapshots(spark):
    payload = json.dumps({"title": "Bug", "body": None, "state": "open", "number": 7, "html_url": "https://h.example/7", "user": {"login": "u"}, "labels": [{"name": "a"}, {"name": "b"}]})
    doc = connectors.issues_to_documents(spark.createDataFrame([(payload,), ("not json",)], "payload string")).collect()
    assert [(d.title, d.text, d.metadata["labels"]) for d in doc] == [("#7 Bug", "", "a,b")]
    page = connectors.pages_to_documents(spark.createDataFrame([("https://h.example/p", "<title>T \"q\"</title><p>x</p>")], "url string, html string"))
    out = connectors.render(page).first()
    assert out.path == "h.example/p.md" and out.markdown == '---\nurl: "https://h.example/p"\ntitle: "T \\"q\\""\n---\nx\n' or "x" in out.markdown
    fresh = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "path string, markdown string")
    stored = spark.createDataFrame([("a", "1"), ("b", "old"), ("d", "4")], "path string, markdown string")
    assert {tuple(r) for r in connectors.snapshot_changes(fresh, stored).collect()} == {("a", "unchanged"), ("b", "updated"), ("c", "added"), ("d", "removed")}
    rules = (("https://t.example/*", "tracker"), ("https://*", "web"))
    urls = spark.createDataFrame([("https://t.example/1",), ("https://x.example",), ("ftp://x",)], "u string")
    assert [r.c for r in urls.select(connectors.route(F.col("u"), rules).alias("c")).collect()] == ["tracker", "web", None]


def test_streams_equal_tables(spark, tmp_path):
    rows = [(f"2025-01-01 {h:02d}:{m:02d}:00", "r" if h % 2 else None, h % 3, float(h * 10 + m)) for h in range(6) for m in (5, 20, 50)]
    df = spark.createDataFrame(rows, "at string, repo string, hits int, ms double").select(F.to_timestamp("at").alias("searched_at"), "repo", "hits", "ms")
    df.write.parquet(str(tmp_path / "log"))
    stream = flows.search_log(spark, str(tmp_path / "log"), df.schema)
    for n, f in (("t", flows.tumbling), ("s", flows.sessions)):
        q = f(stream).writeStream.format("memory").queryName(f"q_{n}").outputMode("complete" if n == "t" else "complete").trigger(availableNow=True).start()
        q.awaitTermination()
        assert {tuple(r) for r in spark.table(f"q_{n}").collect()} == {tuple(r) for r in f(df).collect()}


def test_index_stream_is_idempotent(spark, tmp_path):
    schema = "repo string, rel_path string, lang string, kind string, content string"
    spark.createDataFrame([("r", "a.py", "python", "code", "def f():\n    return 1\n")], schema).write.parquet(str(tmp_path / "in"))
    for n in range(2):
        if n:
            spark.createDataFrame([("r", "b.py", "python", "code", "x = 1\n"), ("r", "a.py", "python", "code", "def f():\n    return 1\n")], schema).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        flows.index_stream(stream, str(tmp_path / "store"), str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "store") + "/batch=*")
    assert sorted((r.path, r.symbol) for r in got.collect()) == [("a.py", "f"), ("b.py", None)]


def test_charsets_of_responses(spark):
    assert [connectors.charset(t) for t in (None, "text/html", 'text/html; charset="latin-1"', "text/html; Charset=nonsense", "text/html; charset=rot_13", "x; charset=utf-32")] == ["utf-8", "utf-8", "latin-1", "utf-8", "utf-8", "utf-32"]
    df = spark.createDataFrame([("text/html; charset=latin-1", b"caf\xe9"), (None, b"caf\xc3\xa9"), ("x", b"\xff"), (None, None)], "t string, b binary")
    assert [r.x for r in df.select(connectors.decoded(df.t, df.b).alias("x")).collect()] == ["café", "café", "\ufffd", None]


def test_fetching_routes_and_reports_failures(spark):
    class Notes(connectors.Connector):
        name = "notes"

        def understands(self, url):
            return url.startswith("note:")

        def fetch(self, url):
            if "bad" in url:
                raise ValueError("gone")
            return url, "T", f"text of {url}", {"by": "notes"}

    df = spark.createDataFrame([("note:a",), ("note:bad",), ("ftp://x",), (None,), ("note:a",)], "url string")
    got = {r.url: (r.text, r.failed) for r in connectors.fetch(df, connectors=[Notes()]).collect()}
    assert got == {"note:a": ("text of note:a", None), "note:bad": (None, "gone"), "ftp://x": (None, "no connector understands it")}
    ruled = connectors.fetch(df.limit(1), (("note:*", "other"),), [Notes()]).first()
    assert ruled.failed == "no connector 'other'"


def test_snapshot_on_disk(spark, tmp_path):
    rows = [("a/x.md", "one"), ("a/y.md", "two"), ("a/y.md", "also")]
    df = spark.createDataFrame(rows, "path string, markdown string")
    assert [tuple(r) for r in connectors.collisions(df).collect()] == [("a/y.md", 2)]
    assert {tuple(r) for r in connectors.materialise(df, str(tmp_path)).collect()} == {("a/x.md", "added"), ("a/y.md", "added")}
    assert (tmp_path / "a/y.md").read_text() == "also"
    changed = spark.createDataFrame([("a/x.md", "one"), ("a/y.md", "new")], "path string, markdown string")
    assert {tuple(r) for r in connectors.materialise(changed, str(tmp_path)).collect()} == {("a/x.md", "unchanged"), ("a/y.md", "updated")}
    assert connectors.load_plugins() == []
