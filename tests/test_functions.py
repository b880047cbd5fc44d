import hashlib

from pyspark.sql import functions as F

from tallyweave.functions import numbers as N
from tallyweave.functions import text as T


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_chunk_id_is_the_content_address(spark):
    text, path = "grüße 😀\n", "src/a.py"
    raw = text.encode() + len(text).to_bytes(8, "big") + path.encode() + len(path).to_bytes(8, "big")
    assert one(spark, T.chunk_id(F.col("t"), F.col("p")), t=text, p=path) == hashlib.sha256(raw).hexdigest()


def test_lines_as_python_splits_them(spark):
    for text in ["a\nb", "a\r\nb\n", "\n", "a\n\nb\n\n", "a\x0bb c", "x\r"]:
        assert one(spark, T.lines(F.col("t")), t=text) == text.splitlines(), repr(text)


def test_names(spark):
    assert one(spark, T.normalised(F.col("n")), n="Max_Retry-Count.x") == "maxretrycountx"
    assert one(spark, T.words(F.col("n")), n="src/foo_bar.py") == "src foo bar py"
    assert one(spark, T.spellings(F.col("n")), n="max_retries") == ["max_retries", "MaxRetries", "maxRetries", "MAX_RETRIES"]
    assert one(spark, T.package_of(F.col("p"), 2), p="a/b/c/d.py") == "a/b"
    assert one(spark, T.package_of(F.col("p"), 2), p="d.py") == "(root)"


def test_globs(spark):
    assert T.glob_to_like("src/**/a_?%.py") == "src/%/a\\__\\%.py"
    paths = spark.createDataFrame([("src/x/a_1.py",), ("src/axb.py",), ("lib/a_1.py",)], "path string")
    assert [r.path for r in paths.where(T.matches_glob(F.col("path"), "src/*a_?.py")).collect()] == ["src/x/a_1.py"]


def test_shingles_need_enough_names(spark):
    assert one(spark, T.shingles(T.identifiers(F.col("t")), 5), t="a b c d e f a b c d e") == ["a b c d e", "b c d e f", "c d e f a", "d e f a b", "e f a b c", "f a b c d"]
    assert one(spark, T.shingles(T.identifiers(F.col("t")), 5), t="a b c") == []


def test_html_and_paths(spark):
    page = "<html><head><title> A &amp; B </title></head><body><script>x<1</script><p>one  two<p>three &lt;4&gt;<br>five</body></html>"
    assert one(spark, T.html_text(F.col("h")), h=page) == "one two\nthree <4>\nfive"
    assert one(spark, T.document_path(F.col("u")), u="https://User:pw@Docs.Example/a/../b/?q=1#frag") == "docs.example/a/b-q=1/index.md"
    assert one(spark, T.document_path(F.col("u")), u="https://docs.example") == "docs.example/index.md"


def test_references(spark):
    assert one(spark, T.ports_read(F.col("t")), t="BASE = 'http://localhost:8080/x' http://h:8080") == ["8080"]
    assert one(spark, T.urls(F.col("t")), t="see https://a.example/x). and (https://b.example/y?z=1),") == ["https://a.example/x", "https://b.example/y?z=1"]
    got = one(spark, T.tickets(F.col("t"), "PROJ-", "https://t.example/{key}"), t="fix PROJ-412, XPROJ-1")
    assert [(g.name, g.url) for g in got] == [("PROJ-412", "https://t.example/PROJ-412")]


def test_mcnemar_matches_the_binomial(spark):
    from math import comb

    for b, c in [(0, 0), (1, 9), (5, 5), (12, 3), (40, 22)]:
        n, low = b + c, min(b, c)
        exact = min(1.0, 2 * sum(comb(n, i) for i in range(low + 1)) / 2**n) if n else 1.0
        assert abs(one(spark, N.mcnemar(F.col("b"), F.col("c")), b=b, c=c) - exact) < 1e-12


def test_paths_of_addresses_keep_apart(spark):
    path = lambda u: one(spark, T.document_path(F.col("u")), u=u)
    assert path("http://h:8080/a.md") == "h-8080/a.md" and path("https://h/wiki?page=Home") == "h/wiki-page=Home.md"
    assert path("https://h/uv/") == "h/uv/index.md" and path("https://h/uv") == "h/uv.md" and path("https://h/?q") == "h/q/index.md"
    a, b = path("https://h/" + "x" * 300 + "1"), path("https://h/" + "x" * 300 + "2")
    assert a != b and max(map(len, a.split("/"))) < 120


def test_terms_and_phrases(spark):
    text = "Why does `bad token` break parse_rows when the version of LoadTable is unexpected in mountains"
    assert one(spark, T.search_terms(F.col("q")), q=text) == ["bad token", "parse_rows", "LoadTable", "mountains"]
    assert one(spark, T.search_terms(F.col("q")), q="") == [] and len(one(spark, T.search_terms(F.col("q")), q=" ".join(f"name_{i}" for i in range(20)))) == 8
    said = "Here are phrases:\n- keep alive schedule\n* heartbeat-check\n$ rm x\ngrep -r x\nno\n" + " ".join(["w"] * 15) + "\nA remark.\nthird one"
    assert one(spark, T.phrases(F.col("s"), 2), s=said) == ["keep alive schedule", "heartbeat-check"]
