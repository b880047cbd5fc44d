from datetime import datetime

from pyspark.sql import functions as F

from tallyweave.operators import orphans

LINKS = "src_chunk_id string, kind string, name string, line int, dst_chunk_id string, norm string, repo string, path string, indexed_at timestamp"
CHUNKS = "repo string, id string, deleted_at timestamp, indexed_at timestamp"
T1, T2, T3 = datetime(2025, 1, 1), datetime(2025, 2, 1), datetime(2025, 3, 1)


def rows(df):
    return {(r.src_chunk_id, r.kind, r.name, r.field, r.origin, r.depth) for r in df.collect()}


def make(spark, links, chunks):
    return orphans.orphan_links(spark.createDataFrame(links, LINKS), spark.createDataFrame(chunks, CHUNKS))


def test_direct_and_inherited(spark):
    chunks = [("r", "a", None, T1), ("r", "gone", T2, T1), ("r", "late", None, T3), ("q", "other", None, T1)]
    links = [
        ("a", "mentions", "n1", 1, None, "lost", "r", "p", T2),  # no anchor at all
        ("gone", "defines", "n2", 2, None, "weak", "r", "p", T2),  # its chunk is deleted
        ("a", "mentions", "n3", 3, None, "weak", "r", "p", T2),  # anchored by an orphan only
        ("late", "mentions", "n4", 4, "a", "weak", "r", "p", T2),  # source arrives later
        ("other", "blamed_by", "n5", 5, "unknown", None, "r", "p", T2),  # lives in another repository
        (None, "mentions", "n6", 6, "", None, None, None, T2),  # null is no reference, empty is one
    ]
    found = rows(make(spark, [*links, links[0]], chunks))
    assert found == {
        ("a", "mentions", "n1", "norm", "direct", 0),
        ("gone", "defines", "n2", "src_chunk_id", "direct", 0),
        ("a", "mentions", "n3", "norm", "inherited", 1),
        ("late", "mentions", "n4", "src_chunk_id", "direct", 0),
        ("late", "mentions", "n4", "norm", "inherited", 1),
        ("other", "blamed_by", "n5", "src_chunk_id", "direct", 0),
        ("other", "blamed_by", "n5", "dst_chunk_id", "direct", 0),
        (None, "mentions", "n6", "dst_chunk_id", "direct", 0),
    }


def test_empty_tables_and_clashing_columns(spark):
    one = [("a", "mentions", "n", 1, None, "x", "r", "p", T2)]
    assert len(rows(make(spark, one, []))) == 2
    assert rows(make(spark, [], [("r", "a", None, T1)])) == set()
    links = spark.createDataFrame(one, LINKS).withColumn("field", F.lit(1)).withColumn("child", F.lit(2)).withColumn("__since", F.lit(3))
    chunks = spark.createDataFrame([("r", "a", None, T1)], CHUNKS).withColumn("kind", F.lit("k"))
    assert rows(orphans.orphan_links(links, chunks)) == {("a", "mentions", "n", "norm", "direct", 0)}


def test_hot_keys_give_the_same_rows(spark):
    chunks = [("r", f"c{i}", None, T1) for i in range(5)]
    links = [("c1" if i % 3 else "placeholder", "mentions", f"n{i}", i, "c2" if i % 2 else "nowhere", "hot" if i % 4 else "anchored", "r", "p", T2) for i in range(200)]
    links += [("c0", "defines", "d", 999, None, "anchored", "r", "p", T2)]
    plain = orphans.orphan_links(spark.createDataFrame(links, LINKS), spark.createDataFrame(chunks, CHUNKS), hot_rows=None)
    salted = orphans.orphan_links(spark.createDataFrame(links, LINKS), spark.createDataFrame(chunks, CHUNKS), hot_rows=20)
    assert rows(plain) == rows(salted) and len(rows(plain)) > 100


def test_chain_of_any_depth(spark):
    """Records that point at records of their own table, three levels down."""
    nodes = spark.createDataFrame([("a", "zzz"), ("b", "a"), ("c", "b"), ("d", "c"), ("e", None), ("f", "e")], "id string, up string")
    ref = orphans.Reference("up", ("up",), orphans.Parents(nodes, ("id",), record=("id", "up")))
    found = {(r.id, r.origin, r.depth) for r in orphans.cascade(nodes, ("id", "up"), [ref]).collect()}
    assert found == {("a", "direct", 0), ("b", "inherited", 1), ("c", "inherited", 2), ("d", "inherited", 3)}


def test_report_counts_by_month(spark):
    links = [("x", "mentions", "n", i, None, None, "r", "p", T1 if i < 3 else T2) for i in range(5)]
    report = orphans.orphan_report(make(spark, links, []))
    assert {(r.field, r.repo, r.month, r.direct_orphans) for r in report.collect()} == {("src_chunk_id", "r", "2025-01", 3), ("src_chunk_id", "r", "2025-02", 2)}
