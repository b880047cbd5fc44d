"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.operators import orphans
from tallyweave.plans.registry import query
from tallyweave.session import table


@query("p4_found", """
    SELECT DISTINCT l.repo, l.src_chunk_id, l.kind, l.name, l.line, f.field
    FROM (SELECT DISTINCT repo, src_chunk_id, kind, name, line, indexed_at, dst_chunk_id, norm FROM links) l
    CROSS JOIN (VALUES ('src_chunk_id'), ('dst_chunk_id'), ('norm')) f(field)
    WHERE (f.field = 'src_chunk_id' AND l.src_chunk_id IS NOT NULL AND NOT EXISTS (
              SELECT 1 FROM chunks c WHERE c.repo = l.repo AND c.id = l.src_chunk_id
                 AND c.deleted_at IS NULL AND c.indexed_at <= l.indexed_at))
       OR (f.field = 'dst_chunk_id' AND l.dst_chunk_id IS NOT NULL AND NOT EXISTS (
              SELECT 1 FROM chunks c WHERE c.repo = l.repo AND c.id = l.dst_chunk_id
                 AND c.deleted_at IS NULL AND c.indexed_at <= l.indexed_at))
       OR (f.field = 'norm' AND l.norm IS NOT NULL AND l.kind = 'mentions' AND NOT EXISTS (
              SELECT 1 FROM links a WHERE a.kind IN ('defines', 'declares') AND a.norm = l.norm))
""")
def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orphans.orphan_links(table(spark, sf_dir, "links"), table(spark, sf_dir, "chunks"))
    return rows.where(F.col("origin") == "direct").select("repo", "src_chunk_id", "kind", "name", "line", "field").distinct()


@query("p4_report", """
    WITH l AS (SELECT DISTINCT repo, src_chunk_id, kind, name, line, indexed_at, dst_chunk_id, norm FROM links),
    c AS (SELECT repo, id, min(indexed_at) AS since FROM chunks WHERE deleted_at IS NULL AND repo IS NOT NULL AND id IS NOT NULL GROUP BY ALL),
    o AS (SELECT l.*, l.src_chunk_id IS NOT NULL AND NOT coalesce(s.since <= l.indexed_at, false) AS bad_src, l.dst_chunk_id IS NOT NULL AND NOT coalesce(d.since <= l.indexed_at, false) AS bad_dst
        FROM l LEFT JOIN c s ON s.repo = l.repo AND s.id = l.src_chunk_id LEFT JOIN c d ON d.repo = l.repo AND d.id = l.dst_chunk_id),
    dead AS (SELECT DISTINCT repo, src_chunk_id, kind, name, line, indexed_at FROM o WHERE bad_src OR bad_dst),
    a AS (SELECT DISTINCT norm FROM l WHERE kind IN ('defines', 'declares') AND norm IS NOT NULL),
    b AS (SELECT DISTINCT norm FROM l WHERE kind IN ('defines', 'declares') AND norm IS NOT NULL AND NOT EXISTS (SELECT 1 FROM dead x WHERE x.repo IS NOT DISTINCT FROM l.repo
        AND x.src_chunk_id IS NOT DISTINCT FROM l.src_chunk_id AND x.kind = l.kind AND x.name IS NOT DISTINCT FROM l.name AND x.line IS NOT DISTINCT FROM l.line AND x.indexed_at IS NOT DISTINCT FROM l.indexed_at)),
    r AS (SELECT DISTINCT 'src_chunk_id' AS field, 'direct' AS origin, repo, src_chunk_id, kind, name, line, indexed_at FROM o WHERE bad_src
        UNION ALL SELECT DISTINCT 'dst_chunk_id', 'direct', repo, src_chunk_id, kind, name, line, indexed_at FROM o WHERE bad_dst
        UNION ALL SELECT DISTINCT 'norm', CASE WHEN norm IN (SELECT norm FROM a) THEN 'inherited' ELSE 'direct' END, repo, src_chunk_id, kind, name, line, indexed_at FROM l WHERE kind = 'mentions' AND norm IS NOT NULL AND norm NOT IN (SELECT norm FROM b))
    SELECT field, repo, strftime(indexed_at AT TIME ZONE 'UTC', '%Y-%m') AS month, count(CASE WHEN origin = 'direct' THEN 1 END) AS direct_orphans, count(CASE WHEN origin = 'inherited' THEN 1 END) AS inherited_orphans
    FROM r GROUP BY ALL
""")
def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_report(orphans.orphan_links(table(spark, sf_dir, "links"), table(spark, sf_dir, "chunks")))


_CHAIN = """rec AS (SELECT DISTINCT 'nation' AS kind, CAST(n_nationkey AS BIGINT) AS id, 'region' AS up_kind, CAST(n_regionkey AS BIGINT) AS up FROM nation
        UNION SELECT 'customer', c_custkey, 'nation', c_nationkey FROM customer UNION SELECT 'order', o_orderkey, 'customer', o_custkey FROM orders
        UNION SELECT 'line', l_orderkey * 100 + l_linenumber, 'order', l_orderkey FROM lineitem),
    own AS (SELECT kind, id FROM rec UNION SELECT 'region', r_regionkey FROM region WHERE r_name <> 'ASIA')"""


@query("p4_cascade", f"""
    WITH RECURSIVE {_CHAIN},
    lost AS (SELECT kind, id, 0 AS depth FROM rec WHERE up IS NOT NULL AND NOT EXISTS (SELECT 1 FROM own WHERE own.kind = rec.up_kind AND own.id = rec.up)
        UNION SELECT rec.kind, rec.id, lost.depth + 1 FROM rec JOIN lost ON rec.up_kind = lost.kind AND rec.up = lost.id)
    SELECT kind, depth, CASE WHEN depth = 0 THEN 'direct' ELSE 'inherited' END AS origin, count(*) AS records FROM lost GROUP BY ALL
""")
def p4_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What hangs on one region that is taken out: a chain of nations, customers, orders and lines."""
    key = lambda c: F.col(c).cast("bigint")
    row = lambda name, kind, id_, up_kind, up: table(spark, sf_dir, name).select(F.lit(kind).alias("kind"), id_.alias("id"), F.lit(up_kind).alias("up_kind"), up.alias("up"))
    rows = (
        row("nation", "nation", key("n_nationkey"), "region", key("n_regionkey"))
        .unionByName(row("customer", "customer", key("c_custkey"), "nation", key("c_nationkey")))
        .unionByName(row("orders", "order", key("o_orderkey"), "customer", key("o_custkey")))
        .unionByName(row("lineitem", "line", key("l_orderkey") * 100 + key("l_linenumber"), "order", key("l_orderkey")))
    )
    regions = table(spark, sf_dir, "region").where(F.col("r_name") != "ASIA").select(F.lit("region").alias("kind"), key("r_regionkey").alias("id"), F.lit(None).cast("string").alias("up_kind"), F.lit(None).cast("bigint").alias("up"))
    record = ("kind", "id", "up_kind", "up")
    parents = orphans.Parents(rows.unionByName(regions), ("kind", "id"), record=record)
    found = orphans.cascade(rows, record, [orphans.Reference("up", ("up_kind", "up"), parents)])
    return found.groupBy("kind", "depth", "origin").agg(F.count(F.lit(1)).alias("records"))
