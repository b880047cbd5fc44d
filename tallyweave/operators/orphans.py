"""References to records that do not exist.

A foreign-key graph is declared as a list of :class:`Reference` objects, each
pointing at the keys of a :class:`Parents` table. The operator finds, for every
child record and reference, whether the referenced key exists (``direct``
orphans), then walks down the graph to a fixpoint: a parent that is itself an
orphan no longer counts as existing, so the children that hang on nothing but
orphaned parents come out as ``inherited`` orphans.

All references of a level meet all parent keys in one join. What is shuffled are
128-bit hashes of keys and records; the records themselves move once, at the end,
to those of their references that are orphans.

Defined results for odd input
    * null reference: no reference, never an orphan
    * empty string or any other placeholder: a reference like any other
    * exact duplicate child rows: one record, counted once
    * a parent key present several times: exists if any of its rows qualifies
    * empty child table: no rows; empty parent table: every reference is an orphan
    * extra columns, whatever their names: ignored (only declared columns are read)
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.session import cut

#: A key with more references than this is looked up through salted copies, one for
#: every so many references.
HOT_KEY_ROWS = 100_000


@dataclass(frozen=True)
class Parents:
    """Keys that may be referenced: rows of a table, restricted by ``where``.

    ``since``: the moment a row came to exist. ``record``: columns naming the record
    that a row is, when the rows are themselves children (the edge the cascade
    follows).
    """

    rows: DataFrame
    keys: tuple[str, ...]
    where: Column | None = None
    since: str | None = None
    record: tuple[str, ...] = ()


@dataclass(frozen=True)
class Reference:
    """``keys`` of a child point at the keys of ``parents``; the last one is the reference itself.

    ``where``: which child records hold this reference at all. ``at``: when given
    together with the parents' ``since``, the parent must not be later than it.
    """

    name: str
    keys: tuple[str, ...]
    parents: Parents
    where: Column | None = None
    at: str | None = None


def _hashes(columns: Sequence[Column], *salt: int) -> list[Column]:
    """128 bits of the columns; a null differs from every value, in every place."""
    nulls = reduce(lambda a, b: a + b, [F.when(c.isNull(), F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(columns)])
    fixed = [F.lit(s) for s in salt]
    return [F.xxhash64(*fixed, nulls, *columns), F.xxhash64(F.lit(0x5EED), *fixed, nulls, *columns)]


def _record(columns: Sequence[str]) -> list[Column]:
    r = _hashes([F.col(c) for c in columns])
    return [r[0].alias("r1"), r[1].alias("r2")]


def _spaces(refs: Sequence[Reference]) -> list[Parents]:
    out: list[Parents] = []
    for r in refs:
        if not any(r.parents is p for p in out):
            out.append(r.parents)
    return out


def _references(children: DataFrame, record: Sequence[str], refs: Sequence[Reference], spaces: Sequence[Parents]) -> DataFrame:
    """(k1, k2, at, r1, r2, field, held): all references that are not null, one row each.

    A null in the key columns before the last (a scope, such as the repository)
    matches no parent: ``held`` is false and such a reference leads to nothing.
    """
    structs = []
    for n, r in enumerate(refs):
        space = next(i for i, p in enumerate(spaces) if p is r.parents)
        keys = [F.col(c) for c in r.keys]
        k1, k2 = _hashes(keys, space)
        at = F.col(r.at) if r.at and r.parents.since else F.lit(None).cast("timestamp")
        held = reduce(lambda a, b: a & b, [c.isNotNull() for c in keys])
        there = keys[-1].isNotNull() if r.where is None else keys[-1].isNotNull() & r.where
        structs.append(F.when(F.coalesce(there, F.lit(False)), F.struct(k1.alias("k1"), k2.alias("k2"), at.alias("at"), F.lit(n).cast("byte").alias("field"), held.alias("held"))))
    # The generator keeps the hashes of a row from being worked out once for each column of the struct.
    return children.select(*_record(record), F.explode(F.array_compact(F.array(*structs))).alias("x")).select("x.*", "r1", "r2")


def _parent_rows(spaces: Sequence[Parents], only: Sequence[Parents]) -> DataFrame:
    """(k1, k2, since, r1, r2): rows of all parent tables; r1, r2 are null where no edge leads on."""
    out = None
    for i, p in enumerate(spaces):
        if not any(p is q for q in only):
            continue
        rows = p.rows if p.where is None else p.rows.where(p.where)
        k1, k2 = _hashes([F.col(c) for c in p.keys], i)
        since = F.col(p.since) if p.since else F.lit(None).cast("timestamp")
        own = _record(p.record) if p.record else [F.lit(None).cast("bigint").alias("r1"), F.lit(None).cast("bigint").alias("r2")]
        part = rows.select(k1.alias("k1"), k2.alias("k2"), since.alias("since"), *own)
        out = part if out is None else out.unionByName(part)
    return out


def _hot_keys(refs: DataFrame, hot_rows: int | None) -> DataFrame | None:
    """(k1, k2, copies): keys with more than ``hot_rows`` references; null when there are none.

    The list has at most (references / hot_rows) rows, so it is small enough to
    broadcast whatever the data are; it is counted before it is used.
    """
    if not hot_rows:
        return None
    counted = refs.groupBy("k1", "k2").count().where(F.col("count") > hot_rows)
    hot = cut(counted.select("k1", "k2", F.ceil(F.col("count") / hot_rows).cast("int").alias("copies")))
    return hot if hot.take(1) else None


def _lookup(refs: DataFrame, parents: DataFrame, how: str, hot: DataFrame | None) -> DataFrame:
    """Join of references to a parent side that is unique per key.

    The references of a hot key are spread over several copies of its one parent row.
    """
    if hot is None:
        return refs.join(parents, ["k1", "k2"], how)
    spot = F.pmod(F.xxhash64("r1", "r2"), F.coalesce("copies", F.lit(1))).cast("int").alias("salt")
    salted = refs.join(F.broadcast(hot), ["k1", "k2"], "left").select(*refs.columns, spot)
    each = F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("salt")
    copies = parents.join(F.broadcast(hot), ["k1", "k2"], "left").select(*parents.columns, each)
    return salted.join(copies, ["k1", "k2", "salt"], how).drop("salt")


def _orphaned(refs: Sequence[Reference]) -> Column:
    timed = [n for n, r in enumerate(refs) if r.at and r.parents.since]
    on_time = F.coalesce(F.col("since") <= F.col("at"), F.lit(False))
    on_time = F.when(F.col("field").isin(*timed), on_time).otherwise(F.lit(True)) if timed else F.lit(True)
    return ~F.coalesce(F.col("alive") & on_time, F.lit(False))


def _first_level(refs: DataFrame, parents: DataFrame, orphaned: Column, hot: DataFrame | None) -> DataFrame:
    """(r1, r2, field) of the references whose key does not exist."""
    keyed = parents.groupBy("k1", "k2").agg(F.min("since").alias("since"), F.lit(True).alias("alive"))
    found = _lookup(refs.where("held"), keyed, "left", hot).where(orphaned)
    return found.select("r1", "r2", "field").unionByName(refs.where("NOT held").select("r1", "r2", "field")).distinct()


def _touched(parents: DataFrame, found: DataFrame, depth: int) -> DataFrame:
    """(k1, k2, since, alive): the keys that lost a parent row in round ``depth``, and what is left of them."""
    dead = found.groupBy("r1", "r2").agg(F.min("depth").alias("died"))
    rows = parents.join(dead, ["r1", "r2"], "left")
    left = F.when(F.col("died").isNull(), F.col("since"))
    return (
        rows.groupBy("k1", "k2")
        .agg(F.min(left).alias("since"), F.max(F.col("died").isNull()).alias("alive"), F.max(F.coalesce(F.col("died") == depth, F.lit(False))).alias("touched"))
        .where("touched").drop("touched")
    )


def cascade(children: DataFrame, record: Sequence[str], refs: Sequence[Reference], hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """All orphan references with their ``origin`` and ``depth``.

    Columns: the ``record`` columns, ``field``, ``origin`` (direct or inherited)
    and ``depth`` (0 for direct, n for the n-th round of the cascade).

    A round takes the records that the round before orphaned from the parent side
    and looks again only at the references of the keys this touches; what is left of a
    key's rows says from when on it still exists. The walk ends when no key is touched,
    after at most as many rounds as the longest chain has links.
    Every round is cut by a checkpoint, so the plan does not grow; the state is one
    narrow row per orphan reference.
    """
    spaces = _spaces(refs)
    # Every round reads the references again: narrow rows, hashed once.
    held = cut(_references(children, record, refs, spaces))
    orphaned, hot = _orphaned(refs), _hot_keys(held.where("held"), hot_rows)
    depth = 0
    found = cut(_first_level(held, _parent_rows(spaces, spaces), orphaned, hot).withColumn("depth", F.lit(0)))
    edges = [p for p in spaces if p.record]
    onward = held.where(F.col("held") & F.col("field").isin(*[n for n, r in enumerate(refs) if r.parents.record]))
    while edges:
        keys = cut(_touched(_parent_rows(spaces, edges), found, depth))
        if not keys.take(1):
            break
        depth += 1
        lost = _lookup(onward, keys, "inner", hot).where(orphaned).select("r1", "r2", "field").distinct()
        fresh = lost.join(found.select("r1", "r2", "field"), ["r1", "r2", "field"], "left_anti")
        found = found.unionByName(cut(fresh.withColumn("depth", F.lit(depth))))
    names = F.array(*[F.lit(r.name) for r in refs])
    whole = children.select(F.struct(*record).alias("child"), *_record(record))
    rows = found.join(whole, ["r1", "r2"]).groupBy("r1", "r2", "field", "depth").agg(F.first("child").alias("child"))
    return rows.select(
        *[F.col(f"child.{c}").alias(c) for c in record], names[F.col("field").cast("int")].alias("field"),
        F.when(F.col("depth") == 0, "direct").otherwise("inherited").alias("origin"), "depth",
    )


LINK = ("repo", "src_chunk_id", "kind", "name", "line", "indexed_at")


def link_references(links: DataFrame, chunks: DataFrame) -> list[Reference]:
    """The foreign keys of the link table: two to chunks, one to other links' names."""
    alive = Parents(chunks, ("repo", "id"), F.col("deleted_at").isNull() & F.col("repo").isNotNull() & F.col("id").isNotNull(), "indexed_at")
    anchors = Parents(links, ("norm",), F.col("kind").isin("defines", "declares") & F.col("norm").isNotNull(), record=LINK)
    return [
        Reference("src_chunk_id", ("repo", "src_chunk_id"), alive, at="indexed_at"),
        Reference("dst_chunk_id", ("repo", "dst_chunk_id"), alive, at="indexed_at"),
        Reference("norm", ("norm",), anchors, where=F.col("kind") == "mentions"),
    ]


def orphan_links(links: DataFrame, chunks: DataFrame, hot_rows: int | None = HOT_KEY_ROWS) -> DataFrame:
    """Orphan references of links, direct and inherited."""
    slim = links.select(*LINK, "dst_chunk_id", "norm")
    return cascade(slim, LINK, link_references(slim, chunks.select("repo", "id", "deleted_at", "indexed_at")), hot_rows=hot_rows)


def orphan_report(orphans: DataFrame, by: str = "indexed_at") -> DataFrame:
    """Orphans per field, repo and month, direct and inherited apart."""
    return (
        orphans.groupBy("field", "repo", F.date_format(F.date_trunc("month", F.col(by)), "yyyy-MM").alias("month"))
        .agg(
            F.count(F.when(F.col("origin") == "direct", 1)).alias("direct_orphans"),
            F.count(F.when(F.col("origin") == "inherited", 1)).alias("inherited_orphans"),
        )
    )
