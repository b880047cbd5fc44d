"""Most similar vectors of every vector, by vantage-point trees per shard.

Vectors are normalised, so the cosine order is the order of the Euclidean
distance. The upper levels of one vantage-point tree, built on a bounded sample,
cut the space into cells; the rows of a cell, in shards of a bounded size, are
vantage-point trees of their own. A query first searches its own cell. The
distance of its k-th best there says which other cells may hold better ones: at a
node the triangle inequality bounds how near anything on the far side can be, and
the far side is skipped when that bound times ``relax`` exceeds the distance. Only
the cells that are left see the query. ``relax`` = 1 restores exact search.

The rows are written once, ordered by cell, to files in the shared folder. A task
keeps a block of queries with their best so far and reads the files it needs one
after the other, so neither a query nor a row is copied for a cell: what is written
grows with the rows, only what is read grows with rows times blocks of queries.

Blocks of queries walk a tree together: a node costs one matrix-vector product,
a leaf one matrix product for the queries that still need it. Products are in
single precision and only rule out; what may be among the best is ranked by its
cosine in double precision.

Exact copies are searched once: one representative stands for all rows with the
same vector, and up to k + 1 member ids travel with it, which is all that any
answer can use.

Defined results for odd input
    * null, too short, too long, all-zero vectors, and ones with null, NaN or
      infinite numbers: take no part
    * exact duplicate rows: one row; the same vector under several ids: neighbours
      of each other with similarity 1
    * ties: the smaller id first
    * fewer than k other vectors: as many as there are; empty table: no rows
    * extra columns, whatever their names: ignored
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import cut, shared_folder

K = 10
DIM = 64
#: Pruning is relaxed by this factor. Distances in 64 dimensions lie close together,
#: so factors below 4 prune next to nothing; at 5 about three true neighbours in a
#: thousand are missed, at 8 one in twenty.
RELAX = 5.0
SHARD_ROWS = 8192
LEAF_ROWS = 4096
#: Queries of one matrix product, columns that are looked at as one, and the errors
#: in single precision of a product and of a distance (largest near zero).
TILE_ROWS, GROUP, ROUNDING, SLACK = 1024, 16, 2e-6, 1e-3
#: Vectors, at most about so many, on which the cells are laid out, and the least of
#: them per cell; every row is assigned to a cell. So there are at most 1,024 cells.
SAMPLE_ROWS, SAMPLE_PER_CELL = 16_384, 16


def usable(vector: Column, dim: int = DIM) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


class Best:
    """The k best cosines of every query so far, with the ids they belong to (-1: none); of equals the smaller id."""

    def __init__(self, queries: int, k: int) -> None:
        self.cos = np.full((queries, k), -np.inf)
        self.who = np.full((queries, k), -1, dtype=np.int64)
        self.worst = np.full(queries, -np.inf)

    def offer(self, q: np.ndarray, ids: np.ndarray, cos: np.ndarray) -> None:
        """Take those (query, id, cosine) that belong among the best; in rounds of at most one per query."""
        order = np.lexsort((ids, -cos, q))
        q, ids, cos = q[order], ids[order], cos[order]
        start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
        nth = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
        for n in range(min(self.cos.shape[1], int(nth.max(initial=-1)) + 1)):
            at = nth == n
            i, x, c = q[at], ids[at], cos[at]
            have = self.cos[i]
            last = np.where(have == self.worst[i][:, None], self.who[i], -2)
            slot = last.argmax(axis=1)
            better = (c > self.worst[i]) | ((c == self.worst[i]) & (x < last.max(axis=1)))
            i, slot = i[better], slot[better]
            self.cos[i, slot], self.who[i, slot] = c[better], x[better]
            self.worst[i] = self.cos[i].min(axis=1)


class Tree:
    """A vantage-point tree over the rows of a matrix of unit vectors; ``exact`` are
    the same rows in double precision, ``ids`` their ids (the row numbers)."""

    def __init__(self, rows: np.ndarray, leaf: int = LEAF_ROWS, seed: int = 7, exact: np.ndarray | None = None, ids: np.ndarray | None = None) -> None:
        self.rows, self.leaf = rows, leaf
        self.exact = rows if exact is None else exact
        self.ids = np.arange(len(rows)) if ids is None else ids
        self.rng = np.random.default_rng(seed)
        self.visited = 0
        self.room = np.empty(0, dtype=np.float32)  # products of a leaf, in memory that is used again
        self.root = self._build(np.arange(len(rows)))

    def _end(self, at: np.ndarray):
        """A leaf: its row numbers, and its rows with as many zeros as fill the last group."""
        return at, np.concatenate([self.rows[at], np.zeros((-len(at) % GROUP, self.rows.shape[1]), dtype=self.rows.dtype)])

    def _build(self, at: np.ndarray):
        if len(at) <= self.leaf:
            return self._end(at)
        # The vantage point whose distances spread most, of a few tried on a few rows.
        trial = at[self.rng.integers(0, len(at), 5)]
        probe = at[self.rng.integers(0, len(at), 200)]
        spread = np.var(_distance(self.rows[probe], self.rows[trial].T), axis=0)
        point = self.rows[trial[int(np.argmax(spread))]]
        d = _distance(self.rows[at], point)
        radius = float(np.median(d))
        near = d <= radius
        if near.all() or not near.any():  # all at one distance: no cut can tell them apart
            return self._end(at)
        return point, radius, self._build(at[near]), self._build(at[~near])

    def search(self, queries: np.ndarray, k: int, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """Row numbers (-1: none) and cosines of the k best per query, unordered."""
        best = Best(len(queries), k)
        self.improve(best, queries, queries, np.full(len(queries), -1), np.arange(len(queries)), relax)
        return best.who, best.cos

    def improve(self, best: Best, queries: np.ndarray, exact: np.ndarray, own: np.ndarray, active: np.ndarray, relax: float) -> None:
        """Offer the rows to the queries numbered by ``active``; not the one with the query's own id."""
        self._walk(self.root, best, (queries, exact, own), active, relax)

    def _walk(self, node, best, asked, active, relax) -> None:
        if not len(active):
            return
        if len(node) == 2:
            for a in range(0, len(active), TILE_ROWS):
                self._leaf(node, best, asked, active[a : a + TILE_ROWS])
            return
        point, radius, inner, outer = node
        d = _distance(asked[0][active], point)
        near = d <= radius
        self._walk(inner, best, asked, active[near], relax)
        self._walk(outer, best, asked, active[~near], relax)
        worst = best.worst[active]
        reach = np.where(np.isfinite(worst), np.sqrt(np.maximum(0, 2 - 2 * worst)), np.inf)
        far = np.abs(d - radius) * relax <= reach + SLACK
        self._walk(outer, best, asked, active[near & far], relax)
        self._walk(inner, best, asked, active[~near & far], relax)

    def _leaf(self, node, best, asked, active) -> None:
        at, rows = node
        queries, exact, own = asked
        self.visited += len(at) * len(active)
        if self.room.size < len(active) * len(rows):
            self.room = np.empty(len(active) * len(rows), dtype=np.float32)
        sims = np.matmul(queries[active], rows.T, out=self.room[: len(active) * len(rows)].reshape(len(active), len(rows)))
        floor = best.worst[active]
        k, fresh = best.cos.shape[1], ~np.isfinite(floor)
        if fresh.any() and len(at) > k + 1:  # one more than k, since the query itself may be a row
            floor[fresh] = np.partition(sims[fresh, : len(at)], len(at) - k - 1, axis=1)[:, len(at) - k - 1]
        floor = (floor - ROUNDING).astype(np.float32)[:, None]
        # Columns that are ``width`` apart are one group; few groups hold anything better.
        width = len(rows) // GROUP
        q, g = np.nonzero(sims.reshape(len(active), GROUP, width).max(axis=1) > floor)
        if not len(q):
            return
        cols = g[:, None] + np.arange(GROUP) * width
        some, which = np.nonzero(sims[q[:, None], cols] > floor[q])
        q, r = q[some], cols[some, which]
        q, r = active[q[r < len(at)]], at[r[r < len(at)]]
        apart = self.ids[r] != own[q]
        q, r = q[apart], r[apart]
        best.offer(q, self.ids[r], np.einsum("ij,ij->i", exact[q], self.exact[r], dtype=np.float64))


def _distance(rows: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, 2 - 2 * (rows @ point)))


def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        if len(pdf):
            m = np.stack(pdf["vector"].to_numpy())
            yield pd.DataFrame({"rep": pdf["rep"], "ids": pdf["ids"], "packed": [r.tobytes() for r in m]})


def _units(column: pd.Series, dim: int) -> np.ndarray:
    """Unit vectors in double precision; huge and tiny lengths do not overflow."""
    raw = b"".join(column)
    m = np.frombuffer(raw, dtype=np.float32 if len(raw) == 4 * dim * len(column) else np.float64).reshape(-1, dim).astype(np.float64)
    m /= np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


class Cells:
    """The upper levels of a vantage-point tree; its leaves are cells, numbered from the left."""

    def __init__(self, sample: np.ndarray, cells: int, seed: int = 7) -> None:
        self.rng = np.random.default_rng(seed)
        self.count = 0
        self.root = self._build(sample, max(1, cells))

    def _build(self, rows: np.ndarray, cells: int):
        if cells > 1 and len(rows) >= 2 * SAMPLE_PER_CELL:
            trial = rows[self.rng.integers(0, len(rows), 8)]
            probe = rows[self.rng.integers(0, len(rows), 500)]
            point = trial[int(np.argmax(np.var(_distance(probe, trial.T), axis=0)))]
            d = _distance(rows, point)
            radius = float(np.median(d))
            near = d <= radius
            if not near.all() and near.any():
                return point, radius, self._build(rows[near], cells // 2), self._build(rows[~near], cells - cells // 2)
        self.count += 1
        return self.count - 1

    def own(self, units: np.ndarray) -> np.ndarray:
        """The cell of every vector."""
        out = np.zeros(len(units), dtype=np.int32)
        todo = [(self.root, np.arange(len(units)))]
        while todo:
            node, ids = todo.pop()
            if isinstance(node, int):
                out[ids] = node
            elif len(ids):
                near = _distance(units[ids], node[0]) <= node[1]
                todo += [(node[2], ids[near]), (node[3], ids[~near])]
        return out

    def others(self, units: np.ndarray, reach: np.ndarray, relax: float) -> tuple[np.ndarray, np.ndarray]:
        """(row, cell) of the cells that may hold something nearer than ``reach``, the own ones left out."""
        rows, cells = [], []
        todo = [(self.root, np.arange(len(units)), np.ones(len(units), dtype=bool))]
        while todo:
            node, ids, home = todo.pop()
            if isinstance(node, int):
                rows.append(ids[~home])
                cells.append(np.full(int((~home).sum()), node, dtype=np.int32))
            elif len(ids):
                gap = _distance(units[ids], node[0]) - node[1]
                far = np.abs(gap) * relax <= reach[ids] + SLACK
                for child, here in ((node[2], gap <= 0), (node[3], gap > 0)):
                    keep = here | far
                    todo.append((child, ids[keep], (home & here)[keep]))
        return np.concatenate(rows), np.concatenate(cells)


def _assign(cells: Cells, dim: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf[["rep", "packed"]].assign(cell=cells.own(_units(pdf["packed"], dim).astype(np.float32)))

    return run


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder as Spark names it; it is one that all workers share."""
    plain = re.sub(r"^file:/*", "/", folder)
    return (fs.LocalFileSystem(), plain) if plain.startswith("/") else fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", folder))


def _load(place: tuple[fs.FileSystem, str], name: str, dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, cells and unit vectors of a file of rows."""
    where, folder = place
    with where.open_input_file(f"{folder}/{name}") as f:
        t = pq.read_table(f, columns=["rep", "cell", "packed"], use_threads=False)
    return t["rep"].to_numpy(), t["cell"].to_numpy(), _units(t["packed"].to_pylist(), dim)


def _search(folder: str, layout: list[tuple[str, list[int]]], cells: Cells, k: int, relax: float, dim: int):
    """``layout``: the files in the order of their cells, with the cells each holds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        place = _open(folder)
        for pdf in batches:
            for block in pdf.itertuples():
                reps, own, exact = (x[block.start : block.end] for x in _load(place, layout[block.file][0], dim))
                queries, best = exact.astype(np.float32), Best(len(reps), k)
                home = set(np.unique(own).tolist())
                # Files from the block's own on and round, so that tasks do not all read the same one.
                turn = [*range(block.file, len(layout)), *range(block.file)]

                def offer(n, active) -> None:  # noqa: B023
                    ids, at, rows = _load(place, layout[n][0], dim)  # noqa: B023
                    for c in np.unique(at).tolist():
                        mine = active(c)
                        if len(mine):
                            part = at == c
                            Tree(rows[part].astype(np.float32), exact=rows[part], ids=ids[part]).improve(best, queries, exact, reps, mine, relax)  # noqa: B023

                for n in turn:
                    if home & set(layout[n][1]):
                        offer(n, lambda c: np.flatnonzero(own == c))  # noqa: B023
                if cells.count > 1:
                    # What is short of k others bounds nothing: its reach is infinite.
                    reach = np.sqrt(np.maximum(0, 2 - 2 * best.worst))
                    row, cell = cells.others(queries, reach, relax)
                    order = np.argsort(cell, kind="stable")
                    row, ends = row[order], np.cumsum(np.bincount(cell, minlength=cells.count))
                    asked = dict(enumerate(np.split(row, ends[:-1])))
                    for n in turn:
                        if any(len(asked[c]) for c in layout[n][1]):
                            offer(n, asked.__getitem__)
                q, j = np.nonzero(best.who >= 0)
                some, at = np.unique(q, return_index=True)
                if len(some):
                    yield pd.DataFrame({"rep": reps[some], "others": np.split(best.who[q, j], at[1:]), "cos": np.split(best.cos[q, j], at[1:])})

    return run


def representatives(vectors: DataFrame, id_column: str, vector_column: str, k: int, dim: int) -> tuple[DataFrame, DataFrame]:
    """(rep, ids, vector) per distinct vector and (id, rep) per row.

    The id list is cut to k + 1 by a ranking that Spark applies before the
    shuffle as well, so a vector shared by a third of all rows moves little.
    """
    rows = (
        vectors.where(usable(F.col(vector_column), dim))
        .select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
        .withColumn("k1", F.xxhash64("vector"))
        .withColumn("k2", F.hash("vector", F.lit(1)))
    )
    # Ids and vectors part here: only one vector of a group is moved.
    members = cut(rows.select("id", "k1", "k2").distinct())
    first = Window.partitionBy("k1", "k2").orderBy("id")
    heads = (
        members.withColumn("n", F.row_number().over(first))
        .where(F.col("n") <= k + 1)
        .groupBy("k1", "k2")
        .agg(F.array_sort(F.collect_list("id")).alias("ids"))
        .withColumn("rep", F.col("ids")[0])
    )
    reps = heads.join(rows.groupBy("k1", "k2").agg(F.first("vector").alias("vector")), ["k1", "k2"])
    members = members.join(heads.select("k1", "k2", "rep"), ["k1", "k2"]).select("id", "rep")
    return reps.select("rep", "ids", "vector"), members


_FOUND = "rep bigint, others array<bigint>, cos array<double>"


def candidates(units: DataFrame, k: int, relax: float, dim: int, shard_rows: int) -> DataFrame:
    """(rep, others, cos): the k best others of every packed vector (rep, packed), unordered."""
    spark = units.sparkSession
    n = units.count()
    if not n:
        return spark.createDataFrame([], _FOUND)
    keep = max(1, n // SAMPLE_ROWS)
    drawn = units.where(F.pmod(F.xxhash64("rep"), F.lit(keep)) == 0).select("packed").toPandas()
    sample = _units(drawn["packed"], dim).astype(np.float32) if len(drawn) else np.zeros((0, dim), dtype=np.float32)
    cells = Cells(sample, min(-(-n // shard_rows), SAMPLE_ROWS // SAMPLE_PER_CELL))
    rows = units.select("rep", "packed").mapInPandas(_assign(cells, dim), "rep bigint, packed binary, cell int")
    folder = shared_folder(spark, "vectors")
    rows.repartitionByRange(-(-n // shard_rows), "cell", "rep").sortWithinPartitions("cell", "rep").write.option("maxRecordsPerFile", shard_rows).parquet(folder)
    # One row per file and cell it holds: about two for each shard.
    held = spark.read.parquet(folder).groupBy(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "cell").count().collect()
    files: dict[str, dict[int, int]] = {}
    for r in sorted(held, key=lambda r: (r["cell"], r["file"])):
        files.setdefault(r["file"], {})[r["cell"]] = r["count"]
    layout = [(name, list(holds)) for name, holds in files.items()]
    cores = spark.sparkContext.defaultParallelism
    block = max(1, min(shard_rows, max(512, -(-n // (4 * cores)))))
    blocks = [(i, a, a + block) for i, holds in enumerate(files.values()) for a in range(0, sum(holds.values()), block)]
    tasks = spark.createDataFrame(spark.sparkContext.parallelize(blocks, len(blocks)), "file int, start int, end int")
    return tasks.mapInPandas(_search(folder, layout, cells, k, relax, dim), _FOUND)


def nearest(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "vector", k: int = K, relax: float = RELAX, dim: int = DIM, shard_rows: int = SHARD_ROWS, least: float | None = None) -> DataFrame:
    """(id, rank, other_id, similarity): the k most similar vectors of every one;
    where ``least`` is given, those of them that are at least so similar.

    Nothing is shuffled or written per cell; every vector is moved by its hash, kept,
    and laid out by cell, each once.
    """
    reps, members = representatives(vectors, id_column, vector_column, k, dim)
    units = cut(reps.mapInPandas(_pack, "rep bigint, ids array<bigint>, packed binary"))
    found = candidates(units, k, relax, dim, shard_rows)
    best = found.select("rep", F.explode(F.arrays_zip("others", "cos")).alias("x")).select("rep", F.col("x.others").alias("other"), F.col("x.cos").alias("cos"))
    if least is not None:  # what is less similar changes no rank of the others
        best = best.where(F.col("cos") >= least)
    # Candidates of a representative: its own copies, then the copies of its neighbours.
    own = units.select("rep", "ids", F.lit(1.0).alias("cos"))
    theirs = best.join(units.select(F.col("rep").alias("other"), "ids"), "other").select("rep", "ids", "cos")
    answers = (
        own.unionByName(theirs)
        .select("rep", "cos", F.explode("ids").alias("other_id"))
        .groupBy("rep")
        .agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cos")).alias("d"), "other_id"))), 1, k + 1).alias("near"))
    )
    mine = members.join(answers, "rep").select("id", F.slice(F.filter("near", lambda x: x.other_id != F.col("id")), 1, k).alias("near"))
    return mine.select(F.col("id").alias(id_column), F.posexplode("near").alias("p", "x")).select(
        id_column, (F.col("p") + 1).alias("rank"), F.col("x.other_id").alias("other_id"), (-F.col("x.d")).alias("similarity")
    )


def near_pairs(vectors: DataFrame, least: float = 0.95, id_column: str = "vec_id", **how) -> DataFrame:
    """Pairs (smaller id, larger id) at least ``least`` similar, one of them in the other's list."""
    rows = nearest(vectors, id_column, least=least, **how).where(F.col("similarity") >= least)
    a, b = F.least(id_column, "other_id"), F.greatest(id_column, "other_id")
    return rows.select(a.alias(f"{id_column}_a"), b.alias(f"{id_column}_b")).distinct()
