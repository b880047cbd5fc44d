"""The chunk store as tables: current rows, additions, removals, reconciliation."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import text as T


@dataclass(frozen=True)
class SearchFilter:
    """Or within a field, and across fields; empty fields do not restrict."""

    lang: tuple[str, ...] = ()
    kind: tuple[str, ...] = ()
    path: tuple[str, ...] = ()
    symbol: tuple[str, ...] = ()

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.lang:
            out = out & F.col("lang").isin(*self.lang)
        if self.kind:
            out = out & F.col("kind").isin(*self.kind)
        for parts, test in ((self.path, lambda g: T.matches_glob(F.col("path"), g)), (self.symbol, lambda g: T.symbol_contains(F.col("symbol"), g))):
            any_of = None
            for g in parts:
                any_of = test(g) if any_of is None else any_of | test(g)
            out = out if any_of is None else out & any_of
        return F.coalesce(out, F.lit(False))


def live(chunks: DataFrame) -> DataFrame:
    """The current row of every chunk that is not deleted; its key is (repo, id)."""
    latest = Window.partitionBy("repo", "id").orderBy(F.desc("indexed_at"), F.asc_nulls_last("path"), F.asc_nulls_last("start_line"))
    rows = chunks.where(F.col("deleted_at").isNull() & F.col("id").isNotNull() & F.col("repo").isNotNull())
    return rows.withColumn("__n", F.row_number().over(latest)).where("__n = 1").drop("__n")


def additions(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh chunks whose (repo, id) is not stored, each once: dedup before any costly step."""
    return fresh.dropDuplicates(["repo", "id"]).join(stored.select("repo", "id").distinct(), ["repo", "id"], "left_anti")


def stale(stored: DataFrame, fresh: DataFrame, paths: DataFrame | None = None) -> DataFrame:
    """Stored chunks that the fresh pass did not produce, in the given paths or everywhere."""
    scope = stored if paths is None else stored.join(paths.select("repo", "path").distinct(), ["repo", "path"], "left_semi")
    return scope.join(fresh.select("repo", "id").distinct(), ["repo", "id"], "left_anti")


def remove(stored: DataFrame, gone: DataFrame) -> DataFrame:
    return stored.join(gone.select("repo", "id").distinct(), ["repo", "id"], "left_anti")


def moved(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Chunks kept by content whose lines changed, with their new lines."""
    new = fresh.select("repo", "id", F.col("start_line").alias("new_start"), F.col("end_line").alias("new_end"))
    return stored.join(new, ["repo", "id"]).where(~F.col("start_line").eqNullSafe(F.col("new_start")) | ~F.col("end_line").eqNullSafe(F.col("new_end")))


def reconcile(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store after a full pass: kept rows take the fresh lines, others leave or join."""
    return fresh.dropDuplicates(["repo", "id"]).select(stored.columns)


def datasets(chunks: DataFrame) -> DataFrame:
    return chunks.select("repo").where(F.col("repo").isNotNull()).distinct()


def covering(chunks: DataFrame, path: str, line: int) -> DataFrame:
    """Chunks that cover a line, innermost first, named before unnamed."""
    at = (F.col("path") == path) & (F.col("start_line") <= line) & (F.col("end_line") >= line)
    order = Window.orderBy(F.col("end_line") - F.col("start_line"), F.col("symbol").isNull(), "repo", "id")
    return chunks.where(at).withColumn("rank", F.row_number().over(order))


def compact(spark, path: str, files: int) -> tuple[int, int]:
    """Rewrite a table folder into fewer files; returns bytes before and after.

    The new files are written beside the old ones and swapped in by renames, so a
    reader never sees a half-written table.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    here = jvm.org.apache.hadoop.fs.Path(path)
    fs = here.getFileSystem(conf)
    size = lambda p: fs.getContentSummary(p).getLength()
    before = size(here)
    fresh, old = jvm.org.apache.hadoop.fs.Path(path + ".new"), jvm.org.apache.hadoop.fs.Path(path + ".old")
    spark.read.parquet(path).coalesce(files).write.mode("overwrite").parquet(path + ".new")
    fs.rename(here, old)
    fs.rename(fresh, here)
    fs.delete(old, True)
    return before, size(here)
