"""Layout against meaning against history: centroids, neighbours, co-change."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import numbers as N
from tallyweave.functions import text as T
from tallyweave.operators import search

NEIGHBOURS, LEAST_COMMITS, MOST_DEPTH = 5, 4, 8
#: Folders that are not the subject of a repository at any depth, and at the top only.
ASIDE = ("test", "tests", "spec", "specs", "testing", "__tests__", "e2e", "testdata", "fixtures", "vendor", "vendored", "third_party", "thirdparty")
ASIDE_TOP = ("example", "examples", "sample", "samples", "demo", "demos", "bench", "benchmarks", "script", "scripts", "tools", "external", "deps")


def centroids(rows: DataFrame, keys: list[str], vector: str = "vector") -> DataFrame:
    """Mean vector per key, brought to length one; a mean of length zero stays.

    Positions are averaged with map-side combine, so a key with any number of
    vectors sends one partial mean per task and position.
    """
    flat = rows.select(*keys, F.posexplode(vector).alias("pos", "x"))
    mean = flat.groupBy(*keys, "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = mean.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e.x).alias("mean"))
    size = N.norm(F.col("mean"))
    return packed.select(*keys, F.transform("mean", lambda x: x / F.when(size == 0, F.lit(1.0)).otherwise(size)).alias("vector"))


def branching_depth(files: DataFrame) -> DataFrame:
    """(repo, depth): the first folder level with other than one distinct name, at most MOST_DEPTH."""
    parts = files.select("repo", F.posexplode(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)).alias("level", "name"))
    names = parts.groupBy("repo", "level").agg(F.count_distinct("name").alias("names"))
    first = names.where(F.col("names") != 1).groupBy("repo").agg((F.min("level") + 1).alias("depth"))
    deepest = names.groupBy("repo").agg((F.max("level") + 1).alias("levels"))
    return deepest.join(first, "repo", "left").select("repo", F.least(F.coalesce("depth", "levels"), F.lit(MOST_DEPTH)).alias("depth"))


def source_prefix(files: DataFrame) -> DataFrame:
    """(repo, prefix): the folders all files about the subject share, with a last slash; empty if none."""
    names = F.split("path", "/")
    aside = F.exists(F.slice(names, 1, F.size(names) - 1), lambda d: d.isin(*ASIDE))
    kept = files.where(~names[0].isin(*ASIDE_TOP) & ~aside)
    parts = kept.select("repo", "path", F.posexplode(F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)).alias("level", "name"))
    total = kept.groupBy("repo").agg(F.count_distinct("path").alias("files"))
    levels = parts.groupBy("repo", "level").agg(F.count_distinct("name").alias("names"), F.min("name").alias("name"), F.count_distinct("path").alias("with_level"))
    shared = levels.join(total, "repo").withColumn("ok", ((F.col("names") == 1) & (F.col("with_level") == F.col("files"))).cast("int"))
    run = Window.partitionBy("repo").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    kept_levels = shared.withColumn("all_ok", F.min("ok").over(run)).where("all_ok = 1")
    prefix = kept_levels.groupBy("repo").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("level", "name"))), lambda e: e["name"]), "/").alias("prefix"))
    whole = F.when(F.col("prefix") != "", F.concat("prefix", F.lit("/")))
    return files.select("repo").distinct().join(prefix, "repo", "left").select("repo", F.coalesce(whole, F.lit("")).alias("prefix"))


def neighbours(files: DataFrame, k: int = NEIGHBOURS, dim: int = 64) -> DataFrame:
    """The k most similar files of the same repository: (vec_id, other_id, similarity, rank); of equals the last path first."""
    side = lambda name: files.select(F.col("vec_id").alias(name), "repo", "vector")
    near = search.nearest(side("query_id"), side("row_id"), k, dim, within="repo", ties=True).drop("rank")
    placed = near.join(files.select(F.col("vec_id").alias("row_id"), "path").dropDuplicates(["row_id"]), "row_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), F.desc("path"), "row_id")
    ranked = placed.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select(F.col("query_id").alias("vec_id"), F.col("row_id").alias("other_id"), "similarity", "rank")


def agreement(files: DataFrame, near: DataFrame, k: int = NEIGHBOURS) -> DataFrame:
    """(repo, files, packages, agreement, baseline): how often neighbours share a package."""
    packages = files.select("vec_id", "repo", "package")
    share = near.join(packages, "vec_id").join(packages.select(F.col("vec_id").alias("other_id"), F.col("package").alias("other_package")), "other_id")
    per_file = share.groupBy("repo", "vec_id").agg((F.sum((F.col("package") == F.col("other_package")).cast("int")) / F.lit(k)).alias("share"))
    counts = packages.groupBy("repo").agg(F.count_distinct("vec_id").alias("files"), F.count_distinct("package").alias("packages"))
    mean = per_file.groupBy("repo").agg(F.avg("share").alias("mean_share"))
    return counts.join(mean, "repo", "left").select("repo", "files", "packages", F.round("mean_share", 3).alias("agreement"), F.round(F.lit(1.0) / F.col("packages"), 3).alias("baseline"))


def strangers(files: DataFrame, near: DataFrame) -> DataFrame:
    """Files none of whose neighbours share their package, the most similar first."""
    packages = files.select("vec_id", "repo", "path", "package")
    both = near.join(packages, "vec_id").join(packages.select(F.col("vec_id").alias("other_id"), F.col("package").alias("other_package"), F.col("path").alias("other_path")), "other_id")
    grouped = both.groupBy("vec_id", "repo", "path", "package").agg(
        F.max((F.col("package") == F.col("other_package")).cast("int")).alias("at_home"),
        F.max("similarity").alias("similarity"),
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "other_path"))), lambda e: e.other_path).alias("neighbours"),
    )
    rows = grouped.where("at_home = 0").select("vec_id", "repo", "path", "package", F.array_join("neighbours", ",").alias("neighbours"), F.round("similarity", 3).alias("similarity"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("similarity"), "path", "vec_id")))


def co_change(commit_files: DataFrame, least: int = LEAST_COMMITS, most_files: int = 1000) -> DataFrame:
    """(repo, left_path, right_path, commits): files that change together often.

    Pairs are made within a commit; a commit of more than ``most_files`` files (an
    import or a format run) is cut into slices of that size whose pairs are joined
    slice by slice, so no task ever holds more than two slices.
    """
    rows = commit_files.select("repo", "sha", "path").distinct()
    sizes = rows.groupBy("repo", "sha").agg(F.count(F.lit(1)).alias("n"))
    small = rows.join(sizes.where(F.col("n") <= most_files).select("repo", "sha"), ["repo", "sha"])
    side = lambda name: small.select("repo", "sha", F.col("path").alias(name))
    pairs = side("left_path").join(side("right_path"), ["repo", "sha"]).where(F.col("left_path") < F.col("right_path"))
    slices = F.ceil(F.col("n") / most_files)
    big = rows.join(sizes.where(F.col("n") > most_files).select("repo", "sha", slices.cast("bigint").alias("slices")), ["repo", "sha"]).withColumn("slice", F.pmod(F.xxhash64("path"), F.col("slices")))
    other = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("slices") - 1))
    a = big.withColumnRenamed("path", "left_path").withColumnRenamed("slice", "s1").withColumn("s2", other)
    b = big.withColumnRenamed("path", "right_path").withColumnRenamed("slice", "s2").withColumn("s1", other).drop("slices")
    wide = a.join(b, ["repo", "sha", "s1", "s2"]).where(F.col("left_path") < F.col("right_path")).select("repo", "sha", "left_path", "right_path")
    return pairs.unionByName(wide).groupBy("repo", "left_path", "right_path").agg(F.count(F.lit(1)).alias("commits")).where(F.col("commits") >= least)


def coupled(pairs: DataFrame, files: DataFrame) -> DataFrame:
    """Co-changing files of different packages with the similarity of their centroids; many commits and little likeness first."""
    side = lambda n: files.select("repo", F.col("path").alias(f"{n}_path"), F.col("package").alias(f"{n}_package"), F.col("vector").alias(f"{n}_vector"))
    both = pairs.join(side("left"), ["repo", "left_path"]).join(side("right"), ["repo", "right_path"]).where(F.col("left_package") != F.col("right_package"))
    rows = both.select("repo", "left_path", "right_path", "commits", F.round(N.cosine(F.col("left_vector"), F.col("right_vector")), 3).alias("similarity"))
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("commits"), "similarity", "left_path", "right_path")))
