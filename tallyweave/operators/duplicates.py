"""The same code in two places: fingerprints, candidate pairs, Jaccard, folder groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.session import cut

SHINGLE, LEAST_NAMES, LEAST_JACCARD = 5, 60, 0.45
WHOLESALE_PAIRS = 10


def fingerprints(chunks: DataFrame, size: int = SHINGLE, least: int = LEAST_NAMES) -> DataFrame:
    """(repo, id, path, start_line, end_line, shingles) of the code chunks long enough to compare."""
    # The generator keeps the optimizer from putting the extraction into every shingle.
    code = chunks.where(F.col("kind") == "code")
    named = code.withColumn("names", F.explode(F.array(T.code_identifiers(F.col("text")))))
    long = named.where(F.size("names") >= least)
    return long.select("repo", "id", "path", "start_line", "end_line", F.transform(T.shingles(F.col("names"), size), lambda s: F.xxhash64(s)).alias("shingles"))


_PLACE = ("repo", "id", "path", "start_line", "end_line")


def classes(prints: DataFrame) -> DataFrame:
    """The prints with their class: chunks with the same shingle set share ``rep``, the first of them.

    ``spread``: whether the class lies in more than one file.
    """
    keyed = prints.withColumn("shingles", F.array_sort("shingles")).withColumn("k1", F.xxhash64("shingles")).withColumn("k2", F.xxhash64(F.lit(1), "shingles"))
    first = keyed.groupBy("k1", "k2").agg(F.min(F.struct("repo", "id")).alias("rep"), (F.min(F.struct("repo", "path")) != F.max(F.struct("repo", "path"))).alias("spread"))
    return keyed.join(first, ["k1", "k2"]).drop("k1", "k2")


def similar(sets: DataFrame, minimum: float = LEAST_JACCARD) -> DataFrame:
    """(a, b, jaccard) of the keyed sets (key, shingles) whose Jaccard is at least ``minimum``, a < b.

    Exact, by prefix filtering: with all sets in one order, the rarest shingles first,
    two sets that similar share a shingle among the first n - ceil(minimum * n) + 1 of
    each, so common shingles, however many hold them, are hardly ever met.
    """
    posts = sets.select("key", F.size("shingles").alias("n"), F.explode("shingles").alias("s"))
    counts = posts.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    ordered = posts.join(counts, "s").groupBy("key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "s"))).alias("o"))
    width = (F.col("n") - F.ceil(F.col("n") * minimum - F.lit(1e-9)) + 1).cast("int")
    heads = ordered.select("key", "n", F.explode(F.slice("o", F.lit(1), width)).alias("x")).where("x.df > 1").select("key", "n", F.col("x.s").alias("s"))
    side = lambda t: heads.select(F.col("key").alias(t), F.col("n").alias(f"n{t}"), "s")
    fits = (F.col("na") >= F.col("nb") * minimum - 1e-9) & (F.col("nb") >= F.col("na") * minimum - 1e-9)
    near = side("a").join(side("b"), "s").where((F.col("a") < F.col("b")) & fits).select("a", "b").distinct()
    whole = lambda t: sets.select(F.col("key").alias(t), F.col("shingles").alias(f"s{t}"))
    both = near.join(whole("a"), "a").join(whole("b"), "b")
    inter = F.size(F.array_intersect("sa", "sb"))
    return both.withColumn("jaccard", inter / (F.size("sa") + F.size("sb") - inter)).where(F.col("jaccard") >= minimum).select("a", "b", "jaccard")


def pairs(prints: DataFrame, minimum: float = LEAST_JACCARD) -> DataFrame:
    """Pairs of chunks in different files whose shingle sets have at least ``minimum`` Jaccard.

    Chunks with equal sets are a class: each is paired with the first of its class, and
    only the first are paired with those of other classes, so n copies give n - 1 pairs
    and no link between different texts is lost.
    """
    prints = cut(classes(prints))
    me = F.struct("repo", "id")
    # Numbers in the order of the representatives stand for them; the checkpoint keeps them fixed.
    reps = cut(prints.where(me == F.col("rep")).dropDuplicates(["rep"]).orderBy("rep").withColumn("key", F.monotonically_increasing_id()))
    found = similar(reps.select("key", "shingles"), minimum)
    side = lambda t: reps.select(F.col("key").alias(t), *[F.col(c).alias(f"{c}_{t}") for c in _PLACE], F.col("spread").alias(f"spread_{t}"))
    apart = (F.col("repo_a") != F.col("repo_b")) | (F.col("path_a") != F.col("path_b"))
    cols = [f"{c}_{t}" for t in "ab" for c in _PLACE]
    across = found.join(side("a"), "a").join(side("b"), "b").where(apart | F.col("spread_a") | F.col("spread_b")).select(*cols, F.bround("jaccard", 3).alias("jaccard"))
    copies = prints.where((me != F.col("rep")) & F.col("spread")).select("rep", *[F.col(c).alias(f"{c}_b") for c in _PLACE])
    first = reps.where("spread").select("rep", *[F.col(c).alias(f"{c}_a") for c in _PLACE])
    within = copies.join(first, "rep").select(*cols, F.lit(1.0).alias("jaccard"))
    return across.unionByName(within)


def folder_groups(found: DataFrame) -> DataFrame:
    """Pairs grouped by their two folders: pairs, distinct left files, flags."""
    place = lambda n: F.concat(F.col(f"repo_{n}"), F.lit(":"), T.folder_of(F.col(f"path_{n}")))
    swap = place("a") > place("b")
    rows = found.select(
        F.least(place("a"), place("b")).alias("left"), F.greatest(place("a"), place("b")).alias("right"),
        F.when(swap, F.concat_ws(":", "repo_b", "path_b")).otherwise(F.concat_ws(":", "repo_a", "path_a")).alias("left_file"),
        (F.col("repo_a") != F.col("repo_b")).alias("cross"),
    )
    return rows.groupBy("left", "right").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_distinct("left_file").alias("left_files"), F.max("cross").alias("cross_repo"),
        (F.count(F.lit(1)) >= WHOLESALE_PAIRS).alias("wholesale"), F.first(F.col("left") == F.col("right")).alias("within"),
    )
