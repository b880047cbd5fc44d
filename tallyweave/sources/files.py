"""Files of a workspace: language, policy, and why a file is or is not indexed."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MOST_BYTES = 1 << 20
#: Folders of built or downloaded files; folders that begin with a dot are hidden too.
HIDDEN_DIRS = ("node_modules", "target", "__pycache__", "dist", "build", "out", "coverage", "htmlcov")

#: Languages by suffix and by name: (key, lang, kind).
SUFFIXES = (
    ("py", "python", "code"), ("pyi", "python", "code"), ("ts", "typescript", "code"), ("tsx", "tsx", "code"), ("js", "javascript", "code"), ("jsx", "javascript", "code"),
    ("mjs", "javascript", "code"), ("cjs", "javascript", "code"), ("go", "go", "code"), ("rs", "rust", "code"), ("java", "java", "code"), ("kt", "kotlin", "code"),
    ("kts", "kotlin", "code"), ("scala", "scala", "code"), ("swift", "swift", "code"), ("rb", "ruby", "code"), ("php", "php", "code"), ("cs", "csharp", "code"),
    ("c", "c", "code"), ("h", "c", "code"), ("cc", "cpp", "code"), ("cpp", "cpp", "code"), ("hpp", "cpp", "code"), ("m", "objc", "code"), ("ex", "elixir", "code"),
    ("exs", "elixir", "code"), ("sh", "bash", "code"), ("bash", "bash", "code"), ("sql", "sql", "code"), ("html", "html", "code"), ("vue", "vue", "code"), ("svelte", "svelte", "code"),
    ("tf", "hcl", "config"), ("toml", "toml", "config"), ("yaml", "yaml", "config"), ("yml", "yaml", "config"), ("json", "json", "config"), ("xml", "xml", "config"),
    ("properties", "properties", "config"), ("ini", "ini", "config"), ("md", "markdown", "doc"), ("rst", "rst", "doc"), ("txt", "text", "doc"),
)
NAMES = (("Dockerfile", "dockerfile", "config"), ("Makefile", "text", "doc"), ("README", "text", "doc"))


def _lookup(key: Column, table, column: int) -> Column:
    flat = [F.lit(x) for k, *v in table for x in (k, v[column])]
    return F.create_map(*flat)[key]


def language(path: Column, formats: dict[str, tuple[str, str]] | None = None) -> tuple[Column, Column]:
    """(lang, kind): the workspace's own formats first, then the suffix, then the file name."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    out = []
    for column in (0, 1):
        own = F.lit(None).cast("string")
        for pattern, pair in (formats or {}).items():
            own = F.when(F.concat(F.lit("."), suffix) == pattern, F.lit(pair[column])).otherwise(own)
        out.append(F.coalesce(own, _lookup(suffix, SUFFIXES, column), _lookup(name, NAMES, column)))
    return out[0], out[1]


def examine(files: DataFrame, ignore: tuple[str, ...] = (), formats: dict[str, tuple[str, str]] | None = None, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """Add found_lang, found_kind and ``skip``: the first reason a file is not indexed, or null.

    ``files`` has rel_path, size_bytes and content (null when unreadable). ``most_bytes``
    null: files of any size.
    """
    lang, kind = language(F.col("rel_path"), formats)
    folders = F.split(F.regexp_replace("rel_path", "/?[^/]*$", ""), "/")
    hidden = F.exists(folders, lambda d: d.startswith(".") & (F.length(d) > 1)) | F.arrays_overlap(folders, F.array(*[F.lit(d) for d in HIDDEN_DIRS]))
    ignored = F.lit(False)
    for g in ignore:
        pattern = "^" + "".join(".*" if c == "*" else "." if c == "?" else c if c.isalnum() or c in "/_" else "\\" + c for c in g) + "$"
        ignored = ignored | F.col("rel_path").rlike(pattern)
    skip = (
        F.when(hidden, "hidden or artefact folder").when(ignored, "ignored").when(lang.isNull(), "unknown format")
        .when(F.col("size_bytes") > most_bytes if most_bytes is not None else F.lit(False), "too large").when(F.col("content").isNull(), "unreadable")
        .when(F.instr(F.substring("content", 1, 8192), "\x00") > 0, "binary")
    )
    return files.withColumn("found_lang", lang).withColumn("found_kind", kind).withColumn("skip", skip)


#: Share of the files a language could have claimed that may go unclaimed in silence.
UNCLAIMED_SHARE = 0.1


def run_report(examined: DataFrame) -> DataFrame:
    """(repo, files, unreadable, unclaimed, candidates, mostly_unclaimed): what a pass over files left out.

    Candidates are the files read and those no language claims; what is hidden or
    ignored does not dilute the share.
    """
    read, unclaimed = F.count(F.when(F.col("skip").isNull(), 1)), F.count(F.when(F.col("skip") == "unknown format", 1))
    rows = examined.groupBy("repo").agg(read.alias("files"), F.count(F.when(F.col("skip") == "unreadable", 1)).alias("unreadable"), unclaimed.alias("unclaimed"))
    return rows.withColumn("candidates", F.col("files") + F.col("unclaimed")).withColumn("mostly_unclaimed", F.col("unclaimed") > F.col("candidates") * F.lit(UNCLAIMED_SHARE))


def unclaimed_suffixes(examined: DataFrame) -> DataFrame:
    """(suffix, files) that no language claims, over all repositories."""
    suffix = F.lower(F.regexp_extract("rel_path", r"(\.[^./]+)$", 1))
    return examined.where(F.col("skip") == "unknown format").groupBy(suffix.alias("suffix")).agg(F.count(F.lit(1)).alias("files"))


#: So many paths at most are named to the reader; more are found by a join.
MOST_NAMED = 2_000


def read_folder(spark: SparkSession, root: str, repo: str, paths: DataFrame | None = None) -> DataFrame:
    """Every file below a folder, or those of ``paths`` (rel_path), as rows of the files table;
    bytes that are no UTF-8 are replaced. Only the named files are opened when they are few."""
    base = root.rstrip("/")
    named = None if paths is None else [r.rel_path for r in paths.select("rel_path").limit(MOST_NAMED + 1).collect()]
    reader = spark.read.format("binaryFile")
    if named is not None and len(named) <= MOST_NAMED:
        there = [f"{base}/{p}" for p in named if (Path(base) / p).is_file()] if not re.match(r"^[a-z0-9]+://", base) else [f"{base}/{p}" for p in named]
        if not there:
            return spark.createDataFrame([], "repo string, rel_path string, size_bytes bigint, content string, walked_at timestamp, lang string, kind string")
        raw = reader.load([re.sub(r"([\\*?\[\]{}])", r"\\\1", p) for p in there])
    else:
        raw = reader.option("recursiveFileLookup", "true").load(base)
    here = F.regexp_replace(F.regexp_replace("path", "^file:/*", "/"), "^" + re.escape(base) + "/", "")
    rows = raw.select(F.lit(repo).alias("repo"), here.alias("rel_path"), F.col("length").alias("size_bytes"), F.expr("decode(content, 'UTF-8')").alias("content"), F.col("modificationTime").alias("walked_at"))
    if named is not None and len(named) > MOST_NAMED:
        rows = rows.join(paths.select("rel_path").distinct(), "rel_path", "left_semi").select(rows.columns)
    lang, kind = language(F.col("rel_path"))
    return rows.withColumn("lang", lang).withColumn("kind", kind)
