"""Build manifests: the packages a repository provides and needs."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.sources.files import HIDDEN_DIRS

MOST_BYTES, MOST_DEPTH = 512 << 10, 3
_NAME = re.compile(r"^[A-Za-z0-9@._/\-]+")


def _names(values) -> list[str]:
    return [m.group().rstrip(".") for v in values if isinstance(v, str) and (m := _NAME.match(v.strip()))]


def read_manifest(name: str, text: str) -> tuple[set[str], set[str]]:
    """(provides, needs) of one manifest; one that cannot be read gives nothing."""
    provides, needs = set(), set()
    try:
        if name == "package.json":
            doc = json.loads(text)
            provides |= set(_names([doc.get("name")]))
            for group in ("dependencies", "devDependencies", "peerDependencies"):
                needs |= set(doc.get(group) or {})
        elif name == "pyproject.toml":
            doc = tomllib.loads(text)
            project, poetry = doc.get("project", {}), doc.get("tool", {}).get("poetry", {})
            provides |= set(_names([project.get("name"), poetry.get("name")]))
            needs |= set(_names(project.get("dependencies", []))) | {k for k in poetry.get("dependencies", {}) if k != "python"}
        elif name == "Cargo.toml":
            doc = tomllib.loads(text)
            provides |= set(_names([doc.get("package", {}).get("name")]))
            needs |= set(doc.get("dependencies", {}))
        elif name == "go.mod":
            provides |= set(re.findall(r"(?m)^module\s+(\S+)", text))
            needs |= set(re.findall(r"(?m)^(?:require\s+|\s+)([\w./\-]+\.[\w./\-]+)\s+v", text))
        elif name == "pom.xml":
            ids = re.findall(r"<artifactId>\s*([^<\s]+)\s*</artifactId>", text)
            provides |= set(ids[:1])
            needs |= set(re.findall(r"(?s)<dependency>.*?<artifactId>\s*([^<\s]+)", text))
        elif name == "Gemfile":
            needs |= set(re.findall(r"""(?m)^\s*gem\s+["']([^"']+)""", text))
        elif name.endswith(".gemspec"):
            provides |= set(re.findall(r"""\.name\s*=\s*["']([^"']+)""", text))
            needs |= set(re.findall(r"""add_(?:runtime_|development_)?dependency[\s(]+["']([^"']+)""", text))
        elif name.endswith(".csproj"):
            provides |= {name[:-7]}
            needs |= set(re.findall(r'<(?:PackageReference|ProjectReference)\s+Include="([^"]+)"', text))
    except (ValueError, AttributeError, TypeError):
        return set(), set()
    return provides, needs - provides


def is_manifest(rel_path: Column) -> Column:
    name = F.regexp_extract(rel_path, "([^/]*)$", 1)
    return name.isin("package.json", "pyproject.toml", "Cargo.toml", "go.mod", "pom.xml", "Gemfile") | name.endswith(".gemspec") | name.endswith(".csproj")


def manifest_links(files: DataFrame, most_depth: int | None = MOST_DEPTH, most_bytes: int | None = MOST_BYTES) -> DataFrame:
    """provides / depends_on links of the manifests among the files.

    Deeper or larger ones than the bounds (null: none) and those of vendored folders
    belong to other projects.
    """
    name = F.regexp_extract("rel_path", "([^/]*)$", 1)
    folders = F.split(F.regexp_replace("rel_path", "/?[^/]*$", ""), "/")
    wanted = is_manifest(F.col("rel_path")) & ~F.arrays_overlap(folders, F.array(*[F.lit(d) for d in (*HIDDEN_DIRS, "vendor", "vendored", "third_party", "thirdparty")]))
    if most_depth is not None:
        wanted = wanted & (F.size(F.split("rel_path", "/")) - 1 <= most_depth)
    if most_bytes is not None:
        wanted = wanted & (F.length("content") <= most_bytes)
    few = files.where(wanted).select("repo", "rel_path", name.alias("name"), "content").distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, path, n, text in pdf.itertuples(index=False, name=None):
                provides, needs = read_manifest(n, text)
                out += [(repo, f"manifest:{repo}", k, x, path) for k, names in (("provides", provides), ("depends_on", needs)) for x in sorted(names)]
            yield pd.DataFrame(out, columns=["repo", "src_chunk_id", "kind", "name", "path"])

    return few.mapInPandas(run, "repo string, src_chunk_id string, kind string, name string, path string")
