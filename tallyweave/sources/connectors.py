"""Documents from outside: routing of addresses, conversion, snapshots to markdown."""

from __future__ import annotations

import json
import os
import re
from abc import ABC, abstractmethod
from collections.abc import Iterator, Sequence
from importlib.metadata import entry_points
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.session import cut

DOCUMENT = "url string, title string, text string, metadata map<string,string>"


class Connector(ABC):
    """Fetches documents of the addresses it understands; runs on executors."""

    name = ""

    @abstractmethod
    def understands(self, url: str) -> bool: ...

    @abstractmethod
    def fetch(self, url: str) -> tuple[str, str | None, str, dict[str, str]]: ...


_CONNECTORS: dict[str, Connector] = {}


def register_connector(connector: Connector) -> None:
    """The first connector of a name wins."""
    _CONNECTORS.setdefault(connector.name, connector)


def route(url: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """The connector of the first (glob, connector) rule that fits an address; null if none does."""
    out = F.lit(None).cast("string")
    for glob, name in reversed(rules):
        out = F.when(F.like(url, F.lit(T.glob_to_like(glob)), F.lit("\\")), F.lit(name)).otherwise(out)
    return out


def understood(url: Column, connectors: Sequence[Connector] | None = None) -> Column:
    """The first registered connector that understands an address; null if none does."""
    known = list(_CONNECTORS.values()) if connectors is None else list(connectors)

    @F.pandas_udf("string")
    def ask(urls: pd.Series) -> pd.Series:
        return pd.Series([None if u is None else next((c.name for c in known if c.understands(u)), None) for u in urls], dtype=object)

    return ask(url)


def fetch(addresses: DataFrame, rules: Sequence[tuple[str, str]] = (), connectors: Sequence[Connector] | None = None) -> DataFrame:
    """(url, title, text, metadata, failed): the documents of addresses, fetched where the rows lie.

    Rules come first, then what the connectors say of themselves; an address that nobody
    takes, or that cannot be fetched, is a row with its reason and strands no other.
    """
    known = {c.name: c for c in (_CONNECTORS.values() if connectors is None else connectors)}
    routed = addresses.select("url").where(F.col("url").isNotNull()).distinct().withColumn("by", F.coalesce(route(F.col("url"), rules), understood(F.col("url"), list(known.values()))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, by in pdf.itertuples(index=False, name=None):
                try:
                    if by not in known:
                        raise LookupError(f"no connector {by!r}" if by else "no connector understands it")
                    out.append((*known[by].fetch(url), None))
                except Exception as e:  # any failure of a connector is a reason, not an end
                    out.append((url, None, None, {}, str(e) or type(e).__name__))
            yield pd.DataFrame(out, columns=["url", "title", "text", "metadata", "failed"])

    return routed.mapInPandas(run, f"{DOCUMENT}, failed string")


def load_plugins(group: str = "tallyweave.connectors") -> list[str]:
    """Register the connectors that installed packages offer; what cannot be loaded is named."""
    failed = []
    for point in entry_points(group=group):
        try:
            register_connector(point.load()())
        except Exception as e:  # a broken plug-in takes no other with it
            failed.append(f"{point.name}: {e}")
    return failed


def pages_to_documents(pages: DataFrame) -> DataFrame:
    """(url, html) pages as documents; stays in the JVM."""
    return pages.select("url", T.html_title(F.col("html")).alias("title"), T.html_text(F.col("html")).alias("text"), F.create_map(F.lit("type"), F.lit("html")).alias("metadata"))


ISSUE = "title string, body string, state string, number int, html_url string, user struct<login:string>, labels array<struct<name:string>>"


def issues_to_documents(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Issue payloads (JSON) as documents with their state, author and labels."""
    x = payloads.select(F.from_json(column, ISSUE).alias("i")).select("i.*")
    meta = F.create_map(F.lit("state"), F.col("state"), F.lit("author"), F.col("user.login"), F.lit("labels"), F.array_join(F.transform("labels", lambda e: e["name"]), ","))
    return x.where(F.col("title").isNotNull()).select(F.col("html_url").alias("url"), F.concat(F.lit("#"), "number", F.lit(" "), "title").alias("title"), F.coalesce("body", F.lit("")).alias("text"), meta.alias("metadata"))


def render(documents: DataFrame) -> DataFrame:
    """(path, markdown): JSON-quoted front matter before the text."""
    quote = lambda c: F.regexp_replace(F.to_json(F.struct(F.col(c).alias("v"))), r'^\{"v":(.*)\}$', "$1")
    head = F.concat_ws("\n", F.lit("---"), F.concat(F.lit("url: "), quote("url")), F.when(F.col("title").isNotNull(), F.concat(F.lit("title: "), quote("title"))), F.lit("---"), F.lit(""))
    return documents.select(T.document_path(F.col("url")).alias("path"), F.concat(head, F.col("text"), F.lit("\n")).alias("markdown"))


def snapshot_changes(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """(path, change): added, updated, unchanged or removed, by content."""
    a = fresh.select("path", F.md5(F.encode("markdown", "UTF-8")).alias("new"))
    b = stored.select("path", F.md5(F.encode("markdown", "UTF-8")).alias("old"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("new") == F.col("old"), "unchanged").otherwise("updated")
    return a.join(b, "path", "full").select("path", change.alias("change"))


def charset(content_type: str | None) -> str:
    """The codec that a content type names, if it can decode text; UTF-8 otherwise."""
    named = re.search(r";\s*charset\s*=\s*\"?([^\s;\"]+)", content_type or "", re.IGNORECASE)
    if named is None:
        return "utf-8"
    try:
        b"    ".decode(named.group(1))
    except LookupError:  # no codec of that name, or one that makes no text
        return "utf-8"
    except UnicodeDecodeError:
        pass
    return named.group(1)


def decoded(content_type: Column, body: Column) -> Column:
    """Bodies of responses as text; bytes that do not fit are replaced."""

    @F.pandas_udf("string")
    def decode(types: pd.Series, bodies: pd.Series) -> pd.Series:
        return pd.Series([None if b is None else bytes(b).decode(charset(t), "replace") for t, b in zip(types, bodies, strict=True)], dtype=object)

    return decode(content_type, body)


def collisions(rendered: DataFrame) -> DataFrame:
    """(path, documents): paths that more than one document claims."""
    return rendered.groupBy("path").agg(F.count(F.lit(1)).alias("documents")).where(F.col("documents") > 1)


def materialise(rendered: DataFrame, folder: str) -> DataFrame:
    """Write (path, markdown) as files below a folder all executors share: (path, change).

    Files whose content is the same are left alone; of documents that claim one path the
    first in order of its content is written. A task that is run again writes the same.
    """
    one = rendered.groupBy("path").agg(F.min("markdown").alias("markdown"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, text in zip(pdf["path"], pdf["markdown"], strict=True):
                target, data = Path(folder) / path, text.encode()
                was = target.read_bytes() if target.is_file() else None
                if was != data:
                    target.parent.mkdir(parents=True, exist_ok=True)
                    fresh = target.with_name(f".{target.name}.{os.getpid()}")
                    fresh.write_bytes(data)
                    fresh.replace(target)
                out.append((path, "added" if was is None else "unchanged" if was == data else "updated"))
            yield pd.DataFrame(out, columns=["path", "change"])

    return cut(one.mapInPandas(run, "path string, change string"))


def as_json(document: dict) -> str:
    return json.dumps(document, ensure_ascii=False, sort_keys=True)
