"""Files to chunks: line windows, markdown sections, definitions, tables of configuration.

Each file is cut by the branch its kind and language choose; every non-blank line
of a file lands in at least one chunk. Cutting is sequential within a file and
independent between files, so it runs as a map over batches of files.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import text as T
from tallyweave.operators import definitions as D
from tallyweave.session import spread

WINDOW_LINES, OVERLAP_LINES, MOST_CHARS = 40, 10, 900
#: (start, end, symbol, node_type), one-based and inclusive.
Span = tuple[int, int, str | None, str | None]


def windows(lines: list[str], first: int = 1, window: int = WINDOW_LINES, overlap: int = OVERLAP_LINES, most: int = MOST_CHARS) -> list[Span]:
    """Windows of at most ``window`` lines and ``most`` characters that overlap.

    A longer line stands alone; blank windows are dropped; the next window starts
    a quarter of the taken lines, at most ``overlap``, before the end.
    """
    if overlap >= window:
        raise ValueError("the overlap must be smaller than the window")
    out: list[Span] = []
    at, n = 0, len(lines)
    while at < n:
        taken, size = 0, 0
        while at + taken < n and taken < window:
            cost = len(lines[at + taken]) + 1
            if taken and size + cost > most:
                break
            size += cost
            taken += 1
        if any(x.strip() for x in lines[at : at + taken]):
            out.append((first + at, first + at + taken - 1, None, None))
        if at + taken >= n:
            break
        at += max(1, taken - min(overlap, taken // 4))
    return out


def _bounded(lines: list[str], start: int, end: int, most: int = MOST_CHARS) -> list[Span]:
    """Cut what lies between definitions into runs of at most ``most`` characters."""
    out, at, size = [], start, 0
    for i in range(start, end + 1):
        cost = len(lines[i - 1]) + 1
        if i > at and size + cost > most:
            out.append((at, i - 1, None, None))
            at, size = i, 0
        size += cost
    out.append((at, end, None, None))
    return [s for s in out if any(x.strip() for x in lines[s[0] - 1 : s[1]])]


def cover(lines: list[str], spans: list[Span], leftover: str | None = None) -> list[Span]:
    """Add chunks for the lines that no span holds: gaps and islands."""
    held = [False] * (len(lines) + 2)
    for a, b, *_ in spans:
        for i in range(max(1, a), min(len(lines), b) + 1):
            held[i] = True
    out, i = list(spans), 1
    while i <= len(lines):
        if held[i]:
            i += 1
            continue
        j = i
        while j < len(lines) and not held[j + 1]:
            j += 1
        out += [(a, b, s, leftover) for a, b, s, _ in _bounded(lines, i, j)]
        i = j + 1
    return sorted(out, key=lambda s: (s[0], s[1]))


def python_spans(text: str, lines: list[str]) -> list[Span]:
    """Functions, methods and class heads of a Python file."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return cover(lines, [], "parse-error")
    out: list[Span] = []

    def start_of(node: ast.AST) -> int:
        return min([node.lineno, *[d.lineno for d in getattr(node, "decorator_list", [])]])

    def walk(body: list[ast.stmt], prefix: str, depth: int) -> None:
        for node in body:
            if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
                out.append((start_of(node), node.end_lineno, prefix + node.name, "function_definition"))
            elif isinstance(node, ast.ClassDef):
                members = [n for n in node.body if isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef)]
                if not members or depth >= 8:
                    out.append((start_of(node), node.end_lineno, prefix + node.name, "class_definition"))
                    continue
                first = start_of(members[0])
                if first > start_of(node):
                    out.append((start_of(node), first - 1, prefix + node.name, "class_definition"))
                walk(node.body, f"{prefix}{node.name}.", depth + 1)

    walk(tree.body, "", 0)
    return cover(lines, out)


#: How a definition begins in the languages that have no nesting to follow: (pattern with the name in a group, node type).
DEFINITIONS: dict[str, list[tuple[re.Pattern, str]]] = {
    "toml": [(re.compile(r"^\[\[?\s*([^\]]+?)\s*\]\]?"), "table")],
    "yaml": [(re.compile(r"^([A-Za-z_][\w.\-]*)\s*:"), "block_mapping_pair")],
    "dockerfile": [(re.compile(r"(?i)^FROM\s+\S+(?:\s+AS\s+(\S+))?"), "stage")],
    "bash": [(re.compile(r"^(?:function\s+)?(\w[\w-]*)\s*\(\)"), "function_definition"), (re.compile(r"^function\s+(\w[\w-]*)"), "function_definition")],
    "sql": [(re.compile(r"(?i)^create\s+(?:or\s+replace\s+)?(?:temp(?:orary)?\s+|unique\s+|materialized\s+)*(?:table|view|function|procedure|index|trigger|type|schema|sequence)\s+(?:if\s+not\s+exists\s+)?([\w.\"]+)"), "create")],
    "html": [(re.compile(r"^<([a-zA-Z][\w-]*)"), "element")],
}
_NESTING = {"go", "ruby", "elixir", "objc", "hcl", "json", "xml", *D.NESTED}


def definitions(lang: str, text: str, lines: list[str]) -> list[Span]:
    """The definitions of a file of a language whose nesting is followed."""
    if lang in D.NESTED:
        return D.nested_spans(lang, lines)
    if lang in ("ruby", "elixir"):
        return D.ended_spans(lang, lines)
    if lang == "xml":
        return D.xml_spans(text, lines)
    return {"go": D.go_spans, "objc": D.objc_spans, "hcl": D.hcl_spans, "json": D.json_spans}[lang](lines)


_EXTRA: dict[str, Callable[[str, list[str]], list[Span]]] = {}


def register_chunker(lang: str, spans: Callable[[str, list[str]], list[Span]]) -> None:
    """Add a language: a function of (text, lines) that gives its spans. Built-in ones win."""
    if lang not in DEFINITIONS and lang not in _NESTING and lang != "python":
        _EXTRA[lang] = spans


def load_plugins(group: str = "tallyweave.chunkers") -> list[str]:
    """Register the languages that installed packages offer; what cannot be loaded is named."""
    failed = []
    for point in entry_points(group=group):
        try:
            register_chunker(point.name, point.load())
        except Exception as e:  # a broken plug-in takes no other with it
            failed.append(f"{point.name}: {e}")
    return failed


def _closes(lines: list[str], start: int) -> int:
    """Where a definition that begins at ``start`` ends: its braces balance again."""
    depth, opened = 0, False
    for i in range(start, len(lines) + 1):
        bare = re.sub(r"//.*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|`[^`]*`", "", lines[i - 1])
        depth += bare.count("{") - bare.count("}")
        opened = opened or "{" in bare
        if opened and depth <= 0:
            return i
        if not opened and bare.rstrip().endswith(";"):
            return i
    return len(lines)


def pattern_spans(lang: str, lines: list[str]) -> list[Span]:
    """Definitions by how their first line looks, to their closing brace or to the next."""
    patterns = DEFINITIONS[lang]
    starts = []
    for i, line in enumerate(lines, 1):
        for pattern, node in patterns:
            m = pattern.match(line)
            if m:
                name = ".".join(g for g in m.groups() if g) or None
                starts.append((i, name, node))
                break
    braces = lang == "bash"
    out: list[Span] = []
    last = 0
    for n, (i, name, node) in enumerate(starts):
        if i <= last:
            continue
        end = _closes(lines, i) if braces else (starts[n + 1][0] - 1 if n + 1 < len(starts) else len(lines))
        out.append((i, end, name, node))
        last = end
    return cover(lines, out)


_TAG = re.compile(r"(?is)<!--.*?-->|<(/?)(script|style|template)\b((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)>")
_END = {tag: re.compile(rf"(?i)</{tag}\s*>") for tag in ("script", "style")}


def _template_end(text: str, at: int) -> re.Match | None:
    """The tag that closes a template whose inside begins at ``at``; inner templates count."""
    depth = 1
    for m in _TAG.finditer(text, at):
        if (m.group(2) or "").lower() == "template" and not m.group(3).rstrip().endswith("/"):
            depth += -1 if m.group(1) else 1
            if not depth:
                return m
    return None


def container_sections(text: str) -> list[tuple[str, int, str]]:
    """(lang, first line, text) of the script, style and markup parts of a single-file component."""
    out, at = [], 0
    while m := _TAG.search(text, at):
        at = m.end()
        if not m.group(2) or m.group(1) or m.group(3).rstrip().endswith("/"):
            continue
        tag, attributes = m.group(2).lower(), m.group(3)
        end = _template_end(text, at) if tag == "template" else _END[tag].search(text, at)
        if not end:
            continue
        lang = {"script": "typescript" if re.search(r"lang=[\"']?ts", attributes) else "javascript", "style": "css", "template": "html"}[tag]
        out.append((lang, len((text[:at] + "x").splitlines()), text[at : end.start()]))
        at = end.end()
    return out


def markdown_spans(lines: list[str]) -> list[Span]:
    """Sections by headers outside code fences; the first line always starts one."""
    out, start, fence, title = [], 1, False, None
    for i, line in enumerate(lines, 1):
        if line.startswith("```"):
            fence = not fence
        if line.startswith("#") and not fence and (i > 1 or True):
            if i > start and any(x.strip() for x in lines[start - 1 : i - 1]):
                out.append((start, i - 1, title, "section"))
            start, title = i, line.lstrip("#").strip()
    if any(x.strip() for x in lines[start - 1 :]):
        out.append((start, len(lines), title, "section"))
    return out


def spans_of(text: str, lang: str | None, kind: str | None) -> list[Span]:
    """The spans of a file by the branch that fits it; windows where none does."""
    lines = text.splitlines()
    if not lines:
        return []
    if lang == "markdown":
        return markdown_spans(lines)
    if lang in ("vue", "svelte"):
        out = []
        for inner, first, part in container_sections(text):
            out += [(a + first - 1, b + first - 1, s, n) for a, b, s, n in spans_of(part, inner, kind)]
        return cover(lines, out) if out else windows(lines)
    if lang == "python":
        return python_spans(text, lines)
    if lang in _NESTING:
        found = definitions(lang, text, lines)
        return cover(lines, found) if found else windows(lines)
    if lang in DEFINITIONS:
        return pattern_spans(lang, lines)
    if lang in _EXTRA:
        return cover(lines, _EXTRA[lang](text, lines))
    return windows(lines)


CHUNKS = "repo string, path string, lang string, kind string, symbol string, node_type string, start_line int, end_line int, text string"


def _chunk_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [c.split()[0] for c in CHUNKS.split(", ")]
    for pdf in batches:
        out = []
        for repo, path, lang, kind, content in pdf.itertuples(index=False, name=None):
            lines = content.splitlines()
            for a, b, symbol, node in spans_of(content, lang, kind):
                out.append((repo, path, lang, kind, symbol, node, a, b, "\n".join(lines[a - 1 : b])))
        yield pd.DataFrame(out, columns=names)


def latest(files: DataFrame) -> DataFrame:
    """One readable row per (repo, rel_path): the one walked last."""
    at = F.col("walked_at") if "walked_at" in files.columns else F.lit(None).cast("timestamp")
    held = files.where(F.col("content").isNotNull()).withColumn("__at", at)
    newest = Window.partitionBy("repo", "rel_path").orderBy(F.desc_nulls_last("__at"), F.col("content"), F.asc_nulls_last("lang"))
    return held.withColumn("__n", F.row_number().over(newest)).where("__n = 1").drop("__n", "__at")


def chunk_files(files: DataFrame) -> DataFrame:
    """Chunks with their ids, of distinct readable files (repo, rel_path, lang, kind, content).

    Of several contents of one path the one walked last counts, of those of one moment
    the first in order.
    """
    slim = latest(files).select("repo", F.col("rel_path").alias("path"), "lang", "kind", "content")
    cut = spread(slim).mapInPandas(_chunk_batches, CHUNKS)
    return cut.withColumn("id", T.chunk_id(F.col("text"), F.col("path")))


def markdown_sections(files: DataFrame) -> DataFrame:
    """Markdown sections by window functions alone: (repo, path, start_line, end_line, symbol).

    Fence parity and header count are running sums over the lines of a file.
    """
    rows = latest(files.where(F.col("lang") == "markdown")).select("repo", F.col("rel_path").alias("path"), "content")
    at = rows.select("repo", "path", F.posexplode(T.lines(F.col("content"))).alias("n", "line"))
    run = Window.partitionBy("repo", "path").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    fenced = at.withColumn("fences", F.sum(F.col("line").startswith("```").cast("int")).over(run))
    header = F.col("line").startswith("#") & (F.col("fences") % 2 == 0)
    marked = fenced.withColumn("section", F.sum(header.cast("int")).over(run))
    out = marked.groupBy("repo", "path", "section").agg(
        (F.min("n") + 1).alias("start_line"), (F.max("n") + 1).alias("end_line"), F.max((F.trim("line") != "").cast("int")).alias("filled"),
        F.min_by("line", "n").alias("head"),
    )
    title = F.when(F.col("section") > 0, F.trim(F.regexp_replace("head", "^#+", "")))
    return out.where("filled = 1").select("repo", "path", "start_line", "end_line", title.alias("symbol"))


def commit_chunks(commits: DataFrame) -> DataFrame:
    """One chunk per commit with a message: (repo, path, symbol, text, id ...)."""
    rows = commits.where(F.trim(F.coalesce("message", F.lit(""))) != "")
    path = T.commit_path(F.col("author_date"), F.col("sha"))
    return rows.select(
        "repo", path.alias("path"), F.lit("text").alias("lang"), F.lit("commit").alias("kind"), F.substring("sha", 1, 7).alias("symbol"), F.lit("commit").alias("node_type"),
        F.lit(1).alias("start_line"), F.size(T.lines(F.col("message"))).alias("end_line"), F.col("message").alias("text"), T.chunk_id(F.col("message"), path).alias("id"),
    )
