"""Column functions over names, paths and texts. All stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Line ends as Python's ``splitlines`` sees them.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029]"
IDENTIFIER = "[A-Za-z_][A-Za-z0-9_]*"
WORD = r"[\p{L}\p{N}_]+"
#: Retrieval token estimate: three characters each.
CHARS_PER_TOKEN = 3


def lines(text: Column) -> Column:
    """Lines without their ends; no empty last line for a final line end."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def chunk_id(text: Column, path: Column) -> Column:
    """Content address: SHA-256 of text, its length, path, its length (big-endian)."""
    size = lambda c: F.unhex(F.lpad(F.hex(F.length(c)), 16, "0"))
    return F.sha2(F.concat(F.encode(text, "UTF-8"), size(text), F.encode(path, "UTF-8"), size(path)), 256)


def normalised(name: Column) -> Column:
    """One spelling for snake, kebab, dotted and camel names."""
    return F.lower(F.regexp_replace(name, r"[_.\-]", ""))


def words(name: Column) -> Column:
    """Path and name separators as blanks."""
    return F.trim(F.regexp_replace(name, r"[/_.\-]+", " "))


def retrieval_text(kind: Column, path: Column, symbol: Column, text: Column) -> Column:
    """What is indexed for a chunk: its name in words before its text; commits as they are."""
    head = words(F.concat_ws(" ", symbol, path))
    return F.when(kind == "commit", text).otherwise(F.concat(head, F.lit("\n"), text))


def glob_to_like(glob: str) -> str:
    """``*`` and ``**`` cross folders, ``?`` is one character, the rest is literal."""
    out, i = [], 0
    while i < len(glob):
        c = glob[i]
        if c == "*":
            while i + 1 < len(glob) and glob[i + 1] == "*":
                i += 1
            out.append("%")
        elif c == "?":
            out.append("_")
        else:
            out.append("\\" + c if c in "%_\\" else c)
        i += 1
    return "".join(out)


def matches_glob(path: Column, glob: str) -> Column:
    return F.like(path, F.lit(glob_to_like(glob)), F.lit("\\"))


def symbol_contains(symbol: Column, part: str) -> Column:
    return F.coalesce(F.like(symbol, F.lit(f"%{glob_to_like(part)}%"), F.lit("\\")), F.lit(False))


def token_cost(text: Column) -> Column:
    return F.ceil(F.length(text) / F.lit(CHARS_PER_TOKEN)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-case words of the lexical index."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), 1)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"({IDENTIFIER})"), 1)


def holds_name(text: Column, name: Column) -> Column:
    """Whether a text holds a name, taken literally, with no word character on either side."""
    literal = F.regexp_replace(name, r"([^\p{L}\p{N}_])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), literal, F.lit(r"(?![\p{L}\p{N}_])")))


#: How lines begin that are no code, and the words that bring names into scope.
NOT_CODE = r"^\s*(//|#|\*|/\*|--|;|import\b|from\b|require\b|use\b|package\b)"


def code_identifiers(text: Column) -> Column:
    kept = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(NOT_CODE))
    return identifiers(F.array_join(kept, "\n"))


def shingles(names: Column, size: int = 5) -> Column:
    """Distinct runs of ``size`` names, joined by blanks."""
    n = F.size(names) - size + 1
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(names, i, size), " "))
    return F.when(n >= 1, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def package_of(path: Column, depth: Column | int) -> Column:
    """The first ``depth`` folders of a path, or (root)."""
    depth = F.lit(depth) if isinstance(depth, int) else depth
    folders = F.split(path, "/")
    n = F.size(folders) - 1
    return F.when(n <= 0, F.lit("(root)")).otherwise(F.array_join(F.slice(folders, 1, F.least(n, F.greatest(depth, F.lit(1)))), "/"))


def folder_of(path: Column) -> Column:
    """The folder of a path; empty at the root."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def is_compound(name: Column) -> Column:
    """Names with an inner capital or an underscore, at least four long."""
    return (F.length(name) >= 4) & name.rlike("[a-z0-9][A-Z]|[A-Za-z0-9]_[A-Za-z0-9]")


def is_commit_place(path: Column) -> Column:
    return path.startswith("commits/")


def spellings(name: Column) -> Column:
    """As it is, Pascal, camel and screaming case of a snake or kebab name."""
    parts = F.filter(F.split(F.lower(name), r"[_.\-]+"), lambda x: x != "")
    caps = F.transform(parts, lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 10_000)))
    pascal = F.array_join(caps, "")
    camel = F.concat(F.lower(F.substring(pascal, 1, 1)), F.substring(pascal, 2, 10_000))
    return F.array_distinct(F.array(name, pascal, camel, F.upper(F.array_join(parts, "_"))))


def without_trailers(message: Column) -> Column:
    """A commit message without its trailer lines."""
    kept = F.filter(F.split(message, "\n"), lambda x: ~x.rlike(r"^[A-Z][A-Za-z-]+: "))
    return F.trim(F.array_join(kept, "\n"))


def commit_path(date: Column, sha: Column) -> Column:
    return F.concat(F.lit("commits/"), F.substring(date, 1, 10), F.lit("-"), F.substring(sha, 1, 7))


def ports_read(text: Column) -> Column:
    """Ports that addresses in code point at."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"https?://[A-Za-z0-9_.\-]+:([0-9]{2,5})"), 1))


def urls(text: Column) -> Column:
    """Addresses in a text, without closing punctuation."""
    found = F.regexp_extract_all(text, F.lit("(https?://[^ \\t\\r\\n<>\"'`]+)"), 1)
    return F.array_distinct(F.transform(found, lambda u: F.regexp_replace(u, r"[.,;:!?)\]}]+$", "")))


def tickets(text: Column, prefix: str, template: str) -> Column:
    """References such as PROJ-12 with the address a template makes of them."""
    found = F.array_distinct(F.regexp_extract_all(text, F.lit(rf"\b({prefix}[0-9]+)\b"), 1))
    return F.transform(found, lambda k: F.struct(k.alias("name"), F.replace(F.lit(template), F.lit("{key}"), k).alias("url")))


def html_text(html: Column) -> Column:
    """Readable text of a page: no scripts or styles, breaks at blocks, blanks collapsed."""
    x = F.regexp_replace(html, r"(?is)<(script|style|noscript|svg|head|template)\b.*?</\1\s*>", " ")
    x = F.regexp_replace(x, r"(?is)<!--.*?-->", " ")
    x = F.regexp_replace(x, r"(?i)</?(p|div|li|br|tr|h[1-6])\b[^>]*>", "\n")
    x = F.regexp_replace(x, r"<[^>]+>", "")
    for entity, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(c))
    kept = F.filter(F.transform(F.split(x, "\n"), lambda s: F.trim(F.regexp_replace(s, r"[ \t]+", " "))), lambda s: s != "")
    return F.array_join(kept, "\n")


def html_title(html: Column) -> Column:
    return F.nullif(F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)), F.lit(""))


#: Longest path segment in bytes; what is longer is cut and told apart by a hash.
SEGMENT_BYTES = 100


def _segment(raw: Column) -> Column:
    """One part of an address as a safe name; empty for what is to be dropped."""
    clean = F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9._=\-]", "_"), r"^\.+$", "")
    return F.when(F.length(clean) > SEGMENT_BYTES, F.concat(F.substring(clean, 1, SEGMENT_BYTES), F.lit("-"), F.substring(F.sha2(raw, 256), 1, 8))).otherwise(clean)


def document_path(url: Column) -> Column:
    """A safe relative path for a fetched address: host and port, folders, a leaf in ``.md``.

    Credentials and fragments leave, the query joins the leaf, an address that ends in
    a slash is an index; segments are bounded, with a hash that keeps long ones apart.
    """
    bare = F.regexp_replace(F.regexp_replace(url, "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*://([^/?@]*@)?", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^([^/?]*)", 1)), ":(?=[0-9]+$)", "-")
    path = F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1)
    query = _segment(F.regexp_extract(bare, r"\?(.*)$", 1))
    parts = F.filter(F.transform(F.split(path, "/"), _segment), lambda s: s != "")
    last = F.element_at(parts, -1)
    named = F.when(query == "", parts).when(F.size(parts) == 0, F.array(query)).otherwise(F.concat(F.slice(parts, 1, F.size(parts) - 1), F.array(F.concat(last, F.lit("-"), query))))
    whole = F.when((F.size(named) == 0) | path.endswith("/"), F.concat(named, F.array(F.lit("index")))).otherwise(named)
    top = F.coalesce(F.nullif(_segment(host), F.lit("")), F.lit("unknown-host"))
    out = F.array_join(F.concat(F.array(top), whole), "/")
    return F.when(out.endswith(".md"), out).otherwise(F.concat(out, F.lit(".md")))


#: Words of everyday reports that say nothing about code.
STOP_WORDS = (
    "about", "after", "again", "against", "always", "because", "before", "behaviour", "behavior", "between", "cannot", "could", "doesn", "during", "error",
    "should", "support", "there", "using", "version", "issue", "problem", "returns", "something", "unexpected", "without", "working", "works", "would",
)


def search_terms(question: Column, most: int = 8) -> Column:
    """What one would look for by hand: quoted strings, names of code, then long words, the longest first."""
    quoted = F.transform(F.regexp_extract_all(question, F.lit("[`\"']([^`\"']{3,60})[`\"']"), 1), lambda x: F.trim(x))
    said = F.filter(identifiers(question), lambda w: ~F.lower(w).isin(*STOP_WORDS))
    shaped = F.filter(said, lambda w: w.contains("_") | w.rlike("[a-z][A-Z]"))
    ranked = F.transform(said, lambda w, i: F.struct((-F.length(w)).alias("size"), i.alias("at"), w.alias("word")))
    long = F.transform(F.filter(F.array_sort(ranked), lambda x: x["size"] <= -6), lambda x: x["word"])
    return F.slice(F.array_distinct(F.concat(quoted, shaped, long)), 1, most)


def phrases(said: Column, most: int) -> Column:
    """The lines of a model's answer that can be queries: no remarks, commands or long sentences."""
    trimmed = F.transform(F.split(said, r"\r\n|\n|\r"), lambda x: F.regexp_replace(x, r"^[ \-*\t\"]+|[ \-*\t\"]+$", ""))
    short = lambda x: (F.length(x) >= 3) & (F.size(F.split(F.trim(x), r"\s+")) <= 14)
    kept = F.filter(trimmed, lambda x: short(x) & ~x.rlike(r"[.:!?]$") & ~x.rlike(r"^(grep|rg |find |\$|#|```)"))
    return F.slice(kept, 1, most)
