"""Source files that were not written by hand in this workspace.

Per language a character trigram model of identifiers is trained over all files
(every distinct identifier of a file counts once, so no large file dominates; what
stands in comments is no identifier).
Each file is then judged by
    * mangled names: identifiers whose cross-entropy under the model is high
    * template-like names: few distinct names once numbers are taken out
    * a naming style foreign to its language in this workspace
    * names foreign to the workspace: words that name folders and begin outermost
      comments about as often, but that no code uses and the model finds unlikely, are
      the names of projects maintained elsewhere; files under such a folder or comment
      are vendored
together with what its outermost comments, its path and its shape say (generator
and licence banners at the head, at the foot or between, vendor and output
folders, lock files, literals and number tables that fill the file).

Defined results for odd input
    * null content: judged by its path alone; empty content: likewise
    * null lang: a language of its own; null path: judged by content alone
    * exact duplicate rows: one file; empty table: no rows
    * very long files: read whole
    * extra columns, whatever their names: ignored
"""

from __future__ import annotations

import io
import math
import re
import tokenize
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.lexing import CODE, STATES, lex
from tallyweave.session import cut, spread

_IDENT = re.compile(r"[A-Za-z_$][\w$]*")
_DIGITS = re.compile(r"(?:0x)?[0-9a-f]*\d[0-9a-f]*|\d+", re.IGNORECASE)
_HAS_DIGIT = re.compile(r"\d").search
_COMMENT = re.compile(r"^\s*(?://+!?|#+!?|/\*+!?|<!--+|\*+|--|;+|%|\"\"\"|''')\s?")

#: What a tool writes at the head of its output, in the languages of the workspace.
GENERATED = re.compile(
    r"@generated\b|\bauto-?\s?generated\b|\b(?:code|file|source|content)s?\s+(?:is |was |were |has been )?(?:auto\w*\s+)?generated\b"
    r"|^\W*generated\s+(?:from|by|with|on|at|using)\b|\b(?:produced|created|written|built|emitted)\s+automatically\b|\bautomatically\s+(?:produced|created|written|built|emitted|generated)\b"
    r"|\bmachine[- ](?:written|made|generated|produced)\b|\boutput of (?:the|a)\b.*\bgenerator\b|\bregenerate\b.*\b(?:instead|edit)"
    r"|\bmanual (?:changes|edits)\b.*\b(?:lost|overwritten)\b|\bchanges? (?:will|would) be (?:lost|overwritten)\b"
    r"|\bdo(?: not|n't) (?:edit|modify|change|touch)(?: this file)?(?:[.!*/\s-]*$|\s+(?:by hand|manually)\b)|\bdo(?: not|n't) (?:edit|modify)[.!]"
    r"|\bchange the \w+, not this file\b|\brun\b.*\bto (?:refresh|regenerate|update)\b"
    r"|\bne pas (?:modifier|éditer)\b|\bfichier (?:produit|généré|créé)\b|\bnicht (?:bearbeiten|ändern|editieren|verändern)\b|\bautomatisch (?:erzeugt|generiert|erstellt)\b"
    r"|\bno (?:editar|modificar|tocar)\b|\b(?:archivo|fichero|código)? ?generado (?:por|automáticamente|a partir)\b",
    re.IGNORECASE,
)
#: Lines in which hand-written code speaks of such things.
BY_HAND = re.compile(
    r"\b(?:written|maintained|edited|kept|made|updated) (?:by hand|manually)\b|\bhand-?(?:written|maintained|made)\b|\bwithout asking\b|\breplaces\b|\bused to\b|\bused by\b",
    re.IGNORECASE,
)
_LICENCE = r"MIT|ISC|Zlib|Unlicense|WTFPL|Apache[- ]?\d?(?:\.\d)?|BSD(?:-\d-Clause)?|[AL]?GPL(?:v?\d)?|MPL(?:-\d\.\d)?|EPL|CC0|BSL"
#: A product with a version and a licence or a copyright: a copy from elsewhere.
VENDORED = re.compile(
    rf"^\W*[\w.@/-]+\s+v?\d+(?:\.\d+)+\S*.*(?:\b(?:{_LICENCE})\b|licen[sc]ed|licen[sc]e|copyright|\(c\)|©|contributors)", re.IGNORECASE
)
PATCHED = re.compile(r"^\W*local(?:ly)? (?:patch|modification|change)(?:ed)?\b\s*:", re.IGNORECASE)

VENDOR_DIRS = {
    "vendor", "vendors", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "3rd_party", "external", "externals", "extern",
    "deps", "bundled", "node_modules", "bower_components", "jspm_packages", "site-packages", "pods", "carthage", "godeps", "_vendor",
}
OUTPUT_DIRS = {"gen", "generated", "__generated__", "autogen", "auto_generated", "generated-sources", "_generated", "codegen_out"}
BUILT_NAME = re.compile(r"\.(?:min|bundle|prod|umd|packed)\.(?:js|mjs|cjs|css)$|\.(?:pb|g|gen|generated|designer)\.\w+$|\.d\.gen\.ts$|_pb2(?:_grpc)?\.pyi?$|\.map$", re.IGNORECASE)
LOCK_NAME = re.compile(
    r"^(?:package-lock\.json|npm-shrinkwrap\.json|pnpm-lock\.ya?ml|yarn\.lock|poetry\.(?:lock|toml)|pdm\.lock|uv\.lock|pipfile\.lock|cargo\.lock|go\.sum|composer\.lock|gemfile\.lock|[\w.-]+\.lock(?:\.\w+)?)$",
    re.IGNORECASE,
)
_LOCK_HEAD = re.compile(r"^[ \t{]*\"?lockfile-?version\"?\s*[:=]", re.IGNORECASE | re.MULTILINE)
_LOCK_SUM = re.compile(r"\"?(?:integrity|checksum|resolved|hash|sha\d+)\"?\s*[:=]\s*\"?(?:sha\d+[-:])?[\w+/=-]{20,}", re.IGNORECASE)
_LITERAL = re.compile(r"[A-Za-z0-9+/=_-]{120,}")
_NUMBER_ROW = re.compile(r"(?:-?(?:0x[0-9a-fA-F]+|\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)\s*,\s*){4,}")

#: Bits per character above which an identifier counts as mangled.
MANGLED_BITS = 4.2
#: Shares from which a file is flagged.
MANGLED_SHARE, TEMPLATE_SHARE, DATA_SHARE, FOREIGN_SHARE = 0.3, 0.3, 0.5, 0.8
#: Bits per character above which a word may name a project from elsewhere, how many
#: times more often than in code it must stand in paths and in comments, and how many
#: times more often in one of them than in the other it may: the workspace's own
#: folders hold many files that no comment names.
FOREIGN_BITS, FOREIGN_TIMES, FOREIGN_RATIO = 3.0, 50, 8
#: So many names that differ in nothing but numbers make a template.
TEMPLATE_NAMES = 8

_SLASHES, _HASHES, _DASHES, _MARKUP = r"//[^\n]*|/\*[\s\S]*?\*/[ \t\r]*$", r"#[^\n]*", r"--[^\n]*|/\*[\s\S]*?\*/[ \t\r]*$", r"<!--[\s\S]*?-->[ \t\r]*$"
#: How a comment that begins a line looks, by language; other languages: any of them.
_OWN_LINE = {
    **dict.fromkeys(("python", "yaml", "toml", "bash", "shell", "ruby", "dockerfile", "makefile", "elixir", "perl", "r"), _HASHES),
    **dict.fromkeys((*STATES, "tsx", "c", "cpp", "csharp", "kotlin", "swift", "scala", "objc", "css", "json"), _SLASHES),
    **dict.fromkeys(("php", "hcl"), rf"{_SLASHES}|{_HASHES}"), "sql": _DASHES, **dict.fromkeys(("markdown", "html", "xml", "vue", "svelte"), _MARKUP),
}
_OWN_LINE = {g: re.compile(rf"^(?:{p})", re.MULTILINE) for g, p in _OWN_LINE.items()}
_ANY_OWN_LINE = re.compile(rf"^(?:{_SLASHES}|{_HASHES}|--[^\n]*|{_MARKUP}|[;%][^\n]*)", re.MULTILINE)
#: Texts inside a file of the languages without a lexer here: here-documents, long strings, fences.
_QUOTED = re.compile(r"<<[-~]?[ \t]*(['\"]?)(\w+)\1[^\n]*\n(?:[\s\S]*?\n)??[ \t]*\2[ \t\r]*$|\"\"\"[\s\S]*?\"\"\"|'''[\s\S]*?'''|^```[\s\S]*?^```", re.MULTILINE)
#: Code that a comment above it does not describe.
_OPENING = re.compile(r"(?:import|from|package|use|using|require|include|#include|module|namespace)\b|[\"']use strict|#!")


def trigrams(name: str) -> list[str]:
    """Trigrams of a name in lower case; letters outside ASCII count as one letter."""
    s = name.lower() if name.isascii() else "".join(c if c.isascii() else "~" for c in name.lower())
    s = f"^^{s}$"
    return [s[i : i + 3] for i in range(len(s) - 2)]


def style_of(name: str) -> str:
    bare = name.strip("_$")
    if "_" in bare:
        return "upper" if bare.isupper() else "snake"
    if bare[:1].isupper():
        return "upper" if bare.isupper() else "pascal"
    return "camel" if any(c.isupper() for c in bare) else "plain"


_PART = re.compile(r"[A-Z]?[a-z]{3,}|[A-Z]{4,}(?![a-z])")
_REMARKS = re.compile(r"(?://|#|--|<!--|/\*|^[ \t]*\*).*$", re.MULTILINE)
#: Languages whose words are no use by code: a readme or a manifest may name any project.
_NO_CODE = {"", "markdown", "text", "rst", "html", "xml", "json", "toml", "yaml", "ini"}


def words_of(name: str) -> list[str]:
    """Words of four letters or more of a name in any style."""
    return [w.lower() for w in _PART.findall(name)]


def folder_words(path: str | None) -> set[str]:
    return {w for d in (path or "").split("/")[:-1] for w in words_of(d)}


_LEAD = re.compile(r"[^\w\n]*([\w.@/-]+)")


def comment_words(text: str | None) -> set[str]:
    """Words of the names that the lines of the outermost comments begin with."""
    leads = (_LEAD.match(line) for line in head_comments(text)[0]) if text else ()
    return {w for m in leads if m for w in words_of(m.group(1))}


def _count_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Partial counts: trigrams and styles per language; words in code, folders and outermost comments."""
    counts: dict[str, dict[str, int]] = {}
    names: Counter = Counter()
    used, folders, comments = Counter(), Counter(), Counter()
    parts: dict[str, list[str]] = {}

    def fold() -> None:
        for (lang, name), n in names.items():
            own = counts.setdefault(lang, {})
            for g in trigrams(name):
                own[g] = own.get(g, 0) + n
            if len(name) > 4:
                style = "style " + style_of(name)
                own[style] = own.get(style, 0) + n
        names.clear()
        parts.clear()

    for pdf in batches:
        for path, lang, text in zip(pdf["rel_path"], pdf["lang"], pdf["content"], strict=True):
            lang = "" if lang is None else lang
            folders.update(folder_words(path))
            if not text:
                continue
            comments.update(comment_words(text))
            distinct = set(_IDENT.findall(text if lang in _NO_CODE else _REMARKS.sub("", text)))
            names.update((lang, name) for name in distinct)
            if lang not in _NO_CODE:
                found = set()
                for name in distinct:
                    if name not in parts:
                        parts[name] = words_of(name)
                    found.update(parts[name])
                used.update(found)
        if len(names) > 200_000:
            fold()
    fold()
    grams = [(lang, g, n, 0, 0) for lang, own in counts.items() for g, n in own.items()]
    words = [(None, w, used[w], folders[w], comments[w]) for w in used.keys() | folders.keys() | comments.keys()]
    yield pd.DataFrame(grams + words, columns=["lang", "gram", "n", "folders", "comments"])


class _Costs(dict):
    """Trigram -> bits, each worked out once."""

    def __init__(self, model: NameModel) -> None:
        super().__init__()
        self.model = model

    def __reduce__(self):
        return _Costs, (self.model,)

    def __missing__(self, g: str) -> float:
        m = self.model
        p1 = (m.uni[g[2]] + 0.5) / (m.total + 32)
        p2 = (m.bi[g[1:]] + 4 * p1) / (m.context[g[1]] + 4)
        p3 = (m.tri.get(g, 0) + 4 * p2) / (m.pair[g[:2]] + 4)
        out = self[g] = -math.log2(p3)
        return out


class NameModel:
    """Interpolated trigram model of the identifiers of one language."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.tri = {g: n for g, n in counts.items() if not g.startswith("style ")}
        self.styles = {g[6:]: n for g, n in counts.items() if g.startswith("style ")}
        self.pair, self.bi, self.uni, self.context = Counter(), Counter(), Counter(), Counter()
        for g, n in self.tri.items():
            self.pair[g[:2]] += n
            self.bi[g[1:]] += n
            self.context[g[1]] += n
            self.uni[g[2]] += n
        self.total = sum(self.uni.values()) or 1
        self.named = sum(self.styles.values())
        self.cost = _Costs(self)

    def bits(self, name: str) -> float:
        """Mean bits per character, the end of the name included."""
        grams = trigrams(name)
        return sum(map(self.cost.__getitem__, grams)) / len(grams)

    def foreign(self, style: str) -> bool:
        """Whether fewer than one in fifty names of the language has the style."""
        return self.styles.get(style, 0) * 50 < self.named


def count_names(files: DataFrame) -> DataFrame:
    """(lang, gram, n, folders, comments): trigram counts per language and, with null lang,
    in how many files each word stands in code (n), in the folders and in outermost comments.

    One pass; counts are added per partition, then by key.
    """
    slim = spread(files.select("rel_path", "lang", "content"))
    rows = slim.mapInPandas(_count_batches, "lang string, gram string, n bigint, folders bigint, comments bigint")
    return cut(rows.groupBy("lang", "gram").agg(*[F.sum(c).alias(c) for c in ("n", "folders", "comments")]))


def train(counts: DataFrame) -> dict[str, NameModel]:
    """Models per language, from all files.

    What reaches the driver is one row per language and trigram over some 40
    characters, at most 64,000 rows a language whatever the corpus holds.
    """
    by_lang: dict[str, dict[str, int]] = {}
    for lang, gram, n in counts.where(F.col("lang").isNotNull()).select("lang", "gram", "n").toLocalIterator():
        by_lang.setdefault(lang, {})[gram] = n
    return {g: NameModel(c) for g, c in by_lang.items()}


def foreign_words(counts: DataFrame) -> DataFrame:
    """(word): words that name folders and begin outermost comments, and that code does not use."""
    rare = F.col("n") * FOREIGN_TIMES < F.least("folders", "comments")
    even = F.greatest("folders", "comments") <= FOREIGN_RATIO * F.least("folders", "comments")
    return counts.where(F.col("lang").isNull() & rare & even).select(F.col("gram").alias("word"))


def _everyone(models: dict[str, NameModel]) -> NameModel:
    """One model of the names of all languages."""
    whole: Counter = Counter()
    for m in models.values():
        whole.update(m.tri)
    return NameModel(whole)


def head_comments(text: str) -> tuple[list[str], int]:
    """The comment lines before the first code of a file, and where that code begins."""
    out, inside, at = [], False, 0
    while at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        s = text[at:end].strip()
        if s and not s.startswith(("<<<<<<<", "=======", ">>>>>>>", "|||||||", "@@")):
            s = s.lstrip("+") if s.startswith("+") else s
            if not (inside or _COMMENT.match(s)):
                break
            out.append(s)
            if s.startswith("/*") and "*/" not in s:
                inside = True
            if "*/" in s:
                inside = False
                if s.rstrip().endswith("*/") is False and not s.startswith("/*"):
                    break
        at = end + 1
    return out, at


def _outermost(text: str, lang: str, at: int) -> bool:
    """Whether a line that begins at ``at`` lies in no string, comment or bracket."""
    if lang in STATES:
        before = lex(lang, text[:at])
        return before.error is not None or (before.state == CODE and not before.openers)
    if lang == "python":
        line, depth = text.count("\n", 0, at) + 1, 0
        try:
            for t in tokenize.generate_tokens(io.StringIO(text, newline="\n").readline):
                if t.end[0] >= line and t.start[0] <= line:
                    return t.type == tokenize.COMMENT and depth == 0
                if t.type == tokenize.OP:
                    depth += (t.string in "([{") - (t.string in ")]}")
        except (tokenize.TokenError, SyntaxError):
            pass  # no valid file: what stands at the margin counts
        return True
    return not any(m.start() < at < m.end() for m in _QUOTED.finditer(text))


def _says(line: str) -> str | None:
    if BY_HAND.search(line):
        return None
    if GENERATED.search(line):
        return "generated: banner"
    return "vendored: banner" if VENDORED.match(line) or PATCHED.match(line) else None


def banners(text: str, lang: str | None) -> list[str]:
    """Signs of the comments before the code, and of those that stand on their own behind it.

    Behind the first code a comment counts at the outermost level and at the
    margin, unless it leads straight into code other than imports: it then speaks
    of that code, not of the file.
    """
    head, rest = head_comments(text)
    out = [s for s in map(_says, head) if s]
    for m in _OWN_LINE.get(lang, _ANY_OWN_LINE).finditer(text, rest):
        said = next((s for s in map(_says, map(str.strip, m.group().split("\n"))) if s), None)
        if said is None or said in out:
            continue
        own = _OWN_LINE.get(lang, _ANY_OWN_LINE)
        end, last = m.end(), m
        while last:
            end = last.end()
            last = own.match(text, end + 1) if end + 1 < len(text) else None
        stop = text.find("\n", end + 1)
        following = text[end + 1 : len(text) if stop < 0 else stop]
        if following.strip() and not _OPENING.match(following):
            continue
        if lang == "python":
            code = re.compile(r"^(?![ \t\r]*(?:#|$)).", re.MULTILINE).search(text, end)
            if code and code.group() in " \t":
                continue
        if _outermost(text, lang or "", m.start()):
            out.append(said)
    return out


def path_signs(path: str | None) -> list[str]:
    if not path:
        return []
    *dirs, name = path.split("/")
    out = []
    for i, d in enumerate(dirs):
        if d.lower() in VENDOR_DIRS and i + 1 < len(dirs):
            out.append("vendored: folder")
        if d.lower() in OUTPUT_DIRS:
            out.append("generated: folder")
    if LOCK_NAME.match(name):
        out.append("lock: name")
    if BUILT_NAME.search(name):
        out.append("generated: name")
    return out


def content_signs(text: str, lang: str | None, model: NameModel | None, memory: dict) -> list[str]:
    out = banners(text, lang)
    size = len(text)
    sums = any(w in text for w in ("integrity", "checksum", "resolved"))
    if (lang in _NO_CODE and _LOCK_HEAD.search(text)) or (sums and len(_LOCK_SUM.findall(text)) >= 3):
        out.append("lock: content")
    bulk = sum(m.end() - m.start() for m in _NUMBER_ROW.finditer(text)) + sum(m.end() - m.start() for m in _LITERAL.finditer(text))
    if size >= 200 and bulk >= DATA_SHARE * size:
        out.append("data: literals")
    names = _IDENT.findall(text)
    if len(names) >= 20 and model is not None:
        distinct = Counter(names)
        bare = Counter(_DIGITS.sub("0", n) for n in distinct if _HAS_DIGIT(n))
        alike = max(bare.values(), default=0)
        if alike >= TEMPLATE_NAMES and alike >= TEMPLATE_SHARE * len(distinct):
            out.append("generated: template names")
        # Squeezed text: a mangled file has hardly any white space or very long lines.
        squeezed = text.count(" ") + text.count("\n") + text.count("\t") < 0.08 * size or size > 400 * (text.count("\n") + 1)
        styles = memory.setdefault((lang, "foreign"), {})
        judged = memory.setdefault(lang, {})
        if len(judged) + len(styles) > 400_000:
            judged.clear(), styles.clear()
        strange = 0
        for n, times in distinct.items():
            if len(n) > 4:
                odd = styles.get(n)
                if odd is None:
                    odd = styles[n] = model.foreign(style_of(n))
                if odd:
                    strange += times
        # Cross-entropies decide only where one of the two signs is still possible.
        if squeezed or strange >= FOREIGN_SHARE * 20:
            mangled = used = foreign = styled = 0
            for n, times in distinct.items():
                known = judged.get(n)
                if known is None:
                    known = judged[n] = model.bits(n) > MANGLED_BITS
                used += times
                if known:
                    mangled += times
                elif len(n) > 4:
                    styled += times
                    if styles[n]:
                        foreign += times
            if used and mangled >= MANGLED_SHARE * used and squeezed:
                out.append("minified: mangled names")
            if styled >= 20 and foreign >= FOREIGN_SHARE * styled:
                out.append("vendored: foreign style")
    return out


def _judge_batches(models: dict[str, NameModel]):
    everyone = _everyone(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory: dict = {}
        unlikely: dict[str, bool] = {}
        for pdf in batches:
            found, named = [], []
            for path, lang, text in zip(pdf["rel_path"], pdf["lang"], pdf["content"], strict=True):
                lang = "" if lang is None else lang
                signs = path_signs(path)
                if text:
                    signs += content_signs(text, lang, models.get(lang), memory)
                found.append(list(dict.fromkeys(signs)))
                words = folder_words(path) | comment_words(text)
                for w in words:
                    if w not in unlikely:
                        unlikely[w] = everyone.bits(w) >= FOREIGN_BITS
                named.append(sorted(w for w in words if unlikely[w]))
            yield pd.DataFrame({"repo": pdf["repo"], "rel_path": pdf["rel_path"], "lang": pdf["lang"], "signs": found, "named": named})

    return run


def judge_files(files: DataFrame) -> DataFrame:
    """(repo, rel_path, lang, signs) of every distinct file; no sign: hand-written.

    Two passes over the files; what is shuffled are counts and verdicts. The unlikely
    words of a file's folders and comments, a handful, meet the foreign words in a join.
    """
    counts = count_names(files)
    slim = spread(files.select("repo", "rel_path", "lang", "content"))
    key = ["repo", "rel_path", "lang"]
    judged = cut(slim.mapInPandas(_judge_batches(train(counts)), "repo string, rel_path string, lang string, signs array<string>, named array<string>"))
    named = judged.select(*key, F.explode("named").alias("word")).join(foreign_words(counts), "word", "left_semi")
    vendored = named.select(*key, F.array(F.lit("vendored: foreign name")).alias("signs"))
    every = judged.select(*key, "signs").distinct().unionByName(vendored.distinct())
    return every.groupBy(*key).agg(F.array_distinct(F.flatten(F.array_sort(F.collect_list("signs")))).alias("signs"))


def derived_files(files: DataFrame) -> DataFrame:
    return judge_files(files).where(F.size("signs") > 0)


#: Signs that come from the name models alone, without any list of words or folders.
BY_NAMES = ("minified: mangled names", "generated: template names", "vendored: foreign style", "vendored: foreign name")


def sign_counts(judged: DataFrame) -> DataFrame:
    """(sign, files, by_names): files per sign, and how many of them the name models find too."""
    rows = judged.withColumn("by_names", F.arrays_overlap("signs", F.array(*map(F.lit, BY_NAMES))))
    return rows.select(F.explode("signs").alias("sign"), "by_names").groupBy("sign").agg(F.count(F.lit(1)).alias("files"), F.count(F.when(F.col("by_names"), 1)).alias("by_names"))
