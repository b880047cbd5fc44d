"""Cutting oversized texts at natural boundaries.

A text longer than ``limit`` code points is cut into pieces of at most ``limit``
code points, each beginning with the last ``overlap`` code points of the one
before. Dynamic programming over boundary positions minimises the sum of the
cut penalties, the imbalance of the piece sizes and a price per piece, subject
to the length limit and the overlap.

Boundaries, from cheap to dear: blank line, line end before an unindented line,
line end, sentence end, white space, symbol, any code point. Dearer kinds are
offered only inside stretches that have no cheaper boundary for a quarter of a
piece, so the number of positions stays in proportion to the text and a cut in
the middle of a word is made only where nothing else is within reach. Line ends
of ``\\r\\n`` and base characters with their combining marks are not split.

Defined results for odd input
    * null, empty and short texts (up to ``limit``): no pieces
    * very long texts: linear time in their length; no prefix, no cap
    * null start_line: null line numbers
    * exact duplicate rows: one set of pieces
    * extra columns, whatever their names: ignored
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 900, 100
#: Penalties of the kinds of boundary, against an imbalance of 0 to 1 per piece.
BLANK, OUTER, LINE, SENTENCE, SPACE, SYMBOL, ANY = 0.0, 0.15, 0.4, 0.9, 2.0, 4.0, 9.0
PIECE_PRICE = 1.0

_EOL = re.compile(r"\r\n|\n|\r")
_SENTENCE = re.compile(r"[.!?\u2026;][\"'\u201d\u2019\u00bb)\]]*\s+|[\u3002\uff01\uff1f]")
_SPACE = re.compile(r"\s+")
_SYMBOL = re.compile(r"[,;:)\]}>|/+=&-]+")


def _line_bounds(text: str) -> dict[int, float]:
    found: dict[int, float] = {}
    size = len(text)
    for m in _EOL.finditer(text):
        at = m.end()
        if at >= size:
            continue
        after = text[at]
        if after in "\r\n" or (m.start() and text[m.start() - 1] in "\r\n"):
            found[at] = BLANK if after not in "\r\n" else OUTER
        else:
            found[at] = LINE if after in " \t})]" else OUTER
    return found


def _fill(text: str, at: list[int], found: dict[int, float], pattern: re.Pattern, price: float, gap: int) -> None:
    """Add the boundaries of a dearer kind inside stretches longer than ``gap``."""
    for a, b in zip(at, at[1:], strict=False):
        if b - a > gap:
            for m in pattern.finditer(text, a, b):
                if a < m.end() < b:
                    found.setdefault(m.end(), price)


def _safe(text: str, at: int) -> bool:
    c = text[at]
    if unicodedata.combining(c) or c in "\u200d\ufe0f" or text[at - 1] == "\u200d" or "\U0001f3fb" <= c <= "\U0001f3ff":
        return False
    return not (c == "\n" and text[at - 1] == "\r")


def boundaries(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> dict[int, float]:
    """Cut positions with their penalties, without the two ends of the text."""
    gap = max(1, (limit - overlap) // 4)
    found = _line_bounds(text)
    for pattern, price in ((_SENTENCE, SENTENCE), (_SPACE, SPACE), (_SYMBOL, SYMBOL)):
        _fill(text, [0, *sorted(found), len(text)], found, pattern, price, gap)
    at = [0, *sorted(found), len(text)]
    for a, b in zip(at, at[1:], strict=False):
        if b - a > gap:
            step = max(1, gap // 8)
            for p in range(a + step, b, step):
                q = p
                while q > a + 1 and not _safe(text, q):
                    q -= 1
                if q not in found and (_safe(text, q) or q == a + 1):
                    found[q] = ANY
    return found


def cut_points(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Ends of the pieces, in order; the last is the length of the text."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    size = len(text)
    if size <= limit:
        return [size]
    found = boundaries(text, limit, overlap)
    ends = [*sorted(p for p in found if overlap < p < size), size]
    best, back = [float("inf")] * len(ends), [-1] * len(ends)
    least, fair = limit - overlap, 0.7 * limit
    lo = 0
    for j, e in enumerate(ends):
        price = found.get(e, 0.0) + PIECE_PRICE
        if e <= limit:
            best[j] = price + ((e - fair) / limit) ** 2
        while ends[lo] < e - least:
            lo += 1
        for i in range(lo, j):
            if best[i] < best[j]:
                cost = best[i] + price + ((e - ends[i] + overlap - fair) / limit) ** 2
                if cost < best[j]:
                    best[j], back[j] = cost, i
    if best[-1] == float("inf"):  # no boundary within reach somewhere: cut by length
        return [*range(limit, size, least), size]
    out, j = [], len(ends) - 1
    while j >= 0:
        out.append(ends[j])
        j = back[j]
    return out[::-1]


def split_text(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """(start, end) of the pieces of a text; one piece when it is short enough."""
    ends = cut_points(text, limit, overlap)
    return list(zip([0, *[e - overlap for e in ends[:-1]]], ends, strict=True))


_KEEP = "repo string, id string, path string, symbol string, node_type string, indexed_at timestamp"
PIECES = f"{_KEEP}, piece_no int, n_pieces int, start_line int, end_line int, start_char int, end_char int, text string"


def _split_batches(limit: int, overlap: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for repo, id_, path, symbol, node_type, indexed_at, start_line, text in pdf.itertuples(index=False, name=None):
                spans = split_text(text, limit, overlap)
                eols = [m.end() for m in _EOL.finditer(text)]
                first = None if pd.isna(start_line) else int(start_line)
                a = b = 0
                for n, (s, e) in enumerate(spans):
                    while a < len(eols) and eols[a] <= s:
                        a += 1
                    b = max(a, b)
                    while b < len(eols) and eols[b] < e:
                        b += 1
                    lines = (None, None) if first is None else (first + a, first + b)
                    out.append((repo, id_, path, symbol, node_type, indexed_at, n, len(spans), *lines, s, e, text[s:e]))
            names = [c.split()[0] for c in PIECES.split(", ")]
            pdf = pd.DataFrame(out, columns=names)
            yield pdf.astype({"start_line": "Int32", "end_line": "Int32"})

    return run


def split_oversized(chunks: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Ordered pieces of every row whose text is longer than ``limit``.

    Only oversized rows leave the scan; exact duplicates are removed among them,
    then each text is cut on its own, so the work splits by rows and no key can
    be hot.
    """
    keep = [c.split()[0] for c in _KEEP.split(", ")]
    big = chunks.where(F.length("text") > limit).select(*keep, "start_line", "text")
    return big.dropDuplicates().mapInPandas(_split_batches(limit, overlap), PIECES)


def rejoined(pieces: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(repo, id, digest, short, overlapped): what the pieces of a chunk give when put together
    again, whether all keep the limit and whether each begins with the end of the one before."""
    key = ["repo", "id", "path", "symbol", "node_type", "indexed_at"]
    rows = pieces.groupBy(*key).agg(F.array_sort(F.collect_set(F.struct("piece_no", "text"))).alias("p"))
    texts = F.transform("p", lambda x: x["text"])
    whole = F.concat(texts[0], F.array_join(F.transform(F.slice("p", 2, F.size("p")), lambda x: F.substr(x["text"], F.lit(overlap + 1))), ""))
    linked = F.forall(F.sequence(F.lit(0), F.size("p") - 2), lambda i: F.substr(F.col("p")[i]["text"], F.length(F.col("p")[i]["text"]) - overlap + 1) == F.substring(F.col("p")[i + 1]["text"], 1, overlap))
    return rows.select("repo", "id", F.md5(F.encode(whole, "UTF-8")).alias("digest"), F.forall(texts, lambda t: F.length(t) <= limit).alias("short"), linked.alias("overlapped")).distinct()
