"""Evaluation texts that leak into training text, changed or not.

Words are compared without case, punctuation, white space, line prefixes,
markup and escapes. Every window of WINDOW words of an item, and of a document,
is embedded by the CGK random walk: at each step the walk writes the word it
stands on and moves on or stays as a shared random bit of (step, word) says, so
strings at a small edit distance are written with a small Hamming distance.
Repeated bit-sampling LSH takes a few of the written positions as the key of a
table; windows that share a key in any table are candidates. Candidates are then
verified exactly: a place holds a passage when at least ``least`` words of the
item stand there in order with at most one edit (a word replaced, dropped or
added) per EDIT_EVERY words.

Windows that cannot lie in such a passage because too few of their words occur
in any item are not embedded; this loses nothing, as at most one word in
EDIT_EVERY may be foreign.

Defined results for odd input
    * null, empty and short texts: no pairs; items of fewer than ``least`` words: none
    * exact copies of documents or items: a pair each
    * repeated rows: one pair; empty tables: no rows
    * very long texts: every window of the whole text
    * extra columns, whatever their names: ignored
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.session import spread

LEAST, EDIT_EVERY = 25, 8
WINDOW, STEPS = 12, 24
#: Tables: walks, samplings per walk, positions per sampling. At a window with one
#: edit two in three samplings still agree; a passage has a dozen windows or more.
WALKS, SAMPLINGS, SAMPLED = 4, 3, 5
#: Items whose index is held by a worker at a time; a larger evaluation set is
#: searched in blocks of this size.
BLOCK_ITEMS = 20_000
_SLICE = 200_000

_ESCAPE = re.compile(r"\\(?:u([0-9a-fA-F]{4})|x([0-9a-fA-F]{2})|[nrtfv])")
_TAG = re.compile(r"</?[A-Za-z!][^<>\n]*>")
_LINK = re.compile(r"\]\([^()\s]*\)")
_PREFIX = re.compile(r"^[ \t]*(?:(?:>|//+|#+|\*|-|\+|\||;|%|--|!)[ \t]*)+|^[ \t]*\d{1,6}[:.)|][ \t]+", re.MULTILINE)
_WORD = re.compile(r"[^\W_]+")
_INVISIBLE = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")


def words_of(text: str) -> list[str]:
    if "\\" in text:
        text = _ESCAPE.sub(lambda m: chr(int(m.group(1) or m.group(2), 16)) if m.group(1) or m.group(2) else " ", text)
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub("] ", text)
    text = _PREFIX.sub(" ", text)
    if not text.isascii():
        text = unicodedata.normalize("NFKC", _INVISIBLE.sub("", text))
    return _WORD.findall(text.lower())


class Index:
    """The windows of a block of items under every table of the LSH."""

    def __init__(self, items: Sequence[tuple[int, str]], least: int = LEAST, seed: int = 11) -> None:
        self.least = least
        rng = np.random.default_rng(seed)
        texts = [(i, words_of(t)) for i, t in items if t]
        texts = [(i, w) for i, w in texts if len(w) >= least]
        self.items = [i for i, _ in texts]
        self.number: dict[str, int] = {}
        for _, w in texts:
            for x in w:
                self.number.setdefault(x, len(self.number) + 1)
        self.codes = [np.array([self.number[x] for x in w], dtype=np.int32) for _, w in texts]
        size = len(self.number) + 2
        self.moves = rng.integers(0, 2, (WALKS, STEPS, size), dtype=np.int8)
        self.samples = [[np.sort(rng.choice(STEPS, SAMPLED, replace=False)) for _ in range(SAMPLINGS)] for _ in range(WALKS)]
        self.factor = np.uint64(0x9E3779B97F4A7C15)
        # Equal windows of several items are one string of the index.
        starts = [np.arange(len(c) - WINDOW + 1) for c in self.codes]
        self.place_item = np.repeat(np.arange(len(self.codes)), [len(s) for s in starts]) if starts else np.zeros(0, int)
        self.place_at = np.concatenate(starts) if starts else np.zeros(0, int)
        if len(self.place_at):
            all_windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(c, WINDOW) for c in self.codes])
            strings, which = np.unique(all_windows, axis=0, return_inverse=True)
            which = which.ravel()
        else:
            strings, which = np.zeros((0, WINDOW), np.int32), np.zeros(0, int)
        order = np.argsort(which, kind="stable")
        self.place_item, self.place_at = self.place_item[order], self.place_at[order]
        self.first = np.searchsorted(which[order], np.arange(len(strings) + 1))
        self.strings = strings.astype(np.int32)
        flat = self.strings.ravel()
        keys = self.keys(flat, np.arange(len(strings)) * WINDOW)
        self.tables = []
        for k in keys:
            by = np.argsort(k, kind="stable")
            distinct, first = np.unique(k[by], return_index=True)
            self.tables.append((distinct, np.append(first, len(k)), by))
        # Padded item codes for the check of places.
        self.longest = max((len(c) for c in self.codes), default=0)
        self.padded = np.full((len(self.codes), self.longest + 2 * _MARGIN), -7, dtype=np.int32)
        for r, c in enumerate(self.codes):
            self.padded[r, _MARGIN : _MARGIN + len(c)] = c

    def keys(self, x: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
        """Keys of the windows that begin at ``starts``, one array per table."""
        out = []
        pad = self.moves.shape[2] - 1
        for w in range(WALKS):
            at = np.zeros(len(starts), dtype=np.int64)
            wanted = set(np.concatenate(self.samples[w]).tolist())
            written = {}
            for j in range(max(wanted) + 1):
                inside = at < WINDOW
                now = np.where(inside, x[starts + np.minimum(at, WINDOW - 1)], pad)
                if j in wanted:
                    written[j] = now.astype(np.uint64)
                at += self.moves[w, j][now] & inside
            for positions in self.samples[w]:
                k = np.full(len(starts), len(out) + 1, dtype=np.uint64)
                for p in positions:
                    k = (k ^ written[int(p)]) * self.factor
                    k ^= k >> np.uint64(29)
                out.append(k)
        return out

    def candidates(self, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, string) pairs that share a key in some table."""
        found = []
        for k, (table, first, string) in zip(self.keys(x, starts), self.tables, strict=True):
            at = np.minimum(np.searchsorted(table, k), max(0, len(table) - 1))
            hit = np.nonzero(table[at] == k)[0] if len(table) else []
            if len(hit):
                lo = first[at[hit]]
                n = first[at[hit] + 1] - lo
                rep = np.repeat(hit, n)
                step = np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
                found.append(starts[rep] * np.int64(len(self.first)) + string[np.repeat(lo, n) + step])
        if not found:
            return np.zeros(0, int), np.zeros(0, int)
        both = np.sort(np.concatenate(found))
        both = both[np.append(True, both[1:] != both[:-1])]
        p, string = both // len(self.first), both % len(self.first)
        # At most as many words of the window differ as a passage may have edits.
        near = np.zeros(len(p), dtype=bool)
        columns = np.arange(WINDOW)
        for s in range(0, len(p), 100_000):
            word, ours = x[p[s : s + 100_000, None] + columns], self.strings[string[s : s + 100_000]]
            same = word == ours
            for shift in (1, 2):
                same[:, shift:] |= word[:, shift:] == ours[:, :-shift]
                same[:, :-shift] |= word[:, :-shift] == ours[:, shift:]
            near[s : s + 100_000] = same.sum(axis=1) >= WINDOW - self.least // EDIT_EVERY
        return p[near], string[near]


_MARGIN = 40
_SHIFTS = 3
#: Words of a block and bits of a band of diagonals that are looked at together first.
_LOOK, _BAND = 12, 2


def passage(item: np.ndarray, text: np.ndarray, near: int, least: int = LEAST) -> tuple[int, int, int, int] | None:
    """(item start, item end, text start, edits) of a passage; null if there is none.

    Furthest-reaching edit distance from every place where a run of equal words
    begins, those nearest to the diagonal ``near`` (text position minus item
    position) first.
    """
    places: dict[int, list[int]] = {}
    for j, c in enumerate(text.tolist()):
        places.setdefault(c, []).append(j)
    a, b = item.tolist(), text.tolist()
    begins = [
        (abs(j - i - near), i, j)
        for i, c in enumerate(a)
        for j in places.get(c, ())
        if not (i and j and a[i - 1] == b[j - 1]) and len(a) - i >= least
    ]
    n, m = len(a), len(b)
    for _, i0, j0 in sorted(begins):
        reach: dict[int, int] = {}
        edits = 0
        while True:
            new: dict[int, int] = {}
            if edits == 0:
                options = {j0 - i0: i0}
            else:
                options = {}
                for d, i in reach.items():
                    for d2, i2 in ((d, i + 1), (d + 1, i), (d - 1, i + 1)):
                        if i2 <= n and i2 + d2 <= m and options.get(d2, -1) < i2:
                            options[d2] = i2
            best = 0
            for d, i in options.items():
                while i < n and i + d < m and a[i] == b[i + d]:
                    i += 1
                new[d] = i
                best = max(best, i)
            length = best - i0
            if length >= least and edits * EDIT_EVERY <= length:
                return i0, best, j0, edits
            edits += 1
            if not new or edits * EDIT_EVERY > n - i0:
                break
            # Reaches that are behind what their edits allow can still recover, but not
            # when even an unbroken rest would leave too many edits.
            reach = {d: i for d, i in new.items() if edits * EDIT_EVERY <= min(n, i + m) - i0}
            if length < max(0, (edits - 4) * 4):
                break
    return None


def search(index: Index, texts: Sequence[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text number, item number, item start, item end, edits) of leaking texts."""
    get = index.number.get
    parts, lengths = [], []
    for t in texts:
        w = [get(x, 0) for x in words_of(t)] if t else []
        parts.append(np.array(w, dtype=np.int32))
        lengths.append(len(w))
    if not index.items or not parts:
        return []
    x = np.concatenate(parts)
    ends = np.cumsum(lengths)
    begins = ends - lengths
    if len(x) < WINDOW:
        return []
    of = np.repeat(np.arange(len(parts)), lengths)
    # Places where a passage can lie: 22 words of 25 are the item's, in any 22 in a row 19.
    edits = index.least // EDIT_EVERY
    narrow, enough = index.least - edits, index.least - 2 * edits
    if len(x) < narrow:
        return []
    known = np.concatenate([[0], np.cumsum(x > 0)])
    dense = np.zeros(len(x), dtype=bool)
    dense[: len(x) - narrow + 1] = (known[narrow:] - known[:-narrow] >= enough) & (of[: len(x) - narrow + 1] == of[narrow - 1 :])
    cover = np.zeros(len(x) + 1, dtype=np.int32)
    at = np.nonzero(dense)[0]
    np.add.at(cover, at, 1)
    np.add.at(cover, at + narrow - WINDOW + 1, -1)
    starts = np.nonzero(np.cumsum(cover[:-1]) > 0)[0]
    blocks = -(-np.array(lengths) // _LOOK)
    first_block = np.cumsum(blocks) - blocks
    block_start = np.repeat(begins - first_block * _LOOK, blocks) + np.arange(blocks.sum()) * _LOOK
    out: dict[tuple[int, int], tuple[int, int, int]] = {}
    for s in range(0, len(starts), _SLICE):
        p, string = index.candidates(x, starts[s : s + _SLICE])
        if not len(p):
            continue
        n = index.first[string + 1] - index.first[string]
        rep = np.repeat(np.arange(len(p)), n)
        place = np.repeat(index.first[string], n) + np.arange(len(rep)) - np.repeat(np.cumsum(n) - n, n)
        item, q, p = index.place_item[place], index.place_at[place], p[rep]
        # One look per text, item, block of words and band of diagonals, wide enough
        # for all of its candidates.
        block = first_block[of[p]] + (p - begins[of[p]]) // _LOOK
        band = ((p - q) >> _BAND) - (block_start[block] >> _BAND) + (index.longest >> _BAND) + 2
        key = (block * np.int64((index.longest + _LOOK >> _BAND) + 5) + band) * np.int64(len(index.codes)) + item
        _, once = np.unique(key, return_index=True)
        item, q, p = item[once], q[once], p[once]
        keep = _plausible(index, x, of, item, q, p, _LOOK - 1, (1 << _BAND) - 1)
        item, q, p = item[keep], q[keep], p[keep]
        # The exact check reads the whole item, so one survivor per text, item and band of diagonals will do.
        band = np.stack([of[p], item, (p - q) >> _BAND])
        _, once = np.unique(band, axis=1, return_index=True)
        for i, qq, pp in zip(item[once].tolist(), q[once].tolist(), p[once].tolist(), strict=True):
            t = int(of[pp])
            if (t, i) in out:
                continue
            lo = max(int(begins[t]), pp - qq - _MARGIN)
            hi = min(int(ends[t]), pp - qq + len(index.codes[i]) + _MARGIN)
            found = passage(index.codes[i], x[lo:hi], pp - qq - lo, index.least)
            if found:
                out[t, i] = (found[0], found[1], found[3])
    return [(t, i, *v) for (t, i), v in out.items()]


def _plausible(index: Index, x: np.ndarray, of: np.ndarray, item: np.ndarray, q: np.ndarray, p: np.ndarray, words: int = 0, diagonals: int = 0) -> np.ndarray:
    """Candidates around which enough words agree on the diagonal or those beside it.

    With ``words`` and ``diagonals`` it holds for a candidate when it holds for any
    other one that is at most so many away.
    """
    edits = index.least // EDIT_EVERY
    span = index.least + edits
    around = np.arange(-span - words, WINDOW + span + words)
    keep = np.zeros(len(p), dtype=bool)
    for s in range(0, len(p), 50_000):
        at = p[s : s + 50_000, None] + around
        ok = (at >= 0) & (at < len(x))
        at = np.clip(at, 0, len(x) - 1)
        word = np.where(ok & (of[at] == of[p[s : s + 50_000]][:, None]), x[at], 0)
        row = item[s : s + 50_000, None]
        same = np.zeros(word.shape, dtype=bool)
        for shift in range(-_SHIFTS - diagonals, _SHIFTS + diagonals + 1):
            column = np.clip(q[s : s + 50_000, None] + around + shift + _MARGIN, 0, index.padded.shape[1] - 1)
            same |= index.padded[row, column] == word
        total = np.concatenate([np.zeros((len(same), 1), int), np.cumsum(same & (word > 0), axis=1)], axis=1)
        keep[s : s + 50_000] = (total[:, span:] - total[:, :-span]).max(axis=1) >= index.least - edits - 1
    return keep


_FOUND = "doc_id bigint, item_id bigint, item_from int, item_to int, edits int"


def _search_batches(index: Index):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids = pdf["doc_id"].to_numpy()
            rows = [(ids[t], index.items[i], a, b, e) for t, i, a, b, e in search(index, pdf["text"].tolist())]
            yield pd.DataFrame(rows, columns=["doc_id", "item_id", "item_from", "item_to", "edits"])

    return run


def leaks(documents: DataFrame, items: DataFrame, least: int = LEAST, block: int = BLOCK_ITEMS) -> DataFrame:
    """(doc_id, item_id, item_from, item_to, edits): the leaking pairs with one passage.

    The items, in blocks of at most about ``block``, go to every worker; the
    documents stay where they are read. Nothing of the documents is shuffled but
    the found pairs.
    """
    held = items.where(F.col("text").isNotNull()).select("item_id", "text").distinct()
    blocks = -(-held.count() // block)
    found = None
    slim = spread(documents.select("doc_id", "text").where(F.col("text").isNotNull()))
    for b in range(max(1, blocks)):
        part = held if blocks <= 1 else held.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b)
        index = Index([(r.item_id, r.text) for r in part.sort("item_id").collect()], least)
        rows = slim.mapInPandas(_search_batches(index), _FOUND)
        found = rows if found is None else found.unionByName(rows)
    return found.groupBy("doc_id", "item_id").agg(
        F.min_by(F.struct("item_from", "item_to", "edits"), F.struct("edits", "item_from", "item_to")).alias("x")
    ).select("doc_id", "item_id", "x.*")


def leaked_items(found: DataFrame) -> DataFrame:
    """Which items leaked, and into how many documents."""
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.min("doc_id").alias("first_doc_id"))
