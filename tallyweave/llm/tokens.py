"""Encoding of a corpus with a public byte-level BPE tokenizer.

The text is cut into pretokens by the tokenizer's public pattern. Within each
pretoken a prefix dynamic programme stores, for every byte prefix, the last
token of its unique valid encoding: a token may follow another only when the
merges would not have joined across their border. The encoding is read back
from the end. Since the table of a prefix does not change when bytes are
appended, appending and editing re-encode only the neighbourhood of the change.

Defined results for odd input
    * null and empty text: an empty array of ids
    * strings that look like special tokens: ordinary text
    * blank, very long or unbroken texts: encoded whole
    * repeated rows: one row each; empty table: no rows
    * extra columns, whatever their names: ignored
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from tallyweave.session import spread, tokenizer_dir

#: Distinct pretokens a worker remembers; past it the memory starts afresh, which
#: costs time only.
CACHE_SIZE = 400_000

_SPACES = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_ANY = regex.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACES}\p{{L}}\p{{N}}]+|[{_SPACES}]+(?![^{_SPACES}])|[{_SPACES}]+"
)
_ASCII_SPACES = r"\t\n\x0b\x0c\r "
_ASCII = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^{_ASCII_SPACES}A-Za-z0-9]+|[{_ASCII_SPACES}]+(?![^{_ASCII_SPACES}])|[{_ASCII_SPACES}]+"
)


def pretokens(text: str) -> list[str]:
    return (_ASCII if text.isascii() else _ANY).findall(text)


def _byte_letters() -> dict[str, int]:
    """The public printable stand-ins of the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixEncoder:
    """Byte-level BPE by the table of last tokens of prefixes."""

    def __init__(self, vocabulary: str | Path) -> None:
        model = json.loads(Path(vocabulary).read_text(encoding="utf-8"))["model"]
        letters = _byte_letters()
        as_bytes = {t: bytes(letters[c] for c in t) for t in model["vocab"]}
        self.single = {b[0]: model["vocab"][t] for t, b in as_bytes.items() if len(b) == 1}
        # Work in merge order: bytes first, then one number per merge.
        self.public: list[int] = [self.single[b] for b in range(256)]
        number: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            a, b = number[as_bytes[left]], number[as_bytes[right]]
            whole = as_bytes[left] + as_bytes[right]
            if whole in number:
                continue
            number[whole] = len(self.public)
            self.joined[a, b] = number[whole]
            self.halves.append((a, b))
            self.public.append(model["vocab"][left + right])
        self.number = number
        self.longest = max(map(len, number))
        self._pairs: dict[tuple[int, int], bool] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether merging left and right side by side keeps their border."""
        known = self._pairs.get((left, right))
        if known is None:
            if len(self._pairs) >= CACHE_SIZE:
                self._pairs.clear()
            known = self._pairs[left, right] = self._keeps_border(left, right)
        return known

    def _keeps_border(self, left: int, right: int) -> bool:
        # Undo the later of the two merges step by step; the border is crossed if
        # the tokens that touch it could have merged before that later merge.
        before = len(self.public)
        while True:
            merged = self.joined.get((left, right))
            if merged is not None and merged < before:
                return False
            if left > right:
                before, left = left, self.halves[left][1]
                if left == before:
                    before, right = right + 1, self.halves[right][0]
                    if right + 1 == before:
                        return True
            else:
                before, right = right + 1, self.halves[right][0]
                if right + 1 == before:
                    before, left = left, self.halves[left][1]
                    if left == before:
                        return True

    def extend(self, data: bytes, last: list[int]) -> None:
        """Extend the table ``last`` of data's prefixes up to the whole of data."""
        number, longest = self.number, self.longest
        for end in range(len(last) + 1, len(data) + 1):
            for size in range(min(end, longest), 0, -1):
                token = number.get(data[end - size : end])
                if token is None:
                    continue
                if size == end or self.may_follow(last[end - size - 1], token):
                    last.append(token)
                    break

    def read(self, data: bytes, last: list[int]) -> list[int]:
        """Public ids of the encoding that the table stands for."""
        out, at = [], len(data)
        while at:
            token = last[at - 1]
            out.append(self.public[token])
            at -= self._size(token)
        return out[::-1]

    def _size(self, token: int) -> int:
        if not hasattr(self, "_sizes"):
            self._sizes = [0] * len(self.public)
            for b, t in self.number.items():
                self._sizes[t] = len(b)
        return self._sizes[token]

    def piece(self, pretoken: str) -> tuple[int, ...]:
        data = pretoken.encode("utf-8", "surrogatepass")
        last: list[int] = []
        self.extend(data, last)
        return tuple(self.read(data, last))


class Remembered(dict):
    """Pretoken -> ids, filled on demand."""

    def __init__(self, encoder: PrefixEncoder, most: int = CACHE_SIZE) -> None:
        super().__init__()
        self.encoder, self.most = encoder, most

    def __missing__(self, pretoken: str) -> tuple[int, ...]:
        ids = self.encoder.piece(pretoken)
        if len(pretoken) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[pretoken] = ids
        return ids


class EncodedText:
    """An encoded text that can be appended to and edited."""

    def __init__(self, memory: Remembered, text: str = "") -> None:
        self.memory, self.text = memory, text
        self.pieces = pretokens(text)
        self.redone = len(self.pieces)

    @property
    def ids(self) -> list[int]:
        return list(chain.from_iterable(map(self.memory.__getitem__, self.pieces)))

    def append(self, more: str) -> None:
        self.edit(len(self.text), len(self.text), more)

    def edit(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]; pretokens away from the change are kept.

        A pretoken depends on its own characters and on one character after it,
        so all that end two characters before the change stay; behind the change
        the old cuts are taken over from the first one that both texts share.
        """
        keep, at = 0, 0
        while keep < len(self.pieces) and at + len(self.pieces[keep]) + 2 <= start:
            at += len(self.pieces[keep])
            keep += 1
        # One white-space run may reach back over its own cut.
        while keep and self.pieces[keep - 1].isspace():
            keep -= 1
            at -= len(self.pieces[keep])
        old_cuts, pos = {}, at
        for i in range(keep, len(self.pieces)):
            old_cuts[pos] = i
            pos += len(self.pieces[i])
        text = self.text[:start] + new + self.text[end:]
        shift = len(new) - (end - start)
        pattern = _ASCII if text.isascii() else _ANY
        fresh, tail = [], []
        for m in pattern.finditer(text, at):
            i = old_cuts.get(m.start() - shift) if m.start() > start + len(new) else None
            if i is not None and not text[m.start() - 1].isspace():
                tail = self.pieces[i:]
                break
            fresh.append(m.group())
        self.redone = len(fresh)
        self.text, self.pieces = text, [*self.pieces[:keep], *fresh, *tail]


_MEMORY: dict[str, Remembered] = {}


def memory_for(vocabulary: str) -> Remembered:
    """One encoder per worker process and vocabulary file."""
    if vocabulary not in _MEMORY:
        _MEMORY[vocabulary] = Remembered(PrefixEncoder(vocabulary))
    return _MEMORY[vocabulary]


def _encode_batches(vocabulary: str, id_column: str, text_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = memory_for(vocabulary)
        for batch in batches:
            ids, ends = array("i"), array("i", [0])
            for text in batch.column(text_column).to_pylist():
                if text:
                    ids.extend(chain.from_iterable(map(memory.__getitem__, pretokens(text))))
                ends.append(len(ids))
            lists = pa.ListArray.from_arrays(
                pa.array(np.frombuffer(ends, dtype=np.int32)), pa.array(np.frombuffer(ids, dtype=np.int32) if ids else [], pa.int32())
            )
            yield pa.RecordBatch.from_arrays([batch.column(id_column), lists], [id_column, "ids"])

    return run


def encode(df: DataFrame, vocabulary: str | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(id, ids) of every row: a map over the scan, without a shuffle.

    ``vocabulary`` is the tokenizer file every executor reads; it is not shipped
    with the job.
    """
    vocabulary = vocabulary or f"{tokenizer_dir()}/byte_bpe_50k.json"
    slim = spread(df.select(id_column, text_column))
    kind = slim.schema[id_column].dataType.simpleString()
    return slim.mapInArrow(_encode_batches(vocabulary, id_column, text_column), f"{id_column} {kind}, ids array<int>")
