"""Source files that are not valid in their language.

A file of a brace language, whatever its size, is cut into parts at line ends.
Every part becomes a lexer-state map with a bracket summary; the maps reduce
associatively, within a row (``judge_files``) or across partitions
(``reduce_parts``). A file whose reduction closes every bracket, string and comment
is then judged statement by statement with the local grammar of its language, the
tokens of each part being read from the state that the reduction gives it.
Python, JSON, TOML and YAML have an exact parser at hand, which takes the place
of the local grammar.

Defined results for odd input
    * null content: not judged, counted as unreadable in the report
    * empty content: valid, but for JSON (no value) and Go (no package clause)
    * null or unknown lang, markdown: never flagged
    * byte order mark at the start: ignored
    * exact duplicate rows: one file; empty table: no rows
    * very long files: cut into more parts; size changes no verdict
    * nesting deeper than a parser at hand goes: JSON and YAML are checked without
      recursion, TOML from the inside outwards, Python by its tokens and brackets
    * extra columns, whatever their names: ignored
"""

from __future__ import annotations

import io
import json
import re
import sys
import tokenize
import tomllib
import warnings
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.llm.grammar import check
from tallyweave.llm.lexing import CODE, COMMENT, START, STATES, Summary, combine, finish, lex, summarise
from tallyweave.session import spread

try:
    import yaml

    _YAML_LOADER = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
except ImportError:  # judged by brackets and indentation only
    yaml = None

PART_CHARS = 1 << 13


def parts_of(text: str, size: int = PART_CHARS) -> list[str]:
    """Cut after line ends, at least ``size`` characters apart."""
    out, start = [], 0
    while len(text) - start > size:
        end = text.find("\n", start + size)
        if end < 0:
            break
        out.append(text[start : end + 1])
        start = end + 1
    return [*out, text[start:]]


def open_ends(summary: Summary) -> str | None:
    """What a reduced summary leaves open when the file begins as plain code."""
    (state, _), closers, openers, error = finish(summary)
    if error:
        return error
    if state != CODE:
        return f"ends inside a {state}"
    if closers:
        return f"unmatched {closers[0]}"
    return f"{openers[-1]} never closed" if openers else None


def brace_fault(lang: str, text: str, size: int = PART_CHARS) -> str | None:
    """The verdict on a text of a brace language through the reduction of its parts."""
    parts = parts_of(text, size)
    read: list[dict] = [{} for _ in parts]
    found = open_ends(reduce(combine, [summarise(lang, p, i == 0, r) for i, (p, r) in enumerate(zip(parts, read, strict=True))]))
    if found:
        return found
    tokens, state, stack, newline = [], START, [], True
    for part, runs in zip(parts, read, strict=True):
        x = runs.get(state)
        if x is None or x.fork is not None or state[0] not in (CODE, COMMENT):
            x = lex(lang, part, state, stack, newline)
        else:
            del stack[len(stack) - len(x.closers) :]
            stack.extend(x.openers)
        tokens += x.tokens
        state, newline = (x.state, x.argument), x.newline
    return check(lang, tokens)


def _no_constant(name: str):
    raise ValueError(f"{name} is no JSON value")


_JSON = re.compile(r'[ \t\r\n]*(?:(?P<open>[\[{])|(?P<close>[\]}])|(?P<sep>[,:])|(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<other>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])|(?:true|false|null)\b)|(?P<end>\Z))')


def _deep_json(text: str) -> None:
    """A check without recursion, for nesting that the parser at hand does not follow."""
    stack, wants, pos = [], "value", 0  # what may stand next: value, first (value or end), key, key1, colon, more
    while True:
        m = _JSON.match(text, pos)
        if m is None:
            raise ValueError(f"no JSON at {pos}")
        kind, pos = m.lastgroup, m.end()
        if kind == "end":
            if stack or wants != "more":
                raise ValueError("ends inside a value")
            return
        c = m.group(kind)
        if kind == "open" and wants in ("value", "first"):
            stack.append(c)
            wants = "first" if c == "[" else "key1"
        elif kind == "close" and stack and stack[-1] + c in ("[]", "{}") and wants in ("more", "first" if c == "]" else "key1"):
            stack.pop()
            wants = "more"
        elif kind == "str" and wants in ("key", "key1"):
            wants = "colon"
        elif kind in ("str", "other") and wants in ("value", "first"):
            wants = "more"
        elif c == ":" and wants == "colon":
            wants = "value"
        elif c == "," and wants == "more" and stack:
            wants = "value" if stack[-1] == "[" else "key"
        else:
            raise ValueError(f"{c[:20]} out of place")


def _json(text: str) -> None:
    try:
        # Numbers stay strings: their size is no matter of syntax.
        json.loads(text, parse_constant=_no_constant, parse_int=str, parse_float=str)
    except RecursionError:
        _deep_json(text)


def _python(text: str) -> None:
    digits = sys.get_int_max_str_digits()
    sys.set_int_max_str_digits(0)
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            compile(text, "file", "exec", dont_inherit=True)
    except (RecursionError, MemoryError):  # too deep for the compiler, which says nothing about the syntax
        try:
            for _ in tokenize.generate_tokens(io.StringIO(text).readline):
                pass
        except tokenize.TokenError as e:
            raise SyntaxError(str(e)) from None
    finally:
        sys.set_int_max_str_digits(digits)


#: A string, a comment, or one of the characters that nest values or begin and end them.
_TOML = re.compile(r'"""(?:[^\\]|\\.)*?"{3,5}|\'\'\'.*?\'{3,5}|"(?:[^"\\\n]|\\.)*"|\'[^\'\n]*\'|#[^\n]*|(?P<mark>[\[\]{}=\n"\'])', re.S)
#: Values nested so deep are parsed by themselves and stand as empty ones in what holds them.
_TOML_DEPTH = 50


def _deep_toml(text: str) -> None:
    """A check without deep recursion: nested values are parsed from the inside outwards."""
    stack: list[tuple[str, list[str]]] = [("", [])]
    heights, pos, value = [0], 0, False  # value: behind the equals sign of a statement
    for m in _TOML.finditer(text):
        c = m["mark"]
        if c in ('"', "'"):
            raise ValueError("a string is never closed")
        if c == "=":
            value = True
        elif c == "\n" and len(stack) == 1:
            value = False
        elif value and c and c in "[{":
            stack[-1][1].append(text[pos : m.start()])
            stack.append((c, []))
            heights.append(0)
            pos = m.start()
        elif len(stack) > 1 and c and c in "]}":
            opener, pieces = stack.pop()
            if opener + c not in ("[]", "{}"):
                raise ValueError(f"{opener} is closed by {c}")
            whole, height = "".join([*pieces, text[pos : m.end()]]), heights.pop() + 1
            if height >= _TOML_DEPTH:
                tomllib.loads("x = " + whole)
                whole, height = opener + c, 1
            stack[-1][1].append(whole)
            heights[-1] = max(heights[-1], height)
            pos = m.end()
    if len(stack) > 1:
        raise ValueError(f"{stack[-1][0]} never closed")
    tomllib.loads("".join([*stack[0][1], text[pos:]]))


def _toml(text: str) -> None:
    text = text.replace("\r\n", "\n")
    try:
        tomllib.loads(text)
    except RecursionError:
        _deep_toml(text)


def _yaml(text: str) -> None:
    if yaml is not None:
        try:
            for _ in yaml.compose_all(text, Loader=_YAML_LOADER):
                pass
        except RecursionError:
            for _ in yaml.parse(text, Loader=yaml.SafeLoader):
                pass
        return
    for line in text.splitlines():
        if line.lstrip(" ").startswith("\t") and line.strip():
            raise ValueError("tab in the indentation")
        if line.startswith(("<<<<<<<", ">>>>>>>", "=======", "@@")):
            raise ValueError("conflict marker")


_EXACT = {
    "python": _python,
    "json": _json,
    "toml": _toml,
    "yaml": _yaml,
}


def fault(lang: str | None, text: str | None) -> str | None:
    """Why a text is not valid in a language; null if it is or is not judged."""
    if text is None or lang is None:
        return None
    if text.startswith("﻿"):
        text = text[1:]
    if lang in STATES:
        return brace_fault(lang, text)
    if lang in _EXACT:
        try:
            _EXACT[lang](text)
        except (SyntaxError, ValueError) as e:
            return str(e)[:200] or type(e).__name__
        except Exception as e:  # the parsers' own error classes
            if yaml is not None and isinstance(e, yaml.YAMLError):
                return str(e)[:200].replace("\n", " ")
            raise
    return None


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        yield pd.DataFrame(
            {
                "repo": pdf["repo"],
                "rel_path": pdf["rel_path"],
                "lang": pdf["lang"],
                "unreadable": pdf["content"].isna(),
                "fault": [fault(g, t) for g, t in zip(pdf["lang"], pdf["content"], strict=True)],
            }
        )


def judge_files(files: DataFrame) -> DataFrame:
    """(repo, rel_path, lang, unreadable, fault) of every distinct file.

    A map over the scan; only the verdicts are shuffled to drop repeated rows.
    """
    slim = spread(files.select("repo", "rel_path", "lang", "content"))
    return slim.mapInPandas(_judge, "repo string, rel_path string, lang string, unreadable boolean, fault string").distinct()


def unparsable(files: DataFrame) -> DataFrame:
    return judge_files(files).where(F.col("fault").isNotNull())


def rates(judged: DataFrame) -> DataFrame:
    """Unparsable files per repo and lang: counts and their share of the readable."""
    readable = F.count(F.when(~F.col("unreadable"), 1))
    bad = F.count("fault")
    return judged.groupBy("repo", "lang").agg(
        F.count(F.lit(1)).alias("files"),
        F.count(F.when(F.col("unreadable"), 1)).alias("unreadable"),
        bad.alias("unparsable"),
        F.when(readable > 0, bad / readable).alias("rate"),
    )


def reduce_parts(parts: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, open_end) of files stored as parts (key, lang, part_no, text).

    For files too long for one row: every part is summarised where it lies, and
    only the summaries, a few short strings each, meet in the reduction.
    """

    def summaries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [json.dumps(summarise(g, t).dump()) for g, t in zip(pdf["lang"], pdf["text"], strict=True)]
            yield pd.DataFrame({key: pdf[key], "part_no": pdf["part_no"], "summary": found})

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [Summary.load(json.loads(j)) for j in pdf.sort_values("part_no")["summary"]]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "open_end": [open_ends(reduce(combine, rows))]})

    kind = parts.schema[key].dataType.simpleString()
    known = parts.where(F.col("lang").isin(*STATES) & F.col("text").isNotNull()).select(key, "lang", "part_no", "text")
    return known.mapInPandas(summaries, f"{key} {kind}, part_no int, summary string").groupBy(key).applyInPandas(reduced, f"{key} {kind}, open_end string")
