"""Texts that stop before their author's text did.

Per source the lengths (in characters and in bytes) are modelled as a log-normal
that a length limit may censor: for every candidate limit, a length at which far
more texts end than the lengths around it let expect, a mixture is fitted by
maximum likelihood (EM): a share of the texts is subject to the limit and, when
longer, ends exactly there. The posterior of a text at the limit being censored is
the prior odds of its truncation; away from limits a small base rate is.

What endings say is estimated from the corpus through that fit: the texts at fitted
limits, weighted by their posterior, show how lost texts end; the texts away from
limits, less the share of lost ones among them, show how whole texts end. An ending
is the construct the text stops in (open fence, table row, inline code, sentence,
list entry, trailer ...) and whether its last word, form or closing line is one that
the corpus knows. Markers put in place of the rest, by how the source uses them, and
declared lengths that the text does not reach are two more features, whose
likelihoods follow from the first by expectation maximisation (``fit_evidence``).
A text is truncated when the posterior odds of all that exceed one.

Defined results for odd input
    * null, empty and blank texts: never truncated; they count in the share's base
    * null source: a source of its own
    * null n_chars: no evidence
    * exact copies under other ids: each judged alike; for the frequency of
      closing lines, copies of one text count once
    * few texts, or none at a limit: the documented prior endings (``KINDS``) decide
    * empty table: no rows; very long texts, words and lines: read whole
    * extra columns, whatever their names: ignored
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.session import cut, spread

#: Marks that systems and people put at an end.
MARKER = re.compile(r"\s*(\[more\]|\[\.\.\.\]|\[…\]|\[truncated\]|\(more\)|\(truncated\)|\(continued\)|\.\.\.|…)$", re.IGNORECASE)
_TERMINAL = re.compile(r"[.!?。！？؟।][\"'”’»)\]*_`>]*$|</\w+>$")
_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])(?:\s+|$)(.*)$")
_TRAILER = re.compile(r"^[A-Z][\w-]*: ?\S*|^\S+:$")
_URL = re.compile(r"^(?:[a-z][a-z0-9+.-]*:/?/?\S*)$")
_FENCE = re.compile(r"^\s*(```+|~~~+)")
_SHAPE = re.compile(r"\d+|[^\W\d_]+")

#: Before any text is seen: how lost texts end and how those away from limits do, in
#: shares; both weigh as much as PRIOR_TEXTS texts.
KINDS = {
    "prose": (0.55, 0.005), "fence": (0.14, 0.001), "code": (0.07, 0.001), "row": (0.05, 0.001), "broken": (0.04, 0.001),
    "sentence": (0.03, 0.5), "closed fence": (0.002, 0.1), "closed row": (0.002, 0.03), "remark": (0.002, 0.02), "heading": (0.01, 0.02),
    "list": (0.005, 0.15), "trailer": (0.005, 0.05), "url": (0.005, 0.03), "sign-off": (0.005, 0.03),
    "list unknown": (0.03, 0.02), "trailer unknown": (0.015, 0.005), "url unknown": (0.015, 0.005), "sign-off unknown": (0.015, 0.005),
    "prose known": (0.002, 0.02), "sentence known": (0.002, 0.05), "remark known": (0.002, 0.02), "heading known": (0.002, 0.01),
}
PRIOR_TEXTS, PRIOR_MARKS, PRIOR_DECLARED, DECLARED_RATES = 50.0, 3.0, 200.0, (0.1, 0.01)
#: Share of the texts away from limits that is taken as lost at least; what the
#: fit says of them raises it. No posterior of a limit counts as more than MOST_LOGIT.
LEAST_SHARE, MOST_LOGIT = 0.05, 5.0
#: Endings that leave something open; among a marker's texts their share says what it is for.
OPEN = ("broken", "fence", "row", "code", "prose")
#: A closing line is known when at least this share of the texts (and 3) end in it; a
#: word or form is unknown below this share of all (and 1 or 2).
CLOSING_SHARE, WORD_SHARE, FORM_SHARE = 0.0004, 0.00005, 0.001


def _shape(line: str) -> str:
    return _SHAPE.sub(lambda m: "0" if m.group()[0].isdigit() else ("A" if m.group().isupper() else "a"), line)


def _digest(s: str) -> int:
    return xxhash.xxh3_64_intdigest(s.encode("utf-8", "replace")) >> 1


def ending(text: str) -> tuple[str, str | None, str | None, bool]:
    """(kind, key, marker, own paragraph) of a text's ending.

    ``key`` is what is looked up in the corpus: the last word of a list entry, the
    form of a trailer or address, the closing line itself otherwise.
    """
    whole = text.rstrip()
    m = MARKER.search(whole)
    marker = m.group(1).lower() if m else None
    body = whole[: m.start()].rstrip() if m else whole
    lines = body.split("\n")
    last = lines[-1].rstrip("\r")
    while last.startswith(">"):
        last = last[1:].lstrip()
    own = len(lines) == 1 or not lines[-2].strip(" \r\t>")
    # A short line of its own may be how many texts close.
    closing = whole[len(body) - len(lines[-1]) :].strip() if own and len(lines[-1]) <= 80 else None
    if body.endswith("�"):
        return "broken", None, marker, own
    fence = None
    for line in lines:
        f = _FENCE.match(line)
        if f:
            if fence is None:
                fence = f.group(1)[:3]
            elif line.strip().startswith(fence) and not line.strip().strip("`~"):
                fence = None
    if fence is not None or last.strip() in ("`", "``"):
        return "fence", None, marker, own
    stripped = last.strip()
    if _FENCE.match(last):
        return "closed fence", None, marker, own
    if stripped.startswith("|"):
        rows = []
        for line in reversed(lines):
            s = line.strip().lstrip("> ").strip()
            if not s.startswith("|"):
                break
            rows.append(s)
        whole_row = stripped.endswith("|") and len(stripped) > 1 and stripped.count("|") == rows[-1].count("|") and len(rows) > 2
        return ("closed row" if whole_row else "row"), None, marker, own
    if len(lines) > 1 and lines[-2].strip() == "--":
        return "sign-off", stripped, marker, own
    if stripped == "--" and own:
        return "prose", None, marker, own
    entry = _LIST.match(last)
    if entry:
        content = entry.group(1).strip()
        if not content:
            return "prose", None, marker, own
        if content.count("`") % 2:
            return "code", None, marker, own
        if _TERMINAL.search(content):
            return "sentence", None, marker, own
        return "list", content.split()[-1].lower(), marker, own
    if _URL.match(stripped):
        return "url", _shape(stripped), marker, own
    if own and _TRAILER.match(stripped) and len(stripped) < 80:
        return "trailer", _shape(stripped), marker, own
    if re.match(r"^#{1,6}(\s|$)", stripped):
        return "heading", closing, marker, own
    start = len(lines) - 1
    while start and lines[start - 1].strip() and not _FENCE.match(lines[start - 1]):
        start -= 1
    paragraph = "\n".join(lines[start:])
    if paragraph.count("`") % 2:
        return "code", None, marker, own
    if _TERMINAL.search(stripped):
        return "sentence", closing, marker, own
    if own and len(stripped.split()) <= 5 and stripped and not stripped[-1].isalnum() and stripped[-1] not in ",;:-–—(/_[{`'":
        return "remark", closing, marker, own
    return "prose", closing, marker, own


_READ = (
    "doc_id bigint, source string, chars int, bytes int, kind string, space string, key bigint, marker string, more boolean, copy bigint, blank boolean, words array<bigint>"
)
_LISTED = re.compile(r"^[ \t>]*(?:[-*+]|\d+[.)])[ \t]+.*?([^\s]+)[ \t\r]*$", re.MULTILINE)
#: Where the key of an ending is looked up.
_SPACES = {"list": "word", "url": "form", "trailer": "form", "sign-off": "form", "prose": "closing", "sentence": "closing", "remark": "closing", "heading": "closing"}


def _read_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for doc_id, source, declared, text in pdf.itertuples(index=False, name=None):
            if text is None or not text.strip():
                out.append((doc_id, source, None, None, None, None, None, None, None, None, True, []))
                continue
            kind, key, marker, _ = ending(text)
            size = len(text), len(text.rstrip("\ufffd").encode("utf-8", "replace"))
            words = [_digest(w.lower()) for w in _LISTED.findall(text)] if "\n- " in text or "\n* " in text or "\n1" in text else []
            if kind == "list" and words:
                words = words[:-1]
            space = _SPACES.get(kind) if key is not None else None
            more = not pd.isna(declared) and int(declared) > max(size) + 4
            out.append((doc_id, source, *size, kind, space, None if space is None else _digest(f"{kind} {key}" if space == "form" else key), marker, more, _digest(text), False, words))
        frame = pd.DataFrame(out, columns=[c.strip().split()[0] for c in _READ.split(", ")])
        yield frame.astype({"chars": "Int32", "bytes": "Int32", "key": "Int64", "copy": "Int64", "doc_id": "Int64"})


def read_endings(docs: DataFrame) -> DataFrame:
    """One pass over the texts: a small row per document."""
    slim = spread(docs.select("doc_id", "source", F.col("n_chars").cast("bigint").alias("n_chars"), "text"))
    return slim.mapInPandas(_read_batches, _READ)


def fit_censored(n0, s0, q0, n_at, n_over, s_over, q_over, log_limit, rounds: int = 60):
    """Posterior that a text at the limit is censored, and the censored share.

    Maximum likelihood of the mixture by EM on sufficient statistics: ``n0, s0,
    q0`` (count, sum, sum of squares of log lengths) below the limit, the same
    above it, and the count at it.
    """
    n = n0 + n_over + n_at
    mu = (s0 + s_over + n_at * log_limit) / n
    sd = math.sqrt(max(1e-4, (q0 + q_over + n_at * log_limit**2) / n - mu * mu))
    share, post = 0.5, 1.0
    for _ in range(rounds):
        z = (log_limit - mu) / sd
        tail = max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
        density = math.exp(-0.5 * z * z) / (sd * math.sqrt(2 * math.pi)) / math.exp(log_limit)
        post = share * tail / (share * tail + density)
        hidden = post * n_at
        # Moments of the log length beyond the limit.
        hazard = math.exp(-0.5 * z * z) / math.sqrt(2 * math.pi) / tail
        first = mu + sd * hazard
        second = mu * mu + 2 * mu * sd * hazard + sd * sd * (1 + z * hazard)
        seen = n_at - hidden
        s = s0 + s_over + hidden * first + seen * log_limit
        q = q0 + q_over + hidden * second + seen * log_limit**2
        mu = s / n
        sd = math.sqrt(max(1e-4, q / n - mu * mu))
        share = min(0.9999, max(1e-6, hidden / max(1e-9, hidden + n_over)))
    return post, share


def length_limits(rows: DataFrame) -> DataFrame:
    """(source_key, unit, limit, posterior, limited_share, texts): fitted limits.

    A length qualifies when its count exceeds what the 100 lengths around it let
    expect by six standard deviations; texts subject to several limits are fitted
    for each. The histogram, not the texts, is sorted and summed.
    """
    sized = rows.where(~F.col("blank")).select(
        F.coalesce("source", F.lit("\u0000")).alias("source_key"),
        F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("size")))).alias("x"),
    )
    hist = sized.groupBy("source_key", "x.unit", "x.size").agg(F.count(F.lit(1)).alias("n")).where(F.col("size") > 1)
    log = F.log(F.col("size").cast("double"))
    near = Window.partitionBy("source_key", "unit").orderBy("size").rangeBetween(-50, 50)
    upto = Window.partitionBy("source_key", "unit").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("source_key", "unit")
    summed = (
        hist.withColumn("s", F.col("n") * log).withColumn("q", F.col("n") * log * log)
        .withColumn("expected", (F.sum("n").over(near) - F.col("n")) / 100.0)
        .withColumns({f"{c}0": F.coalesce(F.sum(c).over(upto), F.lit(0)).cast("double") for c in "nsq"})
        .withColumns({f"{c}_over": (F.sum(c).over(every) - F.col(c) - F.col(f"{c}0")).cast("double") for c in "nsq"})
        .where(F.col("n") > F.col("expected") + 6 * F.sqrt(F.col("expected")) + 4)
    )

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [
                fit_censored(r.n0, r.s0, r.q0, float(r.n), r.n_over, r.s_over, r.q_over, math.log(r.size_))
                for r in pdf.rename(columns={"size": "size_"}).itertuples()
            ]
            yield pd.DataFrame(
                {"source_key": pdf["source_key"], "unit": pdf["unit"], "limit": pdf["size"], "posterior": [g[0] for g in got], "limited_share": [g[1] for g in got], "texts": pdf["n"]}
            )

    cols = ["source_key", "unit", "size", "n", "n0", "s0", "q0", "n_over", "s_over", "q_over"]
    return summed.select(*cols).mapInPandas(fit, "source_key string, unit string, limit int, posterior double, limited_share double, texts bigint")


def fitted_limits(docs: DataFrame) -> DataFrame:
    """(source, unit, limit, posterior, limited_share, texts): the limits found in the documents."""
    rows = cut(read_endings(docs)).withColumn("source_key", F.coalesce("source", F.lit("\u0000")))
    return length_limits(rows).select(F.nullif("source_key", F.lit("\u0000")).alias("source"), "unit", "limit", "posterior", "limited_share", "texts")


def fit_evidence(cells: pd.DataFrame, rounds: int = 30) -> dict[str, dict]:
    """Log likelihood ratios (lost against whole) of endings, marker roles and declared lengths.

    ``cells``: f (ending), role, more, prior (mean posterior of a limit, 0 away from
    limits), n. The ratios of the endings rest on the cells at limits, which the
    length fit says are lost; the share of lost texts elsewhere is the largest that
    leaves no ending a negative share among whole texts. ``base`` is its log odds.
    """
    n, p = cells["n"].to_numpy(float), cells["prior"].to_numpy(float)
    known = pd.Index(list(KINDS))
    f = known.get_indexer(cells["f"])
    role, roles = pd.factorize(cells["role"])
    more = cells["more"].to_numpy(int)
    t0, w0 = np.array(list(KINDS.values())).T
    t0, w0 = t0 / t0.sum(), w0 / w0.sum()

    def share(codes, weights, size, prior, strength):
        return (np.bincount(codes, weights, size) + strength * prior) / (weights.sum() + strength)

    lost = share(f, n * p, len(known), t0, PRIOR_TEXTS)
    # Both priors have the same say, so an ending that was never seen keeps its prior ratio.
    strength = PRIOR_TEXTS * max(1.0, ((n * (1 - p)).sum() + PRIOR_TEXTS) / ((n * p).sum() + PRIOR_TEXTS))
    away = share(f, n * (1 - p), len(known), w0, strength)
    at_limits = np.bincount(f, n * p, len(known))
    common = at_limits >= max(5.0, 0.02 * at_limits.sum())
    base = float(min(0.5, max(LEAST_SHARE, (away / lost)[common].min() if common.any() else 0.0)))
    logit = np.log(np.maximum(p, 1e-9) / (1.0000001 - p))
    start = np.clip(logit, math.log(base / (1 - base)), MOST_LOGIT)
    ends, marks, says = np.log(lost / away), np.zeros(max(1, len(roles))), np.zeros(2)
    even = np.full(max(1, len(roles)), 1 / max(1, len(roles)))
    rates = np.array([[1 - r, r] for r in DECLARED_RATES])
    for _ in range(rounds):
        r = 1 / (1 + np.exp(-(start + ends[f] + marks[role] + says[more]))) if len(n) else n
        ends = np.log(lost / share(f, n * (1 - r), len(known), w0, strength))
        marks = np.log(share(role, n * r, len(even), even, PRIOR_MARKS) / share(role, n * (1 - r), len(even), even, PRIOR_MARKS))
        says = np.log(share(more, n * r, 2, rates[0], PRIOR_DECLARED) / share(more, n * (1 - r), 2, rates[1], PRIOR_DECLARED))
    return {
        "endings": dict(zip(known, ends.tolist(), strict=True)), "roles": dict(zip(roles, marks.tolist(), strict=False)),
        "more": {False: float(says[0]), True: float(says[1])}, "base": math.log(base / (1 - base)),
    }


def _filled(key: Column, unique: str) -> Column:
    """A join key whose nulls, which match nothing, are spread over many values."""
    return F.coalesce(key, -F.pmod(F.xxhash64(unique), F.lit(1 << 16)) - 1)


def _limit_posterior(rows: DataFrame, limits: DataFrame) -> DataFrame:
    """``rows`` with ``at_limit``, the posterior that the text is censored at a limit of its source."""
    by_source = limits.groupBy("source_key").agg(
        F.collect_list(F.when(F.col("unit") == "chars", F.struct("limit", "posterior"))).alias("char_limits"),
        F.collect_list(F.when(F.col("unit") == "bytes", F.struct("limit", "posterior"))).alias("byte_limits"),
    )
    # A text cut inside a character keeps fewer whole bytes than the limit.
    at_char = F.aggregate("char_limits", F.lit(0.0), lambda a, x: F.when(x.limit == F.col("chars"), F.greatest(a, x.posterior)).otherwise(a))
    at_byte = F.aggregate(
        "byte_limits", F.lit(0.0),
        lambda a, x: F.when((x.limit == F.col("bytes")) | ((F.col("kind") == "broken") & (F.col("bytes") < x.limit) & (F.col("bytes") >= x.limit - 3)), F.greatest(a, x.posterior)).otherwise(a),
    )
    return rows.join(by_source, "source_key", "left").withColumn("at_limit", F.coalesce(F.greatest(at_char, at_byte), F.lit(0.0))).drop("char_limits", "byte_limits")


def _known_keys(rows: DataFrame) -> DataFrame:
    """(space, key): the words, forms and closing lines that the corpus knows."""
    words = rows.select(F.lit("word").alias("space"), F.explode("words").alias("key"))
    forms = rows.where("space = 'form'").select("space", "key")
    lines = rows.where("space = 'closing'").select("space", "key", "copy").distinct().select("space", "key")
    counts = words.unionByName(forms).unionByName(lines).groupBy("space", "key").agg(F.count(F.lit(1)).alias("n"))
    totals = rows.agg(
        F.count(F.when(~F.col("blank"), 1)).alias("closing"), F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("word"), F.count(F.when(F.col("space") == "form", 1)).alias("form")
    )
    least = (
        F.when(F.col("space") == "word", F.greatest(F.lit(1.0), F.col("word") * WORD_SHARE))
        .when(F.col("space") == "form", F.greatest(F.lit(2.0), F.col("form") * FORM_SHARE))
        .otherwise(F.greatest(F.lit(3.0), F.col("closing") * CLOSING_SHARE))
    )
    return counts.crossJoin(F.broadcast(totals)).where(F.col("n") >= least).select("space", "key", F.lit(True).alias("is_known"))  # totals: one row


def _roles(rows: DataFrame) -> DataFrame:
    """(source_key, marker, role): how a source uses a marker, in classes of how many of its
    texts bear it, how many of those stand at a limit and how many leave something open."""
    n = F.count(F.lit(1))
    fifth = lambda c: F.floor(F.count(F.when(c, 1)) / n * 4.999).cast("string")
    left_open = F.col("kind").isin(*OPEN) & ~F.col("f").endswith(" known")
    marks = rows.where(F.col("marker").isNotNull()).groupBy("source_key", "marker").agg(
        n.alias("marker_n"), fifth(F.col("at_limit") > 0.5).alias("limited"), fifth(left_open).alias("opened")
    )
    sizes = rows.where(~F.col("blank")).groupBy("source_key").agg(n.alias("source_n"))
    often = F.least(F.lit(6), F.floor(-F.log2(F.col("marker_n") / F.col("source_n")))).cast("string")
    return marks.join(sizes, "source_key").select("source_key", "marker", F.concat_ws("/", often, "limited", "opened").alias("role"))


def evidence(docs: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """Every document with its ending (f), marker role and posterior at a limit."""
    rows = cut(read_endings(docs)).withColumn("source_key", F.coalesce("source", F.lit("\u0000")))
    limits = cut(length_limits(rows)) if limits is None else limits
    limited = _limit_posterior(rows, limits).withColumn("key", _filled(F.col("key"), "doc_id")).withColumn("space", F.coalesce("space", F.lit("none")))
    seen = limited.join(_known_keys(rows), ["space", "key"], "left")
    state = F.when((F.col("space") == "closing") & F.col("is_known"), " known").when(F.col("space").isin("word", "form") & F.col("is_known").isNull(), " unknown").otherwise("")
    named = cut(seen.select("doc_id", "source", "source_key", "kind", "marker", "more", "blank", "at_limit", F.concat("kind", state).alias("f")))
    marked = named.where(F.col("marker").isNotNull()).join(_roles(named), ["source_key", "marker"])
    return named.where(F.col("marker").isNull()).withColumn("role", F.lit("none")).unionByName(marked)


def judge(docs: DataFrame, limits: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, kind, marker, at_limit, blank, log_odds, truncated) of every document.

    ``limits`` replaces the limits fitted to the documents. What reaches the driver is
    one row per ending, marker role, declared length and decile of the posterior.
    """
    rows = cut(evidence(docs, limits))
    bins = F.floor(F.col("at_limit") * 10)
    cells = rows.where(~F.col("blank")).groupBy("f", "role", "more", bins.alias("bin")).agg(F.avg("at_limit").alias("prior"), F.count(F.lit(1)).alias("n")).orderBy("f", "role", "more", "bin").toPandas()
    fit = fit_evidence(cells)
    at = F.col("at_limit")
    base = F.when(at > 0, F.greatest(F.lit(fit["base"]), F.least(F.lit(MOST_LOGIT), F.log(at / (1.0000001 - at))))).otherwise(F.lit(fit["base"]))
    look = lambda table, c: F.coalesce(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)], F.lit(0.0)) if table else F.lit(0.0)
    odds = F.round(base + look(fit["endings"], "f") + look(fit["roles"], "role") + look(fit["more"], "more"), 6)
    return rows.select(
        "doc_id", "source", "kind", "marker", "at_limit", "blank",
        F.when(~F.col("blank"), odds).alias("log_odds"),
        F.coalesce(~F.col("blank") & (odds > 0), F.lit(False)).alias("truncated"),
    )


def rates(judged: DataFrame) -> DataFrame:
    """Truncated documents per source and their share of the source's rows."""
    n = F.count(F.when(F.col("truncated"), 1))
    return judged.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), n.alias("truncated"), (n / F.count(F.lit(1))).alias("share"))
