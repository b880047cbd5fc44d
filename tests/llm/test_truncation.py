import math
import random

import pandas as pd

from tallyweave.llm import truncation as C

WHOLE = ["A full sentence.", "Why not?", "He said “no.”", "# T\n\n- one thing\n- two things", "| a | b |\n| --- | --- |\n| 1 | 2 |", "Text.\n\n```\ncode(\n```", "x.\n\n-- \nthe team", "x.\n\nRefs: T-1", "x.\n\nhttps://a.example/b-1", "x.\n\n+1 👍", "(see above)", "終わりです。", "See <b>this</b>"]
CUT = ["The rest of this was los", "It lies in `src/", "x.\n\n```\ncode(", "| a | b |\n| --- | --- |\n| 1 |", "A sentence and then some words", "caf\ufffd", "x.\n\n- ", "x.\n\n``", "- the `na"]


def test_endings():
    bad = {"broken", "fence", "row", "code", "prose"}
    for t in WHOLE:
        assert C.ending(t)[0] not in bad, (t, C.ending(t))
    for t in CUT:
        assert C.ending(t)[0] in bad, (t, C.ending(t))
    assert C.ending("some words and then…")[2] == "…" and C.ending("some words [more]")[:3:2] == ("prose", "[more]")


def test_censored_fit_recovers_the_parameters():
    rng = random.Random(1)
    lengths = [rng.lognormvariate(6.5, 0.8) for _ in range(20000)]
    limit = 1000.0
    seen = [min(x, limit) if rng.random() < 0.7 else x for x in lengths]
    below, over, at = [math.log(x) for x in seen if x < limit], [math.log(x) for x in seen if x > limit], sum(x == limit for x in seen)
    post, share = C.fit_censored(len(below), sum(below), sum(x * x for x in below), float(at), len(over), sum(over), sum(x * x for x in over), math.log(limit))
    assert post > 0.99 and abs(share - 0.7) < 0.05
    # A length at which no more texts end than the density lets expect.
    post, _ = C.fit_censored(len(below) + at + len(over) - 1, sum(map(math.log, lengths)), sum(math.log(x) ** 2 for x in lengths), 1.0, 0, 0.0, 0.0, math.log(40000.0))
    assert post <= 1.0


SENTENCES = ["The cold anchor is empty before the walker sees it.", "We measured the span twice and nothing had leaked.", "Reviewers asked for a smaller digest.", "Users see a wide policy after each sync."]


def corpus():
    rng = random.Random(2)
    rows, cut = [], set()
    for i in range(600):
        text = " ".join(rng.choice(SENTENCES) for _ in range(rng.randint(2, 14)))
        if i % 7 == 0:
            text += "\n\nWe will see…"
        elif i % 5 == 0:
            text += "\n\n- cold anchor\n- wide policy"
        source = ["free", "limited", "marked", None][i % 4]
        declared = len(text)
        if source == "limited" and len(text) > 300:
            text = text[:300]
            if not C._TERMINAL.search(text):
                cut.add(i)
        elif source == "marked" and len(text) > 260:
            text = text[:250].rsplit(" ", 1)[0] + " [more]"
            cut.add(i)
        elif source == "free" and i % 40 == 0:
            text = text[:57]
            cut.add(i)
        rows.append((i, source, declared if source != "free" else None, text))
    return rows, cut


def test_rows(spark):
    rows, cut = corpus()
    extra = [(1000, "free", 5, None), (1001, "free", 5, ""), (1002, None, None, "  \n "), (None, None, None, "Whole.")]
    df = spark.createDataFrame([(*r, 1, "k") for r in rows + extra], "doc_id bigint, source string, n_chars bigint, text string, kind int, marker string")
    judged = C.judge(df).collect()
    assert len(judged) == len(rows) + len(extra)
    found = {r.doc_id for r in judged if r.truncated}
    assert len(found & cut) >= 0.97 * len(cut) and len(found - cut) <= 0.03 * len(cut), (sorted(found - cut)[:5], sorted(cut - found)[:5])
    limits = {(r.source, r.limit) for r in C.fitted_limits(df).where("unit = 'chars'").collect()}
    assert ("limited", 300) in limits
    # The verdicts rest on the fit: without its limits many change.
    none = spark.createDataFrame([], "source_key string, unit string, limit int, posterior double, limited_share double, texts bigint")
    without = {r.doc_id for r in C.judge(df, none).collect() if r.truncated}
    assert len(found ^ without) >= 0.1 * len(cut)
    shares = {r.source: (r.documents, r.truncated) for r in C.rates(C.judge(df)).collect()}
    assert shares["limited"][0] == 150 and None in shares
    assert C.judge(df.limit(0)).count() == 0


def cells(rows):
    return pd.DataFrame(rows, columns=["f", "role", "more", "prior", "n"])


def test_evidence_follows_from_the_texts_at_limits():
    # Two endings that no prior tells apart: only one of them is found at the limits.
    rows = [("heading", "none", False, 0.99, 300), ("heading", "none", False, 0.0, 10), ("remark", "none", False, 0.0, 310), ("sentence", "none", False, 0.0, 5000)]
    fit = C.fit_evidence(cells(rows))
    assert fit["endings"]["heading"] + fit["base"] > 0 > fit["endings"]["remark"] + fit["base"]
    # A marker that only lost texts bear, and a declared length that only they miss.
    rows = [("prose", "none", False, 0.99, 300), ("prose", "a", False, 0.0, 100), ("prose", "none", True, 0.0, 50), ("sentence", "b", False, 0.0, 100), ("sentence", "none", False, 0.0, 5000)]
    fit = C.fit_evidence(cells(rows))
    assert fit["roles"]["a"] > 1 > -1 > fit["roles"]["b"] and fit["more"][True] > 2
    assert C.fit_evidence(cells([]))["endings"]["prose"] > 0


def test_more_lost_texts_than_the_least_share():
    rows = [("prose", "none", False, 0.99, 300), ("prose", "none", False, 0.0, 1500), ("sentence", "none", False, 0.0, 3500)]
    fit = C.fit_evidence(cells(rows))
    assert fit["base"] > math.log(0.2 / 0.8) and fit["base"] + fit["endings"]["prose"] > 0
