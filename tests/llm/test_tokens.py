import random
from itertools import chain

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import tokens as K
from tallyweave.session import tokenizer_dir

VOCABULARY = f"{tokenizer_dir()}/byte_bpe_50k.json"
tokenizers = pytest.importorskip("tokenizers")


@pytest.fixture(scope="module")
def library():
    t = tokenizers.Tokenizer.from_file(VOCABULARY)
    t.encode_special_tokens = True
    return t


def ours(text):
    return list(chain.from_iterable(map(K.memory_for(VOCABULARY).__getitem__, K.pretokens(text))))


TEXTS = ["", " ", "a", "  a\n\n b ", "<|endoftext|> x", "it's 'S we'll", "naïve — déjà", "検索は問題ありません。", "👨‍👩‍👧 ok", "x½²٣", "\x1c\x1d a\x85b\xa0c\u3000d", "a" * 3000, " " * 2000, "\u00ad\ufeffz", "1234567 12,3.4e5", "\r\n\t\r", "\ud7ff\ue000"]


def test_equals_the_library(library):
    for t in TEXTS:
        assert ours(t) == library.encode(t, add_special_tokens=False).ids, t


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text(library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert ours(text) == library.encode(text, add_special_tokens=False).ids


def test_appends_and_edits_redo_little():
    memory = K.memory_for(VOCABULARY)
    rng = random.Random(1)
    base = "The cold anchor is empty,  and it's\n\n fine: x_1 = 22; naïve 検索 end. " * 20
    for _ in range(300):
        e = K.EncodedText(memory, base)
        a = rng.randint(0, len(base))
        b = min(len(base), a + rng.randint(0, 6))
        new = rng.choice(["", " ", "\n", "ab", "'s", "é", " \n ", "x y", "12"])
        e.edit(a, b, new)
        assert e.text == base[:a] + new + base[b:] and e.pieces == K.pretokens(e.text) and e.redone < 60
    e = K.EncodedText(memory)
    for part in ["Hel", "lo wor", "ld  ", "\n\n", "it'", "s"]:
        e.append(part)
    assert e.ids == ours("Hello world  \n\nit's")


def test_table_of_a_prefix_survives_appends():
    enc = K.memory_for(VOCABULARY).encoder
    last = []
    enc.extend(b" tokeniz", last)
    early = list(last)
    enc.extend(b" tokenization", last)
    assert last[: len(early)] == early and tuple(enc.read(b" tokenization", last)) == enc.piece(" tokenization")


def test_rows(spark, library):
    rows = [(i, t, 1, "x") for i, t in enumerate(TEXTS[:-1])] + [(100, None, 1, "x"), (None, "a", 1, "x"), (0, "", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids int, tokens string")
    got = K.encode(df).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: list(r.ids) for r in got}
    assert by[100] == [] and by[0] == [] and by[4] == library.encode(TEXTS[4], add_special_tokens=False).ids
    assert K.encode(df.limit(0)).count() == 0
