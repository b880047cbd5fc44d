import random

import numpy as np

from tallyweave.llm import leaks as L

rng = random.Random(9)
VOCAB = [f"{a}{b}" for a in ["an", "be", "co", "di", "ex", "fo", "gu", "ha", "in", "jo", "ka", "lu"] for b in ["ter", "lon", "mar", "sit", "vex", "rup", "dan", "kel", "pos", "wim"]]


def words(n):
    return [rng.choice(VOCAB) for _ in range(n)]


ITEMS = [(i, " ".join(words(90))) for i in range(30)]


def edited(part, edits):
    part = list(part)
    for at in sorted(rng.sample(range(1, len(part) - 1), edits), reverse=True):
        kind = rng.choice("rda")
        if kind == "r":
            part[at] = "zzz"
        elif kind == "d":
            del part[at]
        else:
            part.insert(at, "yyy")
    return part


def test_recall_of_edited_passages():
    index = L.Index(ITEMS)
    texts, truth = [], set()
    for n in range(400):
        i, text = ITEMS[n % 30]
        size = rng.choice([25, 30, 40, 60])
        at = rng.randrange(0, 90 - size)
        part = edited(text.split()[at : at + size], rng.randint(0, size // 8))
        texts.append(" ".join(words(40) + part + words(40)))
        truth.add((n, i))
    found = {(t, index.items[i]) for t, i, *_ in L.search(index, texts)}
    assert len(found & truth) / len(truth) >= 0.98, len(found & truth) / len(truth)
    assert not {x for x in found - truth}


def test_short_and_broken_passages_are_no_case():
    index = L.Index(ITEMS)
    i, text = ITEMS[0]
    w = text.split()
    short = " ".join(words(30) + w[5:25] + words(30))
    torn = " ".join(words(30) + [x for k in range(0, 80, 10) for x in (*w[k : k + 10], *words(4))] + words(30))
    assert L.search(index, [short, torn, None, "", " ".join(words(300))]) == []


def test_changed_form_does_not_count():
    index = L.Index(ITEMS)
    w = ITEMS[3][1].split()
    forms = [
        "\n".join("> " + " ".join(w[k : k + 7]) for k in range(0, 40, 7)),
        "// " + "\n// ".join(" ".join(w[k : k + 7]).upper() for k in range(0, 40, 7)),
        "<p>" + " ".join(f"<b>{x}</b>" if k % 3 == 0 else x for k, x in enumerate(w[:40])) + "</p>",
        '{"q": "' + "\\n".join(" ".join(w[k : k + 5]) for k in range(0, 40, 5)) + '"}',
        ",  ".join(f"**{x}**" for x in w[:40]), " ".join(w[:40]).replace("a", "\\u0061"), "​".join([" ".join(w[:40])]),
        "\n".join(f"{n}. " + " ".join(w[k : k + 6]) for n, k in enumerate(range(0, 42, 6), 1)),
    ]
    assert {t for t, *_ in L.search(index, forms)} == set(range(len(forms)))


def test_exact_check_equals_edit_distance():
    def brute(a, b, least=10):
        for i in range(len(a)):
            for j in range(len(b)):
                table = np.zeros((len(a) - i + 1, len(b) - j + 1), int)
                table[0], table[:, 0] = np.arange(table.shape[1]), np.arange(table.shape[0])
                for x in range(1, table.shape[0]):
                    for y in range(1, table.shape[1]):
                        table[x, y] = min(table[x - 1, y - 1] + (a[i + x - 1] != b[j + y - 1]), table[x - 1, y] + 1, table[x, y - 1] + 1)
                    if x >= least and table[x].min() * 8 <= x:
                        return True
        return False

    for n in range(60):
        r = random.Random(n)
        a = [r.randrange(1, 12) for _ in range(16)]
        b = edited(a[2:14], r.randint(0, 3))
        b = np.array([x if isinstance(x, int) else 0 for x in b], dtype=np.int32)
        assert (L.passage(np.array(a, dtype=np.int32), b, 0, 10) is not None) == brute(a, b.tolist()), n


def test_rows(spark):
    docs = [(1, ITEMS[0][1]), (2, ITEMS[0][1]), (3, None), (4, ""), (None, ITEMS[1][1]), (6, " ".join(words(20_000)) + " " + ITEMS[2][1])]
    d = spark.createDataFrame([(*r, 1, 2) for r in [*docs, docs[0]]], "doc_id bigint, text string, item_id int, edits int")
    e = spark.createDataFrame([*ITEMS, (99, None), (98, "too short"), (97, ITEMS[0][1])], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in L.leaks(d, e).collect()}
    assert got == {(1, 0), (2, 0), (1, 97), (2, 97), (None, 1), (6, 2)}
    assert got == {(r.doc_id, r.item_id) for r in L.leaks(d, e, block=7).collect()}
    assert {(r.item_id, r.documents) for r in L.leaked_items(L.leaks(d, e)).collect()} == {(0, 2), (97, 2), (1, 1), (2, 1)}
    assert L.leaks(d.limit(0), e).count() == 0 and L.leaks(d, e.limit(0)).count() == 0


def test_passages_behind_a_shared_opening():
    r = random.Random(5)
    opening = " ".join(r.choice(VOCAB) for _ in range(17))
    items = [(i, opening + " " + " ".join(r.choice(VOCAB) for _ in range(130))) for i in range(20)]
    index = L.Index(items)
    texts = []
    for _, text in items:
        w = text.split()
        # The opening, some sixty words of which every third is changed, then the item word by word.
        texts.append(" ".join(w[:17] + [x if k % 3 else "zzz" for k, x in enumerate(w[17:80])] + w[80:120]))
    assert {(t, index.items[i]) for t, i, *_ in L.search(index, texts)} == {(n, n) for n in range(20)}
    # A text that ends like the item begins does not hide what the next one holds.
    w = items[3][1].split()
    pairs = [" ".join(["yyy"] * 30 + w[:20]), " ".join(["xxx"] * 60 + w[80:120])]
    assert [t for t, *_ in L.search(index, pairs)] == [1]


def test_all_candidates_of_a_block_are_looked_at():
    index = L.Index(ITEMS)
    r = random.Random(8)
    x = np.array([r.randrange(len(index.number)) for _ in range(3000)], dtype=np.int32)
    x[500:560] = index.codes[4][10:70]
    of = np.zeros(len(x), dtype=int)
    p = np.repeat(np.arange(450, 600), 40)
    q = np.clip(p - 490 + np.tile(np.arange(-20, 20), 150), 0, 78)
    item = np.full(len(p), 4)
    exact = L._plausible(index, x, of, item, q, p)
    for near in range(0, len(p), 701):
        together = (abs(p - p[near]) < L._LOOK) & (abs((p - q) - (p[near] - q[near])) < 1 << L._BAND)
        if exact[together].any():
            assert L._plausible(index, x, of, item[[near]], q[[near]], p[[near]], L._LOOK - 1, (1 << L._BAND) - 1).all()
