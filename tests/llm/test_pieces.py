from hypothesis import given, settings
from hypothesis import strategies as st

from tallyweave.llm import pieces as P


def check(text, limit=P.LIMIT, overlap=P.OVERLAP):
    spans = P.split_text(text, limit, overlap)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    for (a, b), (c, _) in zip(spans, spans[1:]):
        assert c == b - overlap and a < c
    assert all(0 < b - a <= limit for a, b in spans) or not text
    assert text == text[: spans[0][1]] + "".join(text[a + overlap : b] for a, b in spans[1:])
    return spans


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab .\n\r,é😀́"), max_size=700), st.integers(20, 90), st.integers(0, 10))
def test_pieces_rebuild_the_text(text, limit, overlap):
    check(text, limit, overlap)


def test_cuts_at_lines_and_paragraphs():
    text = "\n".join(f"line {i} " + "word " * 8 for i in range(80))
    for a, b in check(text)[:-1]:
        assert text[b - 1] == "\n"
    blocks = "\n\n".join("x" * 60 + "\n" + "y" * 200 for _ in range(10))
    assert all(blocks[:b].endswith("\n\n") for _, b in check(blocks)[:-1])


def test_long_unbroken_and_joined_characters():
    check("z" * 5000)
    family = "👨‍👩‍👧" * 500
    for _, b in check(family)[:-1]:
        assert family[b] != "‍" and family[b - 1] != "‍"
    crlf = ("ab\r\n" * 1000)[:-1]
    assert all(not (crlf[b - 1] == "\r" and crlf[b : b + 1] == "\n") for _, b in check(crlf)[:-1])
    check("a " * 200_000)


def test_optimal_against_all_cuts():
    """The dynamic programme finds the cheapest cut list of all."""
    from itertools import combinations

    text = "aa bb.\ncc dd ee\n\nff gg hh ii jj kk\nll mm nn oo"
    limit, overlap = 20, 3
    found = P.boundaries(text, limit, overlap)

    def cost(ends):
        total, before = 0.0, None
        for e in ends:
            size = e if before is None else e - before + overlap
            if size > limit:
                return float("inf")
            total += found.get(e, 0.0) + P.PIECE_PRICE + ((size - 0.7 * limit) / limit) ** 2
            before = e
        return total

    spots = [p for p in found if p > overlap]
    best = min(cost([*sorted(c), len(text)]) for n in range(6) for c in combinations(spots, n))
    assert abs(cost(P.cut_points(text, limit, overlap)) - best) < 1e-9


def test_rows(spark):
    schema = "repo string, id string, path string, symbol string, node_type string, indexed_at timestamp, start_line int, text string, piece_no int, n_pieces string"
    long = "\n".join("x" * 50 for _ in range(40))
    rows = [("r", "a", None, "s", "t", None, 11, long, 7, "c")] * 2 + [("r", "b", "p", None, None, None, None, "é" * 901, 7, "c"), ("r", "c", "p", None, None, None, 1, "é" * 900, 7, "c"), ("r", "d", "p", None, None, None, 1, None, 7, "c"), (None, None, None, None, None, None, 1, "", 7, "c")]
    out = P.split_oversized(spark.createDataFrame(rows, schema)).collect()
    a = sorted((r for r in out if r.id == "a"), key=lambda r: r.piece_no)
    assert [r.piece_no for r in a] == list(range(a[0].n_pieces)) and {r.symbol for r in a} == {"s"} and a[0].start_line == 11 and a[-1].end_line == 50
    for r in a:
        assert r.text == long[r.start_char : r.end_char] and r.start_line == 11 + long[: r.start_char].count("\n") and r.end_line == 11 + long[: r.end_char - 1].count("\n")
    b = [r for r in out if r.id == "b"]
    assert len(b) == 2 and all(r.start_line is None for r in b)
    assert {r.id for r in out} == {"a", "b"}
    assert P.split_oversized(spark.createDataFrame([], schema)).count() == 0
