import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.llm import quantiles as Q


def exact(values, p):
    s = sorted(values)
    return s[max(1, math.ceil(p * len(s) - 1e-9)) - 1]


def run(spark, rows, alpha=Q.ALPHA):
    df = spark.createDataFrame(rows, "g string, v double")
    sk = Q.sketch(df, "v", {"g": "g"}, alpha)
    return {r.g: r for r in Q.percentiles(sk, ["g"], Q.PS, alpha).collect()}


def test_relative_error_and_rank_error(spark):
    rng = random.Random(3)
    values = [rng.lognormvariate(3, 2) * rng.choice([1, 1, 1, -1]) for _ in range(5000)] + [30000.0] * 600 + [0.0] * 50
    got = run(spark, [("a", v) for v in values], alpha=0.01)["a"]
    assert got.n == len(values)
    for name, p in Q.PS.items():
        want = exact(values, p)
        assert abs(got[name] - want) <= 0.01 * abs(want) + 1e-12
    fine = run(spark, [("a", v) for v in values])["a"]
    for name, p in Q.PS.items():
        below = sum(v < fine[name] for v in values) / len(values)
        upto = sum(v <= fine[name] for v in values) / len(values)
        assert below - 0.01 <= p <= upto + 0.01 and fine.rank_error <= 0.01


@settings(max_examples=15, deadline=None)
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=30))
def test_any_values(spark, values):
    got = run(spark, [("a", v) for v in values])["a"]
    for name, p in Q.PS.items():
        want = exact(values, p)
        assert abs(got[name] - want) <= 1.1e-4 * abs(want) + 1e-300


def test_days_combine_to_the_whole(spark):
    rng = random.Random(5)
    rows = [("a" if i % 3 else None, f"d{i % 7}", rng.expovariate(0.01)) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, day string, v double")
    parts = [Q.sketch(df.where(F.col("day") == f"d{i}"), "v", {"g": "g", "day": "day"}) for i in range(7)]
    merged = {tuple(r) for r in Q.percentiles(Q.merge(parts, ["g"]), ["g"], Q.PS).collect()}
    whole = {tuple(r) for r in Q.percentiles(Q.sketch(df, "v", {"g": "g"}), ["g"], Q.PS).collect()}
    assert merged == whole and {r[0] for r in whole} == {"a", None}


def test_odd_input(spark):
    rows = [("a", None), ("a", float("nan")), ("a", float("inf")), ("b", 0.0), ("b", -0.0), ("c", 5e-324), ("c", 1.7e308)]
    got = run(spark, rows)
    assert set(got) == {"b", "c"} and got["b"].p50 == 0.0 and got["c"].p50 == 5e-324 and got["c"].p99 == 1.7e308
    assert run(spark, []) == {}


def test_report_counts_repeated_rows_once(spark):
    from datetime import datetime

    s = "searched_at timestamp, query_text string, repo string, ms double, bucket int, n int"
    at = datetime(2025, 3, 4)
    searches = spark.createDataFrame([(at, "q", None, 5.0, 1, 1)] * 3 + [(at, "q", None, 7.0, 1, 1), (at, "q", "r", -1.0, 1, 1), (at, "q", "r", None, 1, 1)], s)
    bench = spark.createDataFrame([("s", (1, 2.0)), ("s", (1, 2.0)), ("t", None)], "scenario string, detail struct<searches:int,p95_ms:double>")
    got = {(r.source, r.grp, r.month, r.n, r.p50) for r in Q.search_percentiles(searches, bench).collect()}
    assert got == {("searches.ms", None, "2025-03", 2, 5.0), ("bench_baseline.p95_ms", "s", None, 1, 2.0)}


def test_distinct_rows_by_their_hashes(spark):
    rows = [("a", None, 1.0), (None, "a", 1.0), ("a", None, 1.0), ("a", "a", None), ("a", "a", float("nan")), ("a", "a", float("nan"))]
    df = spark.createDataFrame(rows, "x string, y string, ms double")
    assert Q.distinct_values(df, "ms", ["x"]).count() == 4
    assert Q.distinct_values(df.limit(0), "ms", ["x"]).count() == 0


def test_rank_errors_are_seen(spark):
    values = spark.createDataFrame([(g, float(i)) for g in ("a", None) for i in range(1, 101)], "g string, ms double")
    found = spark.createDataFrame([("a", 50.0), (None, 60.0)], "g string, p50 double")
    got = {r.g: r.p50 for r in Q.rank_errors(values, found, ["g"], "ms", {"p50": 0.5}).collect()}
    assert got == {"a": 0.0, None: 0.1}
