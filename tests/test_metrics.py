import math
import random

import pytest
from pyspark.sql import functions as F

from labelyard.operators import scoring, stats, usage
from labelyard.operators.attempts import fold_attempts

from conftest import items_of, predictions_of


def scores(spark, gold, **systems):
    items, preds = items_of(spark, gold), predictions_of(spark, **systems)
    rows = scoring.system_scores(scoring.tally(scoring.score_items(preds, items))).collect()
    return {r["system"]: r for r in rows}


def test_exact_set_match_gives_no_partial_credit(spark):
    got = scores(spark, [["a"], ["a", "b"], ["a", "b"]], s=[["a", "b"], ["a"], ["b", "a"]])
    assert got["s"]["n_correct"] == 1


def test_macro_f1_examples(spark):
    assert scores(spark, ["a"], s=["a"])["s"]["macro_f1"] == 1.0
    assert scores(spark, ["a"], s=["b"])["s"]["macro_f1"] == 0.0
    assert scores(spark, [["a"]], s=[["a", "b"]])["s"]["macro_f1"] == 0.5
    refs = ["offensive"] * 194 + ["neither"] * 46 + ["hate"] * 10
    blocked = ["hate"] * 88 + ["neither"] * 42 + ["offensive"] * 120
    low = scores(spark, refs, s=blocked)["s"]["macro_f1"]
    assert low < scores(spark, list(reversed(refs)), s=blocked)["s"]["macro_f1"]


def test_scores_against_definition_on_random_sets(spark):
    rng = random.Random(7)
    draw = lambda: sorted(set(rng.choices("abcd", k=rng.randint(0, 3))))
    gold, pred = [draw() for _ in range(200)], [draw() for _ in range(200)]
    f1s = []
    for label in "abcd":
        tp = sum(label in p and label in g for p, g in zip(pred, gold))
        fp = sum(label in p and label not in g for p, g in zip(pred, gold))
        fn = sum(label not in p and label in g for p, g in zip(pred, gold))
        f1s.append(2 * tp / (2 * tp + fp + fn))
    row = scores(spark, gold, s=pred)["s"]
    assert row["accuracy"] == pytest.approx(sum(p == g for p, g in zip(pred, gold)) / 200)
    assert row["macro_f1"] == pytest.approx(sum(f1s) / 4)


def test_mismatched_items_are_refused(spark):
    items = items_of(spark, ["a", "b", "c"])
    with pytest.raises(ValueError, match="length mismatch"):
        scoring.require_paired(predictions_of(spark, s=["a", "b"]), items)
    twice = predictions_of(spark, s=["a", "b", "c"]).unionByName(predictions_of(spark, s=["a"]))
    faults = scoring.pairing_faults(twice, items).collect()
    assert [(f["item_id"], f["fault"]) for f in faults] == [(0, "duplicate prediction")]
    scoring.require_paired(predictions_of(spark, s=["a", "b", "c"]), items)


@pytest.mark.parametrize("ids", [[0, 0], [0, 1], [0, 1, 2, 3], [0, 1, 2, 2]])
def test_scores_refuse_skipped_invented_and_double_answers(spark, ids):
    items = items_of(spark, ["a", "b", "c"])
    answers = spark.createDataFrame([("s", i, ["a"]) for i in ids], "system string, item_id long, labels array<string>")
    with pytest.raises(Exception, match="length mismatch"):
        scoring.system_scores(scoring.tally(scoring.score_items(answers, items))).collect()


def test_floor(spark):
    floor = scoring.majority_floor(items_of(spark, ["a"] * 7 + ["b"] * 2 + ["c"])).first()
    assert (floor["label"], floor["count"], floor["accuracy"]) == ("a", 7, 0.7)
    tie = scoring.majority_floor(items_of(spark, ["z", "a", "z", "a"])).first()
    assert tie["label"] == "z"  # first seen
    assert scoring.majority_floor(items_of(spark, [[], []])).count() == 0
    spread = ["a"] * 4 + ["b"] * 5 + ["c"]
    refs = ["a"] * 8 + ["b", "c"]
    floor = scoring.majority_floor(items_of(spark, refs)).first()
    got = scores(spark, refs, s=spread)["s"]
    assert got["accuracy"] < floor["accuracy"] and got["macro_f1"] > floor["macro_f1"]


PUBLISHED = [
    (300, 217, 67.3, 77.3), (300, 259, 82.3, 90.0), (300, 279, 90.0, 95.7), (60, 45, 63.3, 85.0),
    (60, 58, 91.7, 100.0), (60, 55, 83.3, 98.3), (98, 64, 56.1, 74.5), (102, 78, 67.6, 84.3),
    (500, 500, 100.0, 100.0), (500, 0, 0.0, 0.0), (1, 1, 100.0, 100.0),
]


def test_intervals_match_the_published_ones(spark):
    df = spark.createDataFrame([p[:2] for p in PUBLISHED] + [(0, 0)], "n long, k long").coalesce(1)
    for method, tolerance in (("exact", 0.051), ("monte_carlo", 2.0)):
        rows = df.select("n", "k", stats.bootstrap_ci(F.col("n"), F.col("k"), method=method).alias("c")).select("n", "k", "c.*").collect()
        by_key = {(r["n"], r["k"]): r for r in rows}
        for n, k, low, high in PUBLISHED:
            row = by_key[(n, k)]
            slack = max(tolerance, 200 / n) if method == "monte_carlo" else tolerance
            assert abs(100 * row["ci_low"] - low) <= slack and abs(100 * row["ci_high"] - high) <= slack
        assert by_key[(0, 0)]["ci_low"] is None


def compared(spark, cells, **kw):
    df = spark.createDataFrame([("a", "b", *c) for c in cells], "a string, b string, n11 long, n10 long, n01 long, n00 long")
    return {(r["mcnemar"]["b"], r["mcnemar"]["c"]): r for r in stats.compare_pairs(df.coalesce(1), **kw).collect()}


def test_mcnemar_and_difference(spark):
    got = compared(spark, [(0, 10, 0, 0), (0, 1, 1, 0), (5, 0, 0, 0), (200, 17, 59, 24), (0, 50, 0, 0)])
    assert got[(10, 0)]["mcnemar"]["p_value"] == pytest.approx(2 / 1024)
    assert got[(1, 1)]["mcnemar"]["p_value"] == 1.0
    same = got[(0, 0)]
    assert (same["mcnemar"]["p_value"], same["diff"], same["ci_low"], same["p_value"]) == (1.0, 0.0, 0.0, 1.0)
    wide = got[(17, 59)]
    exact = 2 * sum(math.comb(76, i) for i in range(18)) / 2**76
    assert wide["mcnemar"]["p_value"] == pytest.approx(exact, rel=1e-9)
    assert (wide["ci_low"], wide["ci_high"]) == pytest.approx((-58 / 300, -26 / 300))
    assert got[(50, 0)]["diff"] == 1.0 and got[(50, 0)]["significant"]


def test_exact_difference_equals_the_trinomial(spark):
    n, x, y = 25, 6, 3
    mass = {}
    for i in range(n + 1):
        for j in range(n - i + 1):
            p = math.comb(n, i) * math.comb(n - i, j) * (x / n) ** i * (y / n) ** j * (1 - (x + y) / n) ** (n - i - j)
            mass[i - j] = mass.get(i - j, 0) + p
    run, ends = 0.0, []
    for d in sorted(mass):
        run += mass[d]
        if len(ends) == 0 and run >= 0.025 or len(ends) == 1 and run >= 0.975:
            ends.append(d / n)
    p = min(1, 2 * min(sum(m for d, m in mass.items() if d <= 0), sum(m for d, m in mass.items() if d >= 0)))
    row = compared(spark, [(10, x, y, 6)])[(x, y)]
    assert [row["ci_low"], row["ci_high"]] == pytest.approx(ends)
    assert row["p_value"] == pytest.approx(p, abs=1e-10)
    flipped = compared(spark, [(10, y, x, 6)])[(y, x)]
    assert flipped["diff"] == -row["diff"] and flipped["mcnemar"]["p_value"] == row["mcnemar"]["p_value"]
    drawn = compared(spark, [(10, x, y, 6)], method="monte_carlo")[(x, y)]
    assert abs(drawn["ci_low"] - row["ci_low"]) <= 2 / n


def test_huge_counts_stay_exact(spark):
    big = compared(spark, [(10**9, 3 * 10**5, 3 * 10**5 + 900, 10**9)])[(3 * 10**5, 3 * 10**5 + 900)]
    z = 900 / math.sqrt(6 * 10**5 + 900)
    normal = math.erfc(z / math.sqrt(2))
    assert big["mcnemar"]["p_value"] == pytest.approx(normal, rel=0.01)
    assert big["p_value"] == pytest.approx(normal, rel=0.01)


def test_pairs_count_one_shuffle_and_refuse_unpaired_items(spark):
    rows = [("x", i, i % 2 == 0) for i in range(10)] + [("y", i, i % 5 == 0) for i in range(10)]
    df = spark.createDataFrame(rows, "system string, item_id long, correct boolean")
    cell = stats.pair_cells(df, [("x", "y")]).first()
    assert (cell["n11"], cell["n10"], cell["n01"], cell["n00"]) == (1, 4, 1, 4)
    with pytest.raises(Exception, match="not scored on the same items"):
        stats.pair_cells(df.filter("NOT (system = 'y' AND item_id = 3)"), [("x", "y")]).collect()


def test_latency_percentiles(spark, monkeypatch):
    import statistics

    from labelyard.operators import ranks

    rng = random.Random(3)
    data = {"a": [float(i) for i in range(20)], "b": [rng.choice([1.0, 2.5, 9.0]) for _ in range(501)],
            "c": [rng.random() for _ in range(40_000)], "d": [7.0], "e": [float(int(rng.random() ** 4 * 60)) for _ in range(3_000)]}
    df = spark.createDataFrame([(s, v) for s, vs in data.items() for v in vs] + [("a", None)], "system string, latency_ms double")
    # Then groups count as large, so brackets are narrowed, once and several times.
    for limit in (ranks.SMALL_GROUP, 30_000, 40, 1):
        monkeypatch.setattr(ranks, "SMALL_GROUP", limit)
        for r in usage.latency_percentiles(df).collect():
            values = sorted(data[r["system"]])
            assert r["n"] == len(values)
            assert r["p50_ms"] == pytest.approx(statistics.median(values))
            assert r["p95_ms"] == values[min(len(values) - 1, int(0.95 * len(values)))]


def test_ranks_of_a_million_distinct_values(spark, monkeypatch):
    """No task ranks more than the bound, however many values a group has."""
    from labelyard.operators import ranks

    monkeypatch.setattr(ranks, "SMALL_GROUP", 500)
    n = 1_000_003
    df = spark.range(n).select(F.lit("a").alias("system"), F.pmod(F.col("id") * 7919, F.lit(n)).cast("double").alias("latency_ms"))
    row = usage.latency_percentiles(df, both_medians=True).first()
    assert (row["n"], row["p50_ms"], row["p95_ms"], row["upper_p50_ms"]) == (n, n // 2, int(0.95 * n), n // 2)


def test_cost_states(spark):
    df = spark.createDataFrame([("llm", 100, 10), ("llm", None, None)], "system string, prompt_tokens long, completion_tokens long")
    priced = usage.cost_per_1k(df, input_per_mtok=1.0, output_per_mtok=0.0).first()
    assert priced["cost_status"] == "priced" and priced["cost_per_1k_usd"] == pytest.approx(0.05)
    unpriced = usage.cost_per_1k(df).first()
    assert unpriced["cost_status"] == "unpriced" and unpriced["cost_per_1k_usd"] is None
    free = usage.cost_per_1k(df.filter("prompt_tokens IS NULL"), input_per_mtok=1.0).first()
    assert free["cost_status"] == "priced" and free["cost_per_1k_usd"] is None


def test_retry_folding(spark):
    rows = [
        (1, 0, 503, None, "HTTP 503: a"), (1, 1, 200, "ok", None),
        (2, 0, 401, None, "HTTP 401: b"), (2, 1, 200, "never", None),
        (3, 0, 429, None, "HTTP 429: c"), (3, 1, 500, None, "HTTP 500: d"),
        (4, 0, None, None, "ReadTimeout: e"), (4, 1, None, None, None),
    ]
    df = spark.createDataFrame(rows, "item_id long, attempt int, status int, content string, error string")
    got = {r["item_id"]: (r["content"], r["error"], r["outcome"]) for r in fold_attempts(df).collect()}
    assert got == {
        1: ("ok", None, "success"), 2: (None, "HTTP 401: b", "rejected"),
        3: (None, "HTTP 500: d", "exhausted"), 4: (None, "unknown error", "exhausted"),
    }
