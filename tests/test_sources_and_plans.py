from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelyard.operators import arms, features
from labelyard.operators.schema import Head, build_schema, schema_from_heads
from labelyard.operators.supervised import build_arm
from labelyard.plans import run_panel, schema_swap, score_panel
from labelyard.sources import (
    available_fixtures, build_manifest, cached_predictions, load_or_fit, read_fixture, read_manifest,
    read_train, write_fixture, write_manifest,
)
from labelyard.streaming import stream_replies

from conftest import items_of, predictions_of

TEXTS = [("the cat sat with the dog", "en"), ("le chat et les chiens", "fr"), ("the end of it", "en"),
         ("pour une fois le", "fr"), ("it is the one", "en"), ("nothing known", "fr")]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(i, t, [g], g) for i, (t, g) in enumerate(TEXTS)]
    return spark.createDataFrame(rows, "item_id long, text string, gold array<string>, label string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([("en", 0, "the of it is with"), ("fr", 1, "le et les une pour")], "label string, ord int, description string")


def test_csv_keeps_quotes_breaks_and_na(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('text,label_id,label,description\n"two\nlines, ""q""",1,a,desc\nNA,2,b,\n,3,a,\n')
    rows = read_fixture(spark, str(path)).orderBy("item_id").collect()
    assert [(r["text"], r["label"], r["description"]) for r in rows] == [
        ('two\nlines, "q"', "a", "desc"), ("NA", "b", ""), ("", "a", "")]
    assert read_train(spark, str(path)).count() == 3
    with pytest.raises(FileNotFoundError):
        read_train(spark, str(tmp_path / "absent.csv"))


def test_manifest_counts_null_labels_as_empty(spark):
    items = spark.createDataFrame([("a",), (None,), ("",)], "label string")
    row = build_manifest(items, "t").first()
    assert (row["n"], row["n_labels"], row["labels"], row["class_counts"]) == (3, 2, ["", "a"], {"": 2, "a": 1})


def test_manifest_files(spark, texts, tmp_path):
    assert read_manifest(spark, str(tmp_path / "x.manifest.json")) is None
    assert available_fixtures(spark, str(tmp_path)).count() == 0
    for name in ("b", "a"):
        write_manifest(build_manifest(texts, name, note=f"note {name}"), f"{tmp_path}/{name}.manifest.json")
    listed = available_fixtures(spark, str(tmp_path)).collect()
    assert [(r["name"], r["n"], r["n_labels"]) for r in listed] == [("a", 6, 2), ("b", 6, 2)]
    row = read_manifest(spark, f"{tmp_path}/a.manifest.json").first()
    assert row["class_counts"] == {"en": 3, "fr": 3} and row["labels_with_description"] == []


def test_partitioned_fixture(spark, texts, tmp_path):
    write_fixture(texts.withColumn("fixture", F.lit("f1")), str(tmp_path / "p"), by_fixture=True)
    assert spark.read.parquet(str(tmp_path / "p")).filter("fixture = 'f1'").count() == 6


def test_cache_scores_only_what_is_missing(spark, texts, labels, tmp_path):
    seen = []

    def score(df):
        seen.append(sorted(r[0] for r in df.select("item_id").collect()))
        return df.select("item_id", F.lit("intent").alias("head"), F.array(F.lit("en")).alias("labels"), F.lit(1.0).alias("confidence"))

    run = dict(score=score, system="s", path=str(tmp_path / "cache"))
    plain = build_schema(labels)
    cached_predictions(texts.filter("item_id < 4"), plain, **run)
    assert cached_predictions(texts, plain, **run).count() == 6
    changed = texts.withColumn("text", F.when(F.col("item_id") == 2, "other").otherwise(F.col("text")))
    assert cached_predictions(changed, plain, **run).count() == 6
    cached_predictions(texts, build_schema(labels, described=True), **run)
    assert seen == [[0, 1, 2, 3], [4, 5], [2], [0, 1, 2, 3, 4, 5]]


def test_bulk_and_external_arms(spark, texts, labels):
    schema = build_schema(labels, described=True)
    raw = arms.classify_many(texts, schema, arms.lexical_scorer, system="lex", batch_size=2)
    got = {r["item_id"]: (r["labels"], r["confidence"]) for r in arms.predictions_of(raw).collect()}
    assert got[0] == (["en"], 1.0) and got[5] == (["en"], None) and len(got) == 6

    def client_factory():
        def call(text, names):
            if "end" in text:
                raise TimeoutError
            if "dog" in text:
                raise RuntimeError("boom")
            return {"content": names[0], "prompt_tokens": 3, "completion_tokens": None}
        return call

    out = {r["item_id"]: r for r in arms.score_external(texts, ["en", "fr"], client_factory, system="x", concurrency=2).collect()}
    assert len(out) == 6 and out[2]["error"] == "timeout" and out[0]["error"] == "RuntimeError: boom"
    assert out[1]["content"] == "en" and out[1]["prompt_tokens"] == 3 and out[1]["completion_tokens"] is None


def test_tfidf_definition(spark, texts):
    rows = features.tfidf(texts).collect()
    docs = {}
    for i, (t, _) in enumerate(TEXTS):
        w = t.split()
        terms = w + [f"{a} {c}" for a, c in zip(w, w[1:])]
        docs[i] = {x: terms.count(x) for x in terms}
    df = {}
    for d in docs.values():
        for x in d:
            df[x] = df.get(x, 0) + 1
    for i, d in docs.items():
        raw = {x: (1 + np.log(c)) * (np.log(7 / (1 + df[x])) + 1) for x, c in d.items()}
        norm = np.sqrt(sum(v * v for v in raw.values()))
        got = {r["term"]: r["weight"] for r in rows if r["item_id"] == i}
        assert got == pytest.approx({x: v / norm for x, v in raw.items()})


def test_embedding_arm_is_closed_and_reloads(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(3 * (i % 2), 1, 4)], "ab"[i % 2]) for i in range(60)]
    train = spark.createDataFrame(rows, "item_id long, embedding array<float>, label string")
    arm = load_or_fit(spark, "embedding", train, str(tmp_path / "arm"))
    again = load_or_fit(spark, "embedding", train, str(tmp_path / "arm"))
    assert again.labels == ["a", "b"] and again.trained_on == 60
    one, two = (sorted((r["item_id"], r["labels"][0]) for r in m.predict(train).collect()) for m in (arm, again))
    assert one == two and sum(l == "ab"[i % 2] for i, l in one) > 55
    with pytest.raises(ValueError, match="unknown baseline"):
        build_arm("nope", train)


def test_pooling_ignores_masked_tokens(spark):
    rows = [(1, [1.0, 2.0], 1), (1, [3.0, 6.0], 1), (1, [100.0, 100.0], 0), (2, [5.0, 5.0], 0)]
    df = spark.createDataFrame(rows, "item_id long, vector array<float>, mask int")
    got = {r["item_id"]: r["pooled"] for r in features.masked_mean_pool(df).collect()}
    assert got == {1: [2.0, 4.0], 2: [0.0, 0.0]}


def test_panel_pairs_and_floor(spark):
    items = items_of(spark, ["a"] * 50)
    preds = predictions_of(spark, good=["a"] * 50, poor=["b"] * 50)
    result = score_panel(items, preds, {"good": "zero_shot", "poor": "supervised"}, name="f")
    rows = {r["name"]: r for r in result.systems.collect()}
    assert set(rows) == {"good", "poor", "majority class (a)"}
    assert rows["majority class (a)"]["ci_low"] is None and rows["good"]["accuracy"] == 1.0
    (pair,) = result.comparisons.collect()
    assert (pair["a"], pair["b"], pair["diff"], pair["significant"], pair["mcnemar"]["b"]) == ("good", "poor", 1.0, True, 50)
    with pytest.raises(ValueError):
        score_panel(items, preds.filter("NOT (system = 'poor' AND item_id = 1)"), {"good": "zero_shot", "poor": "supervised"})


def test_run_panel_reports_what_could_not_run(spark, texts, labels):
    def no_train():
        raise FileNotFoundError("missing train.csv")

    replies = spark.createDataFrame([(i, g if i else "??", 10.0 + i, 5, 1, None) for i, (_, g) in enumerate(TEXTS)],
                                    "item_id long, content string, latency_ms double, prompt_tokens long, completion_tokens long, error string")
    result = run_panel(
        texts, labels, name="f", limit=5, train=no_train, replies=replies,
        systems=["zero_shot", "zero_shot_described", "tfidf", "external"],
    )
    rows = {r["name"]: r for r in result.systems.collect()}
    assert rows["Word overlap + label descriptions"]["accuracy"] == 1.0
    external = rows["External model (zero-shot)"]
    assert external["accuracy"] == 0.8 and external["cost_status"] == "unpriced" and external["p95_ms"] == 14.0
    assert "1 replies unusable, counted as wrong" in external["notes"]
    assert rows["majority class (en)"]["n"] == 5
    assert [tuple(r) for r in result.unavailable.collect()] == [("TF-IDF + logistic regression", "missing train.csv")]
    assert result.comparisons.count() == 2
    with pytest.raises(ValueError, match="unknown systems"):
        run_panel(texts, labels, systems=["x"])


def test_a_panel_ends_with_the_failure_of_an_arm(spark, texts, labels):
    """A fit that fails is no reason beside the other systems; only training rows that do not exist are."""
    def broken():
        return spark.read.parquet("/nowhere/train.parquet")

    one_label = texts.filter("label = 'en'").select("item_id", "text", "label")
    for train, message in ((lambda: one_label, "two labels"), (broken, "PATH_NOT_FOUND")):
        with pytest.raises(Exception, match=message):
            run_panel(texts, labels, name="f", train=train, systems=["zero_shot", "tfidf"])


def test_swap_scores_each_side_on_its_own_labels(spark, texts, labels):
    rows = {r["side"]: r for r in schema_swap(texts, labels, described=True).collect()}
    assert {r["n_labels"] for r in rows.values()} == {1} and all(r["accuracy"] == 1.0 for r in rows.values())
    only_en = {r["side"]: r for r in schema_swap(texts.filter("label = 'en'"), labels, described=True).collect()}
    assert sorted(r["error"] is None for r in only_en.values()) == [False, True]


def test_a_transfer_that_fails_is_no_row(spark, texts):
    from labelyard.plans import supervised_transfer

    four = spark.createDataFrame([(name, i) for i, name in enumerate("abcd")], "label string, ord int")
    rows = spark.createDataFrame([(i, f"{'abcd'[i % 4]} word", "abcd"[i % 4]) for i in range(16)], "item_id long, text string, label string")
    asked = supervised_transfer(rows, lambda: rows, four).first()
    assert (asked["n"], asked["answers_in_b"], asked["supervised_trained_on"], asked["error"]) == (8, 0, 8, None)

    def missing():
        raise FileNotFoundError("no train split")

    assert supervised_transfer(rows, missing, four).first()["error"] == "FileNotFoundError: no train split"
    with pytest.raises(ValueError, match="two labels"):
        supervised_transfer(rows, rows.filter("label = 'a'"), four)
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        supervised_transfer(rows, lambda: spark.read.parquet("/nowhere/train.parquet"), four)


def test_reply_stream_equals_batch(spark, tmp_path):
    rows = [(i, c) for i, c in enumerate(["en", "FR.", "neither"])]
    df = spark.createDataFrame(rows, "item_id long, content string")
    df.write.parquet(str(tmp_path / "in"))
    live = stream_replies(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), ["en", "fr"])
    live.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")) \
        .trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()
    got = sorted((r["item_id"], r["label"]) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [(0, "en"), (1, "fr"), (2, None)]


def test_task_side_scorer_matches_native_route(spark, texts, labels):
    from labelyard.operators.route import route

    schema = build_schema(labels, described=True)
    native = sorted((r["item_id"], r["labels"]) for r in route(texts, schema).collect())
    raw = arms.classify_many(texts, schema, arms.lexical_scorer, system="lex")
    assert sorted((r["item_id"], r["labels"]) for r in arms.predictions_of(raw).collect()) == native
    assert schema_from_heads(spark, [Head("x", ["a"])]).count() == 1


def test_dataset_specs_and_panel_tables(spark, tmp_path):
    from labelyard.sources import DATASETS, ingest

    rows = [(i, f"t{i}", i % 3 if i else None) for i in range(30)]
    tweets = spark.createDataFrame(rows, "item_id long, tweet string, class int")
    out = ingest(tweets, DATASETS["hate_speech"])
    assert {r[0] for r in out.select("label").distinct().collect()} == {"oos", "hate_speech", "offensive", "neither"}
    mail = spark.createDataFrame([(1, "x", 1, "spam"), (2, "y", None, "ham")], "item_id long, text string, label int, label_text string")
    assert sorted(r["label"] for r in ingest(mail, DATASETS["enron_spam"]).collect()) == ["oos", "spam"]

    result = score_panel(items_of(spark, ["a", "b"]), predictions_of(spark, s=["a", "a"]), {"s": "zero_shot"})
    result.write(str(tmp_path / "panel"))
    assert spark.read.parquet(str(tmp_path / "panel" / "systems")).count() == 2
    assert spark.read.parquet(str(tmp_path / "panel" / "comparisons")).count() == 0


def test_text_arm_reaches_the_optimum_over_the_whole_vocabulary(spark, tmp_path):
    """Every class is at the optimum, terms of one item included, and the features are those of ``tfidf``."""
    from labelyard.operators.supervised import GRADIENT_BOUND, FittedArm, fit_arm, optimality

    rng = np.random.default_rng(4)
    words = {"a": ["red", "blue", "green"], "b": ["one", "two", "three"], "c": ["cat", "dog", "blue"]}
    rows = [(i, " ".join(rng.choice(words[y], 6)) + f" own{i} it{i}", y) for i, y in enumerate(rng.choice(["a", "a", "b", "c"], 60).tolist())]
    rows += [(1000, "", "a"), (1001, "?!", "b")]
    for labels in (["a", "b", "c"], ["a", "b"]):
        train = spark.createDataFrame([r for r in rows if r[2] in labels], "item_id long, text string, label string")
        arm = fit_arm("tfidf", train)
        assert arm.labels == labels and all(r["gradient"] < GRADIENT_BOUND for r in optimality(arm, train).collect())
        weights = {(r["item_id"], r["term"]): r["weight"] for r in features.tfidf(train).collect()}
        terms = {r["i"]: r["term"] for r in arm.terms.collect()}
        got = {(r["item_id"], terms[r["i"]]): r["x"] for r in arm.entries(train).collect()}
        assert got == pytest.approx(weights)
        arm.save(str(tmp_path / f"arm{len(labels)}"))
        again = FittedArm.load(spark, str(tmp_path / f"arm{len(labels)}"))
        asked = spark.createDataFrame([(1, "red green", "a"), (2, "", "b"), (3, "nothing known", "b"), (4, "two three", "b")], "item_id long, text string, label string")
        one, two = ({r["item_id"]: (r["labels"][0], r["confidence"]) for r in m.predict(asked).collect()} for m in (arm, again))
        assert one == two and one[1][0] == "a" and one[4][0] == "b" and one[2] == pytest.approx(one[3])
    with pytest.warns(UserWarning, match="stopped after 2 steps"):
        fit_arm("tfidf", train, max_iter=2)
    hashed = fit_arm("tfidf", train, num_features=16)
    assert hashed.terms.count() <= 16 and all(r["gradient"] < GRADIENT_BOUND for r in optimality(hashed, train).collect())
    with pytest.raises(ValueError, match="two labels"):
        fit_arm("tfidf", train.filter("label = 'a'"))


def test_optimiser_sums_large_gradients_in_blocks(spark, monkeypatch):
    from labelyard.operators import logistic

    rng = np.random.default_rng(5)
    rows = [(float(i % 3), 1.0 + i % 2, [int(k) for k in rng.choice(40, 5, replace=False)], rng.random(5).tolist()) for i in range(50)] + [(0.0, 1.0, [], [])]
    table = spark.createDataFrame(rows, "label_index double, weight double, indices array<bigint>, values array<double>").repartition(3)
    theta = rng.normal(size=41 * 3)
    direct = logistic.Objective(table, 40, 3, 0.1, 51.0).at(theta)
    monkeypatch.setattr(logistic, "DIRECT_BYTES", 0)
    monkeypatch.setattr(logistic, "BLOCK", 16)
    summed = logistic.Objective(table, 40, 3, 0.1, 51.0).at(theta)
    assert direct[0] == pytest.approx(summed[0]) and direct[1] == pytest.approx(summed[1])
    step = np.zeros(len(theta))
    step[7] = 1e-6
    up, down = (logistic.Objective(table, 40, 3, 0.1, 51.0).at(theta + sign * step)[0] for sign in (1, -1))
    assert direct[1][7] == pytest.approx((up - down) / 2e-6, rel=1e-4)


def test_text_fit_holds_numbers_by_item_and_not_by_term(spark, monkeypatch):
    """A vocabulary larger than what the driver may hold; steep columns and equal or missing ids lead to the same optimum."""
    from labelyard.operators import supervised

    rng = np.random.default_rng(7)
    words = [f"w{i}" for i in range(400)]
    rows = [(i // 2 if i < 8 else i, " ".join([y * 2, *rng.choice(words, 30)]), y) for i, y in enumerate(rng.choice(["a", "b", "c"], 50).tolist())]
    rows.append((None, "aa w1 w2", "a"))
    train = spark.createDataFrame(rows, "item_id long, text string, label string")
    monkeypatch.setattr(supervised, "MAX_WEIGHTS", 200)
    for steep in (4.0, 0.5):
        monkeypatch.setattr(supervised, "STEEP", steep)
        arm = supervised.fit_arm("tfidf", train.filter("item_id >= 4"))
        assert arm.terms.filter("df > 1").count() > 200
        assert all(r["gradient"] < supervised.GRADIENT_BOUND for r in supervised.optimality(arm, train.filter("item_id >= 4")).collect())
    assert supervised.fit_arm("tfidf", train).trained_on == 51
    with pytest.raises(ValueError, match="too many"):
        supervised.fit_arm("tfidf", train.unionByName(train))


def test_text_fit_reads_numbers_by_item_in_stretches(spark, monkeypatch):
    """Stretches, blocks and broadcasts of a few numbers give the same arm, with ids that come often or are missing."""
    from labelyard.operators import logistic, supervised

    rng = np.random.default_rng(11)
    words = [f"w{i}" for i in range(60)]
    rows = [(None if i < 3 else min(i // 3, 12), " ".join([y * 2, *rng.choice(words, 12)]), y) for i, y in enumerate(rng.choice(["a", "b", "c"], 60).tolist())]
    train = spark.createDataFrame(rows, "item_id long, text string, label string")

    def weights():
        arm = supervised.fit_arm("tfidf", train)
        return np.array([[r["df"], *r["w"]] for r in arm.terms.orderBy("term").collect()]), arm.intercepts

    whole = weights()
    for name, value in (("STRETCH", 4), ("SENT", 1), ("BLOCK", 40), ("DIRECT_BYTES", 0), ("FETCHED_BYTES", 0)):
        monkeypatch.setattr(logistic, name, value)
    parts = weights()
    assert parts[0] == pytest.approx(whole[0], abs=1e-4) and parts[1] == pytest.approx(whole[1], abs=1e-4)


def test_driver_of_an_optimiser_holds_few_numbers_by_item(spark, monkeypatch):
    """Remembered steps are no longer in its memory: each would be four numbers by item and label."""
    import tracemalloc

    from labelyard.operators import logistic

    monkeypatch.setattr(logistic, "STRETCH", 1 << 14)
    rng, n, k = np.random.default_rng(12), 150_000, 3
    rows = []
    for _ in range(4):
        keys = np.concatenate([np.sort(rng.choice(n, 500, replace=False)) for _ in range(40)]).astype(np.int32)
        rows.append([np.full(40, -1, np.int32), np.arange(40, dtype=np.int32) * 500, keys, np.abs(rng.normal(size=len(keys)))])
    table = spark.createDataFrame([tuple(bytearray(x.tobytes()) for x in row) for row in rows], "slots binary, starts binary, keys binary, values binary")
    columns = logistic.Columns(table, np.arange(n), np.zeros(n))
    kernel = logistic.Kernel(columns, rng.integers(0, k, n), np.ones(n), k, np.zeros(0), 1 / n, float(n))
    tracemalloc.start()
    try:
        with pytest.warns(UserWarning, match="stopped after 8 steps"):
            logistic.minimise(kernel, 8, 0.0, "x")
        assert tracemalloc.get_traced_memory()[1] < 12 * 8 * n * k
    finally:
        tracemalloc.stop()


def test_terms_are_counted_some_items_at_a_time(monkeypatch):
    """Pairs stay within a text; an item with more words than are counted at a time, empty lists and missing ids."""
    import pyarrow as pa

    asked = [(1, [["ab", "cd", "ab"], ["cd", "ef"]]), (None, [["ab", "xy"], []]), (2, []), (3, [[]]), (4, [["cd"] * 9]), (5, [["ab"]])]
    batch = pa.RecordBatch.from_arrays([pa.array([i for i, _ in asked]), pa.array([w for _, w in asked], pa.list_(pa.list_(pa.string())))], ["item_id", "words"])
    want = sorted((str(i), term, n) for i, lists in asked for term, n in Counter(t for w in lists for t in [*w, *map(" ".join, zip(w, w[1:]))]).items())
    for words in (1, 4, 1000):
        monkeypatch.setattr(features, "WORDS", words)
        got = [(str(r["item_id"]), r["term"], r["tf"]) for part in features._counted(iter([batch.slice(0, 2), batch.slice(2)])) for r in part.to_pylist()]
        assert sorted(got) == want


def test_occurrences_are_packed_many_terms_to_a_row(spark, monkeypatch):
    """Rows end between terms, whatever their size, and every term is in one row."""
    rows = [(i, f"t{i * j % 7}", 1 + j) for i in range(30) for j in range(3) if i * j % 7 or not j]
    counts = spark.createDataFrame(rows, "item_id int, term string, tf long")
    for chunk in (4, 1 << 16):
        monkeypatch.setattr(features, "CHUNK", chunk)
        stored, got = features.packed_occurrences(counts).collect(), []
        for r in stored:
            starts, items, tfs = np.frombuffer(r["starts"], np.int32), np.frombuffer(r["items"], np.int32), np.frombuffer(r["tfs"])
            assert r["n"] == len(r["terms"]) == len(starts)
            got += [(int(i), r["terms"][at], int(tf)) for at, start in enumerate(starts) for i, tf in zip(*(np.split(x, starts[1:])[at] for x in (items, tfs)))]
        assert sorted(got) == sorted(rows) and len({(r["part"], r["chunk"]) for r in stored}) == len(stored)
        assert sum(r["n"] for r in stored) == len({r[1] for r in rows})


def test_tfidf_ships_each_occurrence_once(spark, monkeypatch):
    """One exchange of the occurrences; ids that come twice or are missing, and norms too many to broadcast."""
    rows = [(1, "ab cd ab"), (1, "cd ef"), (None, "ab xy"), (None, "ab"), (2, None), (3, "cd")]
    items = spark.createDataFrame(rows, "item_id long, text string")
    found = features.tfidf(items)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") == 2 and "Window" not in plan  # once for the norms, the same exchange
    got = sorted((str(r["item_id"]), r["term"], r["tf"], r["df"], round(r["weight"], 9)) for r in found.collect())
    monkeypatch.setattr(features, "NORM_ROWS", 0)
    assert got == sorted((str(r["item_id"]), r["term"], r["tf"], r["df"], round(r["weight"], 9)) for r in features.tfidf(items).collect())
    assert [x[:4] for x in got if x[0] == "1"] == [("1", "ab", 2, 2), ("1", "ab cd", 1, 1), ("1", "cd", 2, 2), ("1", "cd ab", 1, 1), ("1", "cd ef", 1, 1), ("1", "ef", 1, 1)]
    assert ("None", "ab", 2, 2) in [x[:4] for x in got]


def test_tfidf_meets_in_blocks(spark, monkeypatch):
    """Many parts, tasks that deal out few occurrences at a time, string ids: the weights by their definition, no join by broadcast."""
    import math

    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(40)]
    texts = {f"d{i}" if i else None: " ".join(rng.choice(words, int(rng.integers(1, 30)))) for i in range(50)}
    items = spark.createDataFrame(list(texts.items()), "item_id string, text string")
    counts = {i: Counter([*text.split(), *map(" ".join, zip(text.split(), text.split()[1:]))]) for i, text in texts.items()}
    df = Counter(term for held in counts.values() for term in held)
    raw = {(i, term): (1 + math.log(tf)) * (math.log(51 / (1 + df[term])) + 1) for i, held in counts.items() for term, tf in held.items()}
    norm = {i: math.sqrt(sum(raw[i, term] ** 2 for term in held)) for i, held in counts.items()}
    for name, value in (("DEALT", 7), ("PART_CHARS", 100), ("CHUNK", 3)):
        monkeypatch.setattr(features, name, value)
    found = features.tfidf(items)
    got = {(r["item_id"], r["term"]): r for r in found.collect()}
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert set(got) == set(raw) and found.count() == len(raw)
    for (i, term), r in got.items():
        assert (r["tf"], r["df"]) == (counts[i][term], df[term]) and r["weight"] == pytest.approx(raw[i, term] / norm[i])


def test_text_arm_predicts_from_blocks_as_from_rows(spark, monkeypatch):
    """Answers by blocks of terms are those of the joined rows, for whole numbers, strings, missing ids and unknown words."""
    from labelyard.operators import supervised

    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(50)]
    rows = [(i, " ".join([y * 2, *rng.choice(words, 8)]), y) for i, y in enumerate(rng.choice(["a", "b", "c"], 60).tolist())]
    arm = supervised.fit_arm("tfidf", spark.createDataFrame(rows, "item_id long, text string, label string"))
    asked = [(i if i else None, " ".join(rng.choice([*words, "aa", "bb", "new"], int(rng.integers(0, 9))))) for i in range(40)] + [(50, None), (51, "unknown")]
    monkeypatch.setattr(features, "DEALT", 9)
    monkeypatch.setattr(features, "PART_CHARS", 50)
    for kind in ("long", "string"):
        items = spark.createDataFrame([(i if i is None or kind == "long" else str(i), t) for i, t in asked], f"item_id {kind}, text string")
        shares = arm.shares(items)
        assert "BroadcastHashJoin" not in shares._jdf.queryExecution().optimizedPlan().toString()
        by_blocks = {r["item_id"]: r["p"] for r in shares.collect()}
        by_rows = {r["item_id"]: r["p"] for r in arm.scored(items, features.term_counts(items)).collect()}
        assert set(by_blocks) == set(by_rows) and len(by_blocks) == 42
        assert all(by_blocks[i] == pytest.approx(by_rows[i]) for i in by_rows)


def test_packed_rows_are_read_a_few_at_a_time(spark, texts, monkeypatch):
    """A reader holds a row group, so the packed rows of a text fit are stored a few to a group."""
    import pyarrow.parquet as pq

    from labelyard import sizing
    from labelyard.operators import supervised

    stored = {}
    monkeypatch.setattr(features, "CHUNK", 4)
    monkeypatch.setattr(sizing, "WIDE_ROWS", 2)
    monkeypatch.setattr(supervised, "materialise", lambda df, name, *a, **b: stored.setdefault(name, sizing.materialise(df, name, *a, **b)))
    supervised.fit_arm("tfidf", texts.select("item_id", "text", "label"))
    for name in ("occurrences", "columns"):
        groups = [g for f in stored[name].inputFiles() for m in [pq.ParquetFile(f.removeprefix("file://")).metadata] for g in map(m.row_group, range(m.num_row_groups))]
        assert len(groups) > 1 and max(g.num_rows for g in groups) <= 2
    assert stored["occurrences"].count() > 8


def test_concurrent_cache_runs_double_nothing(spark, texts, labels, tmp_path):
    """A run that commits while another one is scoring; the later one leaves out what the first has committed."""
    from labelyard.sources.cache import Runs, _entries

    path, schema = str(tmp_path / "cache"), build_schema(labels)

    def answer(df, said):
        return df.select("item_id", F.lit("intent").alias("head"), F.array(F.lit(said)).alias("labels"), F.lit(1.0).alias("confidence"))

    def slow(df):
        inner = cached_predictions(texts.filter("item_id < 3"), schema, lambda d: answer(d, "first"), system="s", path=path)
        assert inner.count() == 3
        return answer(df, "second")

    assert cached_predictions(texts, schema, slow, system="s", path=path).count() == 6
    cached_predictions(texts, schema, lambda d: answer(d, "other"), system="t", path=path)
    got = cached_predictions(texts, schema, lambda d: pytest.fail("scored again"), system="s", path=path).collect()
    assert sorted((r["item_id"], r["labels"][0]) for r in got) == [(i, "first" if i < 3 else "second") for i in range(6)]
    number, runs = Runs(spark, path, "s", "", _entries(texts.schema["item_id"].dataType)).committed()
    assert number == 3 and len(runs) == 3


def test_panel_keeps_arms_and_answers(spark, texts, labels, tmp_path):
    train = spark.createDataFrame([(100 + i, t, g) for i, (t, g) in enumerate(TEXTS * 3)], "item_id long, text string, label string")
    options = dict(systems=["zero_shot_described", "tfidf"], train=lambda: train, limit=None, cache=str(tmp_path / "kept"))
    first, again = (run_panel(texts, labels, **options) for _ in range(2))
    one, two = ({r["name"]: r for r in p.systems.collect()} for p in (first, again))
    assert one == two and len(one) == 3  # equal latencies too: nothing was measured anew
    assert all(r["p50_ms"] is not None and r["p95_ms"] is not None for n, r in one.items() if "majority" not in n)
    assert len(list((tmp_path / "kept" / "predictions" / "commits").glob("*.json"))) == 2
    options["train"] = lambda: train.filter("item_id < 115")
    run_panel(texts, labels, **options)
    assert len(list((tmp_path / "kept" / "arms").iterdir())) == 2
    assert len(list((tmp_path / "kept" / "predictions" / "commits").glob("*.json"))) == 3


def test_external_calls_resume_from_their_log(spark, texts, tmp_path):
    """A job that fails keeps the replies of finished tasks; a later run asks only for the others, in tasks of bounded size."""
    asked = tmp_path / "asked"
    asked.mkdir()
    log = str(tmp_path / "log")

    def client(broken: bool):
        def factory():
            def call(text, names):
                (asked / f"{len(list(asked.iterdir()))}-{text[:6].strip()}-{np.random.default_rng().integers(1 << 60)}").touch()
                if broken and "maison" in text:
                    raise SystemExit("the task dies")
                return {"content": names[0], "prompt_tokens": 1, "completion_tokens": None}
            return call
        return factory

    options = dict(system="x", concurrency=2, log=log, items_per_task=1)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(["the house", "la maison", "the dog", "the cat", None, ""])] + [(0, "the house")], "item_id long, text string")
    with pytest.raises(Exception):
        arms.score_external(rows, ["en"], client(True), **options).collect()
    before = len(list(asked.iterdir()))
    kept = sum(r["item_id"] != 1 for r in spark.read.option("recursiveFileLookup", "true").parquet(log).collect())
    got = arms.score_external(rows, ["en"], client(False), **options).collect()
    assert sorted(r["item_id"] for r in got) == [0, 0, 1, 2, 3, 4, 5] and all(r["content"] == "en" for r in got)
    assert len(list(asked.iterdir())) - before == 6 - kept
    arms.score_external(rows, ["en"], client(False), **options).collect()
    assert len(list(asked.iterdir())) - before == 6 - kept  # nothing is asked again
    arms.score_external(rows.withColumn("text", F.lit("changed")), ["en"], client(False), **options).collect()
    assert len(list(asked.iterdir())) - before == 12 - kept


def test_schemas_of_many_heads(spark):
    from labelyard.operators.schema import Head, collect_heads, schema_from_heads

    assert len(collect_heads(schema_from_heads(spark, [Head(f"h{i}", ["a", "b"]) for i in range(200)]))) == 200


def test_csv_records_are_the_same_for_any_split(spark, tmp_path):
    """Quoted line breaks, doubled quotes, carriage returns and blank lines, in several files and tasks of a few bytes."""
    import csv

    from labelyard.sources import fixtures

    rng = np.random.default_rng(2)
    pieces = ["a", "\n", '"', ",", "\r\n", "ü", " ", "NA", "\n\n"]
    want = {}
    for number in range(2):
        rows = [["".join(rng.choice(pieces, int(rng.integers(1, 9)))), f"l{i % 3}"] for i in range(120)]
        with open(tmp_path / f"part{number}.csv", "w", newline="", encoding="utf-8") as out:
            writer = csv.writer(out, lineterminator="\r\n" if number else "\n")
            writer.writerows([["text", "label"], *rows])
            out.write("\n")
        want |= {(number << 40) + i: tuple(row) for i, row in enumerate(rows)}
    path = str(tmp_path / "*.csv")
    seen = []
    for size in ("134217728", "64"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            records = fixtures.csv_records(spark, path)
            seen.append(records.select("file").distinct().count())
            tasks = spark.read.text(path).rdd.getNumPartitions()
            got = {r["item_id"]: (r["text"], r["label"]) for r in fixtures.read_train(spark, path).collect()}
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
        assert got == want and seen[-1] == 2
    assert tasks > 10
