import hashlib
import json

import pytest

from labelyard.operators import labels as L
from labelyard.operators import sampling
from labelyard.operators.gate import prediction_gate
from labelyard.operators.route import route, split_blank
from labelyard.operators.schema import Head, build_schema, collect_heads, schema_fingerprint, schema_from_heads


def test_request_validation(spark):
    with pytest.raises(ValueError, match="no labels"):
        schema_from_heads(spark, [Head("i", [])])
    with pytest.raises(ValueError, match="512"):
        schema_from_heads(spark, [Head("i", [f"l{i}" for i in range(513)])])
    good, bad = split_blank(spark.createDataFrame([(1, " \n\t\u00a0\u2003 "), (2, None), (3, "x")], "item_id long, text string"))
    assert good.count() == 1 and bad.select("reason").distinct().first()[0] == "text is empty"


@pytest.mark.parametrize("heads,body", [
    ([Head("intent", ["b", "a é\"q"])], {"intent": ["b", "a é\"q"]}),
    ([Head("z", ["a"], described={"a": "does A", "0": "x"}), Head("b", ["k"])],
     {"z": {"labels": {"a": "does A", "0": "x"}}, "b": ["k"]}),
    ([Head("t", ["a", "b"], multi_label=True, cls_threshold=0.25)],
     {"t": {"labels": ["a", "b"], "multi_label": True, "cls_threshold": 0.25}}),
])
def test_fingerprint_is_the_hash_of_the_sorted_json(spark, heads, body):
    text = json.dumps(body, sort_keys=True, ensure_ascii=False)
    row = schema_fingerprint(schema_from_heads(spark, heads)).first()
    assert row["schema_json"] == text
    assert row["fingerprint"] == hashlib.sha256(text.encode()).hexdigest()[:16]


def test_schema_precedence(spark):
    labels = spark.createDataFrame([("a", 0, "does A"), ("b", 1, ""), ("c", 2, None)], "label string, ord int, description string")
    described = collect_heads(build_schema(labels, described=True))["intent"]
    assert described.described == {"a": "does A"} and list(described.labels) == ["a"]
    multi = collect_heads(build_schema(labels, described=True, multi_label=True))["intent"]
    assert multi.multi_label and multi.cls_threshold == 0.4 and multi.described is None
    none = build_schema(labels.filter("ord > 0"), described=True)
    assert collect_heads(none)["intent"].described is None and none.count() == 2


def test_label_resolution_order(spark):
    df = spark.createDataFrame([(1, 0), (2, 1), (3, 2), (4, 9), (5, None)], "item_id long, id int")
    names = spark.createDataFrame([(0, "zero", "d0"), (1, "one", None)], "id int, name string, description string")
    got = {r["item_id"]: (r["label"], r["description"]) for r in
           L.resolve_labels(df, "id", names=names, fallback={1: "never", 2: "two"}).collect()}
    assert got == {1: ("zero", "d0"), 2: ("one", ""), 3: ("two", ""), 4: ("9", ""), 5: ("oos", "")}


def test_split_is_disjoint_exhaustive_and_stable(spark):
    labels = spark.createDataFrame([(f"l{i}",) for i in range(77)], "label string")
    first = {r["label"]: r["side"] for r in L.split_labels(labels).collect()}
    again = {r["label"]: r["side"] for r in L.split_labels(labels.repartition(7)).collect()}
    assert first == again and len(first) == 77
    assert sum(s == "a" for s in first.values()) == 38


def test_last_non_blank_description_wins(spark):
    rows = [(1, "a", "old"), (2, "a", "new"), (3, "a", " \t\n"), (4, "b", ""), (5, "b", None)]
    df = spark.createDataFrame(rows, "item_id long, label string, description string")
    assert [tuple(r) for r in L.label_descriptions(df).collect()] == [("a", "new")]


def test_samples(spark, monkeypatch):
    df = spark.range(5000).withColumnRenamed("id", "item_id")
    small = {r[0] for r in sampling.sample_n(df, 1200, seed=3).collect()}
    head = [r[0] for r in sampling.first_n(df.repartition(9), 700).collect()]
    assert sorted(head) == list(range(700)) and sampling.first_n(df, None).count() == 5000
    # The range-filter plan of large samples picks the same rows.
    monkeypatch.setattr(sampling, "TOP_N_ROWS", 10)
    large = {r[0] for r in sampling.sample_n(df.repartition(5), 1200, seed=3).collect()}
    assert large == small and len(small) == 1200
    assert sorted(r[0] for r in sampling.first_n(df, 700).collect()) == list(range(700))
    assert sampling.sample_n(df, 9000, seed=3).count() == 5000
    subsets = sampling.nested_subsets(df, [50, 200])
    assert {r[0] for r in subsets[50].collect()} < {r[0] for r in subsets[200].collect()}
    with pytest.raises(ValueError):
        sampling.first_n(df, -1)


def test_a_subset_beyond_the_table_has_all_its_rows(spark):
    subsets = sampling.nested_subsets(spark.range(30).withColumnRenamed("id", "item_id"), [10, 100])
    assert {size: rows.count() for size, rows in subsets.items()} == {10: 10, 100: 30}


@pytest.mark.parametrize("limit", [0, 1000])
def test_slices_of_text_and_null_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(sampling, "TOP_N_ROWS", limit)
    df = spark.createDataFrame([("b",), (None,), ("d",), ("a",), ("c",)], "item_id string").repartition(3)
    assert {r[0] for r in sampling.first_n(df, 3).collect()} == {None, "a", "b"}
    assert sampling.sample_n(df, 5).count() == 5


@pytest.mark.parametrize("limit", [0, 1000])
def test_label_numbers_hold_nulls_and_any_number_of_labels(spark, monkeypatch, limit):
    monkeypatch.setattr(L, "FETCHED_LABELS", limit)
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a"), (4, "b")], "item_id long, label string")
    assert sorted((r["item_id"], r["label_index"]) for r in L.label_index(df).collect()) == [(1, 2), (2, 0), (3, 1), (4, 2)]


def test_routing(spark):
    texts = ["refund refund my card", "lost card", "nothing here at all", "Café café refund", "", None]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    schema = schema_from_heads(spark, [
        Head("intent", ["refund_request", "card_lost", "cafe"], described={"refund_request": "refund money", "card_lost": "lost card", "cafe": "café"}),
        Head("topics", ["card", "refund"], multi_label=True, cls_threshold=0.3),
    ])
    all_rows = {(r["item_id"], r["head"]): (r["labels"], r["confidence"]) for r in route(items, schema).collect()}
    assert len(all_rows) == 12
    for nothing in (4, 5):
        assert all_rows[(nothing, "intent")] == (["refund_request"], None) and all_rows[(nothing, "topics")] == ([], None)
    assert all_rows[(0, "intent")] == (["refund_request"], pytest.approx(2 / 3))
    assert all_rows[(0, "topics")] == (["card", "refund"], pytest.approx(1 / 3))
    assert all_rows[(2, "intent")] == (["refund_request"], None) and all_rows[(2, "topics")] == ([], None)
    assert all_rows[(3, "intent")] == (["cafe"], pytest.approx(2 / 3))


def test_routing_keeps_equal_ids_zero_thresholds_and_wide_schemas(spark):
    items = spark.createDataFrame([(1, "red green"), (1, "red"), (2, "word299 word7 word7")], "item_id long, text string")
    schema = schema_from_heads(spark, [
        Head("all", ["red", "green", "blue"], multi_label=True, cls_threshold=0.0),
        Head("wide", [f"word{i}" for i in range(300)]),
    ])
    rows = sorted((r["item_id"], r["head"], tuple(r["labels"]), r["confidence"]) for r in route(items, schema).collect() if r["confidence"] is not None)
    every = ("blue", "green", "red")
    assert rows == [(1, "all", every, 0.0), (1, "all", every, 0.0), (2, "wide", ("word7",), pytest.approx(2 / 3))]
    assert route(items, schema).count() == 6


def test_gate(spark):
    schema = schema_from_heads(spark, [Head("i", ["a", "b"]), Head("m", ["x"], multi_label=True)])
    rows = [(1, "i", ["a"], 0.5), (1, "m", ["x"], None), (2, "i", ["q"], 1.5), (2, "m", [], 0.1), (3, "i", ["b"], float("nan"))]
    df = spark.createDataFrame(rows, "item_id long, head string, labels array<string>, confidence double")
    got = sorted((r["rule"], r["item_id"], r["head"]) for r in prediction_gate(df, schema).collect())
    items = spark.createDataFrame([(1,), (2,), (3,), (4,)], "item_id long")
    silent = {(r["item_id"], r["head"]) for r in prediction_gate(df, schema, items).collect() if r["rule"] == "head_missing"}
    assert silent == {(3, "m"), (4, "i"), (4, "m")}
    assert got == [("confidence_out_of_range", 2, "i"), ("confidence_out_of_range", 3, "i"),
                   ("empty_multi_label", 2, "m"), ("head_missing", 3, "m"), ("label_outside_schema", 2, "i")]
