import pytest
from pyspark.sql import functions as F

from labelyard.functions import normalise_payload, normalise_payloads, parse_predictions

SHAPES = {
    '"a"': ["a"], '["a","b"]': ["a", "b"], '{"label":"a","confidence":0.9}': ["a"],
    '[{"label":"a"},{"label":"b"}]': ["a", "b"], "null": [], '{"labels":["b","a","a"]}': ["a", "b"],
    '{"label":null}': [], '{"label":["x",{"label":"y"}]}': ["x", "y"], "7": ["7"], "[]": [],
    '{"other":1}': [], '[null,"z",["q",["r"]]]': ["q", "r", "z"], '{"label":"a","labels":["b"]}': ["a"],
    '{"x":{"label":"no"}}': [],
}


def test_normalise_every_shape(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate(SHAPES)], "i int, p string")
    rows = df.select("i", normalise_payload(F.col("p")).alias("l")).orderBy("i").collect()
    assert [r["l"] for r in rows] == list(SHAPES.values())


def test_too_deep_payload_raises_instead_of_losing_labels(spark):
    df = spark.createDataFrame([('[[[[["a"]]]]]',)], "p string")
    with pytest.raises(Exception, match="nested too deeply"):
        df.select(normalise_payload(F.col("p"))).collect()


@pytest.mark.parametrize("depth", [0, 5, 40])
def test_payload_tables_of_any_depth(spark, depth):
    rows = [("[" * depth + '"a"' + "]" * depth,), ('{"label":' * depth + '["b", "a"]' + "}" * depth,), ('"[[[[[[ \\" ]"',), (None,), ("[" * 9,)]
    got = [r["l"] for r in normalise_payloads(spark.createDataFrame(rows, "p string"), "p", "l").collect()]
    assert got == [["a"], ["a", "b"], ['[[[[[[ " ]'], [], []]


def test_parse_predictions_shapes(spark):
    payloads = [
        '{"intent":"a"}', '{"intent":{"label":"a","confidence":0.5}}',
        '{"t":[{"label":"b","confidence":0.7},{"label":"a","confidence":0.3},{"label":"c","confidence":"NaN"}],"u":null}',
        '[1]', None, '{"i":{"label":null,"confidence":"NaN"},"j":["x","y"]}',
    ]
    df = spark.createDataFrame(list(enumerate(payloads)), "i int, p string")
    got = {(r["i"], r["head"]): (r["labels"], r["confidence"]) for r in parse_predictions(df, "p", ["i"]).collect()}
    assert got == {
        (0, "intent"): (["a"], None), (1, "intent"): (["a"], 0.5), (2, "t"): (["a", "b", "c"], 0.3),
        (2, "u"): ([], None), (5, "i"): ([], None), (5, "j"): (["x", "y"], None),
    }
