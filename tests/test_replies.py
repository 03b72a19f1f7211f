import pytest
from pyspark.sql import functions as F

from labelyard.functions import build_prompt, extract_label, reply_cost, reply_record

LABELS = ["card_lost", "card_pin_change", "balance_inquiry", "transfer_pending", "refund_request"]

ACCEPTED = {
    "card_lost": "card_lost", "   card_lost   ": "card_lost", '"card_lost"': "card_lost",
    "'card_lost'": "card_lost", "`card_lost`": "card_lost", "card_lost.": "card_lost",
    "```\ncard_lost\n```": "card_lost", "CARD_LOST": "card_lost", "0": "card_lost",
    "3": "transfer_pending", "The answer is card_pin_change.": "card_pin_change",
    "card_lost\nand then some chatter": "card_lost", "card-lost": "card_lost",
    "card lost": "card_lost", "refund_request.": "refund_request", "\u00a0card_lost\u2003": "card_lost",
}
REJECTED = [
    "banana", "9", "", "   ", "unknown_intent", "the customer is unhappy", "99999999999999999999",
    "definitely_refund_request_here_but_not_a_label", "this looks like a refund issue",
    "The customer is unhappy\ntransfer_pending", "` `\ncard_lost", None,
]


def extract(spark, replies, labels):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(replies)], "i int, r string")
    rows = df.select("i", extract_label(F.col("r"), labels).alias("l")).orderBy("i").collect()
    return [r["l"] for r in rows]


def test_accepts_cosmetic_variants(spark):
    assert extract(spark, list(ACCEPTED), LABELS) == list(ACCEPTED.values())


def test_rejects_everything_else(spark):
    assert extract(spark, REJECTED, LABELS) == [None] * len(REJECTED)


def test_capitalisation_and_separators_on_either_side(spark):
    labels = ["Refund_not_showing_up", "Is it-late?", "other"]
    replies = ["refund_not_showing_up", "is it late", "so: IS-IT-LATE", "Refund_returned_twice"]
    assert extract(spark, replies, labels) == [labels[0], labels[1], labels[1], None]


def test_longest_label_wins(spark):
    assert extract(spark, ["card_lost", "my lost_card_lost", "a card"], ["card", "lost", "card_lost"]) == [
        "card_lost", "card_lost", "card"]


def test_prefix_is_not_an_answer(spark):
    assert extract(spark, ["the customer is unhappy", "theft_report"], ["theft_report", "other"]) == [
        None, "theft_report"]


def test_labels_that_read_the_same_are_refused():
    with pytest.raises(ValueError):
        extract_label(F.lit("x"), ["a-b", "a_b"])


def test_record_and_prompt(spark):
    long = "no\n" * 150
    df = spark.createDataFrame([(long,), ("0",), ("it's bad",)], "c string")
    rows = df.select(reply_record(F.col("c"), LABELS).alias("r")).select("r.*").collect()
    assert len(rows[0]["raw_text"]) == 200 and not rows[0]["valid"]
    assert rows[0]["error"] == f"reply not in label set: {long[:80]!r}"
    assert rows[1]["valid"] and rows[1]["error"] is None
    assert rows[2]["error"] == "reply not in label set: \"it's bad\""
    prompt = df.limit(1).select(build_prompt(F.lit("hi"), ["a", "é"])).first()[0]
    assert prompt == 'Labels:\n["a", "\\u00e9"]\n\nText:\nhi\n\nLabel:'


def test_cost_treats_missing_counts_as_nothing(spark):
    df = spark.createDataFrame([(1_000_000, None), (None, 2_000_000), (None, None)], "p long, c long")
    got = [r[0] for r in df.select(reply_cost(F.col("p"), F.col("c"), 3.0, 0.5)).collect()]
    assert got == [3.0, 1.0, 0.0]
