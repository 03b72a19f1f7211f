"""Column mappings of the public datasets the evaluation is usually run on.

The tables themselves are loaded by the caller; every table needs a row key.
"""

from __future__ import annotations

from .fixtures import IngestSpec

# --- fixed values -----------------------------------------------------------------
DATASETS = {
    "banking77": IngestSpec(
        "banking77", text="utterance", label="label", key="item_id", n=1500,
        repo="DeepPavlov/banking77", note="bank customer intents with descriptions",
    ),
    "clinc150": IngestSpec(
        "clinc150", text="utterance", label="label", key="item_id", n=1500,
        repo="DeepPavlov/clinc150", note="intents with out-of-scope utterances",
    ),
    "hate_speech": IngestSpec(
        "hate_speech", text="tweet", label="class", key="item_id", n=1500,
        label_names={0: "hate_speech", 1: "offensive", 2: "neither"},
        repo="tdavidson/hate_speech_offensive", split="train", note="three classes",
    ),
    "yelp": IngestSpec(
        "yelp", text="text", label="label", key="item_id", n=1000,
        label_names={0: "negative", 1: "neutral", 2: "positive"},
        repo="bespokelabs/yelp_restaurant_reviews_5k", split="train", note="review sentiment",
    ),
    "enron_spam": IngestSpec(
        "enron_spam", text="text", label="label", key="item_id", n=1000, label_text="label_text",
        repo="SetFit/enron_spam", note="mail: spam or ham",
    ),
}

# Rows of the train split, for the datasets that have one.
TRAIN_ROWS = {"banking77": 10_000, "clinc150": 15_250}
# ------------------------------------------------------------------------------------
