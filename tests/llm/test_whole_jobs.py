"""Cases in which an operator once did less than its whole job."""

import numpy as np

import corpus_pipeline
from labelyard.llm import robust_quality, toxicity_cnn


def test_the_stage_links_at_five_words_and_eighty_percent(spark):
    """A copy with a fifth appended and one with a changed word in 49 go; the kept rows equal a brute force."""
    def said(name, n):
        return [f"{name}{i}" for i in range(n)]

    texts = [said("a", 100), said("a", 100) + said("tail", 20), said("b", 49), ["c0", "c1"], said("b", 49), said("d", 100), said("d", 100) + said("more", 40)]
    texts[4][22] = "changed"
    texts += [said("e", 24), said("e", 30), ["c0", "c1"]]  # 20 of 26 shingles are below 80 %
    sets = [{tuple(t[i:i + 5]) for i in range(max(1, len(t) - 4))} for t in texts]
    label = list(range(len(sets)))
    for i, x in enumerate(sets):
        for j in range(i):
            if 100 * len(x & sets[j]) >= 80 * len(x | sets[j]):
                old, new = label[i], label[j]
                label = [new if v == old else v for v in label]
    want = {min(i for i, v in enumerate(label) if v == one) for one in label}
    table = spark.createDataFrame([(i, " ".join(t), "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, table, "").collect()}
    assert got == want == {0, 2, 3, 5, 6, 7, 8}


def test_small_sources_are_judged_by_their_language(spark):
    """Junk that is all of its source, or of its language, goes; clean documents in such sources stay."""
    rng = np.random.default_rng(1)

    def clean(i):
        return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "um"], 80)) + f" {i} {i * 7} {i * 13}"

    def junk(i):
        return " ".join(f"XY{i}A{k:03d}!!***" for k in range(60))

    rows = [(i, clean(i), "en", f"big{i % 2}") for i in range(400)]
    rows += [(1000, junk(0), "en", "one"), (1001, junk(1), "en", "two"), (1002, junk(2), "en", "two"), (1003, junk(3), "xx", "three")]
    rows += [(2000, clean(2000), "en", "four"), (2001, clean(2001), "yy", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: (r.base_failed, r.kept) for r in robust_quality.judged(table).collect()}
    assert all(got[i] == (False, False) for i in (1000, 1001, 1002, 1003))
    assert all(failed or kept for i, (failed, kept) in got.items() if i not in range(1000, 1004))


def test_thresholds_take_all_labelled_rows(spark):
    """A language with few toxic texts in the training sample and many outside it has its own threshold."""
    rng = np.random.default_rng(2)
    words, rows, marks = [f"term{i}" for i in range(50)], [], []
    for i in range(1200):
        text = list(rng.choice(words, 20))
        if i % 2:
            text[3] = "vile"
        rows.append((i, " ".join(text), "rare" if i < 200 else "en"))
        marks.append((i, i % 2))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame(marks, "doc_id long, toxic int")
    model = toxicity_cnn.fit_on(docs, labels, rows=30)
    assert {"", "en", "rare"} == set(model.thresholds)
    scores = {r.doc_id: r.score for r in toxicity_cnn.score(docs.filter("doc_id < 200"), model).collect()}
    assert sum((s >= model.thresholds["rare"]) == bool(i % 2) for i, s in scores.items()) >= 190
