"""Operators that pass columns on must not mind what those are called."""

import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from labelyard.llm import bloom_lines, gear_chunks, poisson_mix, robust_quality, token_groups

FOLDER = Path(token_groups.__file__).parent
LINE = "This very line is long enough to be looked at, and many share it."
OWN = {"doc_id", "text", "lang", "source", "n_chars"}


def internal_names(module):
    """Every quoted word in a module that could be a column of its own."""
    found = set(re.findall(r'"([A-Za-z_][A-Za-z0-9_]{0,30})"', (FOLDER / f"{module}.py").read_text()))
    return sorted({x.lower() for x in found} - OWN)


def table(spark, names=()):
    rows = [(i, f"{LINE}\n" + " ".join(f"w{i}x{k}" for k in range(30)) if i % 3 else f"{LINE}\nequal text in some of them", "en", "s", 1) for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({n: F.concat(F.lit(f"{n}:"), "doc_id") for n in names})


OPERATORS = {
    "gear_chunks": (gear_chunks.drop_repeated_passages, {"n_chunks", "spans", "n_removed"}),
    "bloom_lines": (bloom_lines.drop_repeated_lines, {"n_lines", "n_dropped"}),
    "poisson_mix": (lambda d: poisson_mix.replicate(d, poisson_mix.source_rates(d)), {"copy", "shuffle_key"}),
    "token_groups": (token_groups.one_of_each, set()),
    "robust_quality": (
        lambda d: robust_quality.judged(d, d.columns),
        {"n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", "kept"},
    ),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_internal_names_as_extra_columns(spark, name):
    operator, results = OPERATORS[name]
    extra = [n for n in internal_names(name) if n not in results]
    plain = operator(table(spark))
    rows = operator(table(spark, [*extra, *sorted(results)])).collect()
    assert len(rows) == plain.count() > 0
    for row in rows:
        assert all(row[n] == f"{n}:{row['doc_id']}" for n in extra)
    compared = [c for c in plain.columns if c not in ("shuffle_key",)]
    assert sorted(map(str, (tuple(r[c] for c in compared) for r in rows))) == sorted(map(str, (tuple(r[c] for c in compared) for r in plain.collect())))


def test_the_pipeline_runs_on_normal_and_empty_tables(spark, tmp_path):
    docs = table(spark)
    for name, rows in (("normal", docs), ("empty", docs.limit(0))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(got) == (name == "normal")
        places = sorted((r.sequence_id, r.offset, r.length) for r in got)
        assert all(b[1] == a[1] + a[2] for a, b in zip(places, places[1:]) if a[0] == b[0])
