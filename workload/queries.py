"""Registered queries, each next to the SQL that must give the same rows."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from labelyard.functions import (
    build_prompt, clean_confidence, extract_label, min_confidence, normalise_payload,
    parse_predictions, reply_cost, reply_record,
)
from labelyard.functions.text import tokens
from labelyard.operators import arms as arm_ops
from labelyard.operators import features as feature_ops
from labelyard.operators import labels as label_ops
from labelyard.operators import route as route_ops
from labelyard.operators import sampling
from labelyard.operators import schema as schema_ops
from labelyard.operators import scoring, stats, usage
from labelyard.operators.attempts import fold_attempts
from labelyard.operators.gate import prediction_gate
from labelyard.operators.supervised import GRADIENT_BOUND, build_arm, learning_curve, optimality, timed_predictions
from labelyard.plans import panel as panel_plan
from labelyard.plans import transfer
from labelyard.sizing import materialise, workspace
from labelyard.sources import cache, fixtures
from labelyard.streaming import outcomes, route_outcomes, route_stream

from . import bindings as b
from . import sql as s

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def joined(c: Column | str) -> Column:
    return F.array_join(c, "|")


# --- labels and label resolution ----------------------------------------------

@query("""
SELECT label, (row_number() OVER (ORDER BY label) - 1)::INT AS ord
FROM (SELECT DISTINCT n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey)
""")
def label_set(spark, sf):
    return label_ops.label_set(b.customers(spark, sf))


@query("SELECT role AS label, count(*) AS n FROM conversations GROUP BY role")
def class_counts(spark, sf):
    return label_ops.class_counts(b.turns(spark, sf))


@query("""
SELECT n_name AS label, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 ORDER BY n DESC, label LIMIT 3
""")
def top3_classes(spark, sf):
    return label_ops.top_classes(b.customers(spark, sf))


@query("""
WITH c AS (SELECT lang AS label, count(*) AS c FROM documents GROUP BY 1)
SELECT 'documents' AS name, sum(c)::BIGINT AS n, count(*) AS n_labels,
  string_agg(label, '|' ORDER BY label) AS labels, 'de|en|es' AS labels_with_description,
  string_agg(label || '=' || c, '|' ORDER BY label) AS class_counts, 'languages' AS note
FROM c
""")
def dataset_profile(spark, sf):
    described = b.language_labels(spark, described=("de", "en", "es")).filter("description IS NOT NULL")
    manifest = fixtures.build_manifest(
        b.documents(spark, sf), "documents", note="languages", descriptions=described
    )
    return _flat_manifest(manifest)


def _flat_manifest(manifest: DataFrame) -> DataFrame:
    entries = F.transform(
        F.map_entries("class_counts"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    )
    return manifest.select(
        "name", "n", "n_labels", joined("labels").alias("labels"),
        joined("labels_with_description").alias("labels_with_description"),
        joined(F.array_sort(entries)).alias("class_counts"), "note",
    )


_ITEM_DESCRIPTIONS = """
WITH i AS (
  SELECT c_custkey AS item_id, n_name AS label,
    CASE WHEN c_acctbal > 9900 THEN c_mktsegment ELSE '' END AS description
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
d AS (SELECT label, arg_max(description, item_id) AS description FROM i
      WHERE trim(description) <> '' GROUP BY 1)
"""


@query(_ITEM_DESCRIPTIONS + "SELECT label, description FROM d")
def label_descriptions(spark, sf):
    return label_ops.label_descriptions(b.customers(spark, sf))


@query(_ITEM_DESCRIPTIONS + """
SELECT count(*) AS n_labels, round(avg((description IS NOT NULL)::INT), 6) AS coverage
FROM (SELECT DISTINCT label FROM i) LEFT JOIN d USING (label)
""")
def description_coverage(spark, sf):
    items = b.customers(spark, sf)
    labels = label_ops.described_label_set(
        label_ops.label_set(items), label_ops.label_descriptions(items)
    )
    return label_ops.description_coverage(labels).select("n_labels", r6("coverage").alias("coverage"))


@query(_ITEM_DESCRIPTIONS + """
SELECT (SELECT count(*) FROM i) AS n, count(*) AS n_labels,
  round(avg((description IS NOT NULL)::INT), 6) AS label_coverage
FROM (SELECT DISTINCT label FROM i) LEFT JOIN d USING (label)
""")
def fixture_profile(spark, sf):
    items = b.customers(spark, sf).withColumn("text", F.col("label"))
    profile, _, _ = fixtures.fixture_detail(items)
    return profile.select("n", "n_labels", r6("label_coverage").alias("label_coverage"))


@query("SELECT doc_id AS item_id, text, lang AS label FROM documents ORDER BY doc_id LIMIT 50")
def fixture_detail(spark, sf):
    items = b.documents(spark, sf).withColumn("description", F.lit(""))
    return fixtures.fixture_detail(items, 50)[2]


@query("""
SELECT d.doc_id AS item_id, coalesce(quality::VARCHAR, '') AS quality, coalesce(toxic::VARCHAR, '') AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def null_to_empty(spark, sf):
    rows = _graded(spark, sf).select(
        "item_id", F.col("quality").cast("string"), F.col("toxic").cast("string")
    )
    return label_ops.fill_text(rows, ["quality", "toxic"])


def _graded(spark, sf) -> DataFrame:
    grades = b.table(spark, sf, "labels").withColumnRenamed("doc_id", "item_id")
    docs = b.table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), "source")
    return docs.join(grades, "item_id", "left")


@query("""
WITH i AS (SELECT c_custkey, CASE WHEN c_acctbal >= 0 THEN c_nationkey END AS id FROM customer),
dim AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey
        WHERE r_name NOT IN ('AFRICA', 'ASIA'))
SELECT c_custkey AS item_id,
  CASE WHEN id IS NULL THEN 'oos' ELSE coalesce(n_name,
    CASE id WHEN 0 THEN 'reserved_zero' WHEN 5 THEN 'reserved_five' END, id::VARCHAR) END AS label,
  coalesce(r_name, '') AS description
FROM i LEFT JOIN dim ON id = n_nationkey
""")
def label_resolution(spark, sf):
    items = b.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("item_id"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey")).alias("label_id"),
    )
    nation, region = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).filter(
        ~F.col("r_name").isin("AFRICA", "ASIA")
    ).select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("description"))
    out = label_ops.resolve_labels(items, "label_id", names=names, fallback=b.FALLBACK_NAMES)
    return out.select("item_id", "label", "description")


@query("""
SELECT d.doc_id AS item_id, CASE WHEN quality IS NULL THEN 'oos' ELSE source END AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def label_text_choice(spark, sf):
    return label_ops.resolve_labels(_graded(spark, sf), "quality", label_text="source").select("item_id", "label")


@query("""
SELECT d.doc_id AS item_id, CASE quality WHEN 0 THEN 'poor' WHEN 1 THEN 'good' ELSE 'oos' END AS label
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
""")
def oos_label(spark, sf):
    return label_ops.resolve_labels(
        _graded(spark, sf), "quality", fallback={0: "poor", 1: "good"}
    ).select("item_id", "label")


@query("SELECT doc_id AS item_id, (array_position(['de','en','es','fr'], lang) - 1)::INT AS label_index FROM documents")
def label_index(spark, sf):
    return label_ops.label_index(b.documents(spark, sf)).select("item_id", "label_index")


@query(s.SIDES.format(labels="SELECT DISTINCT n_name AS label FROM nation") + "SELECT label, side FROM sides")
def label_split(spark, sf):
    return label_ops.split_labels(b.table(spark, sf, "nation").select(F.col("n_name").alias("label")))


@query(s.SIDES.format(labels="SELECT DISTINCT n_name AS label FROM nation") + """
SELECT c_custkey AS item_id, n_name AS label FROM customer JOIN nation ON c_nationkey = n_nationkey
WHERE n_name IN (SELECT label FROM sides WHERE side = 'a')
""")
def gold_in_subset(spark, sf):
    sides = label_split(spark, sf)
    return sampling.keep_labels(b.customers(spark, sf), sides.filter("side = 'a'")).select("item_id", "label")


@query(s.SIDES.format(labels="SELECT DISTINCT lang AS label FROM documents") + f"""
SELECT doc_id AS item_id, lang AS label FROM documents
WHERE {s.IS_TRAIN} AND lang IN (SELECT label FROM sides WHERE side = 'b')
""")
def train_one_side(spark, sf):
    docs = b.documents(spark, sf)
    train, _ = sampling.split_by_hash(docs, 0.5)
    sides = label_ops.split_labels(docs)
    return sampling.keep_labels(train, sides.filter("side = 'b'")).select("item_id", "label")


# --- samples and slices -----------------------------------------------------------

@query("SELECT doc_id AS item_id, lang AS label FROM documents ORDER BY md5('0-' || doc_id), doc_id LIMIT 200")
def seeded_sample(spark, sf):
    return sampling.sample_n(b.documents(spark, sf), 200, seed=0).select("item_id", "label")


@query("SELECT doc_id AS item_id, lang AS label FROM documents ORDER BY doc_id LIMIT 500")
def first_n_slice(spark, sf):
    return sampling.first_n(b.documents(spark, sf), 500).select("item_id", "label")


@query("""
WITH o AS (SELECT doc_id AS item_id, row_number() OVER (ORDER BY md5('0-' || doc_id), doc_id) AS pos FROM documents)
SELECT n AS size, item_id FROM o, (VALUES (100), (500), (2000)) v(n) WHERE pos <= n
""")
def nested_train_subset(spark, sf):
    docs = b.documents(spark, sf).select("item_id")
    out = None
    for size, part in sampling.nested_subsets(docs, [100, 500, 2000]).items():
        part = part.select(F.lit(size).alias("size"), "item_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
SELECT doc_id AS item_id, regexp_extract(text, 'Released under[^\\n]*') <> '' AS accepted,
  CASE WHEN regexp_extract(text, 'Released under[^\\n]*') = '' THEN 'text is empty' END AS reason
FROM documents
""")
def blank_text_reject(spark, sf):
    notes = b.documents(spark, sf).select(
        "item_id", F.regexp_extract("text", r"Released under[^\n]*", 0).alias("text")
    )
    good, rejected = route_ops.split_blank(notes)
    return good.select("item_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason")) \
        .unionByName(rejected.select("item_id", F.lit(False).alias("accepted"), "reason"))


@query("""
SELECT c_custkey AS item_id, c_name AS text, CASE WHEN c_acctbal >= 0 THEN c_nationkey::VARCHAR ELSE '' END AS label_id,
  CASE WHEN c_acctbal >= 0 THEN n_name ELSE 'none' END AS label,
  CASE WHEN c_acctbal >= 0 THEN r_name ELSE '' END AS description
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
ORDER BY md5('0-' || c_custkey), c_custkey LIMIT 1500
""")
def ingest_sample(spark, sf):
    table, names = _customer_source(spark, sf)
    spec = fixtures.IngestSpec(
        "customers", "c_name", "nation", "c_custkey", 1500, label_names=b.FALLBACK_NAMES, oos_label="none"
    )
    return fixtures.ingest(table, spec, names)


@query("""
SELECT c_custkey AS item_id, c_name AS text, CASE WHEN c_acctbal >= 0 THEN c_nationkey::VARCHAR ELSE '' END AS label_id,
  CASE WHEN c_acctbal >= 0 THEN n_name ELSE 'oos' END AS label, '' AS description
FROM customer JOIN nation ON c_nationkey = n_nationkey
ORDER BY md5('1-' || c_custkey), c_custkey LIMIT 10000
""")
def ingest_train(spark, sf):
    table, names = _customer_source(spark, sf)
    spec = fixtures.IngestSpec(
        "customers", "c_name", "nation", "c_custkey", 10_000, label_names=b.FALLBACK_NAMES, oos_label="none"
    )
    return fixtures.ingest_train(table, spec, names)


def _customer_source(spark, sf) -> tuple[DataFrame, DataFrame]:
    table = b.table(spark, sf, "customer").withColumn(
        "nation", F.when(F.col("c_acctbal") >= 0, F.col("c_nationkey"))
    )
    nation, region = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    names = nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("r_name").alias("description")
    )
    return table, names


# --- sources and caches -------------------------------------------------------------

@query("SELECT doc_id AS item_id, text, source AS label_id, lang AS label, '' AS description FROM documents")
def fixture_csv_roundtrip(spark, sf):
    path = f"{workspace(spark)}/fixture-{time.time_ns()}.csv"
    items = b.documents(spark, sf).select(
        "item_id", "text", F.col("source").alias("label_id"), "label", F.lit(None).cast("string").alias("description")
    )
    fixtures.write_fixture(items, path, format="csv")
    return fixtures.read_fixture(spark, path)


@query(f"SELECT doc_id AS item_id, text, lang AS label FROM documents WHERE {s.IS_TRAIN}")
def train_csv_roundtrip(spark, sf):
    path = f"{workspace(spark)}/train-{time.time_ns()}.csv"
    train, _ = sampling.split_by_hash(b.documents(spark, sf), 0.5)
    fixtures.write_fixture(train.select("item_id", "text", "label"), path, format="csv")
    return fixtures.read_train(spark, path)


_MANIFEST_SQL = """
SELECT '{name}' AS name, sum(c)::BIGINT AS n, count(*) AS n_labels,
  string_agg(label, '|' ORDER BY label) AS labels, '' AS labels_with_description,
  string_agg(label || '=' || c, '|' ORDER BY label) AS class_counts, '' AS note
FROM ({counts})
"""


@query(_MANIFEST_SQL.format(name="turns", counts="SELECT role AS label, count(*) AS c FROM conversations GROUP BY 1"))
def manifest_roundtrip(spark, sf):
    path = f"{workspace(spark)}/turns-{time.time_ns()}.manifest.json"
    fixtures.write_manifest(fixtures.build_manifest(b.turns(spark, sf), "turns"), path)
    return _flat_manifest(fixtures.read_manifest(spark, path))


@query("""
SELECT 'documents' AS name, count(*) AS n, count(DISTINCT lang) AS n_labels, 'languages' AS note, 'tables' AS repo FROM documents
UNION ALL
SELECT 'turns', count(*), count(DISTINCT role), 'roles', 'tables' FROM conversations
""")
def available_fixtures(spark, sf):
    folder = f"{workspace(spark)}/fixtures-{time.time_ns()}"
    for name, note, items in (
        ("turns", "roles", b.turns(spark, sf)), ("documents", "languages", b.documents(spark, sf))
    ):
        manifest = fixtures.build_manifest(items, name, note=note, repo="tables")
        fixtures.write_manifest(manifest, f"{folder}/{name}.manifest.json")
    return fixtures.available_fixtures(spark, folder).select(
        "name", "n", "n_labels", "note", F.col("source.repo").alias("repo")
    )


@query(s.route("documents", lex10=10) + "SELECT item_id, label AS labels, round(confidence, 6) AS confidence FROM lex10_ans")
def incremental_predictions(spark, sf):
    # Half of the items are cached first; the second call scores only the others.
    path = f"{workspace(spark)}/predictions-{time.time_ns()}"
    schema = b.language_schema(spark, intent=10)
    docs = b.texts(spark, sf)
    first, _ = sampling.split_by_hash(docs, 0.5)
    run = dict(schema=schema, system="lex10", path=path, score=lambda df: route_ops.route(
        df, schema, keep=["item_id", "text_hash"]
    ))
    cache.cached_predictions(first, **run)
    out = cache.cached_predictions(docs, **run)
    return out.select("item_id", joined("labels").alias("labels"), r6("confidence").alias("confidence"))


# --- schemas ------------------------------------------------------------------------

def _nation_labels(spark, sf) -> DataFrame:
    nation, region = b.table(spark, sf, "nation"), b.table(spark, sf, "region")
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey, "left").select(
        F.col("n_name").alias("label"),
        F.when(~F.col("r_name").isin("AFRICA"), F.col("r_name")).alias("description"),
    )
    return label_ops.described_label_set(label_ops.label_set(rows), rows)


def _schema_variants(spark, sf) -> dict[str, DataFrame]:
    labels = _nation_labels(spark, sf)
    subset = label_ops.split_labels(labels).filter("side = 'a'")
    return {
        "plain": schema_ops.build_schema(labels, "plain"),
        "described": schema_ops.build_schema(labels, "described", described=True),
        "multi": schema_ops.build_schema(labels, "multi", described=True, multi_label=True, threshold=0.25),
        "subset": schema_ops.build_schema(labels, "subset", label_subset=subset),
    }


@query(s.NATION_SCHEMA + """
SELECT head, label, ord, coalesce(description, '') AS description, multi_label, coalesce(cls_threshold, -1.0)::DOUBLE AS cls_threshold FROM heads
""")
def schema_build(spark, sf):
    out = None
    for part in _schema_variants(spark, sf).values():
        out = part if out is None else out.unionByName(part)
    return out.select(
        "head", "label", "ord", F.coalesce("description", F.lit("")).alias("description"), "multi_label",
        F.coalesce("cls_threshold", F.lit(-1.0)).alias("cls_threshold"),
    )


@query(s.NATION_SCHEMA + """
, text AS (
SELECT head, '{"' || head || '": ' || CASE
  WHEN bool_or(multi_label) THEN '{"cls_threshold": ' || max(cls_threshold)::VARCHAR || ', "labels": ["'
    || string_agg(label, '", "' ORDER BY ord) || '"], "multi_label": true}'
  WHEN count(description) > 0 THEN '{"labels": {' || string_agg('"' || label || '": "' || description || '"', ', ' ORDER BY label) || '}}'
  ELSE '["' || string_agg(label, '", "' ORDER BY ord) || '"]' END || '}' AS j
FROM heads GROUP BY head)
SELECT head, sha256(j)[1:16] AS fingerprint FROM text
""")
def schema_fingerprint(spark, sf):
    out = None
    for head, part in _schema_variants(spark, sf).items():
        row = schema_ops.schema_fingerprint(part).select(F.lit(head).alias("head"), "fingerprint")
        out = row if out is None else out.unionByName(row)
    return out


@query("""
WITH heads AS (SELECT DISTINCT c_mktsegment AS head FROM customer UNION SELECT 'CLOSED'),
n AS (SELECT c_mktsegment AS head, count(*) AS n_labels FROM customer GROUP BY 1)
SELECT head, coalesce(n_labels, 0) AS n_labels,
  CASE WHEN n_labels IS NULL THEN 'head ''' || head || ''' has no labels'
       WHEN n_labels > 512 THEN 'label set too large (max 512)' END AS error
FROM heads LEFT JOIN n USING (head)
""")
def schema_limits(spark, sf):
    rows = b.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("head"), F.col("c_name").alias("label"))
    heads = rows.select("head").distinct().unionByName(spark.createDataFrame([("CLOSED",)], "head string"))
    return schema_ops.head_limits(heads, rows)


@query("""
SELECT 'described' AS head, count(*) AS n_labels, 'schema: ' || count(*) || ' labels' AS note,
  CASE WHEN count(*) > 25 THEN 'note: descriptions inflate input ~3.9x here (measured ~8.6x slower)' END AS warning
FROM (SELECT DISTINCT p_name FROM part)
UNION ALL
SELECT 'small', count(*), 'schema: ' || count(*) || ' labels', NULL FROM (SELECT DISTINCT n_name FROM nation WHERE n_regionkey <> 0)
""")
def schema_inflation_note(spark, sf):
    parts = b.table(spark, sf, "part").groupBy(F.col("p_name").alias("label")).agg(F.max("p_type").alias("description"))
    labels = label_ops.described_label_set(label_ops.label_set(parts), parts)
    wide = schema_ops.build_schema(labels, "described", described=True)
    small = schema_ops.build_schema(_nation_labels(spark, sf), "small", described=True)
    return schema_ops.inflation_note(wide.unionByName(small))


# --- payloads and replies ---------------------------------------------------------------

@query("""
SELECT doc_id AS item_id, CASE doc_id % 10 WHEN 0 THEN lang WHEN 1 THEN lang || '|' || source WHEN 2 THEN lang
  WHEN 3 THEN lang || '|' || source WHEN 4 THEN '' WHEN 5 THEN lang || '|' || source WHEN 6 THEN source || '|x'
  WHEN 7 THEN lang || '|' || source || '|z' WHEN 8 THEN '' ELSE '7' END AS labels
FROM documents
""")
def normalise_labels(spark, sf):
    return b.payloads(spark, sf).select("item_id", joined(normalise_payload(F.col("payload"))).alias("labels"))


@query("""
WITH d AS (SELECT doc_id, doc_id % 6 AS shape, lang, source, ('0.' || n_chars)::DOUBLE AS c FROM documents)
SELECT doc_id AS item_id, 'lang' AS head, CASE WHEN shape IN (2, 5) THEN '' ELSE lang END AS labels,
  CASE WHEN shape = 1 THEN round(c, 6) END AS confidence FROM d
UNION ALL
SELECT doc_id, 'src', CASE shape WHEN 0 THEN source WHEN 1 THEN source || '|z' WHEN 2 THEN '' WHEN 3 THEN source || '|y'
  WHEN 4 THEN source || '|w' ELSE '12' END,
  CASE shape WHEN 1 THEN round(least(c, 0.7), 6) WHEN 3 THEN 0.25 END FROM d
""")
def parse_prediction_payloads(spark, sf):
    rows = parse_predictions(b.head_payloads(spark, sf), "payload", ["item_id"])
    return rows.select("item_id", "head", joined("labels").alias("labels"), r6("confidence").alias("confidence"))


@query("""
WITH e AS (SELECT event_id, value, (props->>'$.k')::INT AS k FROM events)
SELECT event_id AS item_id, CASE WHEN k % 5 IN (0, 1) THEN NULL ELSE round(value, 6) END AS confidence FROM e
""")
def usable_confidence(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    raw = F.when(k % 5 == 0, "NaN").when(k % 5 == 1, F.concat(F.lit("about "), F.col("value").cast("string"))) \
        .otherwise(F.col("value").cast("string"))
    return b.table(spark, sf, "events").select(
        F.col("event_id").alias("item_id"), r6(clean_confidence(raw)).alias("confidence")
    )


@query("""
WITH e AS (SELECT event_id, value, (props->>'$.k')::INT AS k FROM events)
SELECT event_id AS item_id, round(CASE WHEN k % 5 = 0 THEN k / 100.0 ELSE least(value / 500, k / 100.0) END, 6) AS confidence FROM e
""")
def head_confidence(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    values = F.array(
        F.when(k % 5 != 0, F.col("value") / 500).otherwise(F.lit(float("nan"))).cast("string"),
        (k / 100.0).cast("string"), F.lit(None).cast("string"), F.lit("n/a"),
    )
    return b.table(spark, sf, "events").select(
        F.col("event_id").alias("item_id"), r6(min_confidence(values)).alias("confidence")
    )


@query(s.REPLIES + "SELECT item_id, label FROM parsed")
def extracted_label(spark, sf):
    return b.replies(spark, sf).select("item_id", extract_label(F.col("content"), b.REPLY_LABELS).alias("label"))


@query("""
SELECT doc_id AS item_id, 'Labels:' || chr(10) || '["lang_de", "lang_en", "lang_es", "lang_fr"]' || chr(10) || chr(10)
  || 'Text:' || chr(10) || text || chr(10) || chr(10) || 'Label:' AS prompt
FROM documents
""")
def classification_prompt(spark, sf):
    return b.documents(spark, sf).select("item_id", build_prompt(F.col("text"), b.REPLY_LABELS).alias("prompt"))


@query(s.REPLIES + """
, q AS (SELECT *, replace(replace(replace(replace(content[1:80], chr(92), chr(92) || chr(92)), chr(10), chr(92) || 'n'),
         chr(13), chr(92) || 'r'), chr(9), chr(92) || 't') AS body FROM parsed)
SELECT item_id, label, label IS NOT NULL AS valid, content[1:200] AS raw_text,
  CASE WHEN label IS NULL THEN 'reply not in label set: ' || CASE
    WHEN contains(content[1:80], chr(39)) AND NOT contains(content[1:80], '"') THEN '"' || body || '"'
    ELSE chr(39) || replace(body, chr(39), chr(92) || chr(39)) || chr(39) END END AS error
FROM q
""")
def reply_records(spark, sf):
    return b.replies(spark, sf).select("item_id", reply_record(F.col("content"), b.REPLY_LABELS).alias("r")).select("item_id", "r.*")


@query("""
SELECT event_id AS item_id, round((props->>'$.k')::INT / 1e6 * 3.0 + ((props->>'$.k')::INT % 7) / 1e6 * 15.0, 9) AS cost_usd FROM events
""")
def reply_costs(spark, sf):
    cost = reply_cost(F.col("prompt_tokens"), F.col("completion_tokens"), 3.0, 15.0)
    return b.usage(spark, sf).select("item_id", F.round(cost, 9).alias("cost_usd"))


@query("""
WITH a AS (SELECT user_id, ts, event_id, props, CASE event_type WHEN 'error' THEN 503 WHEN 'view' THEN 429 WHEN 'signup' THEN 400 ELSE 200 END AS status FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (status IN (429, 503))::INT, ts, event_id) AS first_final,
        row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS from_end,
        bool_or(status NOT IN (429, 503)) OVER (PARTITION BY user_id) AS has_final FROM a)
SELECT user_id AS item_id, CASE WHEN status = 200 THEN props END AS content,
  CASE WHEN status >= 400 THEN 'HTTP ' || status || ': ' || props END AS error,
  CASE WHEN status = 200 THEN 'success' WHEN has_final THEN 'rejected' ELSE 'exhausted' END AS outcome
FROM r WHERE (has_final AND first_final = 1) OR (NOT has_final AND from_end = 1)
""")
def retry_fold(spark, sf):
    return fold_attempts(b.attempts(spark, sf), order=["ts", "event_id"])


@query(f"""
WITH asked AS (SELECT * FROM documents WHERE source <> 'src7'),
p AS (
  SELECT doc_id AS item_id, 'lang' AS head, CASE WHEN n_chars > 5000 THEN source ELSE lang END AS label, n_chars / 10000.0 AS confidence FROM asked),
f AS (SELECT a.doc_id AS item_id, quality + toxic AS kept FROM labels l JOIN asked a ON a.doc_id = l.doc_id)
SELECT 'label_outside_schema' AS rule, item_id, head, label AS detail FROM p WHERE label NOT IN ('de','en','es','fr')
UNION ALL SELECT 'confidence_out_of_range', item_id, head, confidence::DOUBLE::VARCHAR FROM p WHERE confidence > 1
UNION ALL SELECT 'empty_multi_label', item_id, 'flags', 'no label kept' FROM f WHERE kept = 0
UNION ALL SELECT 'head_missing', doc_id, 'flags', 'no answer for this head' FROM documents WHERE doc_id NOT IN (SELECT item_id FROM f)
UNION ALL SELECT 'head_missing', doc_id, 'lang', 'no answer for this head' FROM documents WHERE source = 'src7'
""")
def gate_violations(spark, sf):
    # One source got no answer at all.
    heads = [b.language_head("lang", 10), schema_ops.Head("flags", ["quality", "toxic"], multi_label=True)]
    schema = schema_ops.schema_from_heads(spark, heads)
    docs = b.documents(spark, sf)
    answered = docs.filter("source <> 'src7'")
    lang = answered.select(
        "item_id", F.lit("lang").alias("head"),
        F.array(F.when(F.col("n_chars") > 5000, F.col("source")).otherwise(F.col("label"))).alias("labels"),
        (F.col("n_chars") / 10000.0).alias("confidence"),
    )
    flags = b.flags(spark, sf).join(answered.select("item_id"), "item_id", "left_semi").select(
        "item_id", F.lit("flags").alias("head"), F.col("gold").alias("labels"), F.lit(0.5).alias("confidence")
    )
    return prediction_gate(lang.unionByName(flags), schema, docs)


# --- routing and scoring arms ------------------------------------------------------------

@query(s.route("documents", intent=10) + "SELECT item_id, label, round(confidence, 6) AS confidence FROM intent_ans")
def route_single(spark, sf):
    answers = route_ops.route(b.texts(spark, sf), b.language_schema(spark, intent=10))
    return answers.select("item_id", joined("labels").alias("label"), r6("confidence").alias("confidence"))


@query(s.route("documents", lex10=10, lex3=3) + """
SELECT item_id, 'lex10' AS head, label AS labels, round(confidence, 6) AS confidence FROM lex10_ans
UNION ALL SELECT item_id, 'lex3', label, round(confidence, 6) FROM lex3_ans
UNION ALL SELECT item_id, 'every', string_agg(CASE WHEN score / total >= 0.3 THEN label END, '|' ORDER BY label),
  round(min(CASE WHEN score / total >= 0.3 THEN score / total END), 6)
FROM (SELECT *, nullif(sum(score) OVER (PARTITION BY item_id), 0)::DOUBLE AS total FROM lex10_grid) GROUP BY item_id
""")
def route_multi_head(spark, sf):
    every = schema_ops.Head("every", list(b.WORDS), multi_label=True, cls_threshold=0.3)
    schema = b.language_schema(spark, lex10=10, lex3=3)
    described = b.language_schema(spark, every=10).withColumn("multi_label", F.lit(True)).withColumn(
        "cls_threshold", F.lit(every.cls_threshold)
    )
    answers = route_ops.route(b.texts(spark, sf), schema.unionByName(described))
    labels = F.when(F.size("labels") > 0, joined("labels"))
    return answers.select("item_id", "head", labels.alias("labels"), r6("confidence").alias("confidence"))


@query(f"""
WITH tok AS (SELECT doc_id AS item_id, unnest({s.TOKENS}) AS tok FROM documents),
vocabulary AS (SELECT tok AS label, row_number() OVER (ORDER BY count(DISTINCT item_id) DESC, tok) - 1 AS ord FROM tok WHERE NOT contains(tok, '_') GROUP BY tok QUALIFY ord < 400),
hits AS (SELECT item_id, label, ord, count(*) AS score FROM tok JOIN vocabulary ON label = tok GROUP BY ALL),
best AS (SELECT item_id, arg_max(label, score * 1000 - ord) AS label, max(score)::DOUBLE / sum(score) AS confidence FROM hits GROUP BY 1)
SELECT doc_id AS item_id, coalesce(label, (SELECT label FROM vocabulary WHERE ord = 0)) AS label, round(confidence, 6) AS confidence
FROM documents LEFT JOIN best ON item_id = doc_id
""")
def route_wide_schema(spark, sf):
    # The 400 words that most documents have, as 400 labels of one head.
    texts = b.texts(spark, sf)
    words = texts.select("item_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("label")).filter(~F.contains("label", F.lit("_")))
    often = words.groupBy("label").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "label").limit(400)
    labels = often.select("label", (F.row_number().over(W.orderBy(F.desc("n"), "label")) - 1).alias("ord"))
    answers = route_ops.route(texts, schema_ops.build_schema(materialise(labels, "labels"), "word"))
    return answers.select("item_id", joined("labels").alias("label"), r6("confidence").alias("confidence"))


@query(s.route("documents", intent=10) + """
SELECT doc_id AS item_id, CASE WHEN source = 'src3' THEN 'rejected' ELSE 'routed' END AS outcome,
  CASE WHEN source = 'src3' THEN 'text is empty' ELSE label END AS answer
FROM documents JOIN intent_ans ON item_id = doc_id
""")
def stream_outcomes(spark, sf):
    # One stream, both outcomes; it is stopped after its first files and started again.
    base = f"{workspace(spark)}/stream-{time.time_ns()}"
    docs = b.table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), F.when(F.col("source") == "src3", " \t").otherwise(F.col("text")).alias("text"), "source"
    )
    schema = b.language_schema(spark, intent=10)
    for part in (F.col("source") < "src2", F.col("source") >= "src2"):
        docs.filter(part).select("item_id", "text").write.mode("append").parquet(f"{base}/in")
        texts = spark.readStream.schema("item_id long, text string").parquet(f"{base}/in")
        route_outcomes(texts, schema, f"{base}/out", f"{base}/state").awaitTermination()
    routed, rejected = outcomes(spark, f"{base}/out")
    return routed.select("item_id", F.lit("routed").alias("outcome"), joined("labels").alias("answer")).unionByName(
        rejected.select("item_id", F.lit("rejected").alias("outcome"), F.col("reason").alias("answer"))
    )


@query(s.route("documents", intent=10) + "SELECT item_id, label, round(confidence, 6) AS confidence FROM intent_ans")
def route_on_stream(spark, sf):
    base = f"{workspace(spark)}/stream-{time.time_ns()}"
    source = b.table(spark, sf, "documents").schema
    texts = spark.readStream.schema(source).parquet(f"{sf}/documents*.parquet").select(
        F.col("doc_id").alias("item_id"), "text"
    )
    live = route_stream(texts, b.language_schema(spark, intent=10))
    live.writeStream.format("parquet").option("checkpointLocation", f"{base}/state") \
        .trigger(availableNow=True).start(f"{base}/out").awaitTermination()
    answers = spark.read.schema(live.schema).parquet(f"{base}/out")
    return answers.select("item_id", joined("labels").alias("label"), r6("confidence").alias("confidence"))


@query(s.route("documents", intent=10) + "SELECT item_id, label AS labels, round(confidence, 6) AS confidence, true AS timed FROM intent_ans")
def bulk_classify(spark, sf):
    raw = arm_ops.classify_many(
        b.texts(spark, sf), b.language_schema(spark, intent=10), arm_ops.lexical_scorer,
        system="lexical", batch_size=16,
    )
    return arm_ops.predictions_of(raw).select(
        "item_id", joined("labels").alias("labels"), r6("confidence").alias("confidence"),
        (F.col("latency_ms") >= 0).alias("timed"),
    )


@query("""
SELECT doc_id AS item_id, CASE WHEN doc_id % 11 <> 3 THEN ['lang_de','lang_en','lang_es','lang_fr'][1 + strlen(text) % 4] END AS label,
  CASE WHEN doc_id % 11 = 3 THEN 'ConnectionError: refused' END AS error, (doc_id % 11 <> 3)::BOOL AS timed
FROM documents
""")
def external_scoring(spark, sf):
    # The client refuses some items for good. A second run with the same log asks for those again and no others.
    def client_factory(refuse_all: bool):
        def call(text: str, labels: list[str]) -> dict:
            mark, _, said = text.partition("|")
            if refuse_all or int(mark) % 11 == 3:
                raise ConnectionError("refused")
            size = len(said.encode())
            return {"content": f"{size % len(labels)}", "prompt_tokens": size, "completion_tokens": 1}

        return call

    docs = b.documents(spark, sf).select("item_id", F.concat("item_id", F.lit("|"), "text").alias("text"))
    log = f"{workspace(spark)}/calls-{time.time_ns()}"
    arm_ops.score_external(docs, b.REPLY_LABELS, lambda: client_factory(False), system="external", log=log)
    out = arm_ops.score_external(docs, b.REPLY_LABELS, lambda: client_factory(True), system="external", log=log)
    return out.select(
        "item_id", extract_label(F.col("content"), b.REPLY_LABELS).alias("label"), "error",
        F.coalesce(F.col("latency_ms") >= 0, F.lit(False)).alias("timed"),
    )


@query(s.TFIDF + "SELECT item_id, term, tf, df, round(idf, 6) AS idf, round(raw / norm, 6) AS weight FROM weighted")
def tfidf_weights(spark, sf):
    rows = feature_ops.tfidf(b.texts(spark, sf))
    return rows.select("item_id", "term", "tf", "df", r6("idf").alias("idf"), r6("weight").alias("weight"))


@query("""
SELECT role AS label, count(*) AS n_label, round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6)::DOUBLE AS weight
FROM conversations GROUP BY role
""")
def class_weights(spark, sf):
    rows = feature_ops.class_weights(b.turns(spark, sf))
    return rows.select("label", "n_label", r6("weight").alias("weight"))


@query("""
WITH v AS (SELECT label AS item_id, (embedding[1] > 0)::INT AS m, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS dim FROM embeddings)
SELECT item_id, dim::INT AS dim, round(sum(x * m) / greatest(sum(m), 1e-9), 6) AS value FROM v GROUP BY 1, 2
""")
def masked_mean_pool(spark, sf):
    vectors = b.table(spark, sf, "embeddings").select(
        F.col("label").alias("item_id"), F.col("embedding").alias("vector"),
        (F.get("embedding", F.lit(0)) > 0).cast("int").alias("mask"),
    )
    pooled = feature_ops.masked_mean_pool(vectors)
    return pooled.select("item_id", F.posexplode("pooled").alias("dim", "value")).select(
        "item_id", "dim", r6("value").alias("value")
    )


def _doc_split(spark, sf) -> tuple[DataFrame, DataFrame]:
    return sampling.split_by_hash(b.texts(spark, sf), 0.5)


def _system_rows(predictions: DataFrame, items: DataFrame) -> DataFrame:
    rows = panel_plan.system_rows(scoring.score_items(predictions, items))
    return rows.select("name", "n", *[r6(c).alias(c) for c in ("accuracy", "ci_low", "ci_high", "macro_f1")])


@query(s.logistic(s.DOCUMENT_ROWS, text=True) + s.scored_answers("tfidf") + s.SYSTEM_ROWS)
def tfidf_lr(spark, sf):
    train, test = _doc_split(spark, sf)
    return _system_rows(timed_predictions(build_arm("tfidf", train), test, "tfidf"), test)


@query(s.logistic(s.DOCUMENT_ROWS, text=True) + "SELECT item_id, pred AS label, round(confidence, 3) AS confidence FROM answers")
def tfidf_lr_answers(spark, sf):
    train, test = _doc_split(spark, sf)
    answers = build_arm("tfidf", train).predict(test)
    return answers.select("item_id", joined("labels").alias("label"), F.round("confidence", 3).alias("confidence"))


@query(f"""
WITH r AS (SELECT 'tfidf' AS kind, lang AS label FROM documents WHERE {s.IS_TRAIN}
  UNION ALL SELECT 'embedding', label::VARCHAR FROM embeddings WHERE {s.IS_TRAIN.replace("doc_id", "vec_id")})
SELECT kind, label, count(*) AS n_train, round(sum(count(*)) OVER k / (count(*) OVER k * count(*)), 6)::DOUBLE AS weight, true AS optimal
FROM r GROUP BY kind, label WINDOW k AS (PARTITION BY kind)
""")
def supervised_optimum(spark, sf):
    # Every class is at the optimum of its objective, by an aggregation apart from the optimiser.
    found = None
    for kind, (train, _) in (("tfidf", _doc_split(spark, sf)), ("embedding", _embedding_split(spark, sf))):
        rows = optimality(build_arm(kind, train), train).select(
            F.lit(kind).alias("kind"), "label", "n_train", r6("weight").alias("weight"), (F.col("gradient") < GRADIENT_BOUND).alias("optimal")
        )
        found = rows if found is None else found.unionByName(rows)
    return found


def _embedding_split(spark, sf) -> tuple[DataFrame, DataFrame]:
    rows = b.table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("item_id"), "embedding", F.col("label").cast("string").alias("label")
    )
    return sampling.split_by_hash(rows.withColumn("gold", F.array("label")), 0.5)


@query(s.logistic(s.EMBEDDING_ROWS, text=False) + s.scored_answers("embedding") + s.SYSTEM_ROWS)
def embedding_lr(spark, sf):
    train, test = _embedding_split(spark, sf)
    return _system_rows(timed_predictions(build_arm("embedding", train), test, "embedding"), test)


@query(s.logistic(s.EMBEDDING_ROWS, text=False) + "SELECT item_id, pred AS label, round(confidence, 3) AS confidence FROM answers")
def embedding_lr_answers(spark, sf):
    train, test = _embedding_split(spark, sf)
    answers = build_arm("embedding", train).predict(test)
    return answers.select("item_id", joined("labels").alias("label"), F.round("confidence", 3).alias("confidence"))


@query("""
WITH train AS (SELECT label FROM embeddings WHERE ('0x' || md5('0-' || vec_id)[1:8])::BIGINT < 2147483648)
SELECT 'embedding' AS kind, count(*) AS trained_on, count(DISTINCT label) AS labels_seen, true AS reloaded FROM train
""")
def arm_artifact(spark, sf):
    # Fitted once, saved, and the second call reads the saved arm.
    path = f"{workspace(spark)}/arm-{time.time_ns()}"
    train, test = _embedding_split(spark, sf)
    fitted = cache.load_or_fit(spark, "embedding", train, path)
    again = cache.load_or_fit(spark, "embedding", train, path)
    pair = fitted.predict(test).select("item_id", F.col("labels").alias("x")).join(
        again.predict(test).select("item_id", F.col("labels").alias("y")), "item_id"
    )
    return pair.agg(F.bool_and(F.col("x") == F.col("y")).alias("reloaded")).select(
        F.lit(again.kind).alias("kind"), F.lit(again.trained_on).cast("long").alias("trained_on"),
        F.lit(len(again.labels)).cast("long").alias("labels_seen"), "reloaded",
    )


@query(s.curve([100, 500]))
def training_size_curve(spark, sf):
    # At the scale that the SQL is compared at, 2000 is beyond the training rows and skipped.
    train, test = _doc_split(spark, sf)
    return learning_curve(train, test, sizes=(100, 500, 2000)).select("trained_on", "n", r6("accuracy").alias("accuracy"))


# --- metrics ---------------------------------------------------------------------------

def _scored(spark, sf) -> DataFrame:
    return scoring.score_items(b.language_predictions(spark, sf), b.documents(spark, sf))


@query(s.LANGUAGE_SCORED + "SELECT system, item_id, correct FROM scored")
def exact_set_match(spark, sf):
    return _scored(spark, sf).select("system", "item_id", "correct")


@query(s.FLAG_SCORED + "SELECT item_id, gold = pred AS correct FROM f")
def exact_set_match_multi(spark, sf):
    scored = scoring.score_items(b.flag_predictions(spark, sf), b.flags(spark, sf))
    return scored.select("item_id", "correct")


@query("""
SELECT 'lex3' AS system, doc_id AS item_id, 'missing prediction' AS fault FROM documents WHERE source = 'src3'
UNION ALL SELECT 'lex10', doc_id, 'unknown item' FROM documents WHERE source = 'src5'
""")
def pairing_check(spark, sf):
    # lex3 skips one source; the items of another source are withheld from the gold side.
    predictions = b.language_predictions(spark, sf).select("system", "item_id")
    docs = b.documents(spark, sf)
    src = docs.select("item_id", "source")
    kept = predictions.join(src, "item_id").filter(
        ((F.col("system") == "lex10") | (F.col("source") != "src3"))
        & ((F.col("system") == "lex10") | (F.col("source") != "src5"))
    )
    return scoring.pairing_faults(kept, docs.filter("source <> 'src5'"))


@query(s.LANGUAGE_SCORED + s.ACCURACY_CI + """
SELECT system, n, round(k / n, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci
""")
def accuracy_ci(spark, sf):
    rows = panel_plan.system_rows(_scored(spark, sf))
    return rows.select(
        F.col("name").alias("system"), "n", r6("accuracy").alias("accuracy"),
        r6("ci_low").alias("ci_low"), r6("ci_high").alias("ci_high"),
    )


@query(s.LANGUAGE_SCORED + s.LABEL_COUNTS + "SELECT system, label, tp, fp, fn, round(f1, 6) AS f1 FROM per_label")
def per_label_counts(spark, sf):
    rows = scoring.label_counts(scoring.tally(_scored(spark, sf)))
    return rows.select("system", "label", "tp", "fp", "fn", r6("f1").alias("f1"))


@query(s.LANGUAGE_SCORED + s.LABEL_COUNTS + "SELECT system, round(avg(f1), 6) AS macro_f1 FROM per_label GROUP BY 1")
def macro_f1(spark, sf):
    rows = scoring.system_scores(scoring.tally(_scored(spark, sf)))
    return rows.select("system", r6("macro_f1").alias("macro_f1"))


@query(s.FLAG_SCORED + """
, u AS (SELECT label, count(*) FILTER (list_contains(pred, label) AND list_contains(gold, label)) AS tp,
          count(*) FILTER (list_contains(pred, label) AND NOT list_contains(gold, label)) AS fp,
          count(*) FILTER (NOT list_contains(pred, label) AND list_contains(gold, label)) AS fn
        FROM f, (VALUES ('quality'), ('toxic')) v(label) GROUP BY 1)
SELECT 'rule' AS system, (SELECT count(*) FROM f) AS n,
  (SELECT round(avg((gold = pred)::INT), 6) FROM f) AS accuracy,
  round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1
FROM u WHERE tp + fp + fn > 0
""")
def multi_label_scores(spark, sf):
    scored = scoring.score_items(b.flag_predictions(spark, sf), b.flags(spark, sf))
    rows = scoring.system_scores(scoring.tally(scored))
    return rows.select("system", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query("""
WITH c AS (SELECT role AS label, count(*) AS c, min((conv_id, turn)) AS first FROM conversations GROUP BY 1)
SELECT label, c AS count, (SELECT count(*) FROM conversations) AS n, round(c / (SELECT count(*) FROM conversations), 6) AS accuracy,
  round(2.0 * c / (c + (SELECT count(*) FROM conversations)) / (SELECT count(*) FROM c), 6) AS macro_f1
FROM c ORDER BY c DESC, first LIMIT 1
""")
def majority_floor(spark, sf):
    items = b.turns(spark, sf).withColumn("gold", F.array("label"))
    return _rounded_floor(scoring.majority_floor(items))


def _rounded_floor(floor: DataFrame) -> DataFrame:
    return floor.select("label", "count", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"))


@query(s.FLAG_SCORED + """
, votes AS (SELECT gold[1] AS label, count(*) AS c, min(item_id) AS first FROM f WHERE len(gold) > 0 GROUP BY 1),
top AS (SELECT label, c FROM votes ORDER BY c DESC, first LIMIT 1),
k AS (SELECT count(*) FILTER (list_contains(gold, label)) AS tp, count(*) FILTER (NOT list_contains(gold, label)) AS fp,
        count(*) FILTER (gold = [label]) AS hit, count(*) AS n FROM f, top)
SELECT label, c AS count, n, round(hit / n, 6) AS accuracy,
  round(2.0 * tp / (2 * tp + fp) / (SELECT count(DISTINCT x) FROM (SELECT unnest(gold) AS x FROM f)), 6) AS macro_f1
FROM top, k
""")
def majority_floor_multi(spark, sf):
    return _rounded_floor(scoring.majority_floor(b.flags(spark, sf)))


_PAIR = [("lex10", "lex3")]


@query(s.LANGUAGE_SCORED + s.CELLS + "SELECT a, b, n11, n10, n01, n00 FROM cells")
def pair_cells(spark, sf):
    return stats.pair_cells(_scored(spark, sf), _PAIR)


def _compared(spark, sf) -> DataFrame:
    return stats.compare_pairs(pair_cells(spark, sf))


@query(s.LANGUAGE_SCORED + s.CELLS + s.MCNEMAR + "SELECT a, b, n10 AS only_a, n01 AS only_b, round(mcnemar_p, 6) AS p_value FROM mcnemar")
def mcnemar(spark, sf):
    return _compared(spark, sf).select(
        "a", "b", F.col("mcnemar.b").alias("only_a"), F.col("mcnemar.c").alias("only_b"),
        r6("mcnemar.p_value").alias("p_value"),
    )


@query(s.LANGUAGE_SCORED + s.CELLS + s.PAIR_CI + "SELECT a, b, round(diff, 6) AS diff, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value FROM pair_ci")
def paired_bootstrap(spark, sf):
    return _compared(spark, sf).select("a", "b", *[r6(c).alias(c) for c in ("diff", "ci_low", "ci_high", "p_value")])


@query(s.LANGUAGE_SCORED + s.CELLS + s.PAIR_CI + s.MCNEMAR + """
SELECT p.a, p.b, round(diff, 6) AS diff, round(p_value, 6) AS p_value, p_value < 0.05 AS significant,
  round(mcnemar_p, 6) AS mcnemar_p, mcnemar_p < 0.05 AS mcnemar_significant
FROM pair_ci p JOIN mcnemar m ON p.a = m.a AND p.b = m.b
""")
def compare_systems(spark, sf):
    return _compared(spark, sf).select(
        "a", "b", r6("diff").alias("diff"), r6("p_value").alias("p_value"), "significant",
        r6("mcnemar.p_value").alias("mcnemar_p"), "mcnemar_significant",
    )


@query("""
WITH o AS (SELECT event_type AS system, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos,
             count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT system, n, round(median(value), 6) AS p50_ms,
  round(max(value) FILTER (pos = least(n - 1, floor(0.95 * n))), 6) AS p95_ms,
  round(max(value) FILTER (pos = floor(n / 2)), 6) AS upper_p50_ms
FROM o GROUP BY system, n
""")
def latency_percentiles(spark, sf):
    return usage.latency_percentiles(b.usage(spark, sf), both_medians=True).select(
        "system", "n", *[r6(c).alias(c) for c in ("p50_ms", "p95_ms", "upper_p50_ms")]
    )


_COST = """
SELECT event_type AS system, count(*) AS n,
  sum((props->>'$.k')::INT / 1e6 * {i} + ((props->>'$.k')::INT % 7) / 1e6 * {o}) AS cost FROM events GROUP BY 1
"""


@query(f"""
SELECT system, n, round(cost / n * 1000, 6) AS cost_per_1k_usd, 'priced' AS cost_status FROM ({_COST.format(i=3.0, o=15.0)})
UNION ALL
SELECT system || ' unpriced', n, NULL, 'unpriced' FROM ({_COST.format(i=0.0, o=0.0)})
""")
def cost_per_1k(spark, sf):
    rows = b.usage(spark, sf)
    priced = usage.cost_per_1k(rows, input_per_mtok=3.0, output_per_mtok=15.0)
    unpriced = usage.cost_per_1k(rows).withColumn("system", F.concat("system", F.lit(" unpriced")))
    return priced.unionByName(unpriced).select(
        "system", "n", r6("cost_per_1k_usd").alias("cost_per_1k_usd"), "cost_status"
    )


def _parsed_replies(spark, sf) -> DataFrame:
    record = reply_record(F.col("content"), b.REPLY_LABELS)
    return b.replies(spark, sf).drop("error").withColumn("r", record).select(
        "system", "item_id", "latency_ms", "prompt_tokens", "completion_tokens", "r.label", "r.error"
    )


@query(s.REPLIES + """
SELECT 'external' AS system, count(*) AS n, count(label) AS n_usable, count(*) - count(label) AS n_unusable FROM parsed
""")
def unusable_replies(spark, sf):
    return usage.reply_quality(_parsed_replies(spark, sf)).select("system", "n", "n_usable", "n_unusable")


@query("""
SELECT 'HTTP' AS system, count(*) AS n, count(*) FILTER (event_type IN ('error', 'signup')) AS n_errors,
  arg_min(event_type || ' ' || props, event_id) FILTER (event_type IN ('error', 'signup')) AS first_error FROM events
""")
def first_error(spark, sf):
    failed = F.col("event_type").isin("error", "signup")
    rows = b.table(spark, sf, "events").select(
        F.lit("HTTP").alias("system"), F.col("event_id").alias("item_id"), F.lit(None).cast("string").alias("label"),
        F.when(failed, F.concat_ws(" ", "event_type", "props")).alias("error"),
    )
    return usage.reply_quality(rows).select("system", "n", "n_errors", "first_error")


@query("""
WITH t AS (SELECT event_type AS system, count(*) AS n, sum(value) / 1000 / 4 AS sec FROM events GROUP BY 1 HAVING count(*) > 20)
SELECT system, n, round(sec, 6) AS seconds, round(sec / n, 6) AS seconds_per_item FROM t
""")
def timing_note(spark, sf):
    return usage.timing_note(b.usage(spark, sf), 4).select(
        "system", "n", r6("seconds").alias("seconds"), r6("seconds_per_item").alias("seconds_per_item")
    )


@query(s.REPLIES + """
, p AS (SELECT item_id, coalesce(label, '__none__') AS pred, 'lang_' || lang AS gold FROM parsed JOIN documents ON doc_id = item_id),
u AS (SELECT label, count(*) FILTER (pred = label AND gold = label) AS tp, count(*) FILTER (pred = label AND gold <> label) AS fp,
        count(*) FILTER (pred <> label AND gold = label) AS fn
      FROM p, (SELECT DISTINCT pred AS label FROM p UNION SELECT DISTINCT gold FROM p) GROUP BY 1)
SELECT 'external' AS system, (SELECT count(*) FROM p) AS n, (SELECT round(avg((pred = gold)::INT), 6) FROM p) AS accuracy,
  round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END), 6) AS macro_f1,
  round(avg(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) FILTER (label <> '__none__'), 6) AS macro_f1_schema
FROM u
""")
def external_scores(spark, sf):
    items = b.documents(spark, sf).select("item_id", F.array(F.concat(F.lit("lang_"), F.col("label"))).alias("gold"))
    counts = scoring.tally(scoring.score_items(usage.with_unusable(_parsed_replies(spark, sf)), items))
    known = spark.createDataFrame([(x,) for x in b.REPLY_LABELS], "label string")
    within = scoring.system_scores(counts, known).select("system", F.col("macro_f1").alias("within"))
    return scoring.system_scores(counts).join(within, "system").select(
        "system", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"),
        r6("within").alias("macro_f1_schema"),
    )


# --- panel -------------------------------------------------------------------------------

_ROLES = {"lex10": panel_plan.ZERO_SHOT, "lex3": panel_plan.SUPERVISED}


def _panel(spark, sf) -> panel_plan.Panel:
    # The systems are scored once and their answers kept, as a panel reads them often.
    predictions = materialise(b.language_predictions(spark, sf), "predictions")
    notes = spark.createDataFrame(
        [(name, ["", f"{n} words per language"]) for name, n in (("lex10", 10), ("lex3", 3))],
        "system string, notes array<string>",
    )
    return panel_plan.score_panel(
        b.documents(spark, sf), predictions, _ROLES, labels=b.language_labels(spark, ("en", "fr")),
        name="documents", note="languages", notes=notes,
    )


@query(s.LANGUAGE_SCORED + s.ACCURACY_CI + s.LABEL_COUNTS + s.DOC_LATENCY + s.DOC_FLOOR + """
SELECT ci.system AS name, ci.n, round(k / ci.n, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high,
  round(mf, 6) AS macro_f1, round(p50, 6) AS p50_ms, round(p95, 6) AS p95_ms, NULL::DOUBLE AS cost_per_1k_usd, 'free' AS cost_status,
  CASE ci.system WHEN 'lex10' THEN '10' ELSE '3' END || ' words per language' AS notes
FROM ci JOIN (SELECT system, avg(f1) AS mf FROM per_label GROUP BY 1) m ON m.system = ci.system, latency
UNION ALL
SELECT 'majority class (' || label || ')', n, round(c / n, 6), NULL, NULL, round(2.0 * c / (c + n) / k, 6), NULL, NULL, NULL, 'free',
  'floor, not a system: predicts ''' || label || ''' for everything (' || c || '/' || n || ' items)|a model must beat this to be doing anything'
FROM floor
""")
def evidence_panel(spark, sf):
    rows = _panel(spark, sf).systems
    rounded = [r6(c).alias(c) for c in ("accuracy", "ci_low", "ci_high", "macro_f1", "p50_ms", "p95_ms", "cost_per_1k_usd")]
    return rows.select("name", "n", *rounded, "cost_status", joined("notes").alias("notes"))


@query(s.LANGUAGE_SCORED + s.CELLS + s.PAIR_CI + s.MCNEMAR + """
SELECT p.a, p.b, round(diff, 6) AS diff, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(p_value, 6) AS p_value,
  p_value < 0.05 AS significant, n10 AS only_a, n01 AS only_b, round(mcnemar_p, 6) AS mcnemar_p
FROM pair_ci p JOIN mcnemar m ON p.a = m.a AND p.b = m.b
""")
def panel_pairs(spark, sf):
    return _panel(spark, sf).comparisons.select(
        "a", "b", *[r6(c).alias(c) for c in ("diff", "ci_low", "ci_high", "p_value")], "significant",
        F.col("mcnemar.b").alias("only_a"), F.col("mcnemar.c").alias("only_b"), r6("mcnemar.p_value").alias("mcnemar_p"),
    )


@query(s.DOC_FLOOR_ONLY + """
SELECT 'majority class (' || label || ')' AS name, n, round(c / n, 6) AS accuracy, round(2.0 * c / (c + n) / k, 6) AS macro_f1,
  NULL::DOUBLE AS ci_low, NULL::DOUBLE AS ci_high FROM floor
""")
def floor_row(spark, sf):
    return panel_plan.floor_row(b.documents(spark, sf)).select(
        "name", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"), "ci_low", "ci_high"
    )


@query("SELECT 'documents' AS name, count(*) AS n_items, 4::BIGINT AS n_labels, 0.5::DOUBLE AS label_coverage, 'languages' AS note FROM documents")
def panel_fixture(spark, sf):
    return _panel(spark, sf).fixture


@query("""
SELECT 'Word overlap + label descriptions' AS system, 'documents ships no label descriptions (coverage 0%)' AS reason
FROM documents HAVING count(*) > 0
UNION ALL SELECT 'TF-IDF + logistic regression', 'no train split for documents'
UNION ALL SELECT 'External model (zero-shot)', 'no replies table given for the external model'
""")
def unavailable_systems(spark, sf):
    plain = b.language_labels(spark, described=())
    return panel_plan.run_panel(
        b.texts(spark, sf), plain, name="documents", limit=None,
        systems=["zero_shot", "zero_shot_described", "tfidf", "external"],
    ).unavailable


def _run_panel(spark, sf, **options) -> panel_plan.Panel:
    train, test = _doc_split(spark, sf)
    named = F.concat(F.lit("lang_"), F.col("label"))
    return panel_plan.run_panel(
        test.withColumn("gold", F.array(named)).select("item_id", "text", "gold"), b.language_labels(spark).withColumn("label", named),
        limit=None, name="documents", train=lambda: train.select("item_id", "text", named.alias("label")), **options,
    )


@query(s.PANEL + """
SELECT c.system AS name, c.n, round(k / c.n, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high, round(mf, 6) AS macro_f1,
  CASE WHEN c.system LIKE 'External%' THEN (SELECT round(sum(3.0 * (n_chars % 1000) + 15.0 * (n_chars % 7)) / 1e6 / count(*) * 1000, 6) FROM asked) END AS cost_per_1k_usd,
  CASE WHEN c.system LIKE 'External%' THEN 'priced' ELSE 'free' END AS cost_status, true AS timed
FROM ci c JOIN macro m ON m.system = c.system
UNION ALL
SELECT 'majority class (' || gold || ')', n, round(c / n, 6), NULL, NULL, round(2.0 * c / (c + n) / k, 6), NULL, 'free', false
FROM (SELECT gold, count(*) AS c, (SELECT count(*) FROM asked) AS n, (SELECT count(DISTINCT gold) FROM asked) AS k FROM asked GROUP BY 1 ORDER BY c DESC, min(item_id) LIMIT 1)
""")
def full_panel(spark, sf):
    rows = _run_panel(
        spark, sf, systems=["zero_shot", "zero_shot_described", "tfidf", "external"],
        replies=b.replies(spark, sf), input_per_mtok=3.0, output_per_mtok=15.0,
    ).systems
    rounded = [r6(c).alias(c) for c in ("accuracy", "ci_low", "ci_high", "macro_f1", "cost_per_1k_usd")]
    timed = F.col("p50_ms").isNotNull() & F.col("p95_ms").isNotNull()
    return rows.select("name", "n", *rounded, "cost_status", timed.alias("timed"))


@query(s.PANEL + """
SELECT c.system AS name, c.n, round(k / c.n, 6) AS accuracy, round(mf, 6) AS macro_f1, true AS timed, 0::BIGINT AS scored_again
FROM ci c JOIN macro m ON m.system = c.system WHERE c.system IN ('TF-IDF + logistic regression', 'Word overlap + label descriptions')
""")
def panel_cached(spark, sf):
    # The second run finds the fitted arm and every answer, so it commits nothing.
    folder = f"{workspace(spark)}/panel-{time.time_ns()}"
    options = dict(systems=["zero_shot_described", "tfidf"], cache=folder)
    _run_panel(spark, sf, **options)
    runs = cache.Runs(spark, f"{folder}/predictions", "", "", T.StructType())
    before = runs.committed()[0]
    rows = _run_panel(spark, sf, **options).systems.filter(~F.col("name").startswith("majority class"))
    again = runs.committed()[0] - before
    return rows.select(
        "name", "n", r6("accuracy").alias("accuracy"), r6("macro_f1").alias("macro_f1"),
        (F.col("p50_ms").isNotNull() & F.col("p95_ms").isNotNull()).alias("timed"), F.lit(again).cast("long").alias("scored_again"),
    )


# --- transfer ------------------------------------------------------------------------------

@query(s.SWAP_SUBSET + """
SELECT side, n_labels, n AS n_items_scored, round(k / n, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high
FROM ci JOIN sizes ON ci.system = sizes.side
""")
def schema_swap_zero_shot(spark, sf):
    return _swap(spark, sf, "subset")


@query(s.SWAP_FULL + """
SELECT side, n_labels, n AS n_items_scored, round(k / n, 6) AS accuracy, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high
FROM ci JOIN sizes ON ci.system = sizes.side
""")
def schema_swap_full_schema(spark, sf):
    return _swap(spark, sf, "full")


def _swap(spark, sf, scope: str) -> DataFrame:
    rows = transfer.schema_swap(
        b.texts(spark, sf).select("item_id", "text", "label"), b.language_labels(spark),
        limit=None, described=True, schema_scope=scope,
    )
    return rows.select(
        "side", "n_labels", "n_items_scored", *[r6(c).alias(c) for c in ("accuracy", "ci_low", "ci_high")]
    )


@query(s.SIDES.format(labels="SELECT DISTINCT lang AS label FROM documents") + f"""
SELECT (SELECT count(*) FROM documents WHERE NOT {s.IS_TRAIN} AND lang IN (SELECT label FROM sides WHERE side = 'b')) AS n,
  0.0::DOUBLE AS accuracy, 0::BIGINT AS answers_in_b,
  (SELECT count(*) FROM documents WHERE {s.IS_TRAIN} AND lang IN (SELECT label FROM sides WHERE side = 'a')) AS supervised_trained_on
""")
def schema_swap_supervised(spark, sf):
    train, test = _doc_split(spark, sf)
    rows = transfer.supervised_transfer(
        test.select("item_id", "text", "label"), train.select("item_id", "text", "label"), b.language_labels(spark), limit=None,
    )
    return rows.drop("note", "error")


@query("SELECT 'FileNotFoundError: no train split' AS error FROM documents HAVING count(*) > 0")
def schema_swap_without_train(spark, sf):
    def missing() -> DataFrame:
        raise FileNotFoundError("no train split")

    asked = b.texts(spark, sf).select("item_id", "text", "label")
    return transfer.supervised_transfer(asked, missing, b.language_labels(spark), limit=None).select("error")
