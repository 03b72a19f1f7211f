"""How the driver's tables are used as labelled items, systems, replies and attempts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from labelyard.operators.route import route
from labelyard.operators.schema import Head, schema_from_heads
from labelyard.sizing import spread

# --- fixed values: frequent function words per language ----------------------
WORDS = {
    "de": ["der", "die", "und", "den", "von", "zu", "das", "mit", "sich", "für"],
    "en": ["the", "of", "and", "to", "is", "that", "it", "for", "was", "with"],
    "es": ["el", "los", "se", "del", "las", "por", "con", "su", "una", "para"],
    "fr": ["le", "et", "les", "des", "du", "une", "pour", "est", "qui", "dans"],
}
REPLY_LABELS = ["lang_de", "lang_en", "lang_es", "lang_fr"]
FALLBACK_NAMES = {0: "reserved_zero", 5: "reserved_five"}
# ------------------------------------------------------------------------------


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    """Single-label items: a document and its language."""
    return table(spark, sf, "documents").select(
        F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("label"),
        F.array("lang").alias("gold"), "source", "n_chars",
    )


def texts(spark: SparkSession, sf: str) -> DataFrame:
    """The same items for work that reads every word of every text."""
    docs = spread(table(spark, sf, "documents"))
    return docs.select(
        F.col("doc_id").alias("item_id"), "text", F.col("lang").alias("label"),
        F.array("lang").alias("gold"), "source", "n_chars",
    )


def language_head(name: str, n_words: int) -> Head:
    return Head(
        name, list(WORDS), described={lang: " ".join(ws[:n_words]) for lang, ws in WORDS.items()}
    )


def language_schema(spark: SparkSession, **heads: int) -> DataFrame:
    """Heads over the four languages, described by their first n words."""
    return schema_from_heads(spark, [language_head(h, n) for h, n in heads.items()])


def language_labels(spark: SparkSession, described=("de", "en", "es", "fr")) -> DataFrame:
    rows = [
        (lang, pos, " ".join(WORDS[lang]) if lang in described else None)
        for pos, lang in enumerate(WORDS)
    ]
    return spark.createDataFrame(rows, "label string, ord int, description string")


def language_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Two competing systems that read every document once: ten words or three."""
    answers = route(
        texts(spark, sf), language_schema(spark, lex10=10, lex3=3), keep=["item_id", "n_chars"]
    )
    return answers.select(
        F.col("head").alias("system"), "item_id", "labels", "confidence",
        (F.col("n_chars") / 100.0).alias("latency_ms"),
    )


def customers(spark: SparkSession, sf: str) -> DataFrame:
    """Many-label items: a customer and its nation, some with a description."""
    nation = F.broadcast(table(spark, sf, "nation"))  # 25 rows at every scale
    c = table(spark, sf, "customer")
    return c.join(nation, c.c_nationkey == nation.n_nationkey).select(
        F.col("c_custkey").alias("item_id"), F.col("n_name").alias("label"),
        F.when(F.col("c_acctbal") > 9900, F.col("c_mktsegment")).otherwise("").alias("description"),
    )


def flags(spark: SparkSession, sf: str) -> DataFrame:
    """Multi-label items, some with an empty label set."""
    return table(spark, sf, "labels").select(
        F.col("doc_id").alias("item_id"),
        F.filter(
            F.array(F.when(F.col("quality") == 1, "quality"), F.when(F.col("toxic") == 1, "toxic")),
            lambda x: x.isNotNull(),
        ).alias("gold"),
    )


def flag_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """A rule that guesses the flags of every labelled document from its length and text."""
    docs = table(spark, sf, "documents")
    guess = docs.select(
        F.col("doc_id").alias("item_id"),
        F.filter(
            F.array(
                F.when(F.col("n_chars") > 200, "quality"),
                F.when(F.contains("text", F.lit("***")), "toxic"),
            ),
            lambda x: x.isNotNull(),
        ).alias("labels"),
    )
    return guess.join(table(spark, sf, "labels").select(F.col("doc_id").alias("item_id")), "item_id", "left_semi") \
        .select(F.lit("rule").alias("system"), "item_id", "labels")


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Imbalanced three-class items: a conversation turn and its role."""
    return table(spark, sf, "conversations").select(
        F.struct("conv_id", "turn").alias("item_id"), "text", F.col("role").alias("label")
    )


def replies(spark: SparkSession, sf: str) -> DataFrame:
    """One reply per document in eight shapes, from exact to the document itself."""
    name = F.concat(F.lit("lang_"), F.col("lang"))
    shape = F.pmod("doc_id", F.lit(8))
    position = F.array_position(F.array(*[F.lit(x) for x in WORDS]), F.col("lang")) - 1
    content = (
        F.when(shape == 0, name)
        .when(shape == 1, F.upper(name))
        .when(shape == 2, F.concat(F.lit('  "'), name, F.lit('".')))
        .when(shape == 3, F.concat(F.lit("```\n"), name, F.lit("\n```")))
        .when(shape == 4, F.concat(F.lit("The answer is "), F.replace(name, F.lit("_"), F.lit("-"))))
        .when(shape == 5, position.cast("string"))
        .when(shape == 6, F.concat(F.lit("It depends.\n"), name))
        .otherwise(F.col("text"))
    )
    return table(spark, sf, "documents").select(
        F.lit("external").alias("system"), F.col("doc_id").alias("item_id"),
        content.alias("content"), (F.col("n_chars") / 100.0).alias("latency_ms"),
        F.pmod("n_chars", F.lit(1000)).alias("prompt_tokens"),
        F.pmod("n_chars", F.lit(7)).alias("completion_tokens"),
        F.lit(None).cast("string").alias("error"),
    )


def usage(spark: SparkSession, sf: str) -> DataFrame:
    """Calls with latency and token counts: an event, its type as the system."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("system"), F.col("event_id").alias("item_id"),
        F.col("value").alias("latency_ms"), k.alias("prompt_tokens"),
        F.pmod(k, F.lit(7)).alias("completion_tokens"),
    )


def attempts(spark: SparkSession, sf: str) -> DataFrame:
    """Retry attempts: the events of a user in time order."""
    status = (
        F.when(F.col("event_type") == "error", 503)
        .when(F.col("event_type") == "view", 429)
        .when(F.col("event_type") == "signup", 400)
        .otherwise(200)
    )
    return table(spark, sf, "events").select(
        F.col("user_id").alias("item_id"), "ts", "event_id", status.alias("status"),
        F.col("props").alias("content"),
        F.when(status >= 400, F.concat(F.lit("HTTP "), status.cast("string"), F.lit(": "), F.col("props")))
        .alias("error"),
    )


def payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Label payload text in every accepted shape, made of a document's language and source."""
    a, b = F.col("lang"), F.col("source")
    shape = F.pmod("doc_id", F.lit(10))

    def fill(template: str):
        return F.replace(F.replace(F.lit(template), F.lit("$a"), a), F.lit("$b"), b)

    shapes = [
        '"$a"', '["$b","$a","$a"]', '{"label":"$a","confidence":0.9}',
        '[{"label":"$a"},{"label":"$b"}]', "null", '{"labels":["$b","$a"]}',
        '{"label":["x",{"label":"$b"}]}', '[null,"z",["$a",["$b"]]]', '{"label":null,"labels":["$a"]}',
        "7",
    ]
    value = F.when(shape == 0, fill(shapes[0]))
    for i, template in enumerate(shapes[1:], 1):
        value = value.when(shape == i, fill(template))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), value.alias("payload"))


def head_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Two-head prediction payloads in every accepted shape."""
    a, b, n = F.col("lang"), F.col("source"), F.col("n_chars").cast("string")
    shape = F.pmod("doc_id", F.lit(6))

    def fill(template: str):
        out = F.replace(F.replace(F.lit(template), F.lit("$a"), a), F.lit("$b"), b)
        return F.replace(out, F.lit("$n"), n)

    shapes = [
        '{"lang":"$a","src":["$b"]}',
        '{"lang":{"label":"$a","confidence":0.$n},"src":[{"label":"$b","confidence":0.7},{"label":"z","confidence":0.$n}]}',
        '{"lang":null,"src":[]}',
        '{"lang":{"label":"$a","confidence":"NaN"},"src":[{"label":"$b","confidence":"NaN"},{"label":"y","confidence":"0.25"}]}',
        '{"lang":["$a"],"src":[{"label":"$b"},"w"]}',
        '{"lang":{"label":null,"confidence":"high"},"src":12}',
    ]
    value = F.when(shape == 0, fill(shapes[0]))
    for i, template in enumerate(shapes[1:], 1):
        value = value.when(shape == i, fill(template))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("item_id"), value.alias("payload"))
