"""Label payloads of any accepted shape, turned into sorted label arrays.

A payload arrives as JSON text: null, a scalar, an object carrying ``label`` or
``labels``, or an array mixing those. It is parsed once into a VARIANT and is a
plain ``array<string>`` afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def label_array(labels: Column) -> Column:
    """Canonical form of a typed label array: sorted, distinct, no NULLs."""
    return F.array_sort(F.array_distinct(F.filter(labels, lambda e: e.isNotNull())))


def _kind(v: Column) -> Column:
    """First letter of the VARIANT type: O(bject), A(rray), V(oid) or a scalar's."""
    return F.coalesce(F.substring(F.schema_of_variant(v), 1, 1), F.lit("V"))


def _typed(values: Column) -> Column:
    # The kind is looked up once per value, since it is asked for several times.
    return F.transform(values, lambda v: F.struct(v.alias("v"), _kind(v).alias("k")))


def _scalar_text(v: Column) -> Column:
    return F.try_variant_get(v, "$", "string")


def _none() -> Column:
    return F.array().cast("array<variant>")


def _elements(v: Column) -> Column:
    return F.coalesce(F.try_variant_get(v, "$", "array<variant>"), _none())


def _open(t: Column) -> Column:
    """Open one level of nesting: the members of a container, else the value itself."""
    v, kind = t["v"], t["k"]
    # "label" wins over "labels", which may be a list or one bare value
    inner = F.coalesce(
        F.try_variant_get(v, "$.label", "variant"), F.try_variant_get(v, "$.labels", "variant")
    )
    return (
        F.when(kind == "O", F.filter(F.array(inner), lambda x: x.isNotNull()))
        .when(kind == "A", _elements(v))
        .when(kind == "V", _none())
        .otherwise(F.array(v))
    )


def _opened(payload: Column, depth: int) -> Column:
    level = F.array(F.try_parse_json(payload))
    for _ in range(depth):
        level = F.flatten(F.transform(_typed(level), _open))
    typed = _typed(level)
    values = F.transform(F.filter(typed, lambda t: t["k"] != "V"), lambda t: _scalar_text(t["v"]))
    too_deep = F.raise_error(F.lit("label payload is nested too deeply")).cast("array<string>")
    return F.when(F.exists(typed, lambda t: t["k"].isin("O", "A")), too_deep).otherwise(
        label_array(values)
    )


def normalise_payload(payload: Column, depth: int = 4) -> Column:
    """JSON payload text to a label array.

    ``depth`` is the deepest nesting that is opened; the accepted shapes need at
    most four levels. Deeper payloads raise instead of losing labels. A payload
    cannot be nested deeper than it has opening brackets, so the common flat
    shapes take the short way.
    """
    brackets = F.length(payload) - F.length(F.translate(payload, "[{", ""))
    return (
        F.when(brackets == 0, _opened(payload, 0))
        .when(brackets == 1, _opened(payload, 1))
        .otherwise(_opened(payload, depth))
    )


def nesting(payload: Column) -> Column:
    """How deep the brackets of a JSON text are nested; those inside strings don't count."""
    bare = F.regexp_replace(payload, r'"(?:[^"\\]++|\\.)*+"', "")
    marks = F.split(F.regexp_replace(bare, r"[^\[\]{}]", ""), "")
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def walk(seen: Column, mark: Column) -> Column:
        now = seen["now"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(now, seen["most"]).alias("most"))

    return F.aggregate(marks, start, walk, lambda seen: seen["most"])


def normalise_payloads(df: DataFrame, payload: str, name: str) -> DataFrame:
    """Add ``name``, the label array of a payload column of any depth.

    The deepest nesting in the table is looked up first, and every level is opened in a step of its own,
    so nothing is refused or lost.
    """
    deepest = df.agg(F.max(nesting(F.col(payload)))).first()[0] or 0
    out = df.withColumn(name, F.array(F.try_parse_json(F.col(payload))))
    for _ in range(deepest):
        out = out.withColumn(name, F.flatten(F.transform(_typed(F.col(name)), _open)))
    return out.withColumn(name, label_array(F.transform(name, _scalar_text)))


def clean_confidence(value: Column) -> Column:
    """Double value of a confidence; NULL when it does not cast or is NaN."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def min_confidence(values: Column) -> Column:
    """Confidence of a head: the smallest usable value of its kept labels."""
    return F.array_min(F.filter(F.transform(values, clean_confidence), lambda c: c.isNotNull()))


def parse_predictions(df: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Explode ``{head: value}`` payload text into one row per head.

    Accepts a bare label, ``{label, confidence}``, a list of either, and null per
    head. Anything that is not an object yields no rows.
    """
    heads = F.try_variant_get(F.try_parse_json(F.col(payload)), "$", "map<string,variant>")
    rows = df.select(*keep, F.explode(heads).alias("head", "value"))
    value, kind = F.col("value"), _kind(F.col("value"))
    entries = _typed(F.when(kind == "A", _elements(value)).otherwise(F.array(value)))

    def label(t: Column) -> Column:
        return F.when(t["k"] == "O", F.try_variant_get(t["v"], "$.label", "string")).when(
            t["k"] != "V", _scalar_text(t["v"])
        )

    def confidence(t: Column) -> Column:
        return F.when(t["k"] == "O", F.try_variant_get(t["v"], "$.confidence", "string"))

    parts = rows.select(*keep, "head", entries.alias("entries"))
    return parts.select(
        *keep,
        "head",
        label_array(F.transform("entries", label)).alias("labels"),
        min_confidence(F.transform("entries", confidence)).alias("confidence"),
    )
