"""Quality rules: base limits, then multivariate outliers by minimum covariance determinant.

Five statistics of a text are transformed and rounded to whole hundredths. For each language and source, each
language and the whole corpus the
estimator looks for the part of the documents, ``SHARE`` of them, whose covariance has the smallest
determinant. An estimate of n documents weighs n / (n + ``PRIOR_ROWS``) against the one behind it: a source's
against its language's, a language's against the corpus's. A document far by Mahalanobis distance is rejected. All sums
are over whole numbers, so the estimates do not depend on how the table is split. Everything is a
DataFrame expression or an aggregation with a few numbers for each group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from labelyard.llm.columns import set_aside
from labelyard.sizing import materialise

# --- fixed values: words and symbols of the base rules -----------------------------------------
BLANKS = "[\\x20\\x09-\\x0D]+"
NOT_BLANK = "[^\\x20\\x09-\\x0D]"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
# ------------------------------------------------------------------------------------------------

#: Statistic and the least spread taken for it, in transformed units.
STATISTICS = {"symbols": 0.6, "word_length": 0.12, "dup_lines": 0.8, "repeats": 0.8, "capitals": 0.4}
UNIT = 100
#: Part of a group that is fitted; steps; squared distance above which a document is rejected (one in a
#: million of a normal distribution in five dimensions); the median of such a squared distance;
#: documents that the estimate behind a group's own counts for.
SHARE, STEPS, CUTOFF, MEDIAN, PRIOR_ROWS = 0.75, 4, 35.888, 4.3515, 50
BIN = 16

P = len(STATISTICS)
LOWER = [(i, j) for i in range(P) for j in range(i + 1)]


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed.

    Also _lines, lines with a word, and _capitals, A-Z and exclamation marks. A null text has no
    words. Columns of these names are overwritten.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(NOT_BLANK))
    return (
        docs.withColumns({"_words": words, "_kept_lines": lines})
        .withColumns({
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOLS)).cast("long"),
            "_capitals": F.regexp_count(text, F.lit("[A-Z!]")).cast("long"),
            "_lines": F.size("_kept_lines").cast("long"),
            "n_dup_lines": (F.size("_kept_lines") - F.size(F.array_distinct("_kept_lines"))).cast("long"),
            "_windows": F.when(
                F.size("_words") >= WINDOW,
                F.transform(F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_words", i, WINDOW))),
            ),
        })
        .withColumn("_windows", F.when(F.size("_windows") > F.size(F.array_distinct("_windows")), F.col("_windows")))
        .withColumn("_sorted", F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
        .withColumn("_starts", F.sort_array(F.transform(
            F.filter(F.transform("_sorted", lambda x, k: F.struct(
                x["i"].alias("i"),
                (F.coalesce(F.get("_sorted", k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get("_sorted", k + 1)["h"] == x["h"], F.lit(False))).alias("twice"),
            )), lambda x: x["twice"]), lambda x: x["i"],
        )))
        .withColumn("n_repeat_words", F.coalesce(F.aggregate(
            F.transform("_starts", lambda at, k: F.least(F.lit(WINDOW), F.coalesce(F.get("_starts", k + 1) - at, F.lit(WINDOW)))),
            F.lit(0), lambda a, b: a + b,
        ), F.lit(0)).cast("long"))
        .withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
        .drop("_words", "_kept_lines", "_windows", "_sorted", "_starts")
    )


def transformed(measured: DataFrame) -> DataFrame:
    """Add q1 to q5, the transformed statistics in hundredths; null where the base rules fail."""
    def share(count: str, of: str) -> Column:
        return F.log1p(100.0 * F.col(count) / F.greatest(F.col(of), F.lit(1)))

    values = [
        share("n_symbols", "n_words"),
        F.log(F.greatest(F.col("word_chars"), F.lit(1)) / F.greatest(F.col("n_words"), F.lit(1))),
        share("n_dup_lines", "_lines"), share("n_repeat_words", "n_words"), share("_capitals", "word_chars"),
    ]
    return measured.withColumns({
        f"q{i + 1}": F.when(~F.col("base_failed"), F.round(v * UNIT)).cast("long") for i, v in enumerate(values)
    })


def _group_key(rows: DataFrame) -> DataFrame:
    """Add _lang and _pair: the language, and language with source."""
    def known(c: str) -> Column:
        return F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))

    return rows.withColumns({"_lang": known("lang"), "_pair": F.concat_ws("\t", known("lang"), known("source"))})


def _factored(moments: DataFrame) -> DataFrame:
    """From n, s1..s5 and s11..s55 the means m*, the Cholesky factor l* and log determinant."""
    floors = [(UNIT * f) ** 2 for f in STATISTICS.values()]
    out = moments.withColumns({f"m{i}": F.col(f"s{i}") / F.col("_n") for i in range(P)})
    for i, j in LOWER:
        cov = F.col(f"s{i}{j}") / F.col("_n") - F.col(f"m{i}") * F.col(f"m{j}") + (floors[i] if i == j else 0.0)
        for k in range(j):
            cov = cov - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
        out = out.withColumn(f"l{i}{j}", F.sqrt(F.greatest(cov, F.lit(1.0))) if i == j else cov / F.col(f"l{j}{j}"))
    log_det = F.lit(0.0)
    for i in range(P):
        log_det = log_det + 2 * F.log(F.col(f"l{i}{i}"))
    keep = [f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in LOWER]
    return out.select("_group", "_start", *keep, log_det.alias("log_det"))


def _distance(rows: DataFrame) -> DataFrame:
    """Add d2, the squared Mahalanobis distance, by forward substitution."""
    for i in range(P):
        rest = F.col(f"q{i + 1}") - F.col(f"m{i}")
        for j in range(i):
            rest = rest - F.col(f"l{i}{j}") * F.col(f"z{j}")
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    total = F.lit(0.0)
    for i in range(P):
        total = total + F.col(f"z{i}") * F.col(f"z{i}")
    return rows.withColumn("d2", total).drop(*[f"z{i}" for i in range(P)])


def _sums(prefix: str = "q") -> list[Column]:
    q = [F.col(f"{prefix}{i + 1}") for i in range(P)]
    return [F.sum(q[i]).alias(f"s{i}") for i in range(P)] + [F.sum(q[i] * q[j]).alias(f"s{i}{j}") for i, j in LOWER]


def _levels() -> list[tuple[str, Column]]:
    """The groups a document belongs to, the nearest first."""
    return [
        ("pair", F.concat(F.lit("pair\t"), "_pair")), ("lang", F.concat(F.lit("lang\t"), "_lang")), ("all", F.lit("all")),
    ]


def _shrunk(names: DataFrame, fits: DataFrame) -> DataFrame:
    """_pair, means, Cholesky factor and cutoff: each pair's own estimate, weighed by its documents.

    Means, covariances and the logarithm of the cutoff's scale are each a weighted mean, so nothing jumps
    with the size of a group. ``fits`` has m*, l*, _scale and _n of every _group.
    """
    floors = [(UNIT * f) ** 2 for f in STATISTICS.values()]
    out = names
    for level, name in _levels():
        values = {"n": F.col("_n"), "scale": F.col("_scale"), **{f"m{i}": F.col(f"m{i}") for i in range(P)}}
        for i, j in LOWER:
            values[f"c{i}{j}"] = sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j + 1)), F.lit(0.0))
        part = fits.select(F.col("_group").alias(f"_{level}_group"), *[v.alias(f"{level}_{k}") for k, v in values.items()])
        out = out.join(part, name == F.col(f"_{level}_group"))
    for near, behind in (("lang", "all"), ("pair", "lang")):
        own = F.col(f"{near}_n") / (F.col(f"{near}_n") + PRIOR_ROWS)
        out = out.withColumns({
            f"{near}_{k}": own * F.col(f"{near}_{k}") + (1 - own) * F.col(f"{behind}_{k}")
            for k in ["scale", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in LOWER]]
        })
    out = materialise(out, "quality-shrunk")
    # As the sums of one document; ``_factored`` adds the least spreads, which the covariances hold already.
    moments = {f"s{i}": F.col(f"pair_m{i}") for i in range(P)}
    for i, j in LOWER:
        moments[f"s{i}{j}"] = F.col(f"pair_c{i}{j}") + F.col(f"pair_m{i}") * F.col(f"pair_m{j}") - (floors[i] if i == j else 0.0)
    cutoffs = out.select("_pair", (CUTOFF * F.exp("pair_scale")).alias("cutoff"))
    sums = out.select(F.col("_pair").alias("_group"), F.lit("").alias("_start"), F.lit(1).alias("_n"), *[v.alias(k) for k, v in moments.items()])
    return _factored(sums).drop("_start", "log_det").withColumnRenamed("_group", "_pair").join(cutoffs, "_pair")


def estimates(stats: DataFrame) -> DataFrame:
    """Per language and source: means, Cholesky factor and the cutoff; ``stats`` has _lang, _pair and q1 to q5.

    A group is a language with a source, a language or the corpus, each of all its documents; ``_shrunk``
    then weighs the first against the others.

    Two starts, the medians with quartile spreads and the whole group's moments, are each improved by
    concentration steps: fit, order by distance, keep the nearest ``SHARE``, fit again. One step is
    one aggregation into distance bins and a running count over at most some hundred bins a group.
    The start with the smaller determinant stays. Least spreads keep it positive where a statistic
    hardly varies.
    """
    used = stats.filter(~F.col("base_failed"))
    used = materialise(used.select("_pair", "_lang", *[f"q{i + 1}" for i in range(P)]), "quality-vectors")
    names = materialise(used.select("_pair", "_lang").distinct(), "quality-groups")
    used = used.select(F.explode(F.array(*[name for _, name in _levels()])).alias("_group"), *[f"q{i + 1}" for i in range(P)])
    whole = used.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), *_sums())
    quart = used.groupBy("_group").agg(F.count(F.lit(1)).alias("_n"), *[
        F.percentile(f"q{i + 1}", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"p{i}") for i in range(P)
    ])
    middle = {f"s{i}": F.col(f"p{i}")[1] * F.col("_n") for i in range(P)}
    spread = {}
    for i, j in LOWER:
        own = F.pow((F.col(f"p{i}")[2] - F.col(f"p{i}")[0]) / 1.349, 2) if i == j else F.lit(0.0)
        spread[f"s{i}{j}"] = (F.col(f"p{i}")[1] * F.col(f"p{j}")[1] + own) * F.col("_n")
    quart = quart.withColumns({**middle, **spread}).drop(*[f"p{i}" for i in range(P)])
    starts = whole.withColumn("_start", F.lit("all")).unionByName(quart.withColumn("_start", F.lit("quartiles")), allowMissingColumns=True)
    fitted = materialise(_factored(starts), "quality-fit")
    earlier = Window.partitionBy("_group", "_start").orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy("_group", "_start")
    bin_ = F.floor(F.log(F.col("d2") + 1e-6) * BIN)
    for _ in range(STEPS):
        binned = _distance(used.join(fitted.drop("log_det"), "_group")).withColumn("_bin", bin_).groupBy("_group", "_start", "_bin").agg(
            F.count(F.lit(1)).alias("_n"), *_sums()
        )
        near = binned.withColumns({"_before": F.coalesce(F.sum("_n").over(earlier), F.lit(0)), "_all": F.sum("_n").over(every)}).filter(
            F.col("_before") < F.ceil(F.col("_all") * SHARE)
        )
        again = near.groupBy("_group", "_start").agg(*[F.sum(c).alias(c) for c in ["_n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in LOWER]]])
        fitted = materialise(_factored(again), "quality-fit")
    least = fitted.groupBy("_group").agg(F.min_by(F.struct(*fitted.columns), F.struct("log_det", "_start")).alias("fit")).select("fit.*")
    least = materialise(least.drop("log_det", "_start"), "quality-fit")
    middle_bin = _distance(used.join(least, "_group")).groupBy("_group").agg(F.percentile(bin_, F.lit(0.5)).alias("_middle"))
    scale = F.greatest(F.lit(1.0), F.exp((F.col("_middle") + 1) / BIN) / MEDIAN)
    done = least.join(middle_bin, "_group").join(whole.select("_group", "_n"), "_group").withColumn("_scale", F.log(scale)).drop("_middle")
    return materialise(_shrunk(names, materialise(done, "quality-fit")), "quality-estimates")


def judged(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The base statistics, distance2 (null where the base rules fail) and kept of every row.

    ``columns`` of ``docs`` are kept beside them; by default doc_id. The statistics are stored once
    and read by the estimator and for the verdict. Null languages and sources form groups of
    their own; an empty table gives no rows; equal rows are judged alike, each by itself. Kept columns
    named like a result are left out for it.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    columns = [c for c in (columns or ["doc_id"]) if c not in (*names, "distance2", "kept")]
    docs, back = set_aside(docs)
    columns = [{v: k for k, v in back.items()}.get(c, c) for c in columns]
    measured = transformed(base_statistics(docs.select(*dict.fromkeys([*columns, "text", "lang", "source"]))))
    keyed = _group_key(measured)
    held = materialise(keyed.select(*columns, *names, "_lang", "_pair", *[f"q{i + 1}" for i in range(P)]), "quality-rows")
    measured = _distance(held.join(estimates(held), "_pair", "left"))
    return measured.select(
        *columns, *names, F.round("d2", 6).alias("distance2"),
        (~F.col("base_failed") & F.coalesce(F.col("d2") <= F.col("cutoff"), F.lit(True))).alias("kept"),
    ).withColumnsRenamed(back)
