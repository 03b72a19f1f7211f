"""URL filters: a list of rules for hosts and paths, and association rules mined for the rest.

URLs that a listed rule judges are the labelled ones. Spark's FP-growth mines which combinations of
their tokens go with a verdict; rules below a support or confidence, or no better than a part of
themselves, go. What is left is an inverted index, each rule under its rarest token, and a page
takes the best rule that it holds whole. Everything runs on DataFrame functions.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from labelyard.sizing import fits, materialise

# The listed rules as verdict, host, path.
LISTED = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Marks the item of a transaction that is its verdict; tokens never start with it.
VERDICT = "="


@dataclass(frozen=True)
class Mining:
    """``support`` is the share of labelled URLs that hold a rule and its verdict, ``least`` the number of them at
    least; ``tokens`` the longest combination. FP-growth, which has no bound on the length, mines the URLs with at
    most ``block`` frequent tokens; combinations that longer ones hold are counted level by level, over all URLs."""

    support: float = 0.01
    least: int = 5
    confidence: float = 0.7
    tokens: int = 4
    block: int = 10
    default: str = "allow"


def _lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lowered), path, and what follows; all empty for null or without ``://``."""
    at = F.instr(url, "://")
    rest = F.coalesce(F.when(at > 0, F.substr(url, at + 3)), F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    behind = F.substr(rest, F.length(host) + 1)
    path = F.regexp_extract(behind, r"^[^?#]*", 0)
    return _lowered(host), path, F.substr(behind, F.length(path) + 1)


def listed_rule(host: Column, path: Column, rules: list[tuple[str, str, str]] = LISTED) -> Column:
    """struct(rule, verdict) of the longest rule for the host or a domain above it whose path starts the path; else null."""
    found = None
    for verdict, domain, start in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        holds = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        value = F.struct(F.lit(domain + start).alias("rule"), F.lit(verdict).alias("verdict"))
        found = F.when(holds, value) if found is None else found.when(holds, value)
    return found if found is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def tokens_of(host: Column, path: Column, rest: Column) -> Column:
    """Distinct tokens: labels of the host, words of the path and of query and fragment, marked by where they stand."""
    def words(text: Column, mark: str) -> Column:
        return F.transform(F.filter(F.split(_lowered(text), r"[^a-z0-9\x{80}-\x{10FFFF}]+"), lambda x: x != ""), lambda x: F.concat(F.lit(mark), x))

    return F.array_distinct(F.concat(words(host, "h:"), words(path, "p:"), words(rest, "q:")))


def _held(labelled: DataFrame, least: int) -> DataFrame:
    """_row, verdict, tokens: the frequent tokens of the URLs that have any, in their order."""
    numbered = labelled.withColumn("_row", F.monotonically_increasing_id())
    each = numbered.select("_row", "verdict", F.explode("tokens").alias("token"))
    frequent = each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).select("token")
    # the frequent tokens are at most the mean number of tokens of a URL over the support
    kept = each.join(F.broadcast(frequent) if fits(frequent) else frequent, "token")
    return kept.groupBy("_row", "verdict").agg(F.sort_array(F.collect_list("token")).alias("tokens"))


def _index(sets: DataFrame, *columns: str) -> DataFrame:
    """``token`` and ``columns`` of sets with an ``antecedent``, each under the token that is in fewest of them."""
    each = sets.select(F.struct("antecedent", *columns).alias("_set"), F.explode("antecedent").alias("token"))
    shared = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    index = each.join(shared, "token").groupBy("_set").agg(F.min_by("token", F.struct("n", "token")).alias("token")).select("token", "_set.*")
    return F.broadcast(index) if fits(index) else index


def _long_combinations(held: DataFrame, mining: Mining, least: int) -> DataFrame:
    """antecedent, verdict, n: the frequent combinations that a URL with over ``mining.block`` tokens holds, in all URLs.

    A combination is as rare as its rarest part, so each level extends what is frequent by one later token.
    """
    long = held.filter(F.size("tokens") > mining.block)
    short = held.filter(F.size("tokens") <= mining.block)
    grown = long.select("_row", "verdict", "tokens", F.explode("tokens").alias("last")).withColumn("antecedent", F.array("last"))
    found = None
    for level in range(1, mining.tokens + 1):
        grown = materialise(grown.drop("last"), "url-combinations")
        here = grown.groupBy("antecedent", "verdict").agg(F.count(F.lit(1)).alias("n"))
        sets = materialise(here.select("antecedent").distinct(), "url-sets")
        elsewhere = short.select("verdict", "tokens", F.explode("tokens").alias("token")).join(_index(sets), "token").filter(
            F.size(F.array_except("antecedent", "tokens")) == 0
        ).groupBy("antecedent", "verdict").agg(F.count(F.lit(1)).alias("n"))
        counted = here.unionByName(elsewhere).groupBy("antecedent", "verdict").agg(F.sum("n").alias("n"))
        frequent = counted.groupBy("antecedent").agg(F.max("n").alias("most")).filter(F.col("most") >= least).select("antecedent")
        counted = materialise(counted.join(frequent, "antecedent", "left_semi"), "url-frequent")
        found = counted if found is None else found.unionByName(counted)
        going = counted.select("antecedent").distinct()
        later = F.filter("tokens", lambda t: t > F.element_at("antecedent", -1))
        grown = grown.join(F.broadcast(going) if fits(going) else going, "antecedent", "left_semi").select(
            "_row", "verdict", "tokens", "antecedent", F.explode(later).alias("last")
        ).withColumn("antecedent", F.concat("antecedent", F.array("last")))
    return found


def mine(labelled: DataFrame, mining: Mining = Mining()) -> DataFrame:
    """antecedent (sorted tokens), verdict, confidence, support of the rules mined from ``labelled`` (tokens, verdict).

    Confidence is taken among the labelled URLs that hold the antecedent. A rule with a part of itself
    that is as confident of the same verdict goes. No labelled URLs give no rules. Every rule above support and
    confidence is found, however many tokens a URL has; their number is bounded by the support, whatever the number of URLs.
    """
    n = labelled.count()
    least = max(mining.least, -int(-mining.support * n // 1))
    held = materialise(_held(labelled, least), "url-held")
    nothing = labelled.limit(0).select(
        F.col("tokens").alias("antecedent"), "verdict", F.lit(0.0).alias("confidence"), F.lit(0.0).alias("support")
    )
    few = F.size("tokens") <= mining.block
    transactions = held.filter(few).select(F.concat("tokens", F.array(F.concat(F.lit(VERDICT), "verdict"))).alias("items"))
    n_short, n_long = held.agg(F.count(F.when(few, 1)), F.count(F.when(~few, 1))).first()
    found = []
    if n_short:
        model = FPGrowth(itemsCol="items", minSupport=min(1.0, (least - 0.5) / n_short), minConfidence=mining.confidence).fit(transactions)
        rules = model.associationRules.filter(
            F.col("consequent")[0].startswith(VERDICT) & (F.size("antecedent") <= mining.tokens)
            & ~F.exists("antecedent", lambda x: x.startswith(VERDICT))
        )
        found.append(rules.select(
            F.sort_array("antecedent").alias("antecedent"), F.substr(F.col("consequent")[0], F.lit(2)).alias("verdict"),
            "confidence", (F.col("support") * n_short / n).alias("support"),
        ))
    if n_long:  # these take the place of what the shorter URLs say of the same combinations
        counted = materialise(_long_combinations(held, mining, least), "url-counted")
        total = counted.groupBy("antecedent").agg(F.sum("n").alias("total"))
        rules = counted.join(total, "antecedent").filter((F.col("n") >= least) & (F.col("n") / F.col("total") >= mining.confidence)).select(
            "antecedent", "verdict", (F.col("n") / F.col("total")).alias("confidence"), (F.col("n") / n).alias("support")
        )
        found = [short.join(total, "antecedent", "left_anti") for short in found] + [rules]
    if not found:
        return nothing
    rules = found[0]
    for more in found[1:]:
        rules = rules.unionByName(more)
    rules = materialise(rules, "url-rules")
    subsets = F.filter(
        F.transform(
            F.sequence(F.lit(1), F.call_function("shiftleft", F.lit(1), F.size("antecedent")) - 2),
            lambda mask: F.filter("antecedent", lambda x, i: F.call_function("shiftright", mask, i) % 2 == 1),
        ),
        lambda x: F.size(x) > 0,
    )
    parts = rules.filter(F.size("antecedent") > 1).select(
        F.col("antecedent").alias("whole"), "verdict", F.col("confidence").alias("reached"), F.explode(subsets).alias("antecedent")
    )
    worse = parts.join(rules, ["antecedent", "verdict"]).filter("confidence >= reached").select(F.col("whole").alias("antecedent"), "verdict").distinct()
    return rules.join(worse, ["antecedent", "verdict"], "left_anti")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] = LISTED, mining: Mining = Mining()) -> DataFrame:
    """page_id, host, path, rule, verdict, mined, confidence for every row of ``pages`` (page_id, url).

    ``rule`` is the listed one (null if none fits) and decides; otherwise the mined rule with the
    highest confidence, then support, then most tokens, then least by verdict and tokens, in ``mined``;
    otherwise ``mining.default``. A null url, or one without ``://``, has an empty host and path, no
    tokens and the default verdict. Repeated rows and ids stay as they are, other columns are left out,
    an empty table stays empty.
    """
    host, path, rest = url_parts(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    split = split.withColumn("listed", listed_rule(F.col("host"), F.col("path"), rules)).withColumn("tokens", tokens_of(F.col("host"), F.col("path"), F.col("rest")))
    mined = materialise(mine(split.filter("listed is not null").select("tokens", "listed.verdict"), mining), "url-kept-rules")
    index = _index(mined.withColumn("_rule", F.struct("confidence", "support", F.size("antecedent").alias("n"), "verdict", "antecedent")), "_rule").drop("antecedent")
    open_pages = split.withColumn("_row", F.monotonically_increasing_id())
    asked = open_pages.select("_row", "page_id", "host", "path", "listed", "tokens", F.explode_outer(F.when(F.col("listed").isNull(), F.col("tokens"))).alias("token"))
    matched = asked.join(index, "token", "left")
    fitting = F.when(F.size(F.array_except("_rule.antecedent", "tokens")) == 0, F.struct(
        -F.col("_rule.confidence"), -F.col("_rule.support"), -F.col("_rule.n"), F.col("_rule.verdict").alias("verdict"),
        F.col("_rule.antecedent").alias("antecedent"), F.col("_rule.confidence").alias("confidence"),
    ))
    best = matched.withColumn("best", fitting).groupBy("_row").agg(
        *(F.first(c).alias(c) for c in ("page_id", "host", "path", "listed")), F.min("best").alias("best")
    )
    return best.select(
        "page_id", "host", "path", F.col("listed.rule").alias("rule"),
        F.coalesce("listed.verdict", "best.verdict", F.lit(mining.default)).alias("verdict"),
        F.array_join("best.antecedent", " ").alias("mined"), F.col("best.confidence").alias("confidence"),
    )
