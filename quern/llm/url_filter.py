"""URL filters: given rules by host and path, then association rules mined by FP-growth and matched by an inverted index."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.common import materialise

#: (verdict, host, path): fits the host and its subdomains when the path starts with the rule's.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


def _lower_ascii(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """pages with host and path. Host: after the first :// up to /, ? or #, A-Z lower-cased; path: from there up to ? or #. Both empty without ://."""
    u = F.coalesce(F.col(url), F.lit(""))
    at = F.instr(u, "://")
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise("")
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    return pages.withColumn("host", _lower_ascii(host)).withColumn("path", F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(u)), r"(?s)^([^?#]*)", 1))


def _given(rules) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        text, verdict = F.when(fits, host + path).otherwise(text), F.when(fits, kind).otherwise(verdict)
    return text, verdict


def tokens(url: str = "url") -> Column:
    """The distinct tokens of a row that has host and path: host labels, top-level domain, path parts, file ending, query keys.

    Runs of digits become one sign, so numbered pages share tokens.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    sign = lambda x: F.regexp_replace(x, "[0-9]+", "0")
    labels = F.filter(F.split("host", r"\."), lambda x: x != "")
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    query = F.regexp_extract(u, r"(?s)\?([^#]*)", 1)
    return F.array_sort(
        F.array_distinct(
            F.concat(
                F.transform(labels, lambda x: F.concat(F.lit("h:"), sign(x))),
                F.when(F.size(labels) > 0, F.array(F.concat(F.lit("tld:"), F.element_at(labels, -1)))).otherwise(F.array().cast("array<string>")),
                F.transform(parts, lambda x, i: F.concat(F.lit("p"), F.least(i, F.lit(3)).cast("string"), F.lit(":"), sign(x))),
                F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.substring_index(x, "=", 1))),
            )
        )
    )


RULE_SCHEMA = "rule_id long, tokens array<string>, verdict string, confidence double, support double"


def classes(baskets: DataFrame, least: float) -> DataFrame:
    """(token, class) of the tokens met in at least `least` rows of baskets (tokens): tokens that always occur together are one
    class, named by its first. Rows are told apart by 56 bits of hashes of what they hold, summed per token."""
    hashes = [F.sum(F.xxhash64("tokens", F.lit(seed)).bitwiseAND(F.lit((1 << 28) - 1))) for seed in (1, 2)]
    held = baskets.select("tokens", F.explode("tokens").alias("token"))
    per = held.groupBy("token").agg(F.count("*").alias("n"), hashes[0].alias("h1"), hashes[1].alias("h2")).where(F.col("n") >= least)
    names = per.groupBy("n", "h1", "h2").agg(F.min("token").alias("class"))
    return materialise(per.join(names, ["n", "h1", "h2"]).select("token", "class"), "classes")


def mine(labelled: DataFrame, min_support: float = 0.002, min_confidence: float = 0.9, min_count: int = 8) -> tuple[DataFrame, DataFrame]:
    """Rules (rule_id, tokens, verdict, confidence, support) from rows (tokens array<string>, label string or null), and the
    tokens' `classes`: a rule's tokens are names of classes, any token of a class will do.

    Only rows with a label are transactions. Rules kept: one label to the right, confidence and support at least as given,
    and no shorter rule of the same verdict with as much confidence. Support is a share of the rows, `min_count` rows at
    least, so the number of surviving combinations does not follow the number of rows. As a class counts once, rows that share a
    long url make one item of it, not all combinations of its parts. Names of classes that reach the support, the mean
    number of tokens over min_support at the utmost, are one literal of the plan.
    """
    label = F.concat(F.lit("label="), F.col("label"))
    baskets = labelled.where("label is not null and size(tokens) > 0")
    spark = labelled.sparkSession
    n = baskets.count()
    if not n:
        return spark.createDataFrame([], RULE_SCHEMA), spark.createDataFrame([], "token string, class string")
    support = min(1.0, max(min_support, min_count / n))
    known = classes(baskets, support * n - 1e-6)
    names = [r[0] for r in known.select("class").distinct().collect()]
    items = F.concat(F.array_intersect("tokens", F.lit(names) if names else F.array().cast("array<string>")), F.array(label))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=min_confidence).fit(baskets.select(items.alias("items")))
    found = model.associationRules.where(F.element_at("consequent", 1).startswith("label=") & ~F.exists("antecedent", lambda x: x.startswith("label=")))
    found = materialise(found.select(F.array_sort("antecedent").alias("tokens"), F.substring(F.element_at("consequent", 1), 7, 100).alias("verdict"), "confidence", "support"), "rules")
    a, b = found.alias("a"), found.alias("b")
    # a shorter rule inside this one shares a token with it
    inside = a.select("tokens", "verdict", "confidence", F.explode("tokens").alias("k")).alias("a").join(b.select("tokens", "verdict", "confidence", F.explode("tokens").alias("k")).alias("b"), "k")
    inside = inside.where("a.verdict = b.verdict and size(b.tokens) < size(a.tokens) and b.confidence >= a.confidence - 1e-9 and size(array_except(b.tokens, a.tokens)) = 0")
    spare = inside.select("a.tokens", "a.verdict").distinct()
    rules = found.join(spare, ["tokens", "verdict"], "left_anti").select(F.xxhash64("tokens", "verdict").alias("rule_id"), "tokens", "verdict", "confidence", "support")
    return materialise(rules, "rules"), known


def match(sets: DataFrame, rules: DataFrame, known: DataFrame) -> DataFrame:
    """(tokens, verdict, rule_tokens) of the best mined rule for each row of sets (tokens, no repeats) that one fits.

    Inverted index: rules are listed under each token of each of their classes; a rule fits when it is met under as many classes as
    it has. Best: highest confidence, then most classes, then support, then block.
    """
    index = rules.select("rule_id", F.size("tokens").alias("need"), F.explode("tokens").alias("class")).join(known, "class")
    met = sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token").groupBy("tokens", "rule_id", "need").agg(F.countDistinct("class").alias("n")).where("n = need")
    best = met.join(rules.withColumnRenamed("tokens", "rule_tokens"), "rule_id").groupBy("tokens").agg(F.max(F.struct("confidence", "need", "support", (F.col("verdict") == "block").alias("b"), "verdict", "rule_tokens")).alias("m"))
    return best.select("tokens", F.col("m.verdict").alias("mined_verdict"), F.col("m.rule_tokens").alias("mined_rule"))


def url_filter(pages: DataFrame, rules=RULES, labels: DataFrame | None = None, min_support: float = 0.002, min_confidence: float = 0.9) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_rule (tokens; null if none decided) of every row of pages (page_id, url).

    A given rule that fits decides (the longest; rule holds its text). The other rows get the verdict of the best mined rule,
    or allow. Labels to mine from: the given rules' own verdicts and, where given, labels (page_id, label: block or allow; block
    where a page has both).
    A null url, or one without ://, has empty host and path and is allowed. Rows repeat as they came; a null page_id has no
    label of its own; other columns are not read; an empty table gives no rows.
    """
    text, verdict = _given(rules)
    p = with_parts(pages.select("page_id", "url")).withColumn("rule", text).withColumn("given", verdict).withColumn("tokens", tokens())
    p = p.withColumn("tokens", F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(F.col("tokens")))
    p = p.select("page_id", "host", "path", "rule", "given", "tokens")
    if labels is not None:
        p = p.join(labels.groupBy(F.col("page_id").alias("_id")).agg(F.max("label").alias("_label")), p.page_id == F.col("_id"), "left").drop("_id")
    else:
        p = p.withColumn("_label", F.lit(None).cast("string"))
    p = materialise(p, "urls")
    mined = mine(p.select("tokens", F.coalesce("given", "_label").alias("label")), min_support, min_confidence)
    best = match(p.where("given is null").select("tokens").distinct(), *mined)
    best = materialise(best, "best").select(F.col("tokens").alias("_t"), "mined_verdict", "mined_rule")
    out = p.join(best, (p.tokens == best["_t"]) & p.given.isNull(), "left")
    return out.select("page_id", "host", "path", "rule", F.coalesce("given", "mined_verdict", F.lit("allow")).alias("verdict"), F.when(F.col("given").isNull(), F.col("mined_rule")).alias("mined_rule"))
