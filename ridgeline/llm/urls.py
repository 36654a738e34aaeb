"""Operator 5, URL filters: host and path rules, and gradient-boosted trees on lexical features where no rule fits.

The trees learn from the URLs that a rule judges. Features are lengths, depth, shares of digits, entropy, numbers of
parameters, and how often the URLs of a host suffix are blocked. All of it is DataFrame functions
and Spark's own tree learner. The blocked shares are counted over all rows that a rule judges; for a URL that the trees learn
from they leave out its part of the hosts (of FOLDS), so a share never holds the label that it is to tell, and every such URL
is shown a second time as if its suffixes were unknown, for hosts under suffixes that no rule knows. The trees alone learn
from at most about TRAIN_ROWS distinct URLs, frequent ones first, weighted so that they stand for all rows and that both
verdicts weigh the same. A URL is blocked from a probability of BLOCK_AT on, and allowed in doubt.

Edge cases: a null URL, and one without ``://``, has an empty host and path and is judged by its features; repeated rows
are judged alike; where the rules label nothing, or all alike, that verdict (allow, if none) holds for the rest; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import small_side, written

#: (verdict, host, path): a rule fits its host and all subdomains where the path starts with the rule's.
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAIN_ROWS = 20_000
#: Parts of the hosts, and the probability from which on a URL of no rule is blocked.
FOLDS, BLOCK_AT = 5, 0.7
FEATURES = ("length", "host_length", "path_length", "depth", "digits", "entropy", "params", "labels", "hyphens", "longest", "suffix_rate", "suffix_known", "domain_rate", "domain_known")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first :// up to / ? # or the end, A-Z in lower case; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ? # or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: tuple[tuple[str, str, str], ...] = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, name, begin in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(begin)
        rule, verdict = F.when(fits, F.lit(name + begin)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def _count(text: Column, chars: str) -> Column:
    return F.length(text) - F.length(F.translate(text, chars, ""))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / n
    return F.aggregate(F.filter(F.array_distinct(F.split(text, "")), lambda c: c != ""), F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c)))


def lexical(pages: DataFrame) -> DataFrame:
    """pages (url and others) with ``_host``, ``_path`` and the features that need no statistics."""
    url = F.coalesce(F.col("url"), F.lit(""))
    rows = pages.withColumns({"_host": host_of(F.col("url")), "_path": path_of(F.col("url")), "_url": url})
    query = F.regexp_extract("_url", r"(?s)\?([^#]*)", 1)
    return rows.withColumns({
        "length": F.length("_url").cast("double"), "host_length": F.length("_host").cast("double"), "path_length": F.length("_path").cast("double"),
        "depth": _count(F.col("_path"), "/").cast("double"), "digits": _count(F.col("_url"), "0123456789") / F.greatest(F.length("_url"), F.lit(1)),
        "entropy": _entropy(F.col("_url")), "params": F.when(query == "", 0).otherwise(_count(query, "&") + 1).cast("double"),
        "labels": F.size(F.split("_host", r"\.")).cast("double"), "hyphens": _count(F.col("_host"), "-").cast("double"),
        "longest": F.array_max(F.transform(F.split("_host", r"\."), F.length)).cast("double"),
        "_suffix": F.substring_index("_host", ".", -1), "_domain": F.substring_index("_host", ".", -2),
    })


def suffix_statistics(labelled: DataFrame, suffix: str) -> DataFrame:
    """(suffix, _fold, n, blocked): the rows of each suffix and part of the hosts, and how many of them are blocked."""
    return labelled.groupBy(suffix, "_fold").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("blocked"))


def blocked_share(n: Column, blocked: Column, name: str) -> list[Column]:
    """The smoothed share of blocked rows, and the logarithm of the number of rows."""
    return [((blocked + 1.0) / (n + 2.0)).alias(f"{name}_rate"), F.log1p(n.cast("double")).alias(f"{name}_known")]


def without_own_fold(counted: DataFrame, suffix: str, name: str) -> DataFrame:
    """(suffix, _fold, rate, known): of every suffix and part of the hosts, what the other parts say of the suffix."""
    whole = counted.groupBy(suffix).agg(F.sum("n").alias("all_n"), F.sum("blocked").alias("all_blocked"))
    return counted.join(whole, suffix).select(suffix, "_fold", *blocked_share(F.col("all_n") - F.col("n"), F.col("all_blocked") - F.col("blocked"), name))


def training_urls(labelled: DataFrame, n: int) -> DataFrame:
    """The distinct URLs of the ``n`` labelled rows to learn from, about TRAIN_ROWS at most, with their features and a ``weight``.

    A URL is taken with a chance in proportion to its rows, and weighs its rows over that chance.
    """
    same = ["label", "_fold", "_suffix", "_domain", *[f for f in FEATURES if not f.endswith(("_rate", "_known"))]]
    urls = labelled.groupBy("_url").agg(F.count(F.lit(1)).cast("double").alias("weight"), *[F.first(x).alias(x) for x in same])
    chance = F.least(F.lit(1.0), F.col("weight") * (TRAIN_ROWS / n))
    return urls.filter(F.pmod(F.xxhash64("_url"), F.lit(1 << 30)) < chance * (1 << 30)).withColumn("weight", F.col("weight") / chance)


def judged(pages: DataFrame, *keep: str, rules: tuple[tuple[str, str, str], ...] = RULES, unknown: tuple[str, ...] = ()) -> DataFrame:
    """host, path, rule and verdict of every row of pages (url), beside the columns ``keep``.

    The rows of the rules ``unknown`` are judged by the trees, which don't learn from them: a test of how learning carries over.
    """
    rows = lexical(pages.select(F.struct(*[F.col(k) for k in keep]).alias("_row"), "url"))
    rule, verdict = rule_of(F.col("_host"), F.col("_path"), rules)
    rows = rows.withColumns({"_rule": rule, "_verdict": verdict, "_fold": F.pmod(F.xxhash64("_host"), F.lit(FOLDS)).cast("int")})
    rows = written(rows.withColumn("_verdict", F.when(~F.coalesce(F.col("_rule").isin(*unknown), F.lit(False)), F.col("_verdict"))), "urls")
    labelled = rows.filter("_verdict is not null").withColumn("label", (F.col("_verdict") == "block").cast("double"))
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    learned = written(training_urls(labelled, n), "url-sample") if 0 < blocked < n else None
    shares = {r["label"]: r["w"] for r in learned.groupBy("label").agg(F.sum("weight").alias("w")).collect()} if learned is not None else {}
    if len(shares) < 2:
        return _result(rows, F.lit("block" if blocked > n / 2 else "allow"))
    for suffix, name in (("_suffix", "suffix"), ("_domain", "domain")):
        counted = written(suffix_statistics(labelled, suffix), "suffixes")
        known = counted.groupBy(suffix).agg(F.sum("n").alias("n"), F.sum("blocked").alias("blocked"))
        rows = rows.join(small_side(written(known.select(suffix, *blocked_share(F.col("n"), F.col("blocked"), name)), "suffix-shares"), suffix), suffix, "left")
        learned = learned.join(small_side(without_own_fold(counted, suffix, name), suffix), [suffix, "_fold"], "left")
    fill = {f"{name}_rate": 0.5 for name in ("suffix", "domain")} | {f"{name}_known": 0.0 for name in ("suffix", "domain")}
    together = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    even = F.col("weight") * F.when(F.col("label") == 1.0, 0.5 / shares[1.0]).otherwise(0.5 / shares[0.0]) * sum(shares.values())
    unseen = learned.withColumns({k: F.lit(v) for k, v in fill.items()})
    train = together.transform(written(learned.fillna(fill).unionByName(unseen).select("label", even.alias("weight"), *FEATURES), "url-train"))
    model = GBTClassifier(featuresCol="features", labelCol="label", weightCol="weight", maxIter=10, maxDepth=3, seed=7, cacheNodeIds=False).fit(train)
    found = model.transform(together.transform(rows.fillna(fill)))
    return _result(found, F.when(vector_to_array("probability")[1] >= BLOCK_AT, "block").otherwise("allow"))


def _result(rows: DataFrame, otherwise: Column) -> DataFrame:
    return rows.select("_row.*", F.col("_host").alias("host"), F.col("_path").alias("path"), F.col("_rule").alias("rule"), F.coalesce("_verdict", otherwise).alias("verdict"))


