"""URL filter: longest-match host and path rules, and gradient-boosted trees for the rest.

DataFrame functions and Spark's own tree learner only. The trees read lexical features
(lengths, depth, digit ratio, character entropy, parameter counts) and statistics of the
host's suffix, and are trained on a bounded sample of labelled URLs: unless others are
given, those that a rule has judged.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

# Verdict, host, path.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Rows of the training sample (by hash, half of each verdict where there are so many), and the trees' size.
SAMPLE_ROWS, TREES, DEPTH = 5000, 10, 3
#: Weight of one half in a suffix's share of blocked URLs (both verdicts weigh the same).
SMOOTHING = 20.0
#: Power of ten for suffixes that no judged URL has.
RARE = -12.0
FEATURES = ("url_length", "host_length", "path_length", "depth", "dots", "hyphens", "digit_ratio", "entropy", "parameters",
            "parameter_length", "fragment", "suffix_share", "suffix_blocked")


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host and path."""
    rest = F.when(F.instr("url", "://") > 0, F.expr("substring(url, instr(url, '://') + 3)"))
    cut = pages.select("page_id", "url", rest.alias("rest"))
    host = F.coalesce(F.regexp_extract("rest", r"^[^/?#]*", 0), F.lit(""))
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return cut.select("page_id", "url", lowered.alias("host"), F.coalesce(F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1), F.lit("")).alias("path"))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of the longest rule that fits the host or a domain above it and starts
    the path; nulls if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(kind)).otherwise(verdict)
    return rule, verdict


def lexical(rows: DataFrame) -> DataFrame:
    """``rows`` (url, host, path) with the lexical features and the host's suffix."""
    url, n = F.coalesce("url", F.lit("")), F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1))
    count = lambda col, ch: F.length(col) - F.length(F.replace(col, F.lit(ch), F.lit("")))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    bits = F.expr("aggregate(transform(array_distinct(split(coalesce(url, ''), '')), c -> cast(length(coalesce(url, '')) - length(replace(coalesce(url, ''), c, '')) as double)), "
                  "0D, (a, x) -> a + if(x > 0, x * log2(x), 0D))")
    return rows.withColumns({
        "url_length": F.length(url).cast("double"), "host_length": F.length("host").cast("double"), "path_length": F.length("path").cast("double"),
        "depth": count(F.col("path"), "/").cast("double"), "dots": count(F.col("host"), ".").cast("double"), "hyphens": count(F.col("host"), "-").cast("double"),
        "digit_ratio": (n - F.length(F.regexp_replace(url, "[0-9]", ""))) / n.cast("double"), "entropy": F.log2(n.cast("double")) - bits / n,
        "parameters": count(query, "=").cast("double"), "parameter_length": F.length(query).cast("double"), "fragment": F.instr(url, "#").cast("boolean").cast("double"),
        "suffix": F.substring_index("host", ".", -1)})


def judged(pages: DataFrame, rules=RULES, labelled: DataFrame | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row.

    ``labelled``: (url, verdict) rows to train on. A null or scheme-less url has an empty host
    and path and is judged by the trees like any other without a rule; repeated rows get equal
    verdicts; an empty table gives an empty result. If the labelled URLs are all of one verdict,
    it holds for the rest; without any, the rest is allowed. Other columns are not read."""
    rows = parsed(pages)
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    rows = lexical(rows.withColumn("rule", rule).withColumn("ruled", verdict))
    known = rows.withColumn("verdict", F.col("ruled"))
    if labelled is not None:
        # the verdict rides along where a page has its id: a url may have several rows and both verdicts
        known = lexical(parsed(labelled.select(F.col("verdict").alias("page_id"), "url"))).withColumn("verdict", F.col("page_id"))
    # a suffix's share of all URLs, in whole powers of ten: a finer count would name the suffix itself
    share = F.count("*") / F.lit(float(max(rows.count(), 1)))
    per_suffix = rows.groupBy("suffix").agg(F.floor(F.log10(share)).cast("double").alias("suffix_share"))
    blocked = F.avg(F.when(known.verdict == "block", 1.0).when(known.verdict == "allow", 0.0))
    named = F.count(F.when(known.verdict.isin("block", "allow"), 1))
    shares = known.groupBy("suffix").agg(blocked.alias("share"), named.alias("n"), F.sum(F.when(known.verdict == "block", 1).otherwise(0)).alias("b"))
    total = shares.agg(F.sum("b").alias("b"), F.sum("n").alias("n")).first()
    n_blocked, n_known = total.b or 0, total.n or 0
    out = ["page_id", "host", "path", "rule"]
    if not 0 < n_blocked < n_known:
        only = "block" if n_known and n_blocked == n_known else "allow"
        return rows.select(*out, F.coalesce("ruled", F.lit(only)).alias("verdict"))
    n_allowed = n_known - n_blocked
    weight = {"block": n_known / (2 * n_blocked), "allow": n_known / (2 * n_allowed)}  # rules say nothing of how many are bad
    b, a = F.col("b") * F.lit(weight["block"]), (F.col("n") - F.col("b")) * F.lit(weight["allow"])
    shares = shares.select("suffix", ((b + F.lit(SMOOTHING / 2)) / (a + b + F.lit(SMOOTHING))).alias("suffix_blocked"))
    stats = written(per_suffix.join(shares, "suffix", "left"), "url-suffixes")
    with_stats = lambda x: x.join(stats, "suffix", "left").fillna({"suffix_share": RARE, "suffix_blocked": 0.5})
    half = sample_rows // 2
    take = {"block": min(n_blocked, max(half, sample_rows - n_allowed)), "allow": min(n_allowed, max(sample_rows - half, sample_rows - n_blocked))}
    # by row id and url: copies of a url are drawn one by one
    sides = [known.filter(known.verdict == v).orderBy(F.xxhash64("page_id", "url"), "url").limit(n) for v, n in take.items()]
    drawn = {v: sum(take.values()) / (2 * n) for v, n in take.items()}  # both verdicts weigh the same in the sample, too
    sample = with_stats(sides[0].unionAll(sides[1])).select(*FEATURES, (F.col("verdict") == "block").cast("double").alias("y"),
                                       F.when(F.col("verdict") == "block", F.lit(drawn["block"])).otherwise(F.lit(drawn["allow"])).alias("w"), F.xxhash64("page_id", "url").alias("k"))
    table = VectorAssembler(inputCols=list(FEATURES), outputCol="x")
    fitted = written(sample.repartition(1).sortWithinPartitions("k", *FEATURES), "url-sample")
    model = GBTClassifier(featuresCol="x", labelCol="y", weightCol="w", predictionCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=6, checkpointInterval=-1).fit(table.transform(fitted.coalesce(1)))
    scored = model.transform(table.transform(with_stats(rows)))
    return scored.select(*out, F.coalesce("ruled", F.when(F.col("blocked") > 0.5, "block").otherwise("allow")).alias("verdict"))
