"""URL filters: rules by host and path, and boosted trees on lexical features for the rest.

The trees learn from the urls that a rule decides and judge those that none does. Everything is
DataFrame functions and Spark's own gradient-boosted trees.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweir.session import written

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"),
         ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled urls the trees learn from, at most, in order of a hash of the url.
TRAINING_ROWS = 20_000
TREES, DEPTH = 12, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def with_parts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds host and path; both empty for NULL and where there is no `://`."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    rest = F.when(F.locate("://", text) > 0, F.substring(text, F.locate("://", text) + 3, F.length(text))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return pages.withColumns({"host": F.translate(host, UPPER, LOWER), "path": path})


def matched_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; NULL where none does."""
    rule = verdict = F.lit(None).cast("string")
    for said, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # the last one that fits stays
        domain, _, start = text.partition("/")
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(f"/{start}")
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(said)).otherwise(verdict)
    return rule, verdict


FEATURES = ("length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters",
            "marks", "suffix_count", "suffix_blocked", "segment_blocked")


def with_features(pages: DataFrame, url: str = "url") -> DataFrame:
    """Adds lexical features of a table with host and path."""
    text = F.coalesce(F.col(url).cast("string"), F.lit(""))
    size = F.greatest(F.length(text), F.lit(1))
    query = F.regexp_extract(text, r"\?([^#]*)", 1)
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / size
    entropy = F.aggregate(F.array_distinct(F.split(text, "")), F.lit(0.0), lambda s, c: s - F.when(
        c == "", 0.0).otherwise(share(c) * F.log2(F.greatest(share(c), F.lit(1e-9)))))
    count = lambda column, pattern: F.regexp_count(column, F.lit(pattern)).cast("double")
    return pages.withColumns({
        "length": F.length(text).cast("double"), "host_length": F.length("host").cast("double"),
        "path_length": F.length("path").cast("double"), "depth": count(F.col("path"), "/[^/]"),
        "labels": count(F.col("host"), r"\."), "digit_ratio": count(text, "[0-9]") / size, "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(count(query, "&") + 1), "marks": count(text, r"[-_%~@;=+]"),
        "suffix": F.regexp_extract("host", r"[^.]*$", 0), "segment": F.regexp_extract("path", r"^/([^/]*)", 1)})


def _rates(labelled: DataFrame, by: str) -> DataFrame:
    """Per value: urls, labelled urls, blocked ones."""
    return labelled.groupBy(F.col(by).alias(f"{by}_key")).agg(
        F.count(F.lit(1)).alias(f"{by}_n"), F.count("label").alias(f"{by}_known"),
        F.coalesce(F.sum("label"), F.lit(0.0)).alias(f"{by}_sum"))


def _with_rates(rows: DataFrame, rates: DataFrame, by: str, prior: float) -> DataFrame:
    """Smoothed share of blocked urls with the same value, a labelled url's own label left out."""
    own = F.coalesce(F.col("label"), F.lit(0.0))
    known = F.coalesce(f"{by}_known", F.lit(0)) - F.col("label").isNotNull().cast("int")
    return rows.join(rates, F.col(by) == F.col(f"{by}_key"), "left").withColumn(
        f"{by}_blocked", (F.coalesce(f"{by}_sum", F.lit(0.0)) - own + 5 * prior) / (known + 5))


def judge(pages: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", rows: int = TRAINING_ROWS) -> DataFrame:
    """key, host, path, rule, verdict and blocked_score of every row.

    A NULL url or one without `://` has empty parts, fits no rule and is left to the trees. Where
    no url, or only one kind, is decided by rules the trees have nothing to learn: the one kind
    seen, or `allow`, is the verdict. Repeated rows get equal verdicts.
    """
    parted = with_parts(pages.select(F.col(key).alias("page_id"), F.col(url).cast("string").alias("url")))
    rule, said = matched_rule(F.col("host"), F.col("path"), rules)
    known = parted.withColumns({"rule": rule, "said": said})
    known = known.withColumn("label", F.when(F.col("said") == "block", 1.0).when(F.col("said") == "allow", 0.0))
    found = written(with_features(known), "urls")
    labelled, blocked = found.agg(F.count("label"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    columns = ["page_id", "host", "path", "rule"]
    if blocked in (0, labelled):
        same = "block" if labelled and blocked == labelled else "allow"
        return found.select(*columns, F.coalesce("said", F.lit(same)).alias("verdict"),
                            F.lit(1.0 if same == "block" else 0.0).alias("blocked_score"))
    prior = blocked / labelled
    rated = found
    for by in ("suffix", "segment"):
        rated = _with_rates(rated, _rates(found, by), by, prior)
    rated = rated.withColumn("suffix_count", F.log1p(F.coalesce("suffix_n", F.lit(0)).cast("double")))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    sample = rated.where("label IS NOT NULL").orderBy(F.xxhash64("url"), "url", "page_id").limit(rows)
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=1)
    model = trees.fit(vectors.transform(written(sample.select("label", *FEATURES), "sample")))
    scored = model.transform(vectors.transform(rated)).withColumn("blocked_score", vector_to_array("probability")[1])
    return scored.select(
        *columns, F.coalesce("said", F.when(F.col("blocked_score") >= 0.5, "block").otherwise("allow")).alias("verdict"),
        "blocked_score")
