"""Label centroids and nearest-centroid classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from promptweir.functions import vectors as vec


def label_centroids(vectors: DataFrame, label: str = "label", embedding: str = "embedding") -> DataFrame:
    """Element-wise mean vector per label.

    Partial sums per (label, position) are formed before the shuffle, so even one label
    holding most rows sends only its dimensions from each task.
    """
    cells = vectors.select(label, F.posexplode(embedding).alias("pos", "x"))
    means = cells.groupBy(label, "pos").agg(F.avg(F.col("x").cast("double")).alias("mean"))
    ordered = F.array_sort(F.collect_list(F.struct("pos", "mean")))
    return means.groupBy(label).agg(F.transform(ordered, lambda s: s["mean"]).alias("centroid"))


def _declared(centroids: DataFrame, categories: list, label: str) -> Column:
    """Unit centroids of the declared categories as one array.

    It holds at most one entry per declared category, which is what makes it safe to
    hand to every task; the scalar subquery runs once, before the scan of the vectors.
    """
    order = F.create_map(*[F.lit(x) for i, c in enumerate(categories) for x in (c, i)])
    known = centroids.where(F.col(label).isin(categories)).select(
        F.element_at(order, F.col(label)).alias("cat_ord"), F.col(label).alias("category"),
        vec.unit(F.col("centroid")).alias("unit"))
    return known.agg(F.array_sort(F.collect_list(F.struct("cat_ord", "category", "unit")))).scalar()


def with_similarities(
    vectors: DataFrame, centroids: DataFrame, categories: list, variants: list[str],
    label: str = "label",
) -> DataFrame:
    """Adds ``similarities``: per declared category the best cosine over the variants."""
    held = vectors.withColumn("_centroids", _declared(centroids, categories, label))

    def similarities(norms: Column) -> Column:
        def best(c: Column) -> Column:
            cosines = [
                F.when(norms[v] > 0, vec.dot(F.col(v), c["unit"]) / norms[v]) for v in variants]
            return F.struct(
                c["cat_ord"].alias("cat_ord"), c["category"].alias("category"),
                (F.greatest(*cosines) if len(cosines) > 1 else cosines[0]).alias("similarity"))

        return F.transform("_centroids", best)

    norms = F.struct(*[vec.norm(F.col(v)).alias(v) for v in variants])
    return held.withColumn("similarities", vec.let(norms, similarities)).drop("_centroids")


def similarity_rows(vectors: DataFrame, centroids: DataFrame, categories: list, variants: list[str], key: str, label: str = "label") -> DataFrame:
    return with_similarities(vectors, centroids, categories, variants, label).select(key, F.inline_outer("similarities"))


def classify(
    vectors: DataFrame, centroids: DataFrame, categories: list, variants: list[str],
    label: str = "label", boost: bool = True,
) -> DataFrame:
    """Adds ``embedding_category`` and ``embedding_confidence``; NULL without vectors.

    ``boost=False`` with a single variant is the older form of the classifier.
    """
    scored = with_similarities(vectors, centroids, categories, variants, label)
    usable = F.filter("similarities", lambda s: s["similarity"].isNotNull())
    best = F.array_max(F.transform(usable, lambda s: F.struct(
        s["similarity"].alias("v"), (-s["cat_ord"]).alias("r"), s["category"].alias("category"))))
    scored = scored.withColumn("_best", best)
    top = F.col("_best.v")
    confidence = F.when(top > 0.8, F.least(top + 0.1, F.lit(1.0))).otherwise(top) if boost else top
    return (
        scored.withColumn("embedding_category", F.col("_best.category"))
        .withColumn("embedding_confidence", confidence)
        .drop("similarities", "_best")
    )


def cosine_pairs(pairs: DataFrame, left: str, right: str, out: str = "cosine") -> DataFrame:
    return pairs.withColumn(out, vec.cosine(F.col(left), F.col(right)))
