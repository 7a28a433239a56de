"""Near-duplicate embeddings through a pivot-permutation index.

A vector is described by its nearest reference points (pivots). Every pivot has an inverted list of
the vectors that name it. Two vectors of one label become candidates when they share enough pivots
and are verified by their cosine in double precision. A pair is handled in the list of the smallest
pivot it shares, so it is counted once.

Every label has pivots of its own, a share of its vectors taken by hash that grows with the root of
their number. Vectors are described by their directions from the mean of these, so a direction that
all have in common does not count. How many pivots a vector names and how many two must share is
tried out on pivots and points made at the wanted cosine from them (``fitted``).

Equal vectors are one class with a count. A list with many members is cut into blocks that meet
pairwise, so no task holds more than two blocks whatever the label or pivot. A block returns sums
per vector and a spanning set of links, never its pairs.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from promptweir.llm.common import dealt, finite_vector
from promptweir.llm.components import components
from promptweir.session import written

COSINE = 0.93
#: Pivots a vector names, and how many two vectors must share, where that finds enough.
NAMED, SHARED = 12, 3
#: Share of the points tried out that has to be found.
FOUND, TRIED = 0.99, 256
#: Twice the pivots are named while more than this share of all pairs are candidates, if they cut it so far.
FEW, WORTH = 0.1, 0.7
#: Pivots of a label with n vectors: the larger of both numbers, the second times the root of n.
LEAST_PIVOTS, PIVOTS_PER_ROOT = 32, 4
#: A pivot closer than this to another is left out; the first bound that leaves half of them.
APART = (0.8, 0.9, 0.95, 0.99)
#: Vectors described by one call.
PART = 8_192
BLOCK = 1_500


def _unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    v = v / np.maximum(np.abs(v).max(1, keepdims=True), np.finfo(float).tiny)  # no overflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nearest_pivots(vectors: np.ndarray, pivots: np.ndarray, named: int = NAMED) -> np.ndarray:
    """The pivots of each vector from the nearest on, by cosine of unit vectors."""
    close = vectors @ pivots.T
    n = min(named, close.shape[1])
    some = np.argpartition(-close, n - 1, axis=1)[:, :n] if n < close.shape[1] else np.tile(np.arange(n), (len(close), 1))
    return np.take_along_axis(some, np.argsort(-np.take_along_axis(close, some, 1), axis=1, kind="stable"), 1)


def apart(points: np.ndarray, closest: float) -> np.ndarray:
    """Points in order, without those close to an earlier one: a large group of near copies would
    else take many pivots and its members would name different ones."""
    kept = np.empty_like(points)
    n = 0
    for row in points:
        if not (kept[:n] @ row > closest).any():
            kept[n] = row
            n += 1
    return kept[:n]


@dataclass(frozen=True)
class Index:
    mean: np.ndarray
    pivots: np.ndarray
    named: int
    shared: int

    def describe(self, unit: np.ndarray, named: int | None = None) -> np.ndarray:
        away = unit - self.mean
        length = np.linalg.norm(away, axis=1, keepdims=True)
        return nearest_pivots(away / np.where(length > 0, length, 1), self.pivots, named or self.named)


def fitted(unit: np.ndarray, cosine: float = COSINE, named: int = NAMED, shared: int = SHARED) -> Index:
    """The index for a sample of unit vectors: from `named` pivots and at most `shared` ones in common
    on, a setting that finds enough of the points that lie at `cosine` to a vector of the sample, in the
    direction of another one. Where none does, every vector names every pivot and nothing is left out."""
    mean = unit.mean(0) if len(unit) > 1 else np.zeros(unit.shape[1])
    away = unit - mean
    length = np.linalg.norm(away, axis=1, keepdims=True)
    away = away[length[:, 0] > 1e-9] / length[length[:, 0] > 1e-9]
    if not len(away):  # all alike: one pivot, named by all
        mean, away = np.zeros_like(mean), unit[:1]
    for closest in APART:
        pivots = apart(away, closest)
        if 2 * len(pivots) >= len(away):
            break
    own, other = unit[:TRIED], np.roll(unit, -1, axis=0)[:TRIED]
    along = (own * other).sum(1, keepdims=True)
    across = other - along * own
    size = np.linalg.norm(across, axis=1, keepdims=True)
    made = cosine * own + np.sqrt(1 - cosine * cosine) * across / np.where(size > 0, size, 1)
    made = np.where((along >= cosine) | (size < 1e-9), other, made)
    every = Index(mean, pivots, len(pivots), 1)
    best, fewest = every, 1.0
    while 2 * named <= len(pivots) and fewest > FEW:
        mine, theirs = (_incidence(every.describe(x, named), len(pivots)) for x in (own, made))
        least = min(shared, int(np.quantile((mine * theirs).sum(1), 1 - FOUND, method="lower")))
        met = (mine @ mine.T >= least)[np.triu_indices(len(mine), 1)].mean()
        if least and met < fewest * (1 if best is every else WORTH):
            best, fewest = Index(mean, pivots, named, least), met
        named, shared = 2 * named, named  # of more pivots up to half may have to be shared
    return best


def _describe(cosine: float, named: int, shared: int):
    def describe(rows: pd.DataFrame, sample: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return rows.assign(pivots=[], shared=[])
        if sample.empty:  # a label no vector of which was taken: one list for all
            return rows.assign(pivots=[np.zeros(1, np.int32)] * len(rows), shared=1)
        index = fitted(_unit(np.stack(sample.sort_values("s_node")["s_vector"].to_numpy())), cosine, named, shared)
        found = index.describe(_unit(np.stack(rows["vector"].to_numpy()))).astype(np.int32)
        return rows.assign(pivots=list(found), shared=index.shared)
    return describe


def _compare(cosine: float):
    def compare(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        _, _, pivot, one, two = key
        left, right = rows[rows["block"] == one].reset_index(drop=True), rows[rows["block"] == two].reset_index(drop=True)
        same = one == two
        count = int(max(np.max(x) for x in rows["pivots"])) + 1
        names = lambda frame: _incidence(frame["pivots"].to_numpy(), count)
        a, b = names(left), names(right)
        need = int(rows["shared"].iloc[0])
        va, vb = _unit(np.stack(left["vector"].to_numpy())) if len(left) else np.zeros((0, 1)), \
            _unit(np.stack(right["vector"].to_numpy())) if len(right) else np.zeros((0, 1))
        links_a, links_b = np.zeros(len(left), np.int64), np.zeros(len(right), np.int64)
        weight_a, weight_b = left["copies"].to_numpy(), right["copies"].to_numpy()
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for at in range(0, len(left), 256):
            part = slice(at, at + 256)
            candidate = a[part] @ b.T >= need
            if pivot:
                candidate &= a[part, :pivot] @ b[:, :pivot].T < 0.5  # no smaller pivot is shared
            if same:
                candidate &= np.arange(len(left))[part, None] < np.arange(len(right))[None, :]
            i, j = np.nonzero(candidate)
            for k in range(0, len(i), 50_000):
                x, y = i[k:k + 50_000] + at, j[k:k + 50_000]
                close = np.einsum("ij,ij->i", va[x], vb[y]) >= cosine
                x, y = x[close], y[close]
                links_a += np.bincount(x, weight_b[y], len(left)).astype(np.int64)
                links_b += np.bincount(y, weight_a[x], len(right)).astype(np.int64)
                ends.append((x, y))
        nodes = np.concatenate([left["node"].to_numpy(np.int64), right["node"].to_numpy(np.int64)])
        root = nodes.copy()
        x = np.concatenate([e[0] for e in ends]) if ends else np.zeros(0, int)
        y = (np.concatenate([e[1] for e in ends]) if ends else np.zeros(0, int)) + len(left)
        while len(x):
            least = np.minimum(root[x], root[y])
            before = root.copy()
            np.minimum.at(root, x, least)
            np.minimum.at(root, y, least)
            if (root == before).all():
                break
        out = pd.DataFrame({"node": nodes, "links": np.concatenate([links_a, links_b]), "root": root})
        return out[out["links"] > 0]
    return compare


def _incidence(lists: np.ndarray, count: int) -> np.ndarray:
    out = np.zeros((len(lists), count), np.float32)
    for row, one in enumerate(lists):
        out[row, one] = 1
    return out


def link(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label",
         cosine: float = COSINE, named: int = NAMED, shared: int = SHARED) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Only vectors with equal labels that are not NULL are compared. A vector that is NULL, empty or
    zero or has a component that is no finite number links with nothing, as does a row without
    label or key. Repeated rows are vectors of their own that link with each other; rows with equal
    keys and different vectors have links and components of their own. Vectors of different lengths are never linked.
    """
    rows = vectors.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"), F.col(label).alias("label"))
    zero = F.forall("vector", lambda x: x == 0)
    fit = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & finite_vector(F.col("vector")) & ~zero
    rows = rows.withColumn("vector", F.when(fit, F.col("vector")))
    classes = written(rows.where("vector IS NOT NULL").groupBy("label", "vector").agg(
        F.xxhash64("label", "vector").alias("node"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies")), "classes")
    label_size = ["label", "dims"]
    named_classes = classes.select("label", F.size("vector").alias("dims"), "node", "copies", "vector")
    sizes = named_classes.groupBy(*label_size).agg(F.count(F.lit(1)).alias("n")).select(
        *label_size, "n", F.ceil(F.col("n") / PART).cast("int").alias("parts"),
        F.greatest(F.lit(LEAST_PIVOTS), F.ceil(PIVOTS_PER_ROOT * F.sqrt("n"))).alias("wanted"))
    sized = named_classes.join(sizes, label_size)
    own_part = F.pmod(F.xxhash64("node", F.lit("part")), F.col("parts")).cast("int").alias("part")
    sample = sized.where(F.pmod(F.xxhash64("node", F.lit("pivot")), F.col("n")) < F.col("wanted")).select(
        *[F.col(c).alias(f"s_{c}") for c in label_size], F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("s_part"),
        F.col("node").alias("s_node"), F.col("vector").alias("s_vector"))
    part = [*label_size, "part"]
    schema = "label {0}, dims int, node long, copies long, vector {1}, part int, pivots array<int>, shared int".format(
        *[classes.schema[c].dataType.simpleString() for c in ("label", "vector")])
    described = written(
        dealt(sized.select(*label_size, "node", "copies", "vector", own_part), *part).groupBy(*part).cogroup(
            dealt(sample, *[f"s_{c}" for c in part]).groupBy(*[f"s_{c}" for c in part])).applyInPandas(_describe(cosine, named, shared), schema), "described")
    lists = described.select("label", "dims", F.explode("pivots").alias("pivot"), "node", "copies", "vector", "pivots", "shared")
    sizes = lists.groupBy("label", "dims", "pivot").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    replicas = lists.join(sizes, ["label", "dims", "pivot"]).withColumn("block", own).withColumn(
        "other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = replicas.select("label", "dims", "pivot", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"),
                       "block", "node", "copies", "vector", "pivots", "shared")
    block = ["label", "dims", "pivot", "one", "two"]
    found = written(dealt(met, *block).groupBy(*block).applyInPandas(
        _compare(cosine), "node long, links long, root long"), "links")
    counts = found.groupBy(F.col("node").alias("c_node")).agg(F.sum("links").alias("links"))
    labels = components(found, "node", "root").select(F.col("node").alias("l_node"), "component")
    rooted = classes.join(counts, F.col("node") == F.col("c_node"), "left").join(
        labels, F.col("node") == F.col("l_node"), "left").withColumn("root", F.coalesce("component", "node"))
    smallest = rooted.groupBy("root").agg(F.min("least").alias("smallest"))
    known = rooted.join(smallest, "root").select(
        F.col("label").alias("k_label"), F.col("vector").alias("k_vector"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("smallest").alias("component"))
    out = rows.join(known, (F.col("label") == F.col("k_label")) & (F.col("vector") == F.col("k_vector")), "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
