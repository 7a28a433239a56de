"""Set-similarity self-join on word n-grams with prefix filters under several token orders.

Two texts with Jaccard similarity of at least t share a token among the first
n - ceil(t * n) + 1 of each, whatever the global order of the tokens is. An order here is
(frequency class, seeded hash): tokens counted as frequent stand last. Under the first order the
prefixes form an inverted index; a pair that meets there is verified only if its prefixes also
share a token under each of the other orders.

Texts with equal sets are one node. Lists of the index are never expanded into all pairs: first
every node of a list is compared with a pivot of the list, in rounds with other pivots, and
linked nodes become components. Only nodes of one list that are still in different components
are then paired, and only where the token stands early enough in both for sets of their sizes. Every pair that the filters leave is thus verified or already connected, so the
components are those of the full join. Before texts travel to be verified, a pair must pass a
bound from small parity maps of the two sets, which never drops a pair that links.

Sets are keyed by 64-bit hashes; two different sets collide with probability 2**-64 a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from promptweir.llm.common import small_batches
from promptweir.llm.components import components
from promptweir.llm.shingles import mix, sets
from promptweir.session import written

#: Frequent tokens known to every task: at most so many numbers. More only shortens index lists.
FREQUENT = 65_536
#: A task reports tokens that stand so often in so many of its tokens.
REPORT_COUNT, REPORT_TOKENS = 2, 2_000_000
PIVOT_ROUNDS = 1
#: Least bits of a set's parity map; larger sets have up to as many bits as tokens.
MAP_BITS = 512
#: Members compared with one copy of a pivot.
STAR = 256
#: Hash buckets of the ids whose texts are wanted.
BUCKETS = 1 << 18


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + 1 if n else 0


class Orders:
    """The global token orders: frequent tokens last by class, then by a hash seeded per order."""

    def __init__(self, tokens: np.ndarray, classes: np.ndarray, orders: int):
        by = np.argsort(tokens)
        self.tokens, self.classes, self.orders = tokens[by], classes[by].astype(np.uint64), orders

    def prefix(self, tokens: np.ndarray, order: int, percent: int) -> np.ndarray:
        """The first tokens of a set, in order."""
        size = prefix_length(len(tokens), percent)
        if not size:
            return tokens
        rank = mix(tokens ^ np.uint64(0x5851F42D4C957F2D * (order + 1) % (1 << 64))) >> np.uint64(6)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, tokens), len(self.tokens) - 1)
            rank |= np.where(self.tokens[at] == tokens, self.classes[at], np.uint64(0)) << np.uint64(58)
        first = np.argpartition(rank, size - 1)[:size]
        return tokens[first[np.argsort(rank[first])]]


def _key(tokens: np.ndarray) -> int:
    total = int(np.add.reduce(mix(tokens ^ np.uint64(0xC2B2AE3D27D4EB4F))) if len(tokens) else 0) + len(tokens)
    return int(np.uint64(total % (1 << 64)).astype(np.int64))


def _parity(tokens: np.ndarray) -> np.ndarray:
    """Bit b says whether an odd number of tokens fall on b. Where two maps differ in d bits the
    sets differ in at least d tokens. A map folds onto one of half its bits by exclusive or."""
    bits = max(MAP_BITS, 1 << (max(len(tokens), 1).bit_length() - 1))
    odd = np.bincount((tokens >> np.uint64(17)) % np.uint64(bits), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _scan(width: int):
    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []

        def frequent() -> pd.DataFrame:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            often = counts >= REPORT_COUNT
            return pd.DataFrame({"doc_id": pd.array([None] * int(often.sum()), "Int64"), "n_shingles": counts[often],
                                 "key": tokens[often].view(np.int64), "frequent": True, "parity": None})

        for batch in batches:
            sizes, keys, maps, size = [], [], [], sum(map(len, held))
            for one in sets(batch["text"], width):
                sizes.append(len(one))
                keys.append(_key(one))
                maps.append(_parity(one))
                held.append(one)
                size += len(one)
                if size >= REPORT_TOKENS:
                    yield frequent()
                    size = 0
            yield pd.DataFrame({"doc_id": batch["doc_id"].astype("Int64"), "n_shingles": np.array(sizes, np.int64),
                                "key": np.array(keys, np.int64), "frequent": False, "parity": maps})
        if held:
            yield frequent()
    return scan


def _postings(width: int, percent: int, orders: Orders):
    def postings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for batch in batches:
            rows = []
            for one in sets(batch["text"], width):
                key = _key(one)
                if not len(one) or key in seen:  # equal sets give equal postings
                    continue
                if len(seen) > 100_000:
                    seen.clear()
                seen.add(key)
                rows.append((key, len(one), orders.prefix(one, 0, percent).view(np.int64)))
            yield pd.DataFrame(rows, columns=["key", "n", "tokens"])
    return postings


def _verify(width: int, percent: int, orders: Orders):
    """Rows by pivot, the pivot's own row first: pairs that pass all orders and the exact test."""
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pivot, own, fronts = None, np.zeros(0, np.uint64), []
        for batch in batches:
            rows = []
            for a, b, side, one in zip(batch["a"], batch["b"], batch["side"], sets(batch["text"], width)):
                if _key(one) != b:
                    continue
                if side == 0:
                    pivot, own = a, one
                    fronts = [orders.prefix(own, r, percent) for r in range(1, orders.orders)]
                    continue
                assert pivot == a
                if any(np.isin(orders.prefix(one, r, percent), front).any() == 0
                       for r, front in enumerate(fronts, 1)):
                    continue
                at = np.minimum(np.searchsorted(own, one), len(own) - 1)
                common = int((own[at] == one).sum())
                if 100 * common >= percent * (len(own) + len(one) - common):
                    rows.append((a, b))
            yield pd.DataFrame(rows, columns=["a", "b"], dtype="int64")
    return verify


def _possible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and parity maps allow the similarity."""
    side = lambda c: nodes.select(F.col("key").alias(c), F.col("n").alias(f"{c}_n"), F.col("parity").alias(f"{c}_map"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    fits = F.expr(f"100 * least(a_n, b_n) >= {percent} * greatest(a_n, b_n)")  # so maps differ by one fold at most
    half = lambda x: F.zip_with(F.slice(x, 1, F.size(x) / 2), F.slice(x, F.size(x) / 2 + 1, F.size(x) / 2),
                                lambda u, v: u.bitwiseXOR(v))
    folded = lambda x, other: F.when(F.size(x) > F.size(other), half(F.col(x))).otherwise(F.col(x))
    both = both.where(fits).select("a", "b", "a_n", "b_n", folded("a_map", "b_map").alias("a_map"),
                                   folded("b_map", "a_map").alias("b_map"))
    differ = F.aggregate(F.zip_with("a_map", "b_map", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    total = F.col("a_n") + F.col("b_n")
    return both.where((100 + percent) * (total - differ) >= 2 * percent * total).select("a", "b")


def _texts(pairs: DataFrame, nodes: DataFrame, narrow: DataFrame) -> DataFrame:
    """key and text of all nodes in pairs. Most other texts are left out before the shuffle by the
    hash buckets of the wanted ids, a set of at most BUCKETS numbers."""
    wanted = pairs.select(F.col("a").alias("key")).union(pairs.select(F.col("b").alias("key"))).distinct()
    wanted = nodes.select("key", "doc_id").join(wanted, "key", "left_semi")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(BUCKETS))
    some = narrow.withColumn("bucket", bucket).join(
        F.broadcast(wanted.select(bucket.alias("bucket")).distinct()), "bucket", "left_semi").drop("bucket")
    # Ids may repeat with other texts: all come along, and `verify` passes over those of another key.
    return some.join(wanted, "doc_id").groupBy("key", F.xxhash64("text")).agg(F.min("text").alias("text")).select("key", "text")


def _checked(pairs: DataFrame, texts: DataFrame, verify) -> DataFrame:
    """Links among candidate pairs (a, b). A pivot `a` with many partners is copied to several
    places, so no task gets them all; a partner's text travels once per pair."""
    places = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("places"))
    dealt = pairs.join(places, "a").withColumn("place", F.pmod(F.xxhash64("b"), F.col("places")))
    members = dealt.select("a", "place", "b").join(texts, F.col("b") == F.col("key")).select(
        "a", "place", F.lit(1).alias("side"), "b", "text")
    pivots = dealt.select("a", "place").distinct().join(texts, F.col("a") == F.col("key")).select(
        "a", "place", F.lit(0).alias("side"), F.col("a").alias("b"), "text")
    rows = pivots.union(members).repartition("a", "place").sortWithinPartitions("a", "place", "side")
    return rows.mapInPandas(verify, "a long, b long")


def join(docs: DataFrame, width: int = 5, percent: int = 80, orders: int = 3, key: str = "doc_id",
         text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links), kept.

    Works on whole texts. Documents without words (or NULL text) have no shingles and link with
    nothing; equal texts and repeated rows are one node with all their rows. A row with NULL
    doc_id belongs to the node of equal texts that have one and takes its component; else it links
    with nothing. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    scanned = written(narrow.mapInPandas(
        _scan(width), "doc_id long, n_shingles long, key long, frequent boolean, parity array<long>"), "sets")
    often = scanned.where("frequent").groupBy("key").agg(F.sum("n_shingles").alias("n")).orderBy(
        F.col("n").desc(), "key").limit(FREQUENT).toPandas()
    known = Orders(often["key"].to_numpy(np.int64).view(np.uint64),
                   np.minimum(np.log2(often["n"].to_numpy(np.float64).clip(1)).astype(np.int64) + 1, 63), orders)
    rows = scanned.where("NOT frequent")
    nodes = rows.where("n_shingles > 0").groupBy("key").agg(
        F.min("doc_id").alias("doc_id"), F.min("n_shingles").alias("n"), F.min("parity").alias("parity"))

    # A token at place i of a set of n is in the prefix for partners of at most `cap` tokens: with m
    # of them, ceil(t * (n + m) / (1 + t)) must be common, so that many from place i on must exist.
    cap = F.floor((F.col("n") - F.col("place")) * (100 + percent) / percent) - F.col("n")
    index = narrow.mapInPandas(_postings(width, percent, known), "key long, n long, tokens array<long>")
    by_token = Window.partitionBy("token")
    shared = written(index.select("key", "n", F.posexplode("tokens").alias("place", "token")).select(
        "token", "key", "n", cap.alias("cap"), F.min("key").over(by_token).alias("least"), F.max("key").over(by_token).alias("most"),
        F.min("n").over(by_token).alias("least_n")).where("least < most AND cap >= least_n")
        .select("token", "key", "n", "cap").distinct(), "index")
    verify = _verify(width, percent, known)
    fits = lambda y: (f"part <> {y}part AND 100 * least(n, {y}n) >= {percent} * greatest(n, {y}n) "
                         f"AND n <= {y}cap AND {y}n <= cap")
    found: DataFrame | None = None
    tried: DataFrame | None = None
    labels = None
    # The pivot of a list is its member with most index entries: a text close to many others keeps
    # the shared tokens in front, so it links with more of them than a random member would.
    shared = shared.join(shared.groupBy("key").agg(F.count(F.lit(1)).alias("entries")), "key")
    for seed in range(PIVOT_ROUNDS + 1):
        lists = shared if labels is None else shared.join(
            labels.withColumnRenamed("node", "key"), "key", "left")
        lists = lists.withColumn("part", F.col("key") if labels is None else F.coalesce("component", "key"))
        lists = lists.select("token", "key", "n", "cap", "part", "entries")
        spans = [F.min("part").alias("low"), F.max("part").alias("high"), F.min("n").alias("least_n")]
        if seed < PIVOT_ROUNDS:
            pivot = lists.groupBy("token").agg(
                F.max(F.struct("entries", F.xxhash64("key", F.lit(seed)), "key", "n", "cap", "part")).alias("p"), *spans).where("low < high")
            pairs = lists.join(pivot, "token").where(fits("p.")).select(
                F.least("key", "p.key").alias("low"), F.greatest("key", "p.key").alias("high"), F.col("p.key").alias("a"))
        else:
            still = lists.groupBy("token").agg(*spans).where("low < high").select("token", "least_n")
            open_lists = written(lists.join(still, "token").where("cap >= least_n").drop("least_n"), "open")
            other = open_lists.select("token", *[F.col(c).alias(f"b_{c}") for c in ("key", "n", "cap", "part")])
            pairs = open_lists.join(other, "token").where("key < b_key AND " + fits("b_")).select(
                F.col("key").alias("low"), F.col("b_key").alias("high"), F.col("key").alias("a"))
        pairs = pairs.groupBy("low", "high").agg(F.min("a").alias("a")).select(
            "low", "high", "a", F.expr("if(a = low, high, low)").alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["low", "high"], "left_anti")
        pairs = written(pairs, "pairs")
        tried = pairs.select("low", "high") if tried is None else tried.union(pairs.select("low", "high"))
        pairs = written(_possible(pairs.select("a", "b"), nodes, percent), "possible")
        links = written(_checked(pairs, written(_texts(pairs, nodes, narrow), "texts"), verify), "verified")
        found = links if found is None else found.union(links)
        labels = components(found, "a", "b")

    root = nodes.select("key", "doc_id").join(labels, F.col("key") == F.col("node"), "left").select(
        "key", "doc_id", F.coalesce("component", "key").alias("root"))
    smallest = root.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of = root.join(smallest, "root").select(F.col("key").alias("node_key"), "component_id")
    out = rows.join(of, (F.col("key") == F.col("node_key")) & (F.col("n_shingles") > 0), "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))
