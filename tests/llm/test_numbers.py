"""Similarity joins, searches, mixing and the pipeline against brute force."""

import re
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from promptweir.llm import embed_dedup, mixing, ngram_join, queries, shingles, topk
from promptweir.llm.components import components
from tests.oracle import compare

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- shingles and n-gram join -------------------------------------------------------------------

def shingle_set(text, width):
    words = WORD.findall((text or "").translate({i: i + 32 for i in range(65, 91)}))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + width]) for i in range(max(1, len(words) - width + 1)))


def roots(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def joined_by_hand(rows, width=4, percent=85):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    links = [(i, j) for x, (i, a) in enumerate(sets) for j, b in sets[:x]
             if a and b and 100 * len(a & b) >= percent * len(a | b)]
    root = roots({i for i, _ in sets}, links)
    return sorted((i, len(s), root[i]) for i, s in sets)


def near_copies(seed, groups=12, copies=9):
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for g in range(groups):
        base = rng.choice(words, rng.integers(3, 220)).tolist()
        for _ in range(copies):
            own = list(base)
            for at in rng.integers(0, len(own), rng.integers(0, 5)):
                own[at] = str(rng.choice(words))
            texts.append((" \t" if g % 2 else "\n").join(own))
    shared = " ".join(rng.choice(words, 60))
    texts += [shared + " " + " ".join(rng.choice(words, n)) for n in rng.integers(0, 40, 30)]
    return texts


@pytest.mark.parametrize("seed,width,percent", [(1, 4, 85), (2, 2, 70)])
def test_ngram_join_equals_brute_force(spark, seed, width, percent):
    texts = near_copies(seed) + ["", None, "one", "ONE", "one two three", "One Two Three", " \n"] + ["same text of some words"] * 40
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, key string, n long")
    got = ngram_join.join(docs, width, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == joined_by_hand(rows, width, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_ngram_join_verifies_by_pivots_and_pairs(spark, monkeypatch):
    """A chain: only neighbours link, so pivots alone cannot connect it."""
    words = [f"w{i}" for i in range(160)]
    rows = [(i, " ".join(words[i * 4:i * 4 + 100])) for i in range(15)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ngram_join.join(docs, 4, 85).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == joined_by_hand(rows)


def test_ngram_join_of_nothing_and_repeated_rows(spark):
    longer = " ".join(map(str, range(60)))
    twice = spark.createDataFrame([(1, longer), (1, "other words"), (2, longer + " x")], "doc_id long, text string")
    assert {r.component_id for r in ngram_join.join(twice).collect()} == {1}
    docs = spark.createDataFrame([(7, "a b c d e"), (7, "a b c d e"), (None, "a b c d e"), (None, None)], "doc_id long, text string")
    assert ngram_join.join(docs.limit(0)).count() == 0
    got = ngram_join.join(docs).collect()
    assert sorted((str(r.doc_id), str(r.component_id)) for r in got) == [("7", "7"), ("7", "7"), ("None", "7"), ("None", "None")]


def test_shingles_of_long_and_odd_texts():
    texts = ["x " * 300_000, None, "a\x0bb\x0cc d", "É é A a", " ".join(str(i) for i in range(5000))]
    assert [len(s) for s in shingles.sets(texts, 4)] == [len(shingle_set(t, 4)) for t in texts]


def test_parity_maps_never_drop_a_link():
    rng = np.random.default_rng(5)
    for n in (3, 60, 900, 5000):
        a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(0.95 * n)], rng.integers(0, 2**63, n // 20).astype(np.uint64)]))
        differ = sum(int(x).bit_count() for x in (ngram_join._parity(a) ^ ngram_join._parity(b)).view(np.uint64))
        assert differ <= len(set(a.tolist()) ^ set(b.tolist()))


def test_components(spark):
    rng = np.random.default_rng(9)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 120, (70, 2))] + [(i, i + 1) for i in range(200, 240)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long"), "a", "b").collect()}
    expected = roots({x for l in links for x in l}, links)
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert got == {k: v for k, v in expected.items() if k in linked}
    assert components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


# --- mixing -------------------------------------------------------------------------------------

def targets_by_hand(sizes):
    """Deals the excess again until no source is above twice its size."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left = {s: 0.0 for s in order}, 1.5 * sum(sizes.values())
    while left > 1e-9:
        open_ = [s for s in order if target[s] < 2 * sizes[s] - 1e-9]
        total, back = sum(weight[s] for s in open_), 0.0
        for s in open_:
            target[s] += left * weight[s] / total
            if target[s] > 2 * sizes[s]:
                back += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
        left = back
    return target


def mixed(spark, docs):
    frame = mixing.mix(mixing.with_size(docs))
    return frame.select("doc_id", "source", "size", "source_size", "target", mixing.taken(frame).alias("taken")).collect()


def test_mixing_meets_targets(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = mixed(spark, docs)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts) and all(r.size == len(WORD.findall(texts[r.doc_id])) for r in rows)
    sizes, taken = Counter(), Counter()
    for r in rows:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
    expected = targets_by_hand(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(expected[r.source])
    assert all(abs(taken[s] - expected[s]) <= 0.01 * expected[s] + 20 for s in sizes)
    again = mixed(spark, docs.repartition(5))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_mixing_edges(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "w " * int(rng.integers(0, 40)), ["a", "b", None, "", "\U0001F600", "\uFFFF"][i % 6], 1, 2) for i in range(900)]
    rows += [(5000 + i, None, "null texts", 1, 2) for i in range(5)] + [(9000, "one " * 7, "hot", 1, 2)] * 3000
    rows += [(None, "no id", "a", 1, 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size long, target long")
    got = mixed(spark, docs)
    assert len(got) == len(rows)
    sizes, taken = Counter(), Counter()
    for r in got:
        sizes[r.source] += r.size
        taken[r.source] += r.taken
    expected = targets_by_hand(sizes)
    for r in got:
        assert r.target == pytest.approx(expected[r.source]) and 0 <= r.taken <= 2 * r.size
    assert all(abs(taken[s] - expected[s]) <= 0.01 * expected[s] + 45 for s in sizes)
    assert mixed(spark, docs.limit(0)) == []
    assert [r.taken for r in mixed(spark, docs.where("source = 'null texts'"))] == [0] * 5


# --- embeddings ---------------------------------------------------------------------------------

VECTORS = "vec_id long, embedding array<float>, label int, node long, root long"


def awkward_vectors(seed=4, n=260, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(20, d))
    rows = []
    for i in range(n):
        v = base[rng.integers(20)] + rng.normal(size=d) * rng.choice([0.0, 0.1, 0.25, 0.4])
        rows.append((i, v.astype(np.float32).tolist(), int(rng.integers(3))))
    rows += [(1000, rows[0][1], None), (1001, None, 1), (1002, [0.0] * d, 1), (1003, [float("nan")] * d, 1), (1004, [None] * d, 1),
             (1005, [float("inf")] + [1.0] * (d - 1), 1), (1006, [], 1), (1007, [1.0, 2.0], 1), (1008, [1.0, 2.0], 1),
             (1009, rows[5][1], rows[5][2]), (1010, rows[5][1], rows[5][2]), (1011, [1e38] * d, 2), (1012, [1e30] * d, 2)]
    return rows


def usable(v):
    return bool(v) and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v)


def test_embedding_links_equal_brute_force(spark):
    rows = awkward_vectors()
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)
    good = [(i, np.array(v, float) / np.abs(v).max(), l) for i, v, l in rows if usable(v) and l is not None]
    links = [(i, j) for x, (i, a, l) in enumerate(good) for j, b, m in good[:x]
             if l == m and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93]
    got = {r.vec_id: r for r in embed_dedup.link(frame).collect()}
    count = Counter(x for l in links for x in l)
    assert len(got) == len(rows)
    assert all(got[i].n_links <= count[i] for i in got)
    assert sum(r.n_links for r in got.values()) >= 0.97 * sum(count.values())
    root = roots(set(got), links)
    assert np.mean([got[i].component_id == root[i] for i in got]) > 0.97
    assert all(got[i].n_links == 0 and got[i].kept for i in (1000, 1001, 1002, 1003, 1004, 1005, 1006))
    assert embed_dedup.link(frame.limit(0)).count() == 0


def test_embedding_links_equal_sql_where_there_are_some(spark, tmp_path):
    rng = np.random.default_rng(12)
    base = rng.normal(size=(150, 32)) + 1  # a direction that all have in common
    base = np.concatenate([base, base[:60] + rng.normal(size=(60, 32)) * 0.1, base[:9], base[:9]])
    rows = [(i, v.astype(np.float32).tolist(), i % 3 if i < 150 else (i - 150) % 60 % 3) for i, v in enumerate(base)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    done = compare(spark, db, str(tmp_path), queries.queries()["op6_embed_dedup"], queries.oracle_sql()["op6_embed_dedup"])
    assert done["match"], done
    assert queries.op6_embed_dedup(spark, str(tmp_path)).where("NOT kept").count() > 60


def test_embedding_blocks_give_the_same(spark, monkeypatch):
    frame = spark.createDataFrame([(*r, 1, 2) for r in awkward_vectors()], VECTORS)
    whole = sorted(map(tuple, embed_dedup.link(frame).collect()))
    monkeypatch.setattr(embed_dedup, "BLOCK", 7)
    assert sorted(map(tuple, embed_dedup.link(frame).collect())) == whole


@pytest.mark.parametrize("mean_cosine, most_candidates", [(0.0, 0.1), (0.5, 0.1), (0.8, 0.2), (0.9, 0.95)])
def test_pivots_find_links_around_any_mean(mean_cosine, most_candidates):
    rng = np.random.default_rng(8)
    n, d = 3_000, 64
    free = rng.normal(size=(n, d)) / np.sqrt(d)
    free[n // 2:] = free[:n // 2] * 0.95 + 0.31 * free[n // 2:]  # half of the vectors are near copies
    mean = np.zeros(d)
    mean[0] = np.sqrt(mean_cosine / (1 - mean_cosine))
    unit = embed_dedup._unit(free + mean)
    index = embed_dedup.fitted(unit[rng.permutation(n)[:int(embed_dedup.PIVOTS_PER_ROOT * n ** 0.5)]])
    named = embed_dedup._incidence(index.describe(unit), len(index.pivots))
    candidate = named @ named.T >= index.shared
    above = np.triu(np.ones((n, n), bool), 1)
    linked = (unit @ unit.T >= 0.93) & above
    assert linked.sum() > 500
    assert (candidate & linked).sum() >= 0.93 * linked.sum()
    assert (candidate & above).sum() <= most_candidates * above.sum()


def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 60)
    rows = [r for r in awkward_vectors() if r[0] < 1009]
    rows += [(300 + i, rows[0][1], 0) for i in range(9)] + [(None, rows[1][1], 1), (3, rows[3][1], rows[3][2])]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)
    ints = {i: np.floor(256 * np.array(v, float)) for i, v, _ in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    expected = []
    for q, a in ints.items():
        if q % 50 == 0:
            scored = sorted((-int(a @ b), i) for i, b in ints.items() if i != q and len(a) == len(b))[:5]
            expected += [(q, k + 1, i, -s) for k, (s, i) in enumerate(scored)]
    got = topk.top_k(frame, frame["vec_id"] % 50 == 0).collect()
    assert sorted(map(tuple, got)) == sorted(expected)
    assert topk.top_k(frame.limit(0), frame["vec_id"] % 50 == 0).count() == 0
    few = frame.where("vec_id IN (50, 51)")
    assert [(r.query_id, r.vec_id) for r in topk.top_k(few, few["vec_id"] % 50 == 0).collect()] == [(50, 51)]


# --- the pipeline -------------------------------------------------------------------------------

def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    first = corpus_pipeline.good_quality(spark, docs, SF)
    kept = {r.doc_id for r in first.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert first.columns == docs.columns and np.mean([i in kept for i in good]) > 0.95
    second = corpus_pipeline.known_language(spark, docs, SF)
    assert second.columns == docs.columns and second.count() >= 0.98 * docs.count()
    third = corpus_pipeline.without_near_copies(spark, docs, SF)
    expected = {r[2] for r in joined_by_hand([(r.doc_id, r.text) for r in docs.collect()], 5, 80)}
    assert third.columns == docs.columns and sorted(r.doc_id for r in third.collect()) == sorted(expected)
    fourth = corpus_pipeline.mixed_sources(spark, docs, SF)
    copies = Counter(r.doc_id for r in fourth.collect())
    assert fourth.columns == docs.columns
    assert {r.doc_id: r.taken // max(r.size, 1) for r in mixed(spark, docs) if r.taken} == copies


def test_pipeline_of_awkward_documents(spark):
    rows = [(1, "a good text of many words here", "en", "s", 3, 0), (1, "a good text of many words here", "en", "s", 3, 0),
            (2, None, None, None, None, 0), (None, "text without an id", "en", "s", 1, 0), (3, "", "en", "s", 0, 0), (4, "7 7 7", "en", "t", 0, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, component_id long")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns and out.count() <= 2 * len(rows)
        assert stage(spark, docs.limit(0), SF).count() == 0
    assert corpus_pipeline.without_near_copies(spark, docs, SF).where("doc_id = 1").count() == 1
    copies = spark.createDataFrame([(None, "one text of several plain words", 1), (None, "one text of several plain words", 2),
                                    (None, "One text of several  plain words", 3), (5, "one text of several plain words", 4),
                                    (None, "a group without any id at all", 5), (None, "a group without any id at all", 6)],
                                   "doc_id long, text string, n_chars long")
    left = sorted((r.doc_id is None, r.text) for r in corpus_pipeline.without_near_copies(spark, copies, SF).collect())
    assert left == [(False, "one text of several plain words"), (True, "a group without any id at all")]
    assert corpus_pipeline.packed(spark, docs, SF).count() == len(rows)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "language", "near_copies", "mixing", "packing"]


def test_pipeline_runs(spark):
    assert queries.queries() and corpus_pipeline.run(spark, SF).count() > 0


def test_vectors_of_one_id_keep_their_own_links(spark):
    rows = [(1, [1.0, 0.0, 0.0], 0), (1, [0.0, 1.0, 0.0], 0), (2, [1.0, 0.01, 0.0], 0), (3, [0.01, 1.0, 0.0], 0), (4, [0.0, 0.0, 1.0], 0)]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], VECTORS)
    got = sorted(map(tuple, embed_dedup.link(frame).collect()))
    assert got == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (3, 1, 1, False), (4, 0, 4, True)]
