"""Periodic runs, common lines and the term automaton against brute force on small and awkward tables."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptweir.llm import lexical, lines, queries, runs

DOCS = "doc_id long, text string, runs string, n_lines string, kept string, collapsed int, score string"


def docs_of(spark, rows):
    """With extra columns whose names the operators use for their own."""
    return spark.createDataFrame([(i, t, "own", "own", "own", 1, "own") for i, t in rows], DOCS)


# --- runs ---------------------------------------------------------------------------------------

def runs_by_hand(w, least, times):
    found = []
    for p in range(1, len(w) // times + 1):
        i = 0
        while i + p < len(w):
            s = i
            while i + p < len(w) and w[i] == w[i + p]:
                i += 1
            n = i - s + p
            if i > s and n >= max(least, times * p) and not any(
                    all(w[k] == w[k + q] for k in range(s, s + n - q)) for q in range(1, p)):
                found.append((s, n, p))
            i += i == s
    return sorted(found, key=lambda r: (r[0], r[2]))


def drawn(rng):
    n, k = rng.randrange(110), rng.choice([1, 2, 3, 50])
    w = [rng.randrange(k) for _ in range(n)]
    if n and rng.random() < 0.6:
        a = rng.randrange(n)
        p = 1 + (n - a) // rng.randint(2, 10)
        w = [w[i if i < a else a + (i - a) % p] for i in range(n)]
    return w


@pytest.mark.parametrize("least,times", [(24, 3), (9, 3), (6, 2), (2, 2), (8, 4)])
def test_runs_equal_brute_force(least, times):
    rng = random.Random(least * times)
    for _ in range(300):
        w = drawn(rng)
        want = runs_by_hand(w, least, times)
        assert runs.runs_of(w, least, times) == want
        assert runs.text_runs([b"%d" % x for x in w], least, times) == want


def test_segments_say_the_longest_suffix_that_ended_before():
    """Every recoloured segment: the last L words ended at e, no later end, and L is the longest."""
    rng = random.Random(5)
    for _ in range(60):
        w, tree = drawn(rng)[:60], runs.LastEnds()
        for i, x in enumerate(w):
            got = dict(tree.append(x, i))
            want = {}
            for n in range(1, i + 1):
                ends = [e for e in range(n - 1, i) if w[e - n + 1:e + 1] == w[i - n + 1:i + 1]]
                if ends:
                    want[ends[-1]] = n
            assert got == want


def test_a_long_periodic_text_stays_cheap():
    w = [i % 40 for i in range(60_000)]
    assert runs.runs_of(w) == [(0, 60_000, 40)]
    assert runs.runs_of([0] * 50_000) == [(0, 50_000, 1)]


def test_stretches_leave_far_copies_out():
    rng = random.Random(2)
    far = [rng.randrange(10 ** 6) for _ in range(3_000)]
    far[2_000:2_050] = far[10:60]
    assert runs.stretches(np.array(far)) == []


def test_runs_of_a_table(spark):
    rng = random.Random(3)
    rows = [(i, " \t".join(f"w{x}" for x in drawn(rng))) for i in range(80)]
    rows += [(None, None), (90, ""), (91, "  \n "), (92, "a " * 30), (92, "a " * 30), (None, "é x " * 20), (93, "A a " * 9)]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed)
                 for r in runs.periodic_runs(docs_of(spark, rows)).collect())
    want = []
    for i, t in rows:
        w = (t or "").split()
        found = runs_by_hand(w, 24, 3)
        gone = {k for s, n, q in found for k in range(s + q, s + n)}
        want.append((-1 if i is None else i, len(w), found, " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert got == sorted(want)


def test_runs_of_an_empty_table(spark):
    assert runs.periodic_runs(docs_of(spark, [(1, "x")]).limit(0)).collect() == []


def test_planted_words():
    words = [b"%d" % i for i in range(50)]
    for doc in range(300):
        got = queries.planted(doc, words)
        h = zlib.crc32(b"%d" % doc)
        if h % 10:
            assert got == words
        else:
            a = h // 10 % 50
            p = 1 + (50 - a) // (3 + h // 10 % 8)
            assert got == [words[i] if i < a else words[a + (i - a) % p] for i in range(50)]
    assert queries.planted(None, words) == words and queries.planted(7, []) == []


# --- lines --------------------------------------------------------------------------------------

def cleaned_by_hand(rows, least=5):
    key = lambda x: re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", x).translate({c: c + 32 for c in range(65, 91)})
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                holders.setdefault(key(x), set()).add(float("-inf") if i is None else i)
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        gone = [len(holders.get(key(x), ())) >= least and max(holders[key(x)]) != (float("-inf") if i is None else i) for x in own]
        out.append((-1 if i is None else i, len(own), sum(gone), "\n".join(x for x, g in zip(own, gone) if not g)))
    return sorted(out)


def line_rows():
    rng = random.Random(4)
    pool = [f"Line {k} " + "x" * rng.choice([20, 31, 32, 33, 60]) for k in range(30)] + ["é" * 39, "é" * 40, "Ä" * 45, "b" * 40, "\x85" + "c" * 39]
    rows = []
    for i in range(120):
        own = [rng.choice(pool) for _ in range(rng.randrange(12))] + [f"own line of {i} " + "y" * 40]
        own = [rng.choice(["", " ", "\t\r", "\x0b"]) + (x.upper() if rng.random() < 0.3 else x) + rng.choice(["", "\r", " "]) for x in own]
        rows.append((i, "\n".join(own)))
    rows += [(None, "b" * 40), (None, "b" * 40 + "\n\n"), (200, None), (201, ""), (202, "\n"), (7, pool[3] + "\n" + pool[3])]
    return rows + rows[:3]


def test_lines_equal_brute_force(spark, monkeypatch):
    rows = line_rows()
    want = cleaned_by_hand(rows)
    assert sum(x[2] for x in want) > 200
    for keys in (lines.SHARD_KEYS, 7):  # one shard, and several
        monkeypatch.setattr(lines, "SHARD_KEYS", keys)
        found = lines.without_common_lines(docs_of(spark, rows))
        got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in found.collect())
        assert got == want


def test_lines_of_a_table_without_common_lines(spark):
    rows = [(1, "a\nb"), (2, "c" * 50)]
    assert sorted(tuple(r) for r in lines.without_common_lines(docs_of(spark, rows)).collect()) == [(1, 2, 0, "a\nb"), (2, 1, 0, "c" * 50)]
    assert lines.without_common_lines(docs_of(spark, rows).limit(0)).collect() == []


def test_shard_is_a_minimal_perfect_hash():
    rng = np.random.default_rng(1)
    place, mark = (rng.integers(0, 1 << 63, 20_000).astype(np.uint64) for _ in range(2))
    place[:100] = place[0]  # keys that only the second hash tells apart
    docs, keepers = np.arange(1, 20_001).astype("<u4"), np.arange(20_000)[::-1].astype("<i8")
    made = lines.Shard.build(place, mark, docs, keepers)
    assert int(made.taken.sum()) == 20_000 == len(made.marks)
    found, kept = made.find(place, mark)
    assert (found == docs).all() and (kept == keepers).all()
    assert not made.find(place, mark + np.uint64(1))[0].any()
    empty = lines.Shard.build(*(x[:0] for x in (place, mark, docs, keepers)))
    assert not empty.find(place, mark)[0].any()


def test_a_worker_holds_shards_up_to_a_size(spark, monkeypatch):
    monkeypatch.setattr(lines, "SHARD_KEYS", 3)
    path, n = lines.index(lines.counts(docs_of(spark, line_rows())), 5)
    monkeypatch.setattr(lines, "HELD_BYTES", 1)
    shards = lines.Shards(path)
    assert n > 3 and sum(len(s.marks) for k in range(n) if (s := shards[k])) > 8 and len(shards.held) == 1


# --- lexical search -----------------------------------------------------------------------------

def terms_by_hand(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


def search_by_hand(docs, items, k):
    texts = [(i, Counter(terms_by_hand(t))) for i, t in docs]
    texts = [(i, c) for i, c in texts if c]
    n, total = len(texts), sum(sum(c.values()) for _, c in texts)
    df = Counter(t for _, c in texts for t in c)
    own = {}
    for q, t in items:
        own.setdefault(q, set()).update(terms_by_hand(t))
    out = []
    for q, terms in own.items():
        scored = []
        for i, c in texts:
            m = 100 - 50 + (50 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10 ** 9 * c[t]) // (1000 * c[t] + 20 * m))
                    for t in terms if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(q, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:k])]
    return out


def search_tables(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(60)] + ["éa", "É", "straße", "x1", "1", "東京", "a", "aa", "aaa"]
    text = lambda n: "".join(rng.choice([rng.choice(words), rng.choice(words).upper()]) + rng.choice([" ", ", ", "-", "_", "\n", "\x7f"]) for _ in range(n))
    docs = [(i, text(rng.randrange(40))) for i in range(150)]
    docs += [(i, "w1 w2 w3") for i in range(300, 330)] + [(None, "w1 w2 w3"), (400, None), (401, ""), (402, "..."), (3, "w1 w2 w3"), (403, "w5 " * 5000)]
    items = [(i, text(8)) for i in range(30)] + [(40, None), (41, "absent"), (42, "w1 w2 w3"), (1, "w3 w3 W3"), (None, "w7 a aa"), (43, "!")]
    return docs, items


def test_search_equals_brute_force(spark, monkeypatch):
    docs, items = search_tables(spark)
    frame = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("own")).withColumn("query", F.lit(1))
    want = sorted(search_by_hand(docs, items, 10), key=str)
    for block, held in ((256, 1 << 18), (4, 20)):  # one block, and several with little room
        monkeypatch.setattr(lexical, "BLOCK", block)
        monkeypatch.setattr(lexical, "HELD", held)
        monkeypatch.setattr(lexical, "DOCUMENTS", block)
        got = sorted((tuple(r) for r in lexical.search(docs_of(spark, docs), frame, 10).collect()), key=str)
        assert got == want


def test_search_without_documents_or_queries(spark):
    docs, items = search_tables(spark)
    frame = spark.createDataFrame(items, "item_id long, text string")
    assert lexical.search(docs_of(spark, docs).limit(0), frame).collect() == []
    assert lexical.search(docs_of(spark, docs), frame.limit(0)).collect() == []
    assert lexical.search(docs_of(spark, docs), frame.where("text IS NULL")).collect() == []


def test_scanner_finds_whole_terms_only():
    scanner = lexical.Scanner([b"a", b"ab", "é".encode()])
    assert scanner.counts(lexical.plain("a ab-AB aba é éa a".encode())) == {0: 2, 1: 2, 2: 1}
