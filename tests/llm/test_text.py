"""Chat, quality, packing, WARC, URL and language operators on small and awkward tables."""

import base64
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from promptweir.llm import chat, langid, packing, quality, queries, urls, warc
from promptweir.session import shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, picked long"
HARD = ["", None, "a", "  two  spaces ", "x\ry", "<|endoftext|> end", "\\### </turn> \\", "é" * 50, "don't\n\n 12 it's",
        "w " * 9000, "\x00\x0b odd", "漢字テスト 1 2"]


def docs_of(spark, texts, lang="en"):
    rows = [(i, t, lang, "s", None, 1, i) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


# --- chat ---------------------------------------------------------------------------------------

TURNS = "conv_id long, turn long, role string, text string, state string, range int"


def digest_by_hand(turns):
    found = {}
    for conv, turn, role, text in sorted(
            ((c, t, r or "", x or "") for c, t, r, x in turns), key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2], r[3])):
        found.setdefault(conv, []).append((role, text))
    out = {}
    for conv, said in found.items():
        loss = "".join(x for r, x in said if r == "assistant")
        out[conv] = (len(said), hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in said).encode()).hexdigest(), len(loss),
                     hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip_of_awkward_turns(spark):
    turns = [(1, i, ["user", "assistant"][i % 2], t) for i, t in enumerate(HARD + ["####", "#\\##", "</turn></turn>"])]
    turns += [(2, 0, "a: b", "x: y"), (2, 0, "a: b", "x: y"), (2, None, None, None), (3, 1, "### user", "</turn>"),
              (None, 0, "user", "q"), (4, 5, "a:", ": ")]
    frame = spark.createDataFrame([(*t, "clash", 9) for t in turns], TURNS)
    formatted = chat.format_turns(frame)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(formatted).collect()}
    assert got == digest_by_hand(turns)
    for row in formatted.collect():
        whole = "".join(s.text for s in row.segments)
        assert whole.count("</turn>") == 1 and whole.count("###") == 1


def test_chat_machine_follows_conversations_over_ranges(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    legal = [(1, i, ["user", "assistant"][i % 2], str(i)) for i in range(4000)]
    bad = [(2, 0, "assistant", "a"), (2, 1, "user", "b"), (2, 2, "user", "c"), (2, 3, "tool", "d"), (2, 4, "assistant", "e")]
    formatted = chat.format_turns(spark.createDataFrame([(*t, "", 0) for t in legal + bad], TURNS))
    got = {r.conv_id: (r.n_turns, r.valid, r.violations) for r in chat.read_back(formatted).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got == {1: (4000, True, 0), 2: (5, False, 3)}


def test_chat_of_nothing(spark):
    assert chat.read_back(chat.format_turns(spark.createDataFrame([], TURNS))).count() == 0


# --- quality ------------------------------------------------------------------------------------

def test_quality_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in queries.op2_quality(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in got.items())
    right = [got[i].predicted == q for i, q in labels.items() if i in got and got[i].held_out]
    assert len(right) > 50 and np.mean(right) > 0.9


def test_quality_tables_and_pairs_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.random((4000, len(quality.NAMES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y, cycles=20)
    assert (0, 1) in model.pairs
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.95


def test_quality_edges(spark):
    docs = docs_of(spark, HARD).union(docs_of(spark, ["a"]).withColumn("doc_id", F.lit(None).cast("long")))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, labels).collect()
    assert len(rows) == len(HARD) + 1
    assert all(r.quality_score == pytest.approx(0.9) and r.quality_ok == 1 for r in rows)
    assert quality.classify(docs.limit(0), labels).count() == 0
    same = spark.createDataFrame([(0, 0, 0), (2, None, 0), (3, 1, None), (3, 1, None)], "doc_id long, quality int, toxic int")
    assert quality.classify(docs, same).count() == len(HARD) + 1


# --- packing ------------------------------------------------------------------------------------

def reference_pieces(rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc, text in rows:
        ids = model.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % 2048 or 2048
        for piece, (start, length) in enumerate([(0, first)] + [(a, 2048) for a in range(first, len(ids), 2048)]):
            raw = np.array(ids[start:start + length], "<u4").tobytes()
            out.append((doc, piece, start, length, zlib.crc32(raw)))
    return sorted(out)


def assert_gapless(rows):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    return len(by)


def test_packing_of_documents(spark):
    rows = queries.op7_packing(spark, SF).collect()
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == reference_pieces(docs)
    assert assert_gapless(rows) <= -(-sum(r.length for r in rows) // 2048) + 1


def test_packing_of_awkward_texts(spark):
    docs = docs_of(spark, HARD + ["a b"] * 50)
    cut = packing.pieces(docs, queries.ranks_path())
    rows = packing.pack(cut.withColumn("sequence_id", F.lit("own")).withColumn("clash", F.lit(1))).collect()
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.clash == 1 for r in rows)
    assert "ids" not in packing.pieces(docs, queries.ranks_path(), with_ids=False).columns
    expected = reference_pieces([(r.doc_id, r.text) for r in docs.collect()])
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    assert_gapless(rows)
    assert packing.pack(packing.pieces(docs.limit(0), queries.ranks_path())).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan(seed):
    rng = np.random.default_rng(seed)
    lengths = rng.integers(1, [60, 2048, 700, 300][seed], 3000)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    runs, sequences = packing.plan(counts, 2048)
    used, large = np.zeros(sequences, int), np.zeros(sequences, int)
    for length, _, n, repeat, first, _ in runs:
        for at in range(n):
            used[first + at // repeat] += length
            large[first + at // repeat] += 3 * length > 2048
    assert used.max() <= 2048 and large.max() <= 2 and used.sum() == lengths.sum()
    assert {k: sum(r[2] for r in runs if r[0] == k) for k in counts} == counts
    assert sequences <= 1.02 * max(-(-lengths.sum() // 2048), -(-int((3 * lengths > 2048).sum()) // 2)) + 1 or seed == 1


# --- WARC ---------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, first long, payload string"


def test_warc_round_trip(spark):
    rows = [(5, "http://a/\r\nx", "same"), (3, None, "same"), (3, "u", "same"), (9, "u", None), (8, "u", ""), (1, "é", "é\x00\r\n\r\nWARC/1.1"),
            (None, "n", "same"), (None, "n", "alone"), (2, "big", "<p>long</p>" * 300_000)]
    pages = spark.createDataFrame([(*r, 0, "clash") for r in rows], PAGES)
    path = shared_dir(spark, "warc")
    warc.write(pages, path)
    back = warc.read(spark, path).collect()
    key = lambda x: (x is None, x or 0)
    assert sorted((r.page_id for r in back), key=key) == sorted((r[0] for r in rows), key=key)
    for r in back:
        own = [(h or "") for p, _, h in rows if p == r.page_id]
        assert r.payload_bytes in [len(h.encode()) for h in own]
        assert r.payload_digest in [base64.b32encode(hashlib.sha1(h.encode()).digest()).decode() for h in own]
        assert (r.payload is None) == (r.record_type == "revisit")
    same = sorted((r.page_id or 99, r.record_type, r.refers_to) for r in back if r.payload_bytes == 4)
    assert same == [(3, "response", None), (3, "revisit", 3), (5, "revisit", 3), (99, "revisit", 3)]
    assert [(r.page_id, r.record_type, r.refers_to) for r in sorted(
        (r for r in back if r.payload_bytes == 0), key=lambda r: r.page_id)] == [(8, "response", None), (9, "revisit", 8)]


def test_warc_leaves_small_payloads_and_nothing_alone(spark):
    pages = spark.createDataFrame([(i, "u", "tiny", 0, "") for i in range(3)], PAGES)
    path = shared_dir(spark, "warc")
    warc.write(pages, path, least_bytes=5)
    assert {r.record_type for r in warc.read(spark, path).collect()} == {"response"}
    empty = shared_dir(spark, "warc")
    warc.write(pages.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_warc_archive_is_a_chain_of_frames():
    records = [b"record %d " % i * 50 for i in range(300)]
    frames = list(warc.archive(records))
    assert frames[0][:4] == bytes.fromhex("5d2a4d18") and len(frames) == 301
    assert all(f[:4] == bytes.fromhex("28b52ffd") for f in frames[1:])


# --- URLs ---------------------------------------------------------------------------------------

def by_hand(url):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host):]).group()
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = None
    for said, rule in urls.RULES:
        domain, start = rule.split("/", 1)
        if (host == domain or host.endswith("." + domain)) and path.startswith("/" + start):
            if best is None or len(rule) > len(best[1]):
                best = (said, rule)
    return host, path, best


def test_urls_by_rule(spark):
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    for r in queries.op9_urls(spark, SF).collect():
        host, path, best = by_hand(dict(pages)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict == best[0] if best else r.verdict in ("allow", "block")


def test_urls_edges(spark):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y#z", "http://example.com", "x://a.net/es/1\n2#f",
           "http://É.com/", "http://com/?q", "http://a.net/fr/" + "b" * 20000, "http://example.com/en/", "http://badcom/"]
    pages = spark.createDataFrame([(i, u, "clash", "l") for i, u in enumerate(odd * 2)], "page_id long, url string, host string, label string")
    rows = urls.judge(pages).collect()
    assert len(rows) == 2 * len(odd)
    for r in rows:
        host, path, best = by_hand(odd[r.page_id % len(odd)])
        assert (r.host, r.path, r.rule) == (host, path, best and best[1])
        assert r.verdict in ("allow", "block")
    assert urls.judge(pages.limit(0)).count() == 0
    assert {r.verdict for r in urls.judge(pages.where("page_id = 2")).collect()} == {"allow"}


def test_url_trees_learn_what_the_rules_say(spark):
    kinds = ("example.com/en", "com/x", "net/es", "org/en", "org/x")
    pages = spark.createDataFrame(
        [(i, f"http://a{i}.{k}/{i}") for i in range(300) for k in kinds], "page_id long, url string")
    rows = urls.judge(pages).where("host LIKE '%.org'").collect()
    assert {(r.path.split("/")[1], r.verdict) for r in rows} == {("en", "block"), ("x", "allow")}


# --- languages ----------------------------------------------------------------------------------

def test_languages_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries.op10_langid(spark, sf).collect()
    assert len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in rows if r.held_out]) > 0.95


def test_language_edges(spark):
    docs = docs_of(spark, HARD + ["12 34", "hello there"]).union(docs_of(spark, ["bon jour"], None))
    rows = {r.doc_id: r.language for r in langid.identify(docs.withColumn("doc_id", F.monotonically_increasing_id())).collect()}
    assert len(rows) == len(HARD) + 3
    texts = dict(enumerate(r.text for r in docs.collect()))
    got = [r.language.lang_pred for r in langid.identify(docs).collect()]
    assert got == ["en" if t and any(map(str.isalpha, t)) else "und" for t in texts.values()]
    assert {r.language.lang_pred for r in langid.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.identify(docs.limit(0)).count() == 0


def test_gradients_by_finite_differences():
    rng = np.random.default_rng(0)
    model = langid._new(["a", "b", "c"], 4, 1)
    for d in (model.forward, model.backward):
        d.inputs, d.recurrent = d.inputs.astype(np.float64), d.recurrent.astype(np.float64)
    codes, target = rng.integers(0, 256, (5, 3)), np.array([0, 2, 1])
    _, grads = langid.gradients(model, codes, target)
    for weight, grad in zip(model.weights(), grads):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, step = weight[at], 1e-2
        weight[at] = old + step
        up = langid.gradients(model, codes, target)[0]
        weight[at] = old - step
        down = langid.gradients(model, codes, target)[0]
        weight[at] = old
        assert (up - down) / (2 * step) == pytest.approx(grad[at], rel=0.03, abs=1e-4)


def test_every_position_has_a_label():
    model = langid.fit([b"aaa", b"bbb"] * 20, ["x", "y"] * 20, batches=60, batch=16)
    assert model.labels("aaa bbb") == ["x"] * 3 + ["y"] * 3


def test_names_of_the_classifiers_give_way(spark):
    docs = docs_of(spark, ["the one", "le deux"] * 20).withColumns(
        {"language": F.lit("own"), "lang_held_out": F.lit("own"), "quality_score": F.lit("own"), "quality_ok": F.lit(7)})
    told = langid.identify(docs)
    assert told.schema["language"].dataType.fieldNames() == ["lang_pred", "score"] and told.count() == 40
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    scored = quality.classify(docs, labels)
    assert dict(scored.dtypes)["quality_score"] == "double" and scored.where("quality_ok IN (0, 1)").count() == 40


def test_batches_of_text_are_bounded(spark):
    from promptweir.session import _BATCH, small_batches

    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, "1000000b")
    small_batches(spark)
    assert spark.conf.get(_BATCH) == "1000000b"  # the session's own bound stays
    spark.conf.set(_BATCH, before)
