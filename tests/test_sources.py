"""Large array and CSV files read in many ranges against Spark's own readers of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from promptweir.sources import chats, ranges

BITS = ['"', "\\", "{", "}", "[", "]", "a", "é", "\n", ",", " ", '"}', "漢", "\r\n", '""']


def text(rng, n=14):
    return "".join(rng.choice(BITS) for _ in range(rng.randrange(n)))


def document(rng, i):
    says = [{"role": rng.choice(["user", "assistant"]), "content": text(rng),
             "timestamp": rng.choice([{"$date": text(rng, 4)}, "plain", None, 7]),
             "metadata": rng.choice([None, {"promptTokens": i, "cost": 0.5}])} for _ in range(rng.randrange(5))]
    return {"userId": rng.choice([f"u{i}", None]), "title": text(rng), "modelId": "m", "messages": rng.choice([says, says, None]), "n": i}


@pytest.fixture
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "3000", "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def rows(frame, *order):
    """As text, with the dates of timestamps: of an object kept as text the form says nothing."""
    if "messages" in frame.columns:
        frame = frame.withColumn("messages", F.transform("messages", lambda m: m.withField("timestamp", F.coalesce(
            F.get_json_object(m["timestamp"], "$['$date']"), F.when(~m["timestamp"].startswith("{"), m["timestamp"])))))
    return [str(r) for r in frame.orderBy(*order).collect()]


@pytest.mark.parametrize("between", [", ", "\n,\n\t"])
def test_an_array_file_in_many_ranges_equals_the_whole_file(spark, tmp_path, small_ranges, between):
    rng = random.Random(between)
    docs = [document(rng, i) for i in range(300)]
    parts = [json.dumps(d, ensure_ascii=between == ", ") for d in docs]
    (tmp_path / "a.json").write_text(f"[{between.join(parts)}\n]", newline="")
    assert spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 20
    whole = chats.read_chats(spark, str(tmp_path), "whole")
    assert rows(chats.read_chats(spark, str(tmp_path)), "doc_seq") == rows(whole, "doc_seq")
    own = chats.read_chats(spark, str(tmp_path), order_column="n")
    assert rows(own, "doc_seq") == rows(chats.read_chats(spark, str(tmp_path), "whole", "n"), "doc_seq")


def test_array_files_keep_their_order(spark, tmp_path, small_ranges):
    rng = random.Random(9)
    docs = [document(rng, i) for i in range(90)]
    for k, part in enumerate([docs[:40], [], docs[40:41], docs[41:]]):
        (tmp_path / f"part {k}.json").write_text(json.dumps(part) + "\n")
    (tmp_path / "single.json").write_text(json.dumps(docs[0]))
    got = [r.modelId and r.title for r in chats.read_chats(spark, str(tmp_path)).orderBy("doc_seq").collect()]
    assert got == [d["title"] for d in [*docs, docs[0]]]


def test_a_document_longer_than_ranges_and_a_malformed_one(spark, tmp_path, small_ranges):
    long = {"userId": "u", "title": '}{"' * 4000, "modelId": "m", "messages": [{"role": "user", "content": "{" * 9000}]}
    (tmp_path / "a.json").write_text("[" + json.dumps(long) + ', {"userId": oops}, ' + json.dumps(long) + "]")
    got = chats.read_chats(spark, str(tmp_path)).orderBy("doc_seq").collect()
    assert [r.title for r in got] == [long["title"], None, long["title"]] and len(got[2].messages[0].content) == 9000


def test_csv_in_many_ranges_equals_the_whole_file(spark, tmp_path, small_ranges):
    rng = random.Random(3)
    quoted = lambda x: '"' + x.replace('"', '""') + '"'
    lines = [",".join(chats.PAIR.fieldNames())]
    for i in range(400):
        lines.append(",".join([quoted(f"u{i}"), str(i), quoted(text(rng)), "m", quoted(text(rng, 40).strip()), "", quoted(text(rng, 300)), "t",
                               rng.choice(["", "5"]), "6", "1.5", rng.choice(["", "0.25"])]))
    (tmp_path / "p.csv").write_text("\n".join(lines) + "\n", newline="")
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 15
    whole = spark.read.schema(chats.PAIR).option("header", True).option("multiLine", True).option("quote", '"').option(
        "escape", '"').csv(str(tmp_path)).fillna("", ["user_query", "LLM_answer"])
    assert rows(chats.read_pairs_csv(spark, str(tmp_path)), "query_number") == rows(whole, "query_number")


def test_no_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text("[]")
    assert chats.read_chats(spark, str(tmp_path)).count() == 0
    (tmp_path / "b").mkdir()
    (tmp_path / "b" / "p.csv").write_text(",".join(chats.PAIR.fieldNames()) + "\n")
    assert chats.read_pairs_csv(spark, str(tmp_path / "b")).count() == 0


def test_machines_follow_any_cut():
    """Every way to cut a text into two ranges gives the same records."""
    rng = random.Random(1)
    for machine, data in ((ranges.ObjectsOfArray(), json.dumps([document(rng, i) for i in range(6)])),
                          (ranges.QuotedLines(), '"a\nb",1\n"x""\n""y",2\nz,3\n')):
        pieces = data.encode().split(machine.separator.encode())
        pieces = pieces if pieces[-1] else pieces[:-1]
        want = [p[3] for p in machine.parts(pieces, None)]
        for at in range(1, len(pieces)):
            both = pieces[:at], pieces[at:]
            starts = machine.starts([machine.summary(b) for b in both])
            found: dict[int, bytes] = {}
            for own, start in zip(both, starts):
                for record, _, _, body in machine.parts(own, start):
                    found[record] = found.get(record, b"") + body
            assert [found[k] for k in sorted(found)] == want


def test_records_are_cut_once(spark, tmp_path):
    """What is done with the records does not read the files again."""
    (tmp_path / "a.json").write_text('[{"x": "}"}, {"x": [1, {}]}]')
    found = ranges.records(spark, str(tmp_path), ranges.ObjectsOfArray())
    assert "MapInArrow" not in found._jdf.queryExecution().executedPlan().toString()
    assert [r.body for r in found.union(found).distinct().orderBy("record").collect()] == ['{"x": "}"}', '{"x": [1, {}]}']
