"""Pairing and numbering inside a stream against a plain simulation, over triggers and restarts."""

import datetime as dt
import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from promptweir.streaming import pairing, runs

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
SCHEMA = pa.schema([("conv_id", pa.string()), ("pos", pa.int64()), ("role", pa.string()), ("content", pa.string()),
                    ("user_id", pa.string()), ("ts", pa.timestamp("us", "UTC")), ("status", pa.string())])


def drawn(seed, n=400):
    """Turns in order of time; some without time, role, position, user or conversation."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        conv = rng.choice(["a", "b", "c", "d", None])
        rows.append((conv, rng.choice([i, i, None]), rng.choice(["user", "user", "Assistant", "assistant", "system", None]),
                     f" text {i} ", rng.choice(["u", "u", "v", None]),
                     None if rng.random() < 0.05 else START + dt.timedelta(seconds=3 * i + rng.choice([0, 0, 1])), "own"))
    return rows


def simulated(rows, lateness, timeout):
    """(status, query_number, conv, content of question, content of answer) of every settled turn."""
    mark = max(r[5] for r in rows if r[5]) - dt.timedelta(seconds=lateness)
    fit = [r for r in rows if r[5] and (r[2] or "").lower() in ("user", "assistant") and r[5] <= mark]
    out, pairs = [], []
    for conv in {r[0] for r in fit}:
        own = sorted((r for r in fit if r[0] == conv), key=lambda r: (
            r[5], -1 if r[1] is None else r[1], r[2].lower(), r[3].strip(), r[4] is not None, r[4]))
        waiting = []
        for r in own:
            if r[2].lower() == "user":
                waiting.append(r)
                continue
            near = [w for w in waiting if (r[5] - w[5]).total_seconds() <= timeout]
            out += [("timed_out", None, conv, w[3].strip(), None) for w in waiting if w not in near]
            pairs += [(w[4], r[5], "" if conv is None else conv, -1 if w[1] is None else w[1], w[3].strip(), conv, r[3].strip()) for w in near]
            out.append(("answer" if near else "unasked", None, conv, None, r[3].strip()))
            waiting = []
        out += [("timed_out", None, conv, w[3].strip(), None) for w in waiting if w[5] + dt.timedelta(seconds=timeout) <= mark]
    for user in {p[0] for p in pairs}:
        for i, p in enumerate(sorted((p for p in pairs if p[0] == user), key=lambda p: p[1:5]), 1):
            out.append(("paired", i, p[5], p[4], p[6]))
    return sorted(out, key=str)


def write(folder, name, rows):
    folder.mkdir(parents=True, exist_ok=True)
    rng = random.Random(name)
    rows = rng.sample(rows, len(rows))
    pq.write_table(pa.Table.from_pylist([dict(zip(SCHEMA.names, r)) for r in rows], SCHEMA), folder / f"{name}.parquet")


def run(spark, folder, base, files=None, bucket_ms=20_000):
    stream = runs.source(spark, str(folder.parent), folder.name, files)
    out = pairing.numbered_fates(stream.drop("status"), "30 seconds", 60_000, bucket_ms)
    return runs.run_available(out, "numbered", keyed_state=True, base=str(base), partition_by=("status",))


def told(frame):
    return sorted(((r.status, r.query_number, r.conv_id, r.user_query, r.llm_answer) for r in frame.collect()), key=str)


@pytest.mark.parametrize("seed,bucket_ms", [(1, 20_000), (2, 600_000)])
def test_one_run_equals_simulation(spark, tmp_path, seed, bucket_ms):
    rows = drawn(seed)
    write(tmp_path / "turns", "all", rows)
    got = told(run(spark, tmp_path / "turns", tmp_path / "out", bucket_ms=bucket_ms))
    assert got == simulated(rows, 30, 60)
    assert {g[0] for g in got} == {"paired", "answer", "unasked", "timed_out"}


def test_triggers_and_a_restart_give_the_rows_of_one_run(spark, tmp_path):
    rows = sorted((r for r in drawn(3) if r[5]), key=lambda r: r[5])
    for k in range(3):
        write(tmp_path / "turns", f"part{k}", rows[k * 70:(k + 1) * 70])
    first = told(run(spark, tmp_path / "turns", tmp_path / "out", files=1))
    assert first == simulated(rows[:210], 30, 60)
    for k in range(3, 6):  # the run below begins anew and finds progress, state and output in the folder
        write(tmp_path / "turns", f"part{k}", rows[k * 70:(k + 1) * 70])
    assert told(run(spark, tmp_path / "turns", tmp_path / "out", files=1)) == simulated(rows[:420], 30, 60)


def test_turns_behind_the_watermark_are_told_apart(spark, tmp_path):
    at = lambda s: START + dt.timedelta(seconds=s)
    write(tmp_path / "turns", "p1", [("a", 0, "user", "q", "u", at(0), ""), ("a", 1, "assistant", "x", "u", at(10), ""),
                                     ("b", 0, "user", "later", "u", at(500), "")])
    run(spark, tmp_path / "turns", tmp_path / "out", files=1)
    write(tmp_path / "turns", "p2", [("a", 2, "user", "behind", "u", at(5), ""), ("a", 3, "user", "q2", "u", at(480), ""),
                                     ("a", 4, "assistant", "x2", "u", at(490), ""), ("b", 1, "system", "-", "u", at(900), "")])
    got = told(run(spark, tmp_path / "turns", tmp_path / "out", files=1))
    assert got == sorted([("paired", 1, "a", "q", "x"), ("answer", None, "a", None, "x"), ("late", None, "a", "behind", None),
                          ("paired", 2, "a", "q2", "x2"), ("answer", None, "a", None, "x2"), ("timed_out", None, "b", "later", None)], key=str)


def test_every_turn_is_settled_waiting_or_a_dead_letter(spark, tmp_path):
    rows = drawn(4)
    write(tmp_path / "turns", "all", rows)
    settled = told(run(spark, tmp_path / "turns", tmp_path / "out"))
    stream = runs.source(spark, str(tmp_path), "turns")
    dead = runs.run_available(pairing.dead_letters(stream), "dead").collect()
    assert {r.reject_reason for r in dead} == {"no time", "other role"} and all(r.status == "own" for r in dead)
    assert sorted(r.content for r in dead) == sorted(
        r[3] for r in rows if r[5] is None or (r[2] or "").lower() not in ("user", "assistant"))
    found = {s[3] if s[0] in ("paired", "timed_out") else s[4] for s in settled} | {r.content.strip() for r in dead}
    assert len(found) + len(waiting(rows)) == len(rows)


def waiting(rows):
    mark = max(r[5] for r in rows if r[5]) - dt.timedelta(seconds=30)
    fit = [r for r in rows if r[5] and (r[2] or "").lower() in ("user", "assistant")]
    known = {x for s in simulated(rows, 30, 60) for x in s[3:]}
    assert all(r[3].strip() in known or r[5] + dt.timedelta(seconds=60) > mark for r in fit)
    return [r for r in fit if r[3].strip() not in known]
