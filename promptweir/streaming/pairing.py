"""Pairing turns as they arrive, with state per conversation and a count per user."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from itertools import batched

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from promptweir.operators import numbering
from promptweir.operators.pairs import content_text
from promptweir.session import written

PAIR_SCHEMA = (
    "conv_id string, pos bigint, user_id string, user_query string, user_ts timestamp, "
    "llm_answer string, answer_pos bigint, answer_ts timestamp"
)
NUMBERED_SCHEMA = (
    "user_id string, query_number bigint, conv_id string, pos bigint, user_query string, "
    "user_ts timestamp, llm_answer string, answer_ts timestamp"
)
FATE_SCHEMA = f"status string, settled timestamp, {PAIR_SCHEMA}"
NUMBERED_FATES = f"query_number bigint, {FATE_SCHEMA}"

PAIR_NAMES = [c.split()[0] for c in PAIR_SCHEMA.split(", ")]
NUMBERED_NAMES = [c.split()[0] for c in NUMBERED_SCHEMA.split(", ")]
FATE_NAMES = [c.split()[0] for c in FATE_SCHEMA.split(", ")]

#: What becomes of a turn that has a time and a role: a question with its answer, an answer that some
#: question took, an answer to nothing, a question that waited too long, a turn behind the watermark.
PAIRED, ANSWER, UNASKED, TIMED_OUT, LATE = "paired", "answer", "unasked", "timed_out", "late"
#: What keeps a turn out of the matching.
NO_TIME, NO_ROLE = "no time", "other role"


#: Rows of a key that are taken at a time.
TAKEN = 10_000
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _time(ms: int | None) -> datetime | None:
    return None if ms is None else _EPOCH + timedelta(milliseconds=ms)


class InTimeOrder(StatefulProcessor):
    """Holds the rows of a key until the watermark passes them and hands them out in order.

    Waiting makes the result independent of the order of arrival. Rows lie in buckets of time, each a
    state value of its own with a list per column, so that no more than a bucket is in memory,
    and one timer per key stands for the earliest thing to do. Rows behind what has been handed out
    go to `late`.
    """

    #: Name and type of the columns kept; the first is the time in ms, and rows are ordered by all in turn.
    columns: tuple[tuple[str, str], ...]
    #: Of the rows handed out.
    out: Row

    def __init__(self, bucket_ms: int = 600_000):
        self.bucket_ms = bucket_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", "bucket bigint", ", ".join(f"{c} array<{t}>" for c, t in self.columns))
        self.clock = handle.getValueState("clock", "wakes bigint, done bigint")

    def late(self, key, rows: list[tuple], now: int) -> list[tuple]:
        raise NotImplementedError

    def settle(self, key, rows: list[tuple]) -> list[tuple]:
        """Output for rows in order; `after` follows before another key is worked on."""
        raise NotImplementedError

    def after(self, key, now: int) -> tuple[list[tuple], int | None]:
        """Output once all rows up to `now` are settled, and when to come back if no row does."""
        return [], None

    def rows(self, rows: Iterable[tuple]) -> Iterator[Row]:
        return (self.out(*r) for r in rows)

    def handleInputRows(self, key, rows, timerValues):
        now = timerValues.getCurrentWatermarkInMs()
        clock = self.clock.get()
        wakes, done = (None, None) if clock is None else clock
        first, fresh, filled = wakes, clock is None, set()  # a key without a clock holds nothing yet
        names = [c for c, _ in self.columns]
        for taken in batched(rows, TAKEN):
            arrived = [tuple(r[c] for c in names) for r in taken]
            behind = [r for r in arrived if done is not None and r[0] <= done]
            if behind:
                yield from self.rows(self.late(key, behind, max(now, done) + 1))  # output must lie ahead of the watermark
            buckets: dict[int, list[tuple]] = {}
            for r in arrived:
                if done is None or r[0] > done:
                    buckets.setdefault(r[0] // self.bucket_ms, []).append(r)
            for bucket, own in buckets.items():
                self._hold(bucket, own if fresh and bucket not in filled else self._held(bucket) + own)
                filled.add(bucket)
                least = min(r[0] for r in own)
                first = least if first is None else min(first, least)
        self._wake(wakes, first, done)

    def _held(self, bucket: int, sure: bool = False) -> list[tuple]:
        return list(zip(*self.held.getValue((bucket,)))) if sure or self.held.containsKey((bucket,)) else []

    def _hold(self, bucket: int, rows: list[tuple]) -> None:
        self.held.updateValue((bucket,), tuple(map(list, zip(*rows))))

    def _wake(self, before: int | None, at: int | None, done: int | None) -> None:
        if before != at:
            if before is not None:
                self.handle.deleteTimer(before)
            if at is not None:
                self.handle.registerTimer(at)
        self.clock.update((at, done))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs()
        following = None
        for bucket in sorted(k[0] for k in self.held.keys()):
            if bucket * self.bucket_ms > now:
                following = min(r[0] for r in self._held(bucket, True))
                break
            rows = sorted(self._held(bucket, True), key=lambda r: tuple((x is not None, x) for x in r))
            due = [r for r in rows if r[0] <= now]
            yield from self.rows(self.settle(key, due))
            if len(due) < len(rows):
                self._hold(bucket, rows[len(due):])
                following = rows[len(due)][0]
                break
            self.held.removeKey((bucket,))
        out, back = self.after(key, now)
        yield from self.rows(out)
        times = [t for t in (following, back) if t is not None]
        self._wake(None, min(times, default=None), now)

    def close(self) -> None:
        pass


class PairTurns(InTimeOrder):
    """Matches the turns of a conversation in time order: every question with the nearest later
    answer, if that comes within ``timeout_ms``. Each turn leaves once, with what became of it."""

    columns = (("ts_ms", "bigint"), ("pos", "bigint"), ("role", "string"), ("content", "string"), ("user_id", "string"))
    out = Row(*FATE_NAMES)

    def __init__(self, timeout_ms: int, bucket_ms: int = 600_000):
        super().__init__(bucket_ms)
        self.timeout_ms = timeout_ms

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "ts_ms bigint, pos bigint, content string, user_id string")
        self.left: list[tuple] | None = None

    @staticmethod
    def _asked(key, status, settled, turn, answer=(None, None, None)):
        ts, pos, content, user = turn
        text, at, when = answer
        return (status, _time(settled), key[0], pos, user, content, _time(ts), text, at, when)

    @staticmethod
    def _said(key, status, settled, turn):
        ts, pos, _, content, user = turn
        return (status, _time(settled), key[0], None, user, None, None, content, pos, _time(ts))

    def late(self, key, rows, now):
        return [self._asked(key, LATE, now, (r[0], r[1], *r[3:])) if r[2] == "user" else self._said(key, LATE, now, r)
                for r in rows]

    def settle(self, key, rows):
        if not rows:
            return []
        waiting, out = self._before(), []
        stored = bool(waiting)
        for row in rows:
            ts, pos, role, content, user = row
            if role == "user":
                waiting.append((ts, pos, content, user))
                continue
            pairs = [self._asked(key, PAIRED, ts, w, (content, pos, _time(ts))) for w in waiting if ts - w[0] <= self.timeout_ms]
            out += [self._asked(key, TIMED_OUT, ts, w) for w in waiting if ts - w[0] > self.timeout_ms]
            out += [*pairs, self._said(key, ANSWER if pairs else UNASKED, ts, row)]
            waiting = []
        self._wait(waiting, stored)
        return out

    def _before(self) -> list[tuple]:
        """The questions that wait; once read, those of the key at work are at hand."""
        if self.left is None:
            self.left = [tuple(w) for w in self.waiting.get()]
        return list(self.left)

    def _wait(self, waiting: list[tuple], stored: bool) -> None:
        if waiting:
            self.waiting.put(waiting)
        elif stored:
            self.waiting.clear()
        self.left = waiting

    def after(self, key, now):
        waiting = self._before()
        self.left = None
        gone = [w for w in waiting if w[0] + self.timeout_ms <= now]
        left = waiting[len(gone):]
        if gone:
            self.waiting.put(left) if left else self.waiting.clear()
        return ([self._asked(key, TIMED_OUT, now + 1, w) for w in gone],
                left[0][0] + self.timeout_ms if left else None)


class NumberPairs(InTimeOrder):
    """Counts the pairs of a user in order of their answers; other fates pass through."""

    columns = (("answer_ms", "bigint"), ("conv_id", "string"), ("pos", "bigint"), ("user_query", "string"),
               ("user_ms", "bigint"), ("llm_answer", "string"), ("answer_pos", "bigint"))
    out = Row("query_number", *FATE_NAMES)

    def init(self, handle) -> None:
        super().init(handle)
        self.count = handle.getValueState("count", "n bigint")

    def handleInputRows(self, key, rows, timerValues):
        passing: list[tuple] = []

        def pairs():
            for r in rows:
                if r["status"] == PAIRED:
                    yield r
                else:
                    times = {"settled": "settled_ms", "user_ts": "user_ms", "answer_ts": "answer_ms"}
                    passing.append((None, *[_time(r[times[c]]) if c in times else r[c] for c in FATE_NAMES]))
                    if len(passing) == TAKEN:
                        return

        rows = iter(rows)
        more = True
        while more:
            yield from super().handleInputRows(key, pairs(), timerValues)
            yield from self.rows(passing)
            more = len(passing) == TAKEN
            passing.clear()

    def late(self, key, rows, now):
        return self.settle(key, rows)  # no pair comes after the watermark that its answer waited for

    def settle(self, key, rows):
        if not rows:
            return []
        count = self.count.get()
        n, out = 0 if count is None else count[0], []
        for ms, conv, pos, query, asked_ms, answer, answer_pos in rows:
            n += 1
            out.append((n, PAIRED, _time(ms), conv, pos, key[0], query, _time(asked_ms), answer, answer_pos, _time(ms)))
        self.count.update((n,))
        return out


class NumberedPairs:
    """Numbers a user's answered prompts, call by call, into a folder; fit for ``foreachBatch``.

    The pairs of a call are numbered in order of their answers and follow those of earlier calls,
    which hold earlier answers, as pairs wait for the watermark. Only keys are sorted, in ranges of
    even size whatever user they belong to; texts find their number by row. A call that is repeated
    under its number replaces what it wrote.
    """

    def __init__(self, base: str):
        self.base = base

    def _counts(self, spark: SparkSession, call: int) -> DataFrame | None:
        return spark.read.schema("user_id string, n bigint").parquet(f"{self.base}/counts/{call}") if call >= 0 else None

    def __call__(self, pairs: DataFrame, call: int) -> None:
        spark = pairs.sparkSession
        arrived = written(pairs.withColumn("_row", F.monotonically_increasing_id()), "pairs")
        order = ["answer_ts", "conv_id", "pos", "_row"]
        before = self._counts(spark, call - 1)
        numbers = numbering.running_number(arrived.select("user_id", *order), "user_id", order, "query_number", before)
        done = arrived.join(numbers.select("_row", "query_number"), "_row").select(*NUMBERED_NAMES)
        done.write.mode("overwrite").parquet(f"{self.base}/rows/call={call}")
        counts = spark.read.schema(NUMBERED_SCHEMA).parquet(f"{self.base}/rows/call={call}").select(
            "user_id", F.col("query_number").alias("n"))
        counts = counts.unionByName(before) if before is not None else counts
        counts.groupBy("user_id").agg(F.max("n").alias("n")).write.mode("overwrite").parquet(f"{self.base}/counts/{call}")
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/counts/{call - 2}")  # a repeated call needs the last one
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)

    def rows(self, spark: SparkSession) -> DataFrame:
        return spark.read.schema(NUMBERED_SCHEMA).parquet(f"{self.base}/rows").select(*NUMBERED_NAMES)


def reject_reason(ts: Column, role: Column) -> Column:
    """Why a turn cannot be matched; NULL if it can."""
    return F.when(ts.isNull(), NO_TIME).when(~F.coalesce(F.lower(role).isin("user", "assistant"), F.lit(False)), NO_ROLE)


def dead_letters(turns: DataFrame) -> DataFrame:
    """The turns that no matching takes, whole, with ``reject_reason``. Without state: a second sink
    of the stream that ``fates`` reads."""
    reason = reject_reason(F.col("ts"), F.col("role"))
    return turns.withColumn("reject_reason", reason).where("reject_reason IS NOT NULL")


def fates(turns: DataFrame, lateness: str, timeout_ms: int, bucket_ms: int = 600_000) -> DataFrame:
    """What becomes of the turns of a stream (conv_id, pos, role, content, user_id, ts), as ``FATE_SCHEMA``.

    Every turn that has a time and the role user or assistant leaves once, with a status; those
    still in state when the stream ends are waiting. The others are ``dead_letters``. A question fills
    the user columns, with its answer's beside them if it is paired; any other answer fills the answer
    columns only. Content is stripped and never NULL, as in the batch form; a turn without a position
    comes before the others of its instant. ``content`` is held in state until a turn is settled: where
    texts are long and stored anyway, pass a key of the turn and join the texts to the pairs.
    """
    kept = (
        turns.withWatermark("ts", lateness)
        .withColumn("role", F.lower("role")).where(reject_reason(F.col("ts"), F.col("role")).isNull())
        # Without its event-time column Spark does not drop late rows: they get their status.
        .select(F.col("conv_id").cast("string").alias("conv_id"), F.coalesce("pos", F.lit(-1)).cast("bigint").alias("pos"), "role",
                content_text(F.col("content")).alias("content"), F.col("user_id").cast("string").alias("user_id"),
                F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    )
    return kept.groupBy("conv_id").transformWithState(
        statefulProcessor=PairTurns(timeout_ms, bucket_ms), outputStructType=FATE_SCHEMA, outputMode="Append",
        timeMode="EventTime", eventTimeColumnName="settled")


def numbered_fates(turns: DataFrame, lateness: str, timeout_ms: int, bucket_ms: int = 600_000) -> DataFrame:
    """``fates`` with ``query_number``, the place of a pair among its user's in order of answers, counted on
    from trigger to trigger by a second stateful operator that follows the first."""
    settled = fates(turns, lateness, timeout_ms, bucket_ms).withColumns(
        {"settled_ms": F.unix_millis("settled"), "user_ms": F.unix_millis("user_ts"), "answer_ms": F.unix_millis("answer_ts")})
    return settled.groupBy("user_id").transformWithState(
        statefulProcessor=NumberPairs(bucket_ms), outputStructType=NUMBERED_FATES, outputMode="Append", timeMode="EventTime")


def pair_stream(turns: DataFrame, lateness: str, timeout_ms: int) -> DataFrame:
    """Only the pairs of ``fates``."""
    return fates(turns, lateness, timeout_ms).where(F.col("status") == PAIRED).select(*PAIR_NAMES)
