"""Chat formatting by a finite-state machine over roles.

A template declares the text around a turn, the roles whose text is learnt from, and the machine:
which role may follow in which state. Formatting gives every turn three segments (opening, text,
closing), each with its loss flag. Control strings inside a text are broken by a backslash after
their first character and backslashes are doubled, so the output can be read back exactly.

The machine runs over conversations of any length without gathering one: turns are sorted into
ranges, every range follows all states at once, and only the state at the border of two ranges is
filled in afterwards, at most one row for each range.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from promptweir.session import written


@dataclass(frozen=True)
class Template:
    """opening + role + divider, then the text, then closing. `moves` maps (state, role) to a state;
    a role that has no move is a violation and leaves the state as it is."""

    opening: str = "### "
    divider: str = ": "
    closing: str = "</turn>\n"
    controls: tuple[str, ...] = ("###", "</turn>")
    learnt: frozenset[str] = frozenset({"assistant"})
    start: str = "start"
    moves: dict[tuple[str, str], str] = field(default_factory=lambda: {
        ("start", "system"): "ready", ("start", "user"): "asked", ("ready", "user"): "asked",
        ("asked", "assistant"): "answered", ("answered", "user"): "asked"})
    final: frozenset[str] = frozenset({"answered"})

    def states(self) -> list[str]:
        return sorted({self.start, *self.moves.values(), *(s for s, _ in self.moves)})

    def escaping(self, more: tuple[str, ...] = ()) -> str:
        """Pattern of the first character of a control string, wherever one begins."""
        return "(?=" + "|".join(map(re.escape, (*self.controls, *more))) + ")(.)"


CHAT = Template()


def escaped(text: Column, template: Template, more: tuple[str, ...] = ()) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), template.escaping(more), "$1\\\\")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def _machine(template: Template):
    states = template.states()
    number = {s: i for i, s in enumerate(states)}
    moves = {}
    for role in {r for _, r in template.moves}:
        moves[role] = [number[template.moves.get((s, role), s)] for s in states]
    allowed = {(number[s], r) for s, r in template.moves}

    def follow(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conversation, reach = object(), list(range(len(states)))
        bad = [0] * len(states)
        for batch in batches:
            ends, faults = [], []
            for conv, role in zip(batch["conv_key"], batch["role"]):
                if conv != conversation:
                    conversation, reach, bad = conv, list(range(len(states))), [0] * len(states)
                bad = [b + ((s, role) not in allowed) for b, s in zip(bad, reach)]
                step = moves.get(role)
                if step:
                    reach = [step[s] for s in reach]
                ends.append(reach)
                faults.append(bad)
            yield batch.assign(reach=ends, faults=faults)
    return follow, states


def format_turns(turns: DataFrame, template: Template = CHAT, conv: str = "conv_id", turn: str = "turn",
                 role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn in its conversation: conv_id, turn, place (order within the conversation),
    role, segments (text, loss), state after the turn, violations so far.

    NULL texts and roles are empty. Turns of equal number are ordered by role and text, NULL
    numbers come first; a NULL conv_id is a conversation of its own; unknown roles are formatted
    and count as violations; an empty table gives an empty result.
    """
    clean = turns.select(
        F.col(conv).cast("long").alias("conv_id"), F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    ).withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = ["conv_key", "turn", "role", "text"]
    follow, states = _machine(template)
    ranged = clean.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("range", F.spark_partition_id())
    followed = ranged.mapInPandas(follow, ranged.select(
        "*", F.lit(None).cast("array<int>").alias("reach"), F.lit(None).cast("array<int>").alias("faults")).schema)
    done = written(followed.withColumn("row", F.monotonically_increasing_id()), "turns")

    # What a range says about a conversation that began in an earlier range.
    last = done.groupBy("conv_key", "range").agg(
        F.count(F.lit(1)).alias("turns"), F.max_by(F.struct("reach", "faults"), "row").alias("end"))
    spread = last.withColumn("ranges", F.count(F.lit(1)).over(Window.partitionBy("conv_key"))).where("ranges > 1")
    before = Window.partitionBy("conv_key").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    start = states.index(template.start)
    begin = F.expr(f"named_struct('s', {start}, 'v', 0, 'n', 0L)")
    carried = spread.withColumn("past", F.collect_list(F.struct("end", "turns")).over(before)).select(
        F.col("conv_key").alias("c_key"), F.col("range").alias("c_range"),
        F.aggregate("past", begin, lambda a, x: F.struct(
            F.get(x["end"]["reach"], a["s"]).alias("s"),
            (a["v"] + F.get(x["end"]["faults"], a["s"])).alias("v"), (a["n"] + x["turns"]).alias("n"))).alias("from"))
    joined = done.join(carried, (F.col("conv_key") == F.col("c_key")) & (F.col("range") == F.col("c_range")), "left")
    source = F.coalesce(F.col("from.s"), F.lit(start))
    names = F.array(*map(F.lit, states))
    opening = F.concat(F.lit(template.opening), escaped(F.col("role"), template, (template.divider,)), F.lit(template.divider))
    segment = lambda value, loss: F.struct(value.alias("text"), loss.alias("loss"))
    return joined.select(
        "conv_id", "turn", F.struct("range", "row").alias("place"), "role",
        F.array(segment(opening, F.lit(False)),
                segment(escaped(F.col("text"), template), F.col("role").isin(*template.learnt)),
                segment(F.lit(template.closing), F.lit(False))).alias("segments"),
        F.get(names, F.get("reach", source)).alias("state"),
        (F.coalesce(F.col("from.v"), F.lit(0)) + F.get("faults", source)).alias("violations"))


DIGEST = ("conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, "
          "valid boolean, violations long")


def read_back(formatted: DataFrame, template: Template = CHAT) -> DataFrame:
    """Per conversation what its formatted text says, parsed from the segments alone.

    Turns pass in order; of a conversation only two running hashes are held, whatever its length.
    A hash over a whole conversation has no parts, so one task reads one conversation.
    """
    opening, divider, closing = template.opening, template.divider, template.closing

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, conv, sums = object(), None, None

        def row() -> tuple:
            turns, loss, n, chars, size, state, bad = sums
            return (conv, n, turns.hexdigest(), chars, loss.hexdigest(), size, bad == 0 and state in template.final, bad)

        for batch in batches:
            rows = []
            for one, segments, state, bad in zip(batch["conv_id"], batch["segments"], batch["state"], batch["violations"]):
                now = None if pd.isna(one) else int(one)
                if now != key:
                    if sums:
                        rows.append(row())
                    key, conv, sums = now, now, [hashlib.sha256(), hashlib.sha256(), 0, 0, 0, "", 0]
                whole = "".join(s["text"] for s in segments)
                if not (whole.startswith(opening) and whole.endswith(closing)):
                    raise ValueError("not a formatted turn")
                role, _, body = whole[len(opening):-len(closing)].partition(divider)
                sums[0].update(f"{unescape(role)}\n{unescape(body)}\n".encode("utf-8", "surrogatepass"))
                learnt = unescape("".join(s["text"] for s in segments if s["loss"]))
                sums[1].update(learnt.encode("utf-8", "surrogatepass"))
                sums[2:] = [sums[2] + 1, sums[3] + len(learnt), sums[4] + len(whole), state, int(bad)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})
        if sums:
            yield pd.DataFrame([row()], columns=[c.split()[0] for c in DIGEST.split(", ")]).astype({"conv_id": "Int64"})

    ordered = formatted.select("conv_id", "place", "segments", "state", "violations").repartition("conv_id")
    return ordered.sortWithinPartitions("conv_id", "place").mapInPandas(digest, DIGEST)
