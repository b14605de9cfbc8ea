"""The cheapest repair of damaged conversations, and what is wrong with them.

A repaired conversation is empty, or user and assistant in turn, maybe after one system
row. Read from its last row back, each row gets the least cost from there to the end for
every state of that grammar, and with it the way on: of the edits that keep to the least
cost always the first letter. Read forward, a conversation follows these ways from
the first state; so the costs need four numbers at a time and the edits one state,
however long it is. Both readings are streams of sorted rows: no task holds a
conversation's texts. One conversation is one stream, as its audit and its hash are sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenun.session import keep_batches_small
from tenun.sources.shared import Workspace

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
SPACE = " \t\n\x0b\x0c\r"

# States: nothing yet, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: Where each state goes to by the role that may be inserted or given there, which is one for each.
NEXT = (USER, USER, ASSISTANT, USER)
ROLE_TO = {USER: "user", ASSISTANT: "assistant"}
#: Where each state goes to by a role's initial.
STEPS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: Cost and edits from each state after the last row.
END = (0, 2 * INSERT, INSERT, 0)
ENDINGS = ("", "II", "I", "")
_NEVER = 1 << 60


@lru_cache(4096)
def step_back(after: tuple[int, ...], initial: str, forced: bool, truncated: bool) -> tuple[tuple[int, ...], list[str]]:
    """Of one row, from the costs after it: the costs before it, and by state the edits up to it with the state that follows.

    A ``forced`` row can only be deleted.
    """
    more = TRUNCATED if truncated else 0
    own: list[list[tuple[str, int, int]]] = []  # by state: (edit, cost, state)
    for state in range(4):
        ways = [("D", DELETE + after[state], state)]
        if not forced:
            if initial in STEPS[state]:
                to = STEPS[state][initial]
                ways.append(("K", KEEP + more + after[to], to))
            ways.append(("R", REROLE + more + after[NEXT[state]], NEXT[state]))
        own.append(ways)
    here = [min(cost for _, cost, _ in ways) for ways in own]
    # an insertion leads to another state before the same row; two of them lead round
    costs = [0] * 4
    costs[USER], costs[ASSISTANT] = (min(here[a], INSERT + here[b]) for a, b in ((USER, ASSISTANT), (ASSISTANT, USER)))
    costs[START], costs[SYSTEM] = (min(here[a], INSERT + costs[USER]) for a in (START, SYSTEM))
    ways_on = []
    for state in range(4):
        edits, at, taken = "", state, ""
        while taken in ("", "I"):
            tight = [w for w in own[at] if w[1] == costs[at]]
            if costs[at] == INSERT + costs[NEXT[at]]:
                tight.append(("I", costs[at], NEXT[at]))
            taken, _, at = min(tight)
            edits += taken
        ways_on.append(f"{edits}{at}")
    return tuple(costs), ways_on


def _backward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows, the last of each conversation first, with the ways on from every state."""
    now, after = object(), END
    for batch in batches:
        ways = []
        for conv, role, fault in zip(*(batch.column(c).to_pylist() for c in ("conv", "role", "fault"))):
            if conv != now:
                now, after = conv, END
            costs, ways_on = step_back(after, role[:1], fault in ("blank", "duplicate"), fault == "truncated")
            # only differences decide, and there are few kinds of them
            after = tuple(c - min(costs) for c in costs)
            ways.append(" ".join(ways_on))
        names = ["conv", "turn", "role", "sha", "row", "fault"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(ways, pa.string())], [*names, "ways"])


class _Repair:
    """One conversation, row by row."""

    def __init__(self):
        self.state, self.cost, self.audit, self.first = START, 0, [], True
        self.low = self.high = self.turn = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.initial = None
        self.hash = hashlib.sha256()

    def say(self, role: str, text: str) -> None:
        self.hash.update((("" if self.first else "\n") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.first = False

    def edit(self, letter: str, role: str, text: str, truncated: bool) -> None:
        self.audit.append(letter)
        if letter == "D":
            self.cost += DELETE
        elif letter == "K":
            self.cost += KEEP + truncated * TRUNCATED
            self.say(role, text)
            self.state = STEPS[self.state][role[:1]]
        else:
            self.cost += INSERT if letter == "I" else REROLE + truncated * TRUNCATED
            self.state = NEXT[self.state]
            self.say(ROLE_TO[self.state], "" if letter == "I" else text)

    def row(self, turn: int | None, role: str, text: str, fault: str | None, ways: str) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = self.turn = turn
        self.blank += fault == "blank"
        self.duplicate += fault == "duplicate"
        self.truncated += fault == "truncated"
        if self.initial is not None:
            self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
        self.initial = role[:1]
        for letter in ways.split(" ")[self.state][:-1]:
            self.edit(letter, role, text, fault == "truncated")

    def result(self) -> tuple:
        for letter in ENDINGS[self.state]:
            self.edit(letter, "", "", False)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


_RESULT = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())]


def _forward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each conversation; of each of its rows the fault and the ways come first, then the row itself."""
    kind, now, repair, known, out, empty = None, None, None, (), [], True

    def flush() -> pa.RecordBatch:
        columns = [pa.array([r[0] for r in out], kind), *(pa.array([r[1][k] for r in out], t) for k, (_, t) in enumerate(_RESULT))]
        out.clear()
        return pa.RecordBatch.from_arrays(columns, ["conv", *(n for n, _ in _RESULT)])

    for batch in batches:
        kind = batch.schema.field("conv").type
        for conv, turn, role, text, fault, given, present in zip(*(batch.column(c).to_pylist() for c in ("conv", "turn", "role", "text", "fault", "ways", "present"))):
            if empty or conv != now:
                if not empty:
                    out.append((now, repair.result()))
                now, repair, empty = conv, _Repair(), False
            if given is not None:
                known = fault, given
            elif present:
                repair.row(turn, role, text, *known)
        if len(out) >= 1000:
            yield flush()
    if not empty:
        out.append((now, repair.result()))
        yield flush()


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: str | None = None) -> DataFrame:
    """``(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256)``, one row for each conversation.

    Rows are taken by turn, nulls first, equal turns by role, then by the SHA-256 of their
    text. Null roles and texts are one space, rows without a conversation are one. A row's
    first fault counts: blank, a duplicate of an earlier row's role and text, truncated. ``audit``
    has the initials of the cheapest edits, the ASCII-least of the cheapest, ``repaired_sha256``
    is that of the lines ``role:text`` left. ``present`` names a column: a row where it isn't
    true only has its conversation reported. An empty table has no conversations.
    """
    spark = turns.sparkSession
    keep_batches_small(spark)
    work = Workspace(spark, "conversations")
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in (role_col, text_col))
    given = turns.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), text.alias("text"), (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"))
    end = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(end == "", "blank").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated")
    # numbered and hashed once: later plans start from the table
    rows = work.save(given.select(F.monotonically_increasing_id().alias("row"), "*", F.sha2("text", 256).alias("sha"), fault.alias("fault")), "rows")

    there = rows.where("present").select("row", "conv", "turn", "role", "sha", "fault")
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn", "row")
    # what is said once in its conversation is left out; partial counts keep a row said a million times in many tasks
    firsts = there.groupBy("conv", "role", "sha").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("_conv"), F.col("role").alias("_role"), F.col("sha").alias("_sha"), "first.row")
    firsts = firsts.withColumnRenamed("row", "_first")
    again = F.col("conv").eqNullSafe(F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("sha") == F.col("_sha"))
    found = F.when((F.col("fault") == "blank"), "blank").when(F.col("row") != F.col("_first"), "duplicate").otherwise(F.col("fault"))
    judged = there.join(firsts, again, "left").select("row", "conv", "turn", "role", "sha", found.alias("fault"))
    judged = work.save(judged, "judged")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    facts = judged.select("conv", "turn", "role", "sha", "row", "fault")
    backward = [F.col("conv"), *(F.col(c).desc() for c in ("turn", "role", "sha", "row"))]
    ways = facts.repartition(tasks, "conv").sortWithinPartitions(*backward).mapInArrow(_backward, T.StructType(facts.schema.fields).add("ways", "string"))

    # a row meets its fault and its ways by standing behind them: texts are dealt once, and nothing is joined to them
    said = rows.select("conv", "turn", "role", "sha", "row", F.lit(None).cast("string").alias("fault"), F.lit(None).cast("string").alias("ways"), "text", "present")
    both = said.unionByName(ways.withColumns({"text": F.lit(None).cast("string"), "present": F.lit(True)}))
    schema = T.StructType([T.StructField("conv", turns.schema[conv_col].dataType), *(T.StructField(n, T.LongType() if t == pa.int64() else T.StringType()) for n, t in _RESULT)])
    forward = both.repartition(tasks, "conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "sha", "row", F.col("ways").desc())
    return forward.mapInArrow(_forward, schema).withColumnRenamed("conv", conv_col)


def damage_conversations(turns: DataFrame) -> DataFrame:
    """``turns`` damaged by the checksum of their place, for tests of repairs; dropped rows stay with a false ``present``."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    named = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), (F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn"))) % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("kind") == 3, 2).otherwise(1))
    changed = named.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("present"), F.explode(copies).alias("_copy"))
    return changed.drop("_copy")
