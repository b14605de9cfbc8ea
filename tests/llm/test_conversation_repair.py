import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from tenun.llm.conversation_repair import damage_conversations, repair_conversations, step_back
from tests.llm.fixtures import edge_docs, no_docs

ASCII_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
TURNS = "conv_id long, turn long, role string, text string, conv string, row long, sha string, fault string"
FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repaired(rows):
    """Plain recursion over whole edit lists: ``rows`` of one conversation are ``(turn, role, text)``."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(x[2].encode()).hexdigest()))
    faults, seen = [], set()
    for _, role, text in rows:
        solid = text.rstrip(ASCII_SPACE)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))

    @lru_cache(None)
    def best(i, roles, inserted):
        """``(cost, audit, lines)`` of the rest, where ``roles`` is what the grammar has read, shortened to its state."""
        found = [(0, "", ())] if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles) else []

        def on(letter, cost, initial, line, i, inserted):
            to = roles + initial
            if re.fullmatch("s?(ua)*u?", to):
                to = to if len(to) < 4 else to[:-2]
                cost_on, audit, lines = best(i, to, inserted) or (None, "", ())
                if cost_on is not None:
                    found.append((cost + cost_on, letter + audit, ((line,) if line is not None else ()) + lines))

        if inserted < 3:
            for role in ("user", "assistant"):
                on("I", 2, role[0], f"{role}:", i, inserted + 1)
        if i < len(rows):
            _, role, text = rows[i]
            on("D", 3, "", None, i + 1, 0)
            if faults[i] not in ("blank", "duplicate"):
                more = faults[i] == "truncated"
                if role:
                    on("K", more, role[0], f"{role}:{text}", i + 1, 0)
                for to in ("user", "assistant"):
                    on("R", 2 + more, to[0], f"{to}:{text}", i + 1, 0)
        return min(found) if found else None

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", 1, "s", "f") for r in rows], TURNS)


def found(df):
    return {r[0]: tuple(r[f] for f in FIELDS) for r in df.collect()}


def wanted(rows):
    return {c: repaired([r[1:] for r in rows if r[0] == c]) for c in {r[0] for r in rows}}


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", "", "summary", None]
TEXTS = ["Yes.", "No!", "Why?", "cut off", " \n", "", None, "Yes. \t", "1.5", "Größe?", "other."]


def test_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(c, rng.choice([None, *range(9)]), rng.choice(ROLES), rng.choice(TEXTS)) for c in range(150) for _ in range(rng.randrange(1, 9))]
    got = found(repair_conversations(frame(spark, rows).repartition(5)))
    assert got == wanted(rows) and {x for v in got.values() for x in v[6]} == set("DIKR")


def test_sound_conversations_stay(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi!"), (1, 2, "assistant", "Hello."), (2, 5, "user", "a?"), (2, 6, "assistant", "b.")]
    got = found(repair_conversations(frame(spark, rows)))
    assert got[1][5:7] == (0, "KKK") and got[2][5:] == (0, "KK", hashlib.sha256(b"user:a?\nassistant:b.").hexdigest())


def test_ties_go_to_the_least_letter(spark):
    # two users: delete one (3) or put an answer between them (2); a lone row: an insertion costs less than its deletion
    rows = [(1, 0, "user", "a."), (1, 1, "user", "b."), (1, 2, "assistant", "c."), (2, 0, "user", "a."), (3, 0, "assistant", "a."), (4, 0, "system", "a.")]
    assert {c: v[5:7] for c, v in found(repair_conversations(frame(spark, rows))).items()} == {1: (2, "KIK" + "K"), 2: (2, "KI"), 3: (2, "IK"), 4: (3, "D")}


def test_steps_depend_on_differences_alone():
    for after in [(0, 4, 2, 0), (3, 1, 0, 2), (2, 2, 1, 0)]:
        for row in [("u", False, False), ("a", False, True), ("", True, False), ("x", False, True)]:
            costs, ways = step_back(after, *row)
            shifted, same = step_back(tuple(c + 7 for c in after), *row)
            assert ways == same and shifted == tuple(c + 7 for c in costs)


def test_a_long_conversation(spark):
    """Many batches, a third of the rows the same, most of them in one conversation."""
    rng = random.Random(2)
    rows = [(7 if rng.random() < 0.9 else None, i // 3, rng.choice(ROLES[:3]), "same." if i % 3 == 0 else f"text {i}.") for i in range(9000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = found(repair_conversations(frame(spark, rows).repartition(6)))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    short = [r for r in rows if r[0] is None]
    assert got[7][2] == sum(r[0] == 7 and r[3] == "same." for r in rows) - 3 and got[7][4] > 1000
    assert got[None][:5] == repaired([r[1:] for r in short][:])[:5] if len(short) < 300 else len(got) == 2


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        kind = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [] if kind == 0 else [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def test_damage(spark):
    rng = random.Random(3)
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(ROLES), rng.choice(TEXTS)) for c in [None, *range(80)] for _ in range(rng.randrange(1, 5))]
    got = found(repair_conversations(damage_conversations(frame(spark, rows)), present="present"))
    after = damaged(rows)
    want = wanted(after) | {c: (0,) * 6 + ("", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in rows} - {r[0] for r in after}}
    assert got == want and len(want) == 81 and any(c not in {r[0] for r in after} for c in want)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_edge_cases(spark, kind):
    docs = edge_docs(spark).selectExpr(f"cast(doc_id as {kind}) as conv_id", "id as turn", "lang as role", "text", "source as conv", "n_chars as row", "key as sha", "score as ways")
    got = found(repair_conversations(docs))
    rows = [(None if r.conv_id is None else r.conv_id, r.turn, r.role, r.text) for r in docs.collect()]
    assert got == wanted(rows)
    empty = no_docs(spark).selectExpr("doc_id as conv_id", "id as turn", "lang as role", "text")
    assert repair_conversations(empty).count() == 0
