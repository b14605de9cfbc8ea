import hashlib
import random

import numpy as np
import pytest

from tenun.llm.chat import END, MARKS, TEXT, TURN, escape, format_conversations, learned_spans, mask_of, parse, read_back, render, unescape

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")
PARTS = [*MARKS, "<", "|", "\\", "<|", "<\\|", "|>", " ", "\n", "a", "é", "😀", "</s>[INST] ok [/INST]", "<|endoftext|>", "turn"]


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_escape_is_reversible():
    rng = random.Random(1)
    for _ in range(3000):
        t = "".join(rng.choices(PARTS, k=rng.randrange(9)))
        assert unescape(escape(t)) == t and not any(m in escape(t) for m in (*MARKS, "<|"))


def test_render_and_parse():
    turns = [("user", f"{TURN}x{END}"), ("assistant", ""), (f"odd{TEXT}", "<\\|y"), ("assistant", "z")]
    formatted, spans = render(turns)
    assert parse(formatted) == turns and [formatted[a:b] for a, b in spans] == ["", "z"]


def test_mask_by_binary_search():
    starts, ends = np.array([0, 2, 5, 5, 9]), np.array([2, 5, 9, 9, 12])
    assert mask_of(starts, ends, [(5, 9)]).tolist() == [0, 0, 1, 1, 0]
    assert mask_of(starts, ends, [(2, 2), (2, 5), (9, 12)]).tolist() == [0, 1, 0, 0, 1]
    assert mask_of(starts[:0], ends[:0], [(0, 1)]).tolist() == []


def test_round_trip(spark):
    rng = random.Random(2)
    rows, want = [], {}
    for conv in range(60):
        turns = [(rng.choice(["user", "assistant", "system", None]), rng.choice([None, "", "".join(rng.choices(PARTS, k=rng.randrange(30)))])) for _ in range(rng.randrange(1, 7))]
        rows += [(conv, k, role, t, "extra", 1) for k, (role, t) in enumerate(turns)]
        plain = [(r or "", t or "") for r, t in turns]
        learned = "".join(t for r, t in plain if r == "assistant")
        want[conv] = (len(plain), sha("".join(f"{r}\n{t}\n" for r, t in plain)), len(learned), sha(learned), len(render(plain)[0]))
    rng.shuffle(rows)
    given = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string, conv int")
    out = read_back(format_conversations(given, PATH))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in out.collect()}
    assert got == want


def test_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    long_text = "word é " * 60_000
    rows = [(None, 0, "assistant", "no id"), (1, None, "user", "first"), (1, 0, "assistant", long_text), (2, 0, "assistant", "twice"), (2, 0, "assistant", "twice"), (3, 5, None, None)]
    got = {r.conv_id: r for r in read_back(format_conversations(spark.createDataFrame(rows, schema), PATH)).collect()}
    assert set(got) == {None, 1, 2, 3}
    assert got[None].loss_chars == 5 and got[1].loss_chars == len(long_text) and got[1].loss_sha256 == sha(long_text)
    assert got[2].loss_sha256 == sha("twicetwice") and got[3].loss_chars == 0 and got[3].turns_sha256 == sha("\n\n")
    assert format_conversations(spark.createDataFrame([], schema), PATH).count() == 0


def test_learned_spans_equal_plain_loops():
    rng = random.Random(4)
    for _ in range(300):
        at, starts, ends = 0, [], []
        for _ in range(rng.randrange(12)):
            width = rng.choice([1, 1, 3])
            for _ in range(rng.choice([1, 1, 2])):  # bytes of one character
                starts.append(at)
                ends.append(at + width)
            at += width
        mask = [rng.randrange(2) for _ in starts]
        spans = []
        for m, a, b in zip(mask, starts, ends):
            if m and spans and a <= spans[-1][1]:
                spans[-1][1] = max(b, spans[-1][1])
            elif m:
                spans.append([a, b])
        assert learned_spans(np.array(mask, np.int8), np.array(starts), np.array(ends)) == [tuple(s) for s in spans]
