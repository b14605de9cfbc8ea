import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tenun.llm.packing import Places, cut, encoder, pack_documents, plan
from tests.llm.fixtures import edge_docs, no_docs, text

public = pytest.importorskip("public_tokenizers")
PATH = public.path("byte_bpe_50k.json")


def reference():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def test_ids_equal_the_tokenizer_files():
    rng = random.Random(1)
    texts = ["", "a", " <|endoftext|> x", "größe ñandú 😀\u200d👍", "tabs\t\n\n  x\r\n", "1234567 don't I'LL", "\u00a0\u3000z", text(rng, 500), "".join(chr(rng.randrange(32, 0x3000)) for _ in range(2000))]
    want = reference()
    for t in texts:
        assert encoder(PATH).encode_ordinary(t) == want.encode(t, add_special_tokens=False).ids


def test_plan_places_every_piece_once():
    rng = random.Random(2)
    for _ in range(200):
        size = rng.choice([4, 16, 50, 2048])
        counts = Counter(rng.choices(range(1, size + 1), [1 / x ** rng.choice([0.3, 1]) for x in range(1, size + 1)], k=rng.choice([1, 5, 60, 600])))
        planned, used = plan(dict(counts), size), Counter()
        for lengths, n in planned:
            assert n > 0 and sum(lengths) <= size
            for x in lengths:
                used[x] += n
        assert used == counts
        places, at = Places(planned), defaultdict(list)
        for x, n in counts.items():
            for rank in range(n):
                sequence, offset = places(x, rank)
                at[sequence].append((offset, x))
        for spots in at.values():
            spots.sort()
            assert all(a + x == b for (a, x), (b, _) in zip(spots, spots[1:])) and spots[0][0] == 0


def test_exact_complements_come_first():
    assert plan({7: 2, 3: 2}, 10) == [((7, 3), 2)]
    assert plan({6: 1, 3: 1, 1: 1, 2: 1}, 10)[0] == ((6, 3, 1), 1)
    assert plan({4: 1, 3: 1, 2: 1, 1: 1}, 10) == [((4, 3, 2, 1), 1)]
    assert plan({9: 3}, 10) == [((9,), 3)]


def test_plan_is_near_the_bound():
    rng = random.Random(3)
    counts = Counter(min(2048, max(1, int(rng.lognormvariate(6.5, 1)))) for _ in range(20_000))
    used, least = sum(n for _, n in plan(dict(counts))), math.ceil(sum(k * n for k, n in counts.items()) / 2048)
    assert used <= 1.003 * least


def test_cut_leaves_only_the_first_short():
    assert cut(5, 8) == [(0, 5)] and cut(8, 8) == [(0, 8)] and cut(16, 8) == [(0, 8), (8, 8)] and cut(19, 8) == [(0, 3), (3, 8), (11, 8)]


def test_edges(spark):
    docs = edge_docs(spark)
    rows = pack_documents(docs, PATH).collect()
    want = reference()
    have, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        have[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for doc_id, t in {(r.doc_id, r.text) for r in docs.collect() if r.doc_id not in (None, 7)}:
        ids = np.array([*want.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        parts = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in have[doc_id])
        assert parts == [(k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(len(ids), 2048))]
    assert len(have[7]) == 2 and len(have[None]) == 2 and len(have[1]) == 1 and have[1][0].length == 1
    for spots in sequences.values():
        spots.sort()
        assert spots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spots, spots[1:])) and sum(n for _, n in spots) <= 2048
    assert pack_documents(no_docs(spark), PATH).count() == 0


def test_added_tokens_have_their_own_ids(spark):
    from tokenizers import Tokenizer

    want = Tokenizer.from_file(PATH)
    texts = {1: "plain words", 2: "one <|endoftext|> two<|endoftext|>", 3: "<|endoftext|>", 4: "größe <|endoftext|>\n\n x  <|endoftext"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.length, r.ids_crc32) for r in pack_documents(docs, PATH).collect()}
    ids = {k: np.array([*want.encode(t, add_special_tokens=False).ids, 0], "<u4") for k, t in texts.items()}
    assert 50256 in ids[2] and got == {k: (len(x), zlib.crc32(x.tobytes())) for k, x in ids.items()}
