"""Near-duplicate classes by Order MinHash with banded alignment.

A text's occurrence-labelled five-word k-mers are ranked once per band; the
``picks`` smallest are kept *in text order* and hashed to the band's bucket key,
so a bucket holds texts whose sampled k-mers agree in content and in order.
Texts of a bucket are aligned inside a band of diagonals, and linked if their edit
similarity is high enough. Classes are the connected components of all links.
A first round compares with one text a bucket, which joins most copies cheaply; then
every pair of texts of different classes that a bucket still holds is decided.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenun.llm.words import blocks, mix, occurrence_labels, seeds, shingle_hashes, word_hashes, word_sizes
from tenun.operators.components import connected_components
from tenun.sources.shared import Workspace, files_for

SHINGLE = 5
BANDS = 96
PICKS = 2
THRESHOLD = 0.8
EARLY_BANDS = 8
BLOCK = 1024
NEAREST = 1
CROWD = 8
MOST_PASSES = 2
SHORT = 60
_BITS = 4096
_CELLS = 1 << 16


def order_minhash(labels: np.ndarray, bands: int = BANDS, picks: int = PICKS) -> np.ndarray:
    """One bucket key per band for a text's labelled k-mers; none for a text without k-mers."""
    if not len(labels):
        return np.zeros(0, np.uint64)
    salts, places = seeds(bands, 101), seeds(picks, 303) | np.uint64(1)
    short_salts, odds = salts.astype(np.uint32), seeds(bands, 202).astype(np.uint32) | np.uint32(1)
    high = (labels >> np.uint64(32)).astype(np.uint32)
    keys = np.empty(bands, np.uint64)
    step = max(1, _CELLS // len(labels))
    for at in range(0, bands, step):
        part = slice(at, min(bands, at + step))
        ranks = (high[None, :] ^ short_salts[part, None]) * odds[part, None]
        spots = np.empty((len(ranks), min(picks, len(labels))), np.int64)
        for k in range(spots.shape[1]):
            spots[:, k] = ranks.argmin(axis=1)
            np.put_along_axis(ranks, spots[:, k : k + 1], np.uint32(0xFFFFFFFF), axis=1)
        if spots.shape[1] == len(labels):
            spots[:] = np.arange(len(labels))
        spots.sort(axis=1)
        keys[part] = mix((labels[spots] * places[: spots.shape[1]]).sum(axis=1, dtype=np.uint64) + salts[part])
    return keys


def short_keys(words: np.ndarray, sizes: np.ndarray, threshold: float = THRESHOLD) -> np.ndarray:
    """Bucket keys of a short text, of which it shares one with every short text that reaches the threshold.

    Such texts have at least ``common`` occurrence-labelled words in common, so under any
    one order of all words their first ``n - common + 2`` labels have two in common:
    each pair of these is a key. Long words come first, as they tend to be rare.
    """
    n = len(words)
    least = int(np.ceil(n * threshold / (2 - threshold) - 1e-9))
    common = int(np.ceil(threshold * (n + least) / 2 - 1e-9))
    if common < 2:
        return np.zeros(0, np.uint64)
    labels = occurrence_labels(words)
    first = labels[np.lexsort((labels, -sizes))[: n - common + 2]]
    one, two = np.triu_indices(len(first), 1)
    odds = seeds(2, 505) | np.uint64(1)
    return mix(first[one] * odds[0] + first[two] * odds[1])


def banded_similarity(a: np.ndarray, b: np.ndarray, threshold: float = THRESHOLD) -> float:
    """``2 L / (len(a) + len(b))`` with L the longest common subsequence, 0.0 if below ``threshold``.

    An alignment that reaches the threshold leaves out at most
    ``(1 - threshold) * (len(a) + len(b))`` items, so it never strays further than
    that from the main diagonal: only matches in that band are looked at, and the
    decision is exact. One bit per item of ``a`` holds a row of the table.
    """
    total = len(a) + len(b)
    if not total or 2 * min(len(a), len(b)) < threshold * total:
        return 0.0
    width = int((1 - threshold) * total + 1e-9)
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[:short] != b[:short])
    head = int(differ[0]) if len(differ) else short
    a, b = a[head:], b[head:]
    short = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - short :][::-1] != b[len(b) - short :][::-1])
    tail = int(differ[0]) if len(differ) else short
    a, b = a[: len(a) - tail].tolist(), b[: len(b) - tail].tolist()
    common = head + tail
    if a and b:
        spots: dict[int, int] = {}
        for i, x in enumerate(a):
            spots[x] = spots.get(x, 0) | 1 << i
        full = (1 << len(a)) - 1
        window = (1 << (2 * width + 1)) - 1
        row = full
        for j, x in enumerate(b):
            hits = spots.get(x, 0) & (window << (j - width) if j > width else window >> (width - j))
            if hits:
                same = row & hits
                row = ((row + same) | (row - same)) & full
        common += len(a) - row.bit_count()
    score = 2 * common / total
    return score if score + 1e-12 >= threshold else 0.0


def _sketches(bands: int, picks: int, size: int, threshold: float, short: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, texts in blocks(batch.column("text").to_pylist()):
                (words,), offsets = word_hashes(texts)
                keys = []
                for i, text in enumerate(texts):
                    own = words[offsets[i] : offsets[i + 1]]
                    sketch = order_minhash(occurrence_labels(shingle_hashes(own, size, short=True)), bands, picks)
                    if len(own) <= short:
                        sketch = np.concatenate((sketch, short_keys(own, word_sizes(text), threshold)))
                    keys.append(sketch.view(np.int64))
                same = [batch.column(c).slice(start, len(texts)) for c in ("id", "digest")]
                yield pa.RecordBatch.from_arrays([*same, pa.array(keys, pa.list_(pa.int64()))], ["id", "digest", "keys"])

    return run


def parity_bits(words: np.ndarray) -> bytes:
    """Bits that the words' occurrence labels flip: two texts' differ in no more bits than they have labels apart."""
    labels = occurrence_labels(words)
    flips = np.bincount((labels >> np.uint64(32)).astype(np.int64) % _BITS, minlength=_BITS) & 1
    return np.packbits(flips.astype(np.uint8)).tobytes()


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, texts in blocks(batch.column("text").to_pylist()):
            (words,), offsets = word_hashes(texts)
            own = [words[offsets[i] : offsets[i + 1]] for i in range(len(texts))]
            short = [(x >> np.uint64(32)).astype(np.uint32).tobytes() for x in own]
            columns = [pa.array(short, pa.binary()), pa.array([len(x) for x in own], pa.int64()), pa.array([parity_bits(x) for x in own], pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(start, len(texts)), *columns], ["id", "words", "size", "bits"])


def _aligned(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [banded_similarity(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), threshold) for x, y in zip(batch.column("a_words").to_pylist(), batch.column("b_words").to_pylist())]
            keep = pa.array([s > 0 for s in scores], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(scores, pa.float64())], ["a", "b", "similarity"])
            yield out.filter(keep)

    return run


def _possible(threshold: float, nearest: int | None):
    """Pairs ``(a, b)`` of a block that may reach the threshold: an insertion or deletion flips one bit at most.

    Texts of one class aren't paired; with a ``hub``, only texts of that class with
    others. ``nearest`` keeps of each text's pairs with texts after it the so many closest ones.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            members, ends = batch.column("members"), batch.column("members").offsets.to_numpy()
            flat, base = members.flatten(), ends[0]
            ids, classes, parts, sizes = (flat.field(c).to_numpy() for c in ("id", "class", "part", "size"))
            bits = np.frombuffer(b"".join(flat.field("bits").to_pylist()), np.uint64).reshape(-1, _BITS // 64)
            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for at, end, within, hub in zip(ends[:-1] - base, ends[1:] - base, batch.column("within").to_pylist(), batch.column("hub").to_pylist()):
                for i in range(at, end - 1):
                    rest = slice(i + 1, end)
                    most = (1 - threshold) * (sizes[rest] + sizes[i]) + 1e-6
                    fit = (classes[rest] != classes[i]) & (np.abs(sizes[rest] - sizes[i]) <= most)
                    if hub is not None:
                        fit &= (classes[rest] == hub) | (classes[i] == hub)
                    elif not within:
                        fit &= parts[rest] != parts[i]
                    fit = np.flatnonzero(fit)
                    if len(fit):
                        far = np.bitwise_count(bits[fit + i + 1] ^ bits[i]).sum(axis=1, dtype=np.int64)
                        near = np.flatnonzero(far <= most[fit])
                        if nearest is not None and len(near) > nearest:
                            near = near[np.argpartition(far[near], nearest - 1)[:nearest]]
                        others = ids[fit[near] + i + 1]
                        a.append(np.minimum(others, ids[i]))
                        b.append(np.maximum(others, ids[i]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in (a, b)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, size: int = SHINGLE, bands: int = BANDS, picks: int = PICKS, short: int = SHORT) -> DataFrame:
    """One row per id with its near-duplicate class: ``(id_col, class_id, class_size)``.

    Two texts are linked if the edit similarity of their word sequences,
    ``1 - (insertions + deletions) / (words of both)``, is at least ``threshold``
    and they meet in a bucket; a class is named by its smallest id. Equal texts
    are one class before any sketching, so a group of copies costs one sketch.
    Two picks in 96 bands meet with probability ``1 - (1 - J**2)**96`` for a
    k-mer resemblance J: 0.9998 at J = 0.3, 0.98 at J = 0.2, which is what is left
    of a text in which every fifth word was replaced (edit similarity 0.8). Short texts
    have too few k-mers for that: texts of up to ``short`` words also get a bucket for
    every two of their longest words, one of which two that reach the threshold always share.

    The first ``EARLY_BANDS`` bands only save work: there every text of a bucket is
    compared with the bucket's smallest id, which joins most copies at linear cost,
    and then, up to ``MOST_PASSES`` times, each text with the ``NEAREST`` of
    another class. After that all pairs of different classes in the buckets of all
    bands are decided, in blocks of at most about ``BLOCK`` texts a side: bits that
    words flip rule out what can't reach the threshold, without loss, and the rest is
    aligned. Ruling out takes time with the square of the number of texts in a
    bucket that stay in different classes; a class that fills buckets of many bands
    is compared with their other texts once. Every pair that meets is decided, whatever
    other rows there are.

    Null and empty texts count as equal, and form one class; texts without words
    have only equal texts as duplicates. Texts of under ``size`` words are one
    k-mer. Repeated rows with equal ids and texts give one row. An id that stands
    for several texts contradicts itself: it is a class of its own. Ids that are null
    are left out; ids that aren't numbers raise Spark's cast error. Other columns
    are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    work = Workspace(spark, "near-duplicates")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).where("id is not null")
    given = rows.select("id", "text", F.unhex(F.sha2("text", 256)).alias("digest"))
    sketches = work.save(given.mapInArrow(_sketches(bands, picks, size, threshold, short), "id long, digest binary, keys array<long>"), "sketches")
    files = files_for(sketches.count())

    # one row per id; what is saved before a join can be split there if a key is hot
    own = sketches.groupBy("id").agg(F.min("digest").alias("digest"), F.max("digest").alias("last"))
    own = work.save(own.select("id", "digest", (F.col("digest") != F.col("last")).alias("unsure")), "own", files)
    copies = work.save(own.where("not unsure").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies", files)
    same = own.where("not unsure").join(copies, "digest", "left").select("id", F.coalesce("rep", "id").alias("rep"))
    exact = work.save(same.unionByName(own.where("unsure").select("id", F.col("id").alias("rep"))), "exact", files)

    alone = exact.where("id <> rep").select("id").unionByName(own.where("unsure").select("id"))
    heads = work.save(sketches.join(alone, "id", "left_anti").dropDuplicates(["id"]).select("id", "keys"), "heads")
    work.drop("sketches")
    cells = heads.select("id", F.posexplode("keys").alias("band", "key"))
    shared = cells.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    buckets = work.save(cells.join(work.save(shared, "shared", 4 * files), "key").select("key", "id", (F.col("band") < EARLY_BANDS).alias("early")), "buckets", 4 * files)

    members = buckets.select("id").distinct()
    tokens = work.save(rows.join(members, "id", "left_semi").dropDuplicates(["id"]).mapInArrow(_tokens, "id long, words binary, size long, bits binary"), "tokens")
    work.drop("heads")

    links, labels, step = None, None, 0

    def link(pairs: DataFrame) -> bool:
        """Align ``pairs`` and join the classes of those that are linked; whether there are any."""
        nonlocal links, labels, step
        found = (
            pairs.join(tokens.select(F.col("id").alias("a"), F.col("words").alias("a_words")), "a")
            .join(tokens.select(F.col("id").alias("b"), F.col("words").alias("b_words")), "b")
            .select("a", "b", "a_words", "b_words")
            .mapInArrow(_aligned(threshold), "a long, b long, similarity double")
        )
        found = work.save(found, f"links-{step}", files)
        step += 1
        if found.isEmpty():
            return False
        links = found if links is None else links.unionByName(found)
        labels = connected_components(links, "a", "b", files).select(F.col("node").alias("id"), "component")
        return True

    def with_class(cells: DataFrame) -> DataFrame:
        if labels is None:
            return cells.withColumn("class", F.col("id"))
        return cells.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("class"))

    def undecided(cells: DataFrame, nearest: int | None, name: str) -> DataFrame:
        held = work.save(_mixed(work, with_class(cells), f"cells-{name}", 4 * files), f"mixed-{name}", files)
        sizes = held.groupBy("key", "around").agg(F.count("*").alias("n"), F.sum(F.expr("int(class = key)")).alias("hubs"), F.min("class").alias("low"), F.max("class").alias("high"))
        sizes = work.save(sizes.where("low <> high").drop("low", "high"), f"sizes-{name}", files)
        return work.save(_undecided(held, sizes, tokens, threshold, nearest), f"pairs-{name}", files)

    early = buckets.where("early").select("key", "id")
    leaders = work.save(early.groupBy("key").agg(F.min("id").alias("a")), "leaders", files)
    link(early.join(leaders, "key").where("id <> a").select("a", F.col("id").alias("b")).distinct())
    for k in range(MOST_PASSES):
        if not link(undecided(early, NEAREST, str(k)).distinct()):
            break
    link(undecided(buckets.select("key", "id"), None, "all").distinct())

    if labels is None:
        joined = exact.select("id", F.col("rep").alias("class_id"))
    else:
        named = labels.where("id <> component").select(F.col("id").alias("rep"), "component")
        joined = exact.join(named, "rep", "left").select("id", F.coalesce("component", "rep").alias("class_id"))
    joined = work.save(joined, "classes", files)
    work.keep("classes")
    sizes = work.save(joined.groupBy("class_id").agg(F.count("*").alias("n")).where("n > 1"), "sizes", files)
    return joined.join(sizes, "class_id", "left").select(F.col("id").alias(id_col), "class_id", F.coalesce("n", F.lit(1)).cast("long").alias("class_size"))


def _mixed(work: Workspace, cells: DataFrame, name: str, files: int) -> DataFrame:
    """``(key, around, id, class)``: what to compare of the buckets with texts of several classes.

    Where ``CROWD`` texts or more of a bucket are of one class, that class leaves the
    bucket: its texts, and the others of all such buckets, meet once ``around`` the
    class, whose name is then the key, instead of once in every band.
    """
    cells = work.save(cells, name, files)
    tops = cells.groupBy("key", "class").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "class")).alias("top"), F.count("*").alias("classes"))
    tops = work.save(tops.where("classes > 1").select("key", F.when(F.col("top.n") >= CROWD, F.col("top.class")).alias("hub")), f"{name}-tops", files)
    held = cells.join(tops, "key")
    plain = held.where("hub is null or class <> hub").select("key", F.lit(False).alias("around"), "id", "class")
    around = held.where("hub is not null").select(F.col("hub").alias("key"), F.lit(True).alias("around"), "id", "class").distinct()
    return plain.unionByName(around)


def _undecided(held: DataFrame, sizes: DataFrame, tokens: DataFrame, threshold: float, nearest: int | None) -> DataFrame:
    """``_possible`` over what ``_mixed`` holds.

    A bucket's texts are dealt to parts of about ``BLOCK``, and each two parts meet
    in one row, so no task holds a large bucket whole. Around a class, parts of
    its texts meet parts of the others.
    """
    n, hubs = F.col("n"), F.col("hubs")
    parts = lambda x: F.ceil(x / BLOCK).cast("int")
    own = F.when(F.col("around"), parts(hubs)).otherwise(parts(n)).alias("own")
    sizes = sizes.select("key", "around", own, F.when(F.col("around"), parts(n - hubs)).otherwise(parts(n)).alias("far"))
    placed = held.join(sizes, ["key", "around"]).join(tokens.select("id", "size", "bits"), "id")
    center = ~F.col("around") | (F.col("class") == F.col("key"))
    placed = placed.withColumn("part", F.pmod(F.xxhash64("id"), F.when(center, F.col("own")).otherwise(F.col("far"))).cast("int"))
    met = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(center, F.col("far")).otherwise(F.col("own")) - 1)))
    p = F.when(F.col("around"), F.when(center, F.col("part")).otherwise(F.col("other"))).otherwise(F.least("part", "other"))
    q = F.when(F.col("around"), F.when(center, F.col("other")).otherwise(F.col("part"))).otherwise(F.greatest("part", "other"))
    blocks = met.groupBy("key", "around", p.alias("p"), q.alias("q")).agg(F.collect_list(F.struct("id", "class", "part", "size", "bits")).alias("members"))
    hub = F.when(F.col("around"), F.col("key")).alias("hub")
    return blocks.select((F.col("p") == F.col("q")).alias("within"), hub, "members").mapInArrow(_possible(threshold, nearest), "a long, b long")


def keep_one(docs: DataFrame, classes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id names its class; of repeated ids, and of null ids, all rows."""
    heads = classes.where(F.col("class_id") != F.col(id_col)).select(F.col(id_col).alias("_gone"))
    return docs.join(heads, docs[id_col] == heads["_gone"], "left_anti")
