"""Toxicity by a convolutional text classifier, trained here in numpy.

A word is the sum of three hashed embeddings: of the whole word and of its first
four and first five bytes, so inflected forms share weight. Filters of one, two
and three words run over the text, each keeps its maximum, and a logistic layer
weighs the maxima. Decision thresholds are calibrated for each language on scores of
held-out parts; the language is itself told from the text by rank-order profiles.
Scores are rescaled so that every language's threshold lies at 0.7.

All labelled rows are learned from. They are dealt to shards of a bounded size; in a
pass every shard moves its own copy of a network, and the copies are averaged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyarrow.dataset import dataset
from pyarrow.dataset import field as field_of
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenun.llm.language import Profiles, identify_languages, learn_profiles
from tenun.llm.words import blocks, word_hashes
from tenun.sources.shared import Workspace, open_shared

CUT = 0.7
PREFIXES = (4, 5)
SLOTS = 1 << 15
WIDTH = 16
FILTERS = 16
SPANS = (1, 2, 3)
EPOCHS = 12
#: Passes may end before ``EPOCHS`` once a network has moved through so many rows, and the held-out loss of a row falls by less.
ENOUGH, SETTLED = 25_000, 0.002
#: Characters of a shard, and what a text counts besides its own.
SHARD_CHARS, TEXT_CHARS = 50_000_000, 100
#: Labels up to which the texts stay where they are while these are joined; more meet in a shuffle.
MOST_BROADCAST = 2_000_000
#: Pieces of a network that are averaged apart, at most, and steps of the logistic scale on which held-out scores are counted.
PIECES, STEPS = 4, 256
WORDS_AT_ONCE = 1 << 15
FOLDS = 5
STEADY = 20
_PAD = max(SPANS) - 1
#: The network's parts, in one array after another.
SHAPES = ((SLOTS + 1, WIDTH), *((n, WIDTH, FILTERS) for n in SPANS), (len(SPANS) * FILTERS,), (1,))
_ENDS = [0, *np.cumsum([int(np.prod(shape)) for shape in SHAPES]).tolist()]
SIZE = _ENDS[-1]
#: Of each row of a filter's weights: the filter, and which of its words it is for.
_FILTER = np.concatenate([np.arange(FILTERS) + k * FILTERS for k, n in enumerate(SPANS) for _ in range(n)])
_STEP = np.concatenate([np.full(FILTERS, j) for n in SPANS for j in range(n)])


def features(texts: list[str | None]) -> list[np.ndarray]:
    """Per text an array (words, 3) of embedding slots."""
    hashes, offsets = word_hashes(texts, PREFIXES)
    slots = np.stack([(h ^ np.uint64(k * 0x5BD1E995)) & np.uint64(SLOTS - 1) for k, h in enumerate(hashes)], axis=1).astype(np.uint16)
    return [slots[offsets[i] : offsets[i + 1]] for i in range(len(texts))]


def _groups(docs: list[np.ndarray], most: int = WORDS_AT_ONCE) -> Iterator[slice]:
    """Runs of texts of about ``most`` words: what is worked on at a time."""
    at, size = 0, 0
    for i, d in enumerate(docs):
        size += len(d)
        if size >= most:
            yield slice(at, i + 1)
            at, size = i + 1, 0
    if at < len(docs):
        yield slice(at, len(docs))


def _joined(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one array, padded so that no filter sees two of them, and the places from and up to which filters start."""
    pad = np.full((_PAD + 1, 1 + len(PREFIXES)), SLOTS, np.uint16)
    begins = np.cumsum([0] + [len(d) + len(pad) for d in docs])[:-1]
    return np.concatenate([x for d in docs for x in (d, pad)] + [pad]), begins, begins + [len(d) + 1 for d in docs]


def _views(flat: np.ndarray) -> list[np.ndarray]:
    """The embedding, the filters of each span, the logistic layer and the bias, as parts of one array."""
    return [flat[a:b].reshape(shape) for a, b, shape in zip(_ENDS, _ENDS[1:], SHAPES)]


def class_weights(share: float) -> np.ndarray:
    """What a row of label 0 and one of label 1 weigh, if ``share`` of all rows have label 1."""
    return np.array([0.5 / max(1 - share, 1e-9), 0.5 / max(share, 1e-9)]).clip(0, 5)


@dataclass
class TextCNN:
    """The network's weights, in one array, and its numpy training."""

    seed: int = 13
    weights: np.ndarray = field(init=False)

    def __post_init__(self):
        draw = np.random.default_rng(self.seed)
        self.weights = np.zeros(SIZE, np.float32)
        embedding, *filters, out, _ = _views(self.weights)
        embedding[:SLOTS] = draw.normal(0, 0.01, (SLOTS + 1, WIDTH))[:SLOTS]
        for n, bank in zip(SPANS, filters):
            bank[:] = draw.normal(0, 0.5 / np.sqrt(n), bank.shape)
        out[:] = draw.normal(0, 0.5, len(out))

    @property
    def embedding(self) -> np.ndarray:
        return _views(self.weights)[0]

    @property
    def filters(self) -> list[np.ndarray]:
        return _views(self.weights)[1:-2]

    @property
    def out(self) -> np.ndarray:
        return _views(self.weights)[-2]

    @property
    def bias(self) -> float:
        return float(self.weights[-1])

    @bias.setter
    def bias(self, value: float) -> None:
        self.weights[-1] = value

    def _words(self, slots: np.ndarray) -> np.ndarray:
        table = self.embedding
        words = table.take(slots[:, 0], axis=0)
        for c in range(1, slots.shape[1]):
            words += table.take(slots[:, c], axis=0)
        return words

    def _bank(self) -> np.ndarray:
        """A row of weights for every filter and each of the words it sees."""
        return np.concatenate([word.T for bank in self.filters for word in bank])

    def _maps(self, words: np.ndarray) -> np.ndarray:
        """What every filter gives at every place: an array (filters, places)."""
        seen, n, at = self._bank() @ words.T, len(words) - _PAD, 0
        maps = np.empty((len(SPANS) * FILTERS, n), np.float32)
        for k, span in enumerate(SPANS):
            own = maps[k * FILTERS : (k + 1) * FILTERS]
            parts = [seen[at + j * FILTERS : at + (j + 1) * FILTERS, j : j + n] for j in range(span)]
            if span == 1:
                own[:] = parts[0]
            else:
                np.add(*parts[:2], out=own)
            for part in parts[2:]:
                own += part
            at += span * FILTERS
        return maps

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        parts = [self._scores(docs[g]) for g in _groups(docs)]
        return np.concatenate(parts) if parts else np.zeros(0)

    def _scores(self, docs: list[np.ndarray]) -> np.ndarray:
        slots, begins, ends = _joined(docs)
        maps = self._maps(self._words(slots))
        pooled = np.stack([maps[:, b:e].max(axis=1) for b, e in zip(begins, ends)])
        return 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30).astype(np.float64)))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, batch: int = 32, rate: float = 0.05, forget: float = 0.3) -> TextCNN:
        """AdaGrad on class-weighted log loss; whole words are hidden at random so prefixes learn too."""
        draw, sums, weight = np.random.default_rng(self.seed + 1), start_sums(), class_weights(labels.mean())
        for _ in range(epochs):
            self.learn(docs, labels, weight, sums, draw, batch, rate, forget)
        return self

    def learn(self, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, sums: np.ndarray, draw: np.random.Generator, batch: int = 32, rate: float = 0.05, forget: float = 0.3) -> None:
        """One pass over the texts; ``sums`` are AdaGrad's, of the squared slopes."""
        order = draw.permutation(len(docs))
        (table, *_), (table_sums, *_) = _views(self.weights), _views(sums)
        dense, dense_sums = self.weights[table.size :], sums[table.size :]
        for at in range(0, len(docs), batch):
            batch_of = order[at : at + batch]
            given, label = [docs[i] for i in batch_of], labels[batch_of]
            slope, keys, rows = np.zeros_like(dense), [], []
            for group in _groups(given):
                key, back = self._slopes(given[group], label[group], weight[label[group]] / len(batch_of), slope, draw, forget)
                keys.append(key)
                rows.append(back)
            # only the slots of words that some filter chose have a slope
            slots, back = _summed(np.concatenate(keys), np.concatenate(rows))
            dense_sums += slope * slope
            dense -= rate * slope / np.sqrt(dense_sums)
            total = table_sums[slots] + back * back
            table_sums[slots] = total
            table[slots] -= rate * back / np.sqrt(total)
            table[SLOTS] = 0

    def _slopes(self, docs: list[np.ndarray], labels: np.ndarray, weight: np.ndarray, slope: np.ndarray, draw: np.random.Generator, forget: float) -> tuple[np.ndarray, np.ndarray]:
        """Add the texts' gradient to ``slope``, all but the embedding's: that is returned, as slots and a row for each word that was seen."""
        slots, begins, ends = _joined(docs)
        slots[draw.random(len(slots), np.float32) < forget, 0] = SLOTS
        words = self._words(slots)
        maps = self._maps(words)
        tops = np.stack([maps[:, b:e].argmax(axis=1) + b for b, e in zip(begins, ends)])
        pooled = maps[np.arange(len(maps)), tops]
        given = 1 / (1 + np.exp(-np.clip(pooled @ self.out + self.bias, -30, 30)))
        error = ((given - labels) * weight).astype(np.float32)
        flow = (error[:, None] * self.out)[:, _FILTER]
        spot = tops[:, _FILTER] + _STEP
        bank = flow.T[:, None, :] @ words.take(spot.T, axis=0)
        at = 0
        for part in bank.reshape(-1, FILTERS, WIDTH):
            slope[at : at + part.size] += part.T.ravel()
            at += part.size
        slope[at:-1] += pooled.T @ error
        slope[-1] += error.sum()
        return slots[spot.ravel()], (flow[:, :, None] * self._bank()).reshape(-1, WIDTH)


def start_sums() -> np.ndarray:
    return np.full(SIZE, 1e-3, np.float32)


def _summed(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ``keys``, of which each row has several, and the sum of the rows of each."""
    wide, keys = keys.shape[1], keys.ravel()
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(rows[order // wide], first, axis=0)


def best_threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The middle of the thresholds that give the greatest F1; a score stands for ``counts`` rows, or one."""
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    values, place = np.unique(scores, return_inverse=True)
    tries = np.concatenate(([values[0] / 2], (values[1:] + values[:-1]) / 2, [(values[-1] + 1) / 2]))
    above = np.searchsorted(values, tries)
    taken, hits = (np.append(np.cumsum(np.bincount(place, n, len(values))[::-1])[::-1], 0)[above] for n in (counts, counts * (labels == 1)))
    f1 = 2 * hits / np.maximum(taken + counts[labels == 1].sum(), 1)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(np.clip((tries[best[0]] + tries[best[-1]]) / 2, 1e-6, 1 - 1e-6))


def language_thresholds(scores: np.ndarray, labels: np.ndarray, languages: np.ndarray, pooled: float, steady: int = STEADY, counts: np.ndarray | None = None) -> dict[str, float]:
    """The threshold of each language that has rows of both labels.

    It lies between the language's own best threshold and the pooled one, on the
    logistic scale, the nearer to its own the more toxic rows it has: half way with
    ``steady`` of them. A score stands for ``counts`` rows, or one.
    """
    odds = lambda t: np.log(t / (1 - t))
    counts = np.ones(len(scores), np.int64) if counts is None else counts
    out = {}
    for name in sorted(set(languages.tolist())):
        own = languages == name
        toxic = int(counts[own & (labels == 1)].sum())
        if toxic and (labels[own] == 0).any():
            share = toxic / (toxic + steady)
            mixed = share * odds(best_threshold(scores[own], labels[own], counts[own])) + (1 - share) * odds(pooled)
            out[name] = float(1 / (1 + np.exp(-mixed)))
    return out


@dataclass
class ToxicityModel:
    """Network, language profiles and the threshold of each language."""

    network: TextCNN | None
    profiles: Profiles | None = None
    thresholds: dict[str, float] = field(default_factory=dict)
    pooled: float = 0.5

    def score(self, texts: list[str | None]) -> list[float]:
        out: list[float] = []
        if self.network is None:
            return [0.0] * len(texts)
        for _, run in blocks(texts, 1 << 18):
            raw = self.network.scores(features(run))
            level = np.array([self.thresholds.get(self.profiles.identify(t)[0], self.pooled) for t in run])
            out += np.where(raw < level, CUT * raw / level, CUT + (1 - CUT) * (raw - level) / (1 - level)).tolist()
        return out

    def column(self, text: Column | str) -> Column:
        """The score as a column, computed in Arrow batches."""
        scored = F.pandas_udf(lambda texts: pd.Series(self.score(texts.tolist()), dtype="float64"), "double")
        return scored(text)


def _within(rows: DataFrame, most_chars: int) -> Column:
    """Which rows of a bounded sample are kept: of each label those up to the place where the texts get too long together."""
    fits = F.lit(True)
    for label in (0, 1):
        total = 0
        # rows come one part after another, and no more of them than are kept
        for r in rows.where(F.col("label") == label).select("place", F.length("text").alias("chars")).orderBy("place").toLocalIterator():
            total += r["chars"]
            if total > most_chars:
                fits &= (F.col("label") != label) | (F.col("place") < r["place"])
                break
    return fits


def _runs(batches: Iterator[pa.RecordBatch], most: int = 2 * SHARD_CHARS) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, np.ndarray]]:
    """``(shard, texts, labels, folds)`` of rows in order of their shard; a shard of over ``most`` words comes in several."""
    shard, docs, label, fold, size = None, [], [], [], 0
    for batch in batches:
        for at, y, f, slots in zip(*(batch.column(c).to_pylist() for c in ("shard", "label", "fold", "slots"))):
            if docs and (at != shard or size > most):
                yield shard, docs, np.array(label), np.array(fold)
                docs, label, fold, size = [], [], [], 0
            shard = at
            docs.append(np.frombuffer(slots, np.uint16).reshape(-1, 1 + len(PREFIXES)))
            label.append(y)
            fold.append(f)
            size += len(docs[-1]) + TEXT_CHARS
    if docs:
        yield shard, docs, np.array(label), np.array(fold)


_MOVES = "part int, piece int, shard long, moved binary, squares binary, heavy binary"
_STATE = "part int, piece int, weights binary, sums binary"


def _state(folder: str | None, part: int) -> tuple[np.ndarray, np.ndarray]:
    """A network's weights and AdaGrad's sums as the last pass left them in the shared folder; before the first one, as they start."""
    if folder is None:
        return TextCNN().weights, start_sums()
    system, name = open_shared(folder)
    rows = dataset(name, filesystem=system, format="parquet").to_table(columns=["piece", "weights", "sums"], filter=field_of("part") == part).sort_by("piece")
    return tuple(np.concatenate([np.frombuffer(x, np.float32) for x in rows.column(c).to_pylist()]) for c in ("weights", "sums"))


def _row(schema: str, *values) -> pa.RecordBatch:
    names, kinds = zip(*(x.split() for x in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([x], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[kind]) for x, kind in zip(values, kinds)], names)


def _moves(part: int, share: float, folder: str | None, turn: int, pieces: int):
    """What the shards of a task move in one pass: for each, a copy of network ``part`` learns from all its rows but those of that fold.

    ``share`` of the rows that the network learns from have label 1. For every piece of the network there is one row,
    however many shards the task has: sums over these of how the weights moved and how AdaGrad's sums grew, and of what they weigh.
    A weight's moves weigh what they added to its sum, so a word that only few shards have is
    learned from these as it would be from their rows alone.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, sums = _state(folder, part)
        first, last, total = None, None, np.zeros((3, SIZE))
        own, own_sums, draw = TextCNN(), None, None

        def add() -> None:
            moved, squares = own.weights - weights, own_sums - sums
            # where no row has a slope all moves are 0
            heavy = squares.astype(np.float64) + 1e-30
            for row, x in zip(total, (heavy * moved, heavy * squares, heavy)):
                row += x

        for shard, docs, labels, folds in _runs(batches):
            if shard != last:
                if last is None:
                    first = shard
                else:
                    add()
                last, own.weights, own_sums = shard, weights.copy(), sums.copy()
                draw = np.random.default_rng([own.seed, turn, shard])
            seen = np.flatnonzero(folds != part)
            own.learn([docs[i] for i in seen], labels[seen], class_weights(share), own_sums, draw)
        if last is not None:
            add()
            for piece, rows in enumerate(np.array_split(total.astype(np.float32), pieces, axis=1)):
                yield _row(_MOVES, part, piece, first, *(x.tobytes() for x in rows))

    return run


def _averaged(folder: str | None, pieces: int):
    """The networks after a pass, piece by piece: all tasks' moves as one mean. Rows come in order of part, piece and shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, total = None, None

        def moved() -> pa.RecordBatch:
            before = [np.array_split(x, pieces)[last[1]] for x in _state(folder, last[0])]
            after = [(x + mean).astype(np.float32) for x, mean in zip(before, total[:2] / total[2])]
            return _row(_STATE, *last, *(x.tobytes() for x in after))

        for batch in batches:
            for part, piece, *sums in zip(*(batch.column(c).to_pylist() for c in ("part", "piece", "moved", "squares", "heavy"))):
                sums = np.stack([np.frombuffer(x, np.float32) for x in sums]).astype(np.float64)
                if (part, piece) != last:
                    if last is not None:
                        yield moved()
                    last, total = (part, piece), np.zeros_like(sums)
                total += sums
        if last is not None:
            yield moved()

    return run


def _counted(folder: str | None, parts: list[int]):
    """How many rows have a language, a label and a score, each by the network of its fold: ``step`` is the score's place on the logistic scale."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorers = {part: TextCNN() for part in parts}
        for part, scorer in scorers.items():
            scorer.weights = _state(folder, part)[0]
        for batch in batches:
            folds = np.array(batch.column("fold").to_pylist())
            docs = [np.frombuffer(b, np.uint16).reshape(-1, 1 + len(PREFIXES)) for b in batch.column("slots").to_pylist()]
            for part, scorer in scorers.items():
                own = np.flatnonzero(folds == part)
                if len(own):
                    scores = scorer.scores([docs[i] for i in own])
                    steps = np.rint(STEPS * np.log(scores / (1 - scores))).astype(np.int32)
                    yield pa.RecordBatch.from_arrays([batch.column("lang").take(pa.array(own)), batch.column("label").take(pa.array(own)), pa.array(steps)], ["lang", "label", "step"])

    return run


class _Networks:
    """One network for each fold, which learns from all other rows, and one that learns from all; part ``FOLDS`` is the latter.

    They stay in a table of the shared folder, which tasks read and the next pass writes anew; none comes to the driver
    before the end.
    """

    def __init__(self, work: Workspace, dealt: DataFrame, shares: dict[int, float], shards: int):
        self.work, self.dealt, self.shares, self.turns, self.pieces = work, dealt, shares, 0, min(shards, PIECES)
        self.table, self.folder = None, None
        # a task adds up what its shards move, so what is exchanged grows with the cores and not with the rows
        self.tasks = min(shards, -(-dealt.sparkSession.sparkContext.defaultParallelism // len(shares)))

    def moves(self) -> DataFrame:
        # Spark would put single partitions that meet in a union into one task, so the network that reads most has two at least
        tasks = {part: max(2, self.tasks) if part == FOLDS else self.tasks for part in self.shares}
        return reduce(DataFrame.union, [self.dealt.coalesce(tasks[part]).mapInArrow(_moves(part, share, self.folder, self.turns, self.pieces), _MOVES) for part, share in self.shares.items()])

    def learn(self) -> None:
        """One pass. All networks and shards learn side by side."""
        met = self.moves().repartitionById(self.pieces * (FOLDS + 1), F.col("part") * self.pieces + F.col("piece")).sortWithinPartitions("part", "piece", "shard")
        name = f"networks-{self.turns}"
        self.table = self.work.save(met.mapInArrow(_averaged(self.folder, self.pieces), _STATE), name)
        if self.folder is not None:
            self.work.drop(f"networks-{self.turns - 1}")
        self.folder = self.work.uri(name)
        self.turns += 1

    def network(self) -> TextCNN:
        """The network that learned from all rows."""
        out = TextCNN()
        rows = self.table.where(F.col("part") == FOLDS).select("piece", "weights").collect()
        out.weights = np.concatenate([np.frombuffer(r["weights"], np.float32) for r in sorted(rows, key=lambda r: r["piece"])])
        return out

    def held_out(self) -> tuple[np.ndarray, ...]:
        """``(languages, labels, scores, counts)`` of all rows, each scored by the network of its fold.

        The scores are rounded on the logistic scale, so a language has two times 15 361 counts at most.
        """
        counts = self.dealt.mapInArrow(_counted(self.folder, [part for part in self.shares if part < FOLDS]), "lang string, label int, step int")
        found = counts.groupBy("lang", "label", "step").agg(F.count("*").alias("n")).toArrow().sort_by([(c, "ascending") for c in ("lang", "label", "step")])
        lang, label, step, n = (found.column(c).to_numpy() for c in found.column_names)
        return lang, label, 1 / (1 + np.exp(-step / STEPS)), n


def _loss(labels: np.ndarray, scores: np.ndarray, counts: np.ndarray) -> float:
    return float(-(counts * np.log(np.where(labels == 1, scores, 1 - scores))).sum() / max(counts.sum(), 1))


def labelled_ids(labels: DataFrame, id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """``(id, label)``: an int for every id that has a label of exactly 0 or 1, as a number or as text; 1 if it has both."""
    label = F.col(label_col).cast("string").try_cast("double")
    marked = labels.select(F.col(id_col).alias("id"), label.alias("label")).where("id is not null and label in (0.0D, 1.0D)")
    return marked.groupBy("id").agg(F.max("label").cast("int").alias("label"))


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", most_toxic: int | None = None, most_clean: int | None = None, most_chars: int | None = None, epochs: int = EPOCHS) -> ToxicityModel:
    """Fit the classifier on all labelled rows of ``docs``.

    Every row is read whole in every pass, by the network and by all but one of
    the ``FOLDS`` networks that the thresholds come from: each of these learns without one part,
    and scores that part. Passes end after ``epochs``, or when a network has moved through ``ENOUGH`` rows and a further
    pass lowers the held-out loss by less than ``SETTLED``. There is a threshold for each
    language that the profiles of the labelled rows tell apart, drawn to the threshold of all rows together where a
    language has few toxic rows.

    Labels that are null or neither 0 nor 1, and those whose document or text is
    missing, are left out. An id with both labels counts as toxic; rows that
    repeat an id count once each. Empty texts are examples like others. Without
    labels of both classes, or without any, every score is 0.

    Only if the caller asks for it, a sample is used: of each class the ``most_toxic`` or
    ``most_clean`` labelled ids with the smallest hash, as far as their whole
    texts together have ``most_chars`` characters.
    """
    work = Workspace(docs.sparkSession, "toxicity")
    order = F.xxhash64(F.col("id"))
    marked = labelled_ids(labels, id_col, label_col)
    if most_toxic is not None or most_clean is not None:
        classes = [(marked.where(F.col("label") == label), most) for label, most in ((1, most_toxic), (0, most_clean))]
        marked = reduce(DataFrame.union, [rows if most is None else rows.orderBy(order, "id").limit(most) for rows, most in classes])
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("text is not null")
    marked = work.save(marked, "labels")
    if marked.count() <= MOST_BROADCAST:
        marked = F.broadcast(marked)
    rows = work.save(texts.join(marked, "id").withColumns({"fold": F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)), "place": order}), "rows")
    if most_chars is not None:
        rows = rows.where(_within(rows, most_chars))
    profiles = learn_profiles(rows)
    numbers = rows.groupBy("fold", "label").agg(F.count("*").alias("n"), F.sum(F.length("text").cast("long") + TEXT_CHARS).alias("chars")).collect()
    shards = max(1, -(-sum(r["chars"] for r in numbers) // SHARD_CHARS))
    shares = {}
    for part in range(FOLDS + 1):
        seen = [sum(r["n"] for r in numbers if r["fold"] != part and r["label"] == label) for label in (0, 1)]
        if min(seen) and (part == FOLDS or any(r["fold"] == part for r in numbers)):
            shares[part] = seen[1] / sum(seen)
    if FOLDS not in shares:
        work.keep()
        return ToxicityModel(None, profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, part in blocks(batch.column("text").to_pylist()):
                cut = batch.slice(start, len(part))
                langs = pa.array([profiles.identify(t)[0] for t in part], pa.string())
                slots = pa.array([f.tobytes() for f in features(part)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(cut.column(c) for c in names[:4]), langs, slots], names)

    names = ["id", "label", "fold", "shard", "lang", "slots"]
    kind = rows.schema["id"].dataType.simpleString()
    shard = F.pmod(F.xxhash64(F.lit("shard"), "id", F.xxhash64("text")), F.lit(shards)).alias("shard")
    # texts are exchanged, as they are smaller than their words' slots
    met = rows.select("id", "label", "fold", shard, "text").repartitionById(shards, F.col("shard").cast("int")).sortWithinPartitions("shard", "id", "label", "text")
    # each pass reads the shards from the executors' disks; a lost one is made again from the rows
    dealt = met.mapInArrow(run, f"id {kind}, label int, fold long, shard long, lang string, slots binary").persist(StorageLevel.DISK_ONLY)
    dealt.count()  # else the networks, which come to it at the same time, each make it
    networks, before = _Networks(work, dealt, shares, shards), None
    for turn in range(1, epochs + 1):
        networks.learn()
        if turn < epochs and turn * sum(r["n"] for r in numbers) < ENOUGH * shards:
            continue
        lang, label, scores, counts = networks.held_out()
        loss = _loss(label, scores, counts)
        if before is not None and before - loss < SETTLED:
            break
        before = loss
    network = networks.network()
    dealt.unpersist()
    work.keep()
    if len(set(label.tolist())) < 2:
        return ToxicityModel(network, profiles)
    pooled = best_threshold(scores, label, counts)
    return ToxicityModel(network, profiles, language_thresholds(scores, label, lang, pooled, counts=counts), pooled)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 if the score is 0.7 or more).

    Only the whole text is read. Null and empty texts get the score of a text
    without words. All rows and columns stay; a column named ``score`` or
    ``predicted`` is replaced.
    """
    scored = docs.withColumn("score", model.column(F.col(text_col)))
    return scored.withColumn("predicted", (F.col("score") >= CUT).cast("int"))
