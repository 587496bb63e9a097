"""Toxicity by class-conditional Kneser-Ney models (operator 3).

Each class, toxic and ordinary, has an interpolated Kneser-Ney model of the characters of words: its own counts at
the highest order, and below it one chain of continuation counts that the classes share, so that rare
expressions and unseen forms of a stem are smoothed alike and do not tell for either side. A document is described by
the difference of its two log-likelihoods, normalised by its length, over the whole text and over its most
toxic words; a logistic curve, fitted on documents that a model of the other half of them scored, makes a probability of it.

Labels may be fitted on at most MAX_TRAIN documents and MAX_BYTES of text, taken by a hash of the id where there are more, and on
at most MAX_GRAMS grams, the most frequent: so what is broadcast and the model have a bound whatever the texts are. Scoring is a map.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from heapq import nlargest

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.common import arrow_texts, crc_fold, slices, stored

ORDER, DISCOUNT, CACHE_WORDS = 8, 0.75, 300_000
#: The most that training reads and keeps: labelled documents, bytes of their texts, distinct grams. Scoring has no such bound.
MAX_TRAIN, MAX_BYTES, MAX_GRAMS = 20_000, 256 << 20, 250_000
EDGE = ".,;:!?\"'()[]{}<>*_-`~|/\\#$%&"
THRESHOLD = 0.3


def word_form(raw: str) -> str:
    """A word as it is modelled: lower case, punctuation at its edges off, between ^ and $."""
    w = raw.lower().strip(EDGE)
    return f"^{w}$" if w else ""


def grams_of(word: str, order: int = ORDER) -> list[str]:
    """The context of up to order - 1 characters, and the character, at each place after the ^."""
    return [word[max(0, i - order + 1) : i + 1] for i in range(1, len(word))]


@dataclass
class Model:
    """Difference of the classes' log-probabilities: of seen grams, and of any other character after a context. Without weights nothing was learnt."""

    seen: dict[str, float]
    after: dict[str, float]
    weights: tuple[float, ...] | None = None

    def word(self, word: str) -> float:
        seen, after = self.seen, self.after
        return sum(seen[g] if g in seen else after.get(g[:-1], 0.0) for g in grams_of(word))


class KneserNey:
    """Interpolated models of two classes over one chain of continuation counts. counts: (class 0 or 1, gram) to how often."""

    def __init__(self, counts: dict[tuple[int, str], int], discount: float = DISCOUNT):
        self.discount = discount
        self.of: tuple[dict[str, int], dict[str, int]] = ({}, {})
        for (c, g), n in counts.items():
            self.of[c][g] = self.of[c].get(g, 0) + n
        self.types = {g for d in self.of for g in d}
        # A gram's continuation count is in how many distinct characters to its left it, or a longer gram's end, is met, over both classes.
        ends, level = set(self.types), self.types
        while level := {g[1:] for g in level if len(g) > 1}:
            ends |= level
        self.left = Counter(g[1:] for g in ends if len(g) > 1)
        self.left_total, self.left_kinds = defaultdict(int), defaultdict(int)
        for g, n in self.left.items():
            self.left_total[g[:-1]] += n
            self.left_kinds[g[:-1]] += 1
        self.total, self.kinds = (defaultdict(int), defaultdict(int)), (defaultdict(int), defaultdict(int))
        for c in (0, 1):
            for g, n in self.of[c].items():
                self.total[c][g[:-1]] += n
                self.kinds[c][g[:-1]] += 1
        self.memo: dict[str, float] = {}
        for g in sorted(self.left, key=len):  # shorter ones first, so that none goes down further than one step
            self.shared(g)

    def shared(self, gram: str) -> float:
        """The backoff probability of gram's last character after the others; the alphabet has one place for characters never met."""
        got = self.memo.get(gram)
        if got is None:
            context, d = gram[:-1], self.discount
            low = self.shared(gram[1:]) if context else 1.0 / (self.left_kinds.get("", 0) + 1)
            n = self.left_total.get(context, 0)
            got = low if not n else (max(self.left.get(gram, 0) - d, 0) + d * self.left_kinds[context] * low) / n
            self.memo[gram] = got
        return got

    def backoff(self, c: int, context: str) -> float:
        """What class c leaves for the shared chain after a context."""
        n = self.total[c].get(context, 0)
        return self.discount * self.kinds[c][context] / n if n else 1.0

    def probability(self, c: int, gram: str) -> float:
        context = gram[:-1]
        low = self.shared(gram[1:]) if context else self.shared(gram)
        n = self.total[c].get(context, 0)
        return (max(self.of[c].get(gram, 0) - self.discount, 0) / n if n else 0.0) + self.backoff(c, context) * low


def train(counts: dict[tuple[int, str], int], discount: float = DISCOUNT) -> Model:
    """counts: (class 0 or 1, gram) to how often."""
    kn = KneserNey(counts, discount)
    seen = {g: math.log(kn.probability(1, g) / kn.probability(0, g)) for g in kn.types}
    return Model(seen, {h: math.log(kn.backoff(1, h) / kn.backoff(0, h)) for h in {g[:-1] for g in kn.types}})


def features(model: Model, words: list[str], cache: dict[str, float]) -> tuple[float, float, float]:
    """Of a text's words: the length-normalised difference of the log-likelihoods, then the largest and second largest of its distinct words (0 where there is none)."""
    if not words:
        return 0.0, 0.0, 0.0
    different = set(words)
    for w in different:
        if w not in cache:
            form = word_form(w)
            cache[w] = model.word(form) if form else 0.0
    top = nlargest(2, map(cache.__getitem__, different))
    return sum(map(cache.__getitem__, words)) / len(words), top[0], top[1] if len(top) > 1 else 0.0


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> tuple[float, ...]:
    """Weights of a logistic regression, the constant first, by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return tuple(float(v) for v in w)


def probability(weights: tuple[float, ...] | None, f: tuple[float, ...]) -> float:
    """The curve's value; 0 without weights: what could not be learnt convicts no text."""
    if weights is None:
        return 0.0
    z = weights[0] + sum(w * x for w, x in zip(weights[1:], f, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN, most_bytes: int = MAX_BYTES) -> DataFrame:
    """doc_id, text, toxic and half of the labelled documents outside fold 2 of 4, at most about `most` of them.

    A document labelled twice counts as toxic if any label says so; null labels and ids are passed over. Of these, in order of
    a hash of the id, those up to most_bytes of text in all are taken. The rows are written once, as they are read twice.
    """
    known = labels.where("doc_id is not null and toxic is not null").where(crc_fold("doc_id", 4) != 2)
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = known.count()
    share = min(1.0, most / n) if n else 1.0
    mix = F.pmod(F.xxhash64("doc_id", F.lit("train")), F.lit(1 << 30))
    few = known.where(mix < F.lit(int(share * (1 << 30)))).withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2)).cast("int"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = F.octet_length("text")
    rows = stored(texts.where(size <= most_bytes).join(F.broadcast(few), "doc_id"), "toxicity-training")
    whole = rows.agg(F.sum(size)).first()[0] or 0
    return rows if whole <= most_bytes else rows.where(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1 << 30)) < F.lit(int(most_bytes / whole * (1 << 30))))


def gram_counts(rows: DataFrame, most: int = MAX_GRAMS) -> dict[int, dict[tuple[int, str], int]]:
    """half to ((class, gram) to how often). Counted where the texts are read, added up by Spark; of more than `most`, the most frequent."""
    schema = pa.schema([("half", pa.int32()), ("toxic", pa.int32()), ("gram", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], dict[str, int]] = defaultdict(lambda: defaultdict(int))
        for b in batches:
            for half, toxic, text in zip(b.column("half").to_pylist(), b.column("toxic").to_pylist(), arrow_texts(b.column("text")), strict=True):
                words = held[half, int(bool(toxic))]
                for w in text.split():
                    words[w] += 1
        for (half, toxic), words in held.items():
            got: dict[str, int] = defaultdict(int)
            for w, n in words.items():
                for g in grams_of(word_form(w)):
                    got[g] += n
            yield pa.RecordBatch.from_arrays([pa.array([half] * len(got), pa.int32()), pa.array([toxic] * len(got), pa.int32()), pa.array(list(got)), pa.array(list(got.values()), pa.int64())], schema=schema)

    counted = rows.select("half", "toxic", "text").mapInArrow(run, "half int, toxic int, gram string, n long").groupBy("half", "toxic", "gram").agg(F.sum("n").alias("n"))
    out: dict[int, dict] = {0: {}, 1: {}}
    t = counted.orderBy(F.desc("n"), "gram", "half", "toxic").limit(most).toArrow()
    for half, toxic, g, n in zip(*(t.column(c).to_pylist() for c in ("half", "toxic", "gram", "n")), strict=True):
        out[half][toxic, g] = n
    return out


def fit(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """The model of all training rows, with the curve fitted on rows that the other half's model scored.

    Where the training rows do not have both classes, there is nothing to compare: the model then scores every text 0.
    """
    rows = training_rows(docs, labels, most)
    if rows.select("toxic").distinct().count() < 2:
        return Model({}, {})
    halves = gram_counts(rows)
    models = {h: train(halves[1 - h]) for h in (0, 1)}
    shared = docs.sparkSession.sparkContext.broadcast(models)
    del models
    schema = pa.schema([("toxic", pa.int32()), ("f0", pa.float64()), ("f1", pa.float64()), ("f2", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models, caches = shared.value, ({}, {})
        for b in batches:
            got = [(t, *features(models[h], text.split(), caches[h])) for h, t, text in zip(b.column("half").to_pylist(), b.column("toxic").to_pylist(), arrow_texts(b.column("text")), strict=True)]
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*got, strict=True), schema.types, strict=True)], schema=schema)

    t = rows.select("half", "toxic", "text").mapInArrow(run, "toxic int, f0 double, f1 double, f2 double").toArrow()
    y = t.column("toxic").to_numpy().astype(float)
    x = np.stack([t.column(c).to_numpy() for c in ("f0", "f1", "f2")], 1)
    shared.destroy()
    whole = halves.pop(0)
    for k, n in halves.pop(1).items():
        whole[k] = whole.get(k, 0) + n
    model = train(whole)
    model.weights = logistic(x, y)
    return model


def scored(docs: DataFrame, model: Model, held_fold: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted and llr (the length-normalised difference) of every row.

    The score depends on the text alone. Null and empty texts have no words and get the score of a
    difference of 0; a model that learnt nothing scores 0 throughout; repeated rows are scored alike; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32()), ("llr", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for whole in batches:
            for b in slices(whole, "text"):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                f = [features(model, text.split(), cache) for text in arrow_texts(b.column("text"))]
                p = [probability(model.weights, x) for x in f]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array([int(v >= threshold) for v in p], pa.int32()), pa.array([x[0] for x in f], pa.float64())], schema=schema)

    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_fold("doc_id", 4) == held_fold).alias("held_out"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int, llr double")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, with their own columns, whose score is below threshold."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, cache = shared.value, {}
        for whole in batches:
            at = whole.schema.get_field_index("text")
            for b in slices(whole, whole.column(at)):
                if len(cache) > CACHE_WORDS:
                    cache.clear()
                keep = [probability(model.weights, features(model, text.split(), cache)) < threshold for text in arrow_texts(b.column(at))]
                yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
