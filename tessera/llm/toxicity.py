"""Operator 6: toxicity by multiple-instance learning.

A document is a bag of sentences; only documents have labels. A sentence's score is logistic in hashed features of its
words, a document's score is the noisy-or of its sentences' (it's toxic unless no sentence is). Trained on the noisy-or
itself, the model also says which sentences offend.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Batches, lean, shuffles_removed, small_batches, table

#: Hashed features; labelled documents that training gets at most (half of them toxic, if there are so many), and the
#: characters of text that these may have together. The sample is a documented bound; scoring covers every document.
FEATURES, SAMPLE_DOCS, SAMPLE_CHARS = 1 << 18, 6000, 40_000_000
ROUNDS, RATE, DECAY, SEED, LEAST_DOCS = 12, 0.4, 1e-4, 5, 5
#: Words that a worker remembers the weight of; then it starts anew.
REMEMBERED = 500_000
#: Sentences of more words are cut, so that one long line isn't one instance.
MOST_WORDS = 60

SENTENCES = re.compile(r"[.!?\n]+").split
WORDS = re.compile(r"\w+").findall


def features(word: str) -> list[int]:
    """A word's hashed features: itself and its first 3, 4, 5 and 6 characters."""
    keys = [f"w{word}", *(f"p{word[:n]}" for n in (3, 4, 5, 6) if len(word) > n or n == 3)]
    return [xxhash.xxh32_intdigest(k.encode("utf-8", "surrogatepass")) % FEATURES for k in keys]


def sentences(text: str) -> list[list[str]]:
    """Sentences as lower-case words, without empty ones; long ones in runs of MOST_WORDS."""
    found = (WORDS(s) for s in SENTENCES(text.lower()))
    return [w[i : i + MOST_WORDS] for w in found for i in range(0, len(w), MOST_WORDS)]


def noisy_or(logits: np.ndarray) -> float:
    """1 - prod(1 - sigmoid(x)); 0 for no sentences."""
    return float(-np.expm1(-np.logaddexp(0, logits).sum()))


class Model:
    """weights of the features and one bias."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.words = weights, bias, {}

    def word(self, w: str) -> float:
        found = self.words.get(w)
        if found is None:
            if len(self.words) > REMEMBERED:
                self.words.clear()
            found = self.words[w] = float(self.weights[features(w)].sum())
        return found

    def logits(self, text: str) -> np.ndarray:
        known, word = self.words.get, self.word
        sums = []
        for s in sentences(text):
            total = self.bias
            for w in s:
                x = known(w)
                total += word(w) if x is None else x
            sums.append(total)
        return np.array(sums)

    def score(self, text: str) -> float:
        return noisy_or(self.logits(text))


@dataclass
class Bag:
    """A text for training: features of its distinct words, one after another from each word's start on, and for each
    word in the text its place among these and its sentence."""

    features: np.ndarray
    starts: np.ndarray
    place: np.ndarray
    at: np.ndarray
    size: int

    def __post_init__(self):
        self.used, self.number = np.unique(self.features, return_inverse=True)
        self.number = self.number.astype(np.int32)

    @classmethod
    def of(cls, text: str) -> Bag:
        own, known, flat, starts, place, at = sentences(text), {}, [], [], [], []
        for k, s in enumerate(own):
            for w in s:
                if w not in known:
                    known[w] = len(known)
                    starts.append(len(flat))
                    flat += features(w)
                place.append(known[w])
                at.append(k)
        return cls(*(np.array(x, np.int32) for x in (flat, starts, place, at)), len(own))

    def packed(self) -> bytes:
        parts = (self.features, self.starts, self.place, self.at)
        return zlib.compress(np.concatenate([np.array([self.size, *map(len, parts)], np.int32), *parts]).tobytes())

    @classmethod
    def unpacked(cls, data: bytes) -> Bag:
        size, *lengths = (flat := np.frombuffer(zlib.decompress(data), np.int32))[:5].tolist()
        return cls(*np.split(flat[5:], np.cumsum(lengths)[:-1]), size)

    def without(self, ok: np.ndarray) -> Bag:
        """Only features that are ok, by number; the words stay."""
        kept = ok[self.features]
        return Bag(self.features[kept], np.concatenate([[0], np.cumsum(kept)])[self.starts].astype(np.int32), self.place, self.at, self.size)

    def sums(self, weights: np.ndarray) -> np.ndarray:
        """Each sentence's sum of weights."""
        upto = np.concatenate([[0.0], np.cumsum(weights[self.features])])
        word = upto[np.append(self.starts[1:], len(self.features))] - upto[self.starts]
        return np.bincount(self.at, word[self.place], minlength=self.size)

    def spread(self, d: np.ndarray) -> np.ndarray:
        """The transpose of sums(): for each place in features what its sentences' values d add up to."""
        word = np.bincount(self.place, d[self.at], minlength=len(self.starts))
        return np.repeat(word, np.diff(np.append(self.starts, len(self.features))))


def slopes(x: np.ndarray, toxic: int) -> np.ndarray:
    """Derivative of a document's log loss by its sentences' logits x.

    With p the noisy-or and s the sentences' scores it is s * (1 - toxic / p): a clean document pushes every sentence
    down, a toxic one its likeliest ones up.
    """
    s = 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    return s * (1 - toxic / min(max(noisy_or(x), 1e-9), 1 - 1e-9))


def train(docs: list[Bag], toxic: list[int]) -> Model:
    """Adagrad on the log loss of the noisy-or, a document a step, in a fixed random order.

    Weights stay at 0 or above, so that harmless words around an offending one can't make up for it.
    Features in fewer than LEAST_DOCS documents keep weight 0: by them the labels could be learned by heart.
    """
    seen = np.zeros(FEATURES, np.int32)
    for d in docs:
        seen[d.used] += 1
    docs = [d.without(seen >= LEAST_DOCS) for d in docs]
    w, g2 = np.zeros(FEATURES), np.full(FEATURES, 1e-1)
    bias, bias2 = -4.0, 1e-1
    order = np.random.default_rng(SEED)
    for _ in range(ROUNDS):
        for k in order.permutation(len(docs)):
            own = docs[k]
            if not own.size:
                continue
            d = slopes(own.sums(w) + bias, toxic[k])
            used = own.used
            g = np.bincount(own.number, own.spread(d), minlength=len(used)) + DECAY * w[used]
            g2[used] += g * g
            w[used] = np.maximum(w[used] - RATE * g / np.sqrt(g2[used]), 0)
            b = d.sum()
            bias2 += b * b
            bias -= 0.3 * RATE * b / np.sqrt(bias2)
    return Model(w, bias)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: crc32 of the id as text is a multiple of 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def sample(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(place, toxic, bag) of the texts to train on: at most SAMPLE_DOCS / 2 a class, chosen by a hash of the id, none
    held out, of at most SAMPLE_CHARS together; a text that doesn't fit any more is passed over for the next ones.

    An id with labels of both kinds counts as toxic; of rows with one id one text serves, the least.
    """
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    order = F.xxhash64("doc_id", F.lit(SEED))
    parts = [known.where(F.col("toxic") == y).orderBy(order, "doc_id").limit(SAMPLE_DOCS // 2) for y in (1, 0)]
    chosen = F.broadcast(parts[0].unionByName(parts[1]))  # at most SAMPLE_DOCS rows of two numbers
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).join(chosen, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    # the driver gets at most SAMPLE_DOCS rows of two numbers
    sizes = rows.select("doc_id", F.length("text").alias("n")).orderBy(order, "doc_id").collect()
    fits, held = [], 0
    for r in sizes:
        if held + r.n <= SAMPLE_CHARS:
            fits.append((r.doc_id, len(fits)))
            held += r.n
    places = F.broadcast(spark.createDataFrame(fits, "doc_id long, place int"))

    def bags(batches: Batches) -> Batches:
        for b in batches:
            made = [Bag.of(t).packed() for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(made, pa.binary())], names=["place", "toxic", "bag"])

    return rows.join(places, "doc_id").select("place", "toxic", "text").mapInArrow(lean(bags), "place int, toxic int, bag binary")


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of labels (doc_id, toxic) over docs (doc_id, text); without labels one that scores by its bias alone.

    Texts become bags in tasks; one task trains on the sample, whose size is bounded, and gives the weights. Neither
    texts nor bags pass through the driver.
    """
    small_batches(docs.sparkSession)

    def trained(batches: Batches) -> Batches:
        rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
        model = train([Bag.unpacked(x) for _, _, x in rows], [y for _, y, _ in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype("f4").tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], names=["weights", "bias"])

    with shuffles_removed(docs.sparkSession):
        found = sample(docs, labels).repartition(1).sortWithinPartitions("place").mapInArrow(lean(trained), "weights binary, bias double").collect()
    # a task without rows gives no model
    return Model(np.frombuffer(found[0].weights, "f4").astype(float), found[0].bias) if found else Model(np.zeros(FEATURES), -4.0)


def scorer(model: Model) -> Callable[[DataFrame], Column]:
    weights, bias = zlib.compress(model.weights.astype("f4").tobytes()), model.bias
    loaded: list[Model] = []

    @F.pandas_udf("double")
    def score(text: pd.Series) -> pd.Series:
        if not loaded:
            loaded.append(Model(np.frombuffer(zlib.decompress(weights), "f4").astype(float), bias))
        return text.map(lambda t: loaded[0].score(t or "")).astype(float)

    return score


def scored(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """docs with a column of that name, the score (0 to 1) of text; null and empty texts score 0.

    Rows keep their partitions and all other columns; one of this name would be replaced, so take a free name for such
    tables. Very long texts are scored whole, sentence by sentence. An empty table stays empty.
    """
    small_batches(docs.sparkSession)
    return docs.withColumn(name, scorer(model)(F.col("text")))


def offending(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, sentence, text, score): the sentences whose own score reaches least, numbered from 0."""
    small_batches(docs.sparkSession)
    weights, bias = model.weights, model.bias

    def run(batches: Batches) -> Batches:
        own = Model(weights, bias)
        for b in batches:
            rows = []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                p = 1 / (1 + np.exp(-own.logits(t or "")))
                said = sentences(t or "")
                rows += [(i, int(k), " ".join(said[k]), float(p[k])) for k in np.flatnonzero(p >= least)]
            cols = list(zip(*rows, strict=True)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.float64())], names=["doc_id", "sentence", "text", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, sentence int, text string, score double")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = scored(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
