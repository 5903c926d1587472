"""Quality classifier: supervised subword embeddings (operator 5).

Every word gives hashed features: the word, its character n-grams, its shape, and
the pair with the word before (a repeated word gives one shared feature); words
of any length give all of them.  A document is the mean of its features' learned vectors; softmax over two classes.
Vectors and output layer are trained together by numpy stochastic gradient
descent on a bounded sample of labelled rows.

After training a document's score only needs one number per feature (its vector
times the output layer), so scoring is a table lookup summed per distinct word.

Only ``text`` enters a score.  Null and empty texts have no features and get the
score of the bias.  Labels that are null or neither 0 nor 1, labels without a
document and documents with contradicting labels are not trained on.  With no
usable label of one of the classes every score is 0.5.  Extra columns are ignored.
"""

from __future__ import annotations

import tempfile
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, read_table, release, slices, stored, text_or_empty
from .registry import register


@dataclass(frozen=True)
class Settings:
    """``sample_docs`` bounds the labelled rows that training sees (half per class where there
    are enough); each counts with all features of its whole text."""

    buckets: int = 1 << 17
    dim: int = 16
    char_grams: tuple[int, ...] = (3, 4)
    sample_docs: int = 4000
    epochs: int = 6
    least_steps: int = 400
    rate: float = 0.25
    batch: int = 16
    seed: int = 11


def _hash(data: str) -> int:
    return zlib.crc32(data.encode())


def word_shape(word: str) -> str:
    """Runs of upper case, lower case, digits and each other sign: "ABC!!" is "A!"."""
    out = []
    for c in word:
        kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c
        if not out or out[-1] != kind:
            out.append(kind)
    return "".join(out)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_CRC = _crc_table()
#: Words up to this length are hashed gram by gram, longer ones by array; the buckets are the same.
SHORT_WORD = 60
#: Character n-grams that are hashed at once (memory bound for words of any length).
GRAM_BLOCK = 1 << 18


def long_grams(marked: str, n: int, buckets: int) -> Iterator[np.ndarray]:
    """Buckets of all character n-grams of ``marked``, in blocks: ``_hash`` of each, all of a block at once."""
    for at in range(0, len(marked) - n + 1, GRAM_BLOCK):
        data = np.frombuffer(marked[at:at + GRAM_BLOCK + n - 1].encode(), np.uint8)
        ends = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))  # characters start where no UTF-8 byte continues
        low, high = ends[:-n], ends[n:]
        crc = np.full(len(low), 0xFFFFFFFF, np.uint32)
        for k in range(int((high - low).max())):
            seen = data[np.minimum(low + k, len(data) - 1)]
            crc = np.where(low + k < high, _CRC[(crc ^ seen) & 0xFF] ^ (crc >> np.uint32(8)), crc)
        yield ((crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int32)


def word_features(word: str, s: Settings) -> Iterator[list[int] | np.ndarray]:
    """Feature buckets of one word in blocks: itself, its shape and its character n-grams."""
    marked = f"<{word}>"
    own = [_hash("w" + marked) % s.buckets, _hash("s" + word_shape(word)) % s.buckets]
    if len(word) <= SHORT_WORD:
        yield own + [_hash(marked[i:i + n]) % s.buckets for n in s.char_grams for i in range(len(marked) - n + 1)]
        return
    yield own
    for n in s.char_grams:
        yield from long_grams(marked, n, s.buckets)


class WordTable:
    """Numbers words as they come, with a hash for pairs; starts anew when it grows too large."""

    LIMIT = 400_000
    #: Most characters of the words of more than SHORT_WORD characters.
    LONG_CHARS = 8_000_000

    def __init__(self, settings: Settings, weights: np.ndarray | None = None):
        self.s, self.weights = settings, weights
        self.reset()

    def reset(self) -> None:
        self.index: dict[str, int] = {}
        self.long_chars = 0
        self.hashes, self.sums, self.sizes = array("Q"), array("d"), array("q")
        #: Buckets of all words one after the other, four bytes each, and the place of each word's first.
        self.features, self.starts = array("i"), array("q")

    def add(self, word: str) -> int:
        self.hashes.append(_hash("p" + word))
        if self.weights is None:
            self.starts.append(len(self.features))
            for block in word_features(word, self.s):
                self.features.frombytes(np.asarray(block, np.int32).tobytes())
            self.sizes.append(len(self.features) - self.starts[-1])
        else:
            total, size = 0.0, 0
            for block in word_features(word, self.s):
                total += float(self.weights[block].sum())
                size += len(block)
            self.sums.append(total)
            self.sizes.append(size)
        if len(word) > SHORT_WORD:
            self.long_chars += len(word)
        k = self.index[word] = len(self.index)
        return k

    def make_room(self) -> None:
        if len(self.index) > self.LIMIT or self.long_chars > self.LONG_CHARS:
            self.reset()

    def ids(self, words: list[str]) -> np.ndarray:
        known, add = self.index, self.add
        return np.array([known[w] if w in known else add(w) for w in words], dtype=np.int64)

    def pairs(self, ids: np.ndarray) -> np.ndarray:
        """Buckets of consecutive words; a word that repeats the one before gives bucket 0."""
        h = np.frombuffer(self.hashes, dtype=np.uint64)
        a, b = h[ids[:-1]], h[ids[1:]]
        mixed = (a * np.uint64(0x9E3779B97F4A7C15)) ^ (b * np.uint64(0xC2B2AE3D27D4EB4F))
        bucket = (mixed >> np.uint64(29)) % np.uint64(self.s.buckets)
        return np.where(ids[:-1] == ids[1:], np.uint64(0), bucket).astype(np.int64)


def document_features(text: str, table: WordTable) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature buckets of a whole text and how often each occurs."""
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    table.make_room()
    ids = table.ids(words)
    distinct, times = np.unique(ids, return_counts=True)
    starts, sizes = (np.frombuffer(x, np.int64)[distinct] for x in (table.starts, table.sizes))
    every = np.frombuffer(table.features, np.int32)
    own = np.concatenate([every[lo:lo + n] for lo, n in zip(starts.tolist(), sizes.tolist())])
    weight = np.repeat(times, sizes)
    pairs = table.pairs(ids)
    bags, inverse = np.unique(np.concatenate([own, pairs]), return_inverse=True)
    return bags, np.bincount(inverse, np.concatenate([weight, np.ones(len(pairs))])).astype(np.int64)


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Stochastic gradient descent; returns one weight per feature and the bias of class 1 over class 0."""
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-1.0 / s.dim, 1.0 / s.dim, (s.buckets, s.dim)).astype(np.float32)
    out = np.zeros((s.dim, 2), np.float32)
    out[:] = rng.normal(0, 0.1, out.shape)
    bias = np.zeros(2, np.float32)
    n = len(bags)
    epochs = max(s.epochs, -(-s.least_steps // -(-n // s.batch)))  # a small sample is gone over more often
    steps, step = epochs * -(-n // s.batch), 0
    for _ in range(epochs):
        order = rng.permutation(n)
        for at in range(0, n, s.batch):
            rows = order[at:at + s.batch]
            rate = s.rate * (1 - step / steps) + 1e-4
            step += 1
            sizes = [len(bags[r][0]) for r in rows]
            features = np.concatenate([bags[r][0] for r in rows])
            share = np.concatenate([bags[r][1] / max(1, bags[r][1].sum()) for r in rows]).astype(np.float32)
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            weighted = vectors[features] * share[:, None]
            hidden = np.zeros((len(rows), s.dim), np.float32)
            full = np.array(sizes) > 0
            if full.any():
                hidden[full] = np.add.reduceat(weighted, starts[full])
            logits = hidden @ out + bias
            logits -= logits.max(1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), labels[rows]] -= 1.0  # gradient of the loss
            to_hidden = p @ out.T
            out -= rate * hidden.T @ p
            bias -= rate * p.sum(0) * 0.1
            # The mean makes each feature's share tiny; the features' step is scaled by the mean size.
            scale = np.minimum(np.repeat(np.array(sizes, np.float32), sizes) * share, 4.0)
            for k, (lo, size) in enumerate(zip(starts.tolist(), sizes)):  # a bag's features are distinct
                vectors[features[lo:lo + size]] -= rate * to_hidden[k] * scale[lo:lo + size, None]
    return (vectors @ (out[:, 1] - out[:, 0])).astype(np.float64), float(bias[1] - bias[0])


def fold_of(doc_id) -> F.Column:
    """crc32 of the id as text, modulo 3; a null id is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 3


def training_bags(docs: DataFrame, labels: DataFrame, s: Settings) -> tuple[list, np.ndarray]:
    """Features of the bounded sample: rows of the training folds with the smallest id hashes per class."""
    usable = (labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold_of(F.col("doc_id")) != 1))
              .groupBy("doc_id").agg(F.min("quality").alias("label"), F.max("quality").alias("other"))
              .filter(F.col("label") == F.col("other")).select("doc_id", "label"))
    half = s.sample_docs // 2
    drawn = [usable.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(half) for k in (0, 1)]
    sample = F.broadcast(drawn[0].unionByName(drawn[1]))  # at most sample_docs narrow rows

    def bags(batches):
        release()
        table = WordTable(s)
        for batch in slices(batches):
            found = [document_features(text, table) for text in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f.astype("<i4").tobytes() for f, _ in found], pa.binary()),
                 pa.array([t.astype("<i4").tobytes() for _, t in found], pa.binary())], ["doc_id", "label", "features", "times"])

    texts = docs.select("doc_id", text_or_empty().alias("text")).join(sample, "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label"), "text")
    # One row per document before anything is collected; an id may hold many rows, so they are reduced map-side.
    texts = texts.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("order"), "text")).alias("one")).select(
        "doc_id", "label", F.col("one.text").alias("text"))
    rows = stored(texts.mapInArrow(bags, "doc_id long, label int, features binary, times binary"), "quality-bags")
    # Whole texts may have many features: they go to a file of the driver's, part by part, and are mapped from there.
    places, at = [], 0
    with tempfile.TemporaryFile() as file:
        for r in rows.toLocalIterator():
            features, times = bytes(r["features"]), bytes(r["times"])
            file.write(features + times)
            places.append((r["doc_id"], r["label"], at, len(features) // 4))
            at += len(features) + len(times)
        file.flush()
        values = np.memmap(file, "<i4", "r") if at else np.zeros(0, "<i4")
    places.sort()
    bags_of = [(values[lo // 4:lo // 4 + n], values[lo // 4 + n:lo // 4 + 2 * n]) for _, _, lo, n in places]
    return bags_of, np.array([p[1] for p in places], np.int64)


def train_quality(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> tuple[np.ndarray, float]:
    bags, y = training_bags(docs, labels, s)
    if len(set(y.tolist())) < 2:
        return np.zeros(s.buckets), 0.0
    return train(bags, y, s)


def with_score(docs: DataFrame, model: tuple[np.ndarray, float], s: Settings = Settings(), text: str = "text",
               score: str = "score") -> DataFrame:
    """``docs`` plus a double column ``score``: the probability of class 1 for each row's whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # one number per feature bucket

    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release()
        weights, bias = shared.value
        table = WordTable(s, weights)
        for batch in batches:
            out = [np.zeros(0)]
            for at in range(0, len(batch), SLICE_ROWS):
                table.make_room()
                out.append(_scores(batch.iloc[at:at + SLICE_ROWS].tolist(), table, weights, bias))
            yield pd.Series(np.concatenate(out), dtype="float64")

    return docs.withColumn(score, F.pandas_udf(probability, "double")(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def _scores(texts: list[str], table: WordTable, weights: np.ndarray, bias: float) -> np.ndarray:
    """Scores of a batch: word sums by table, pairs by bucket, all documents of the batch at once."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    ids = table.ids([x for w in words for x in w])
    if not len(ids):
        return np.full(len(texts), 1 / (1 + np.exp(-bias)))
    sums, count = np.frombuffer(table.sums), np.frombuffer(table.sizes, dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), sizes)
    total = np.bincount(doc, sums[ids], len(texts))
    number = np.bincount(doc, count[ids], len(texts))
    pair = weights[table.pairs(ids)]
    inside = doc[:-1] == doc[1:]
    total += np.bincount(doc[1:][inside], pair[inside], len(texts))
    number = number + np.maximum(sizes - 1, 0)
    return 1 / (1 + np.exp(-(total / np.maximum(number, 1) + bias)))


def quality_scores(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = train_quality(docs, labels, s)
    scored = with_score(docs.select("doc_id", "text"), model, s)
    return scored.select("doc_id", (fold_of(F.col("doc_id")) == 1).alias("held_out"), "score",
                         (F.col("score") >= 0.5).cast("int").alias("predicted"))


@register("op5_quality_classifier")
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
