"""Best-fit packing by length patterns and non-negative least squares (operator 2).

1. Documents become pieces of at most ``capacity`` tokens (Arrow tasks; narrow rows).
2. The histogram of piece lengths, at most ``capacity`` rows, goes to the driver.
3. The driver enumerates few-document patterns that fill a sequence exactly, fits
   their repeat counts to the histogram by non-negative least squares, rounds them
   within what the histogram holds, and packs the residual lengths best-fit
   decreasing.  All of it works on counts per length, so its cost depends on
   ``capacity`` and never on the number of documents.
4. A piece's place follows from its length and its rank among equal lengths:
   rank = pieces of that length in earlier blocks (a window over block totals)
   + its number within its block.  No task sees all pieces of a hot length.

Null and empty texts are one piece holding the end id.  Null ids are packed like
any other row, repeated rows as often as they occur.  An empty table packs into
nothing.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored, text_or_empty
from .registry import register
from .tokens import END_ID, WORD_VOCABULARY, encoder, vocabulary_path

CAPACITY = 2048
#: Iterations of the least-squares fit, and patterns kept for the second, sparse fit per distinct length.
FIT_STEPS, KEPT_PER_LENGTH = 200, 2

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, block int, nth long"


def document_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int = END_ID) -> DataFrame:
    """Pieces of every document; ``nth`` numbers a block's pieces of one length from 0."""

    def pieces(batches):
        from collections import Counter

        from pyspark import TaskContext
        block, seen, enc = TaskContext.get().partitionId(), Counter(), encoder(vocabulary).encode
        end, step = np.array([end_id], "<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = enc(text) + end
                for k, at in enumerate(range(0, len(ids), step)):
                    part = ids[at:at + step]
                    size = len(part) // 4
                    rows.append((doc, k, at // 4, size, zlib.crc32(part), block, seen[size]))
                    seen[size] += 1
            columns = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)],
                                             ["doc_id", "piece", "start", "length", "ids_crc32", "block", "nth"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(pieces, PIECES)


def length_patterns(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of 1 to 3 lengths (0: none) that occur and sum to ``capacity``, longest first."""
    has = np.zeros(capacity + 1, bool)
    has[lengths] = True
    found = [np.array([[capacity, 0, 0]])] if has[capacity] else []
    a = np.flatnonzero(has[:capacity])
    pair = a[(2 * a >= capacity) & has[capacity - a]]
    found.append(np.stack([pair, capacity - pair, np.zeros_like(pair)], 1))
    for longest in a[3 * a >= capacity]:
        rest = capacity - longest
        second = a[(a <= longest) & (2 * a >= rest) & (a < rest)]
        second = second[has[rest - second]]
        found.append(np.stack([np.full_like(second, longest), second, rest - second], 1))
    return np.concatenate(found).astype(np.int64) if found else np.zeros((0, 3), np.int64)


def fit_repeats(patterns: np.ndarray, counts: np.ndarray, steps: int = FIT_STEPS) -> np.ndarray:
    """Non-negative least squares of pattern repeats against the histogram, by multiplicative updates.

    Long lengths weigh more: what stays over of them costs whole sequences, while
    short ones still fill gaps.
    """
    size = len(counts)
    weight = np.linspace(0.1, 1.0, size)
    weight[0] = 0.0  # column 0 stands for "no document"
    flat = patterns.ravel()
    gather = lambda v: v[patterns].sum(1)
    x = np.full(len(patterns), counts.sum() / max(1, 2 * len(patterns)), float)
    target = gather(weight * counts) + 1e-12
    for _ in range(steps):
        covered = np.bincount(flat, np.repeat(x, 3), minlength=size)
        x *= target / (gather(weight * covered) + 1e-12)
    return x


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: (lengths of one sequence, number of such sequences)."""
    space: list[dict[tuple[int, ...], int]] = [{} for _ in range(capacity + 1)]
    for length in np.flatnonzero(left)[::-1].tolist():
        todo, room = int(left[length]), length
        while todo:
            while room <= capacity and not space[room]:
                room += 1
            if room > capacity:  # nothing open has room: new sequences, each as full of this length as fits
                each = capacity // length
                full, over = divmod(todo, each)
                for copies, number in ((each, full), (over, 1 if over else 0)):
                    if number:
                        key = (length,) * copies
                        rest = space[capacity - length * copies]
                        rest[key] = rest.get(key, 0) + number
                break
            pattern, number = space[room].popitem()
            used = min(number, todo)
            if used < number:
                space[room][pattern] = number - used
            rest, key = space[room - length], pattern + (length,)
            rest[key] = rest.get(key, 0) + used
            todo -= used
    return [(pattern, number) for group in space for pattern, number in group.items()]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """The packing plan: sequences as (lengths, repeats) that use up the histogram exactly."""
    counts = np.zeros(capacity + 1)
    for length, number in histogram.items():
        counts[length] = number
    left, plan = counts.astype(np.int64), []
    patterns = length_patterns(np.flatnonzero(left), capacity)
    if len(patterns):
        x = fit_repeats(patterns, counts)
        kept = np.argsort(-x, kind="stable")[:KEPT_PER_LENGTH * int((left > 0).sum())]
        patterns = patterns[kept]
        x = fit_repeats(patterns, counts)
        for k in np.argsort(-x, kind="stable").tolist():
            repeats = int(np.rint(x[k]))
            if repeats < 1:
                break
            used, each = np.unique(patterns[k][patterns[k] > 0], return_counts=True)
            repeats = min(repeats, int((left[used] // each).min()))
            if repeats:
                left[used] -= repeats * each
                plan.append((tuple(patterns[k][patterns[k] > 0].tolist()), repeats))
    return plan + best_fit(left, capacity)


def plan_slots(plan: list[tuple[tuple[int, ...], int]]) -> tuple[np.ndarray, ...]:
    """Runs of places per length: length, first rank, first sequence, offset; sorted by length and rank."""
    runs, taken, sequence = [], {}, 0
    for pattern, repeats in plan:
        offset = 0
        for length in pattern:
            runs.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + repeats
            offset += length
        sequence += repeats
    table = np.array(runs, dtype=np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return tuple(np.ascontiguousarray(table[:, k]) for k in range(4))


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of ``docs``."""
    spark = docs.sparkSession
    pieces = stored(document_pieces(docs, vocabulary, capacity), "pieces")
    per_block = stored(pieces.groupBy("block", "length").agg(F.count(F.lit(1)).alias("number")), "piece-counts")
    histogram = {r["length"]: r["number"] for r in  # at most ``capacity`` rows
                 per_block.groupBy("length").agg(F.sum("number").alias("number")).collect()}
    # At most three places per kept pattern plus the residual's: bounded by capacity, not by documents.
    slots = spark.sparkContext.broadcast(plan_slots(pack_histogram(histogram, capacity)))
    earlier = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ranks = per_block.select("block", "length", F.coalesce(F.sum("number").over(earlier), F.lit(0)).alias("earlier"))
    ranked = pieces.join(ranks, ["block", "length"]).select(
        "doc_id", "piece", "start", "length", "ids_crc32", (F.col("earlier") + F.col("nth")).alias("rank"))

    def place(batches):
        length, first, sequence, offset = slots.value
        span = np.int64(1) << 44  # more than any rank
        keys = length * span + first
        for batch in batches:
            own, rank = (batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 5))
            at = np.searchsorted(keys, own * span + rank, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:5], pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, "
                                    "sequence_id long, offset long")


@register("op2_best_fit_packing")
def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read_table(spark, sf_dir, "documents"), vocabulary_path(WORD_VOCABULARY))
