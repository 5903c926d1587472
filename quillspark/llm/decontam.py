"""Benchmark decontamination by Wu-Manber multi-pattern search over words (operator 3).

Texts are word sequences (A-Z lower-cased; a word is a run of digits, letters a-z
and code points from U+0080).  The patterns are the windows of the benchmark
items: ``WINDOW`` consecutive words, or a whole shorter item.

For patterns of one length m a table is kept of the blocks of two consecutive
words (one word if m is 1):

* shift: how far the search may skip when a block ends at a position; a block that
  occurs in no pattern lets it skip m - 1 words at once;
* suffix buckets: where the shift is 0, the patterns that end in this block;
* direct comparison of the whole window confirms an occurrence.

Shorter items get tables of their own, so one short item does not shrink the
skips of all others.  The benchmark is dealt into blocks of bounded size; each
block's patterns are broadcast and run past all documents.

Null texts and texts without words have no words and no hits.  An item without
words has no window; an item without id counts under the name "null".  Repeated
rows are kept, repeated items count once.  Empty tables are fine on either side.
Documents keep all their columns beside the added one (``found``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, stored
from .registry import register

WINDOW = 10
#: Most characters of benchmark text per broadcast block, and per single item row of it.
BLOCK_CHARS = 8_000_000

_FOLD = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20
              for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


class WuManber:
    """Search tables for patterns (tuples of words) of any lengths; ``items`` per pattern."""

    def __init__(self, patterns: dict[tuple[bytes, ...], set]):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary
        by_length: dict[int, dict[tuple[int, ...], frozenset]] = {}
        for words, items in patterns.items():
            key = tuple(number.setdefault(w, len(number) + 1) for w in words)  # 0: a word of no pattern
            by_length.setdefault(len(key), {})[key] = frozenset(items)
        self.base = len(number) + 1
        self.tables = [(m, *self._table(m, found)) for m, found in sorted(by_length.items(), reverse=True)]

    def _table(self, m: int, patterns: dict) -> tuple[dict, dict]:
        shift: dict[int, int] = {}
        buckets: dict[int, dict] = {}
        for key, items in patterns.items():
            if m == 1:
                shift[key[0]] = 0
                buckets.setdefault(key[0], {})[key] = items
                continue
            for end in range(1, m):
                block = key[end - 1] * self.base + key[end]
                shift[block] = min(shift.get(block, m), m - 1 - end)
            buckets.setdefault(block, {})[key] = items
        return shift, buckets

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set]:
        """Half-open word spans of the occurrences (in order of length, then place) and their items."""
        number = self.vocabulary.get
        ids = [number(w, 0) for w in words]
        n, base, spans, items = len(ids), self.base, [], set()
        for m, shift, buckets in self.tables:
            if m == 1:
                for at, one in enumerate(ids):
                    if one in buckets:
                        spans.append((at, at + 1))
                        items |= buckets[one][(one,)]
                continue
            skip, at, shift_of = m - 1, m - 1, shift.get
            while at < n:
                block = ids[at - 1] * base + ids[at]
                step = shift_of(block, skip)
                if step:
                    at += step
                    continue
                window = tuple(ids[at - m + 1:at + 1])
                hit = buckets[block].get(window)
                if hit is not None:
                    spans.append((at - m + 1, at + 1))
                    items |= hit
                at += 1
        return spans, items


def item_windows(rows: list[tuple], window: int) -> dict[tuple[bytes, ...], set]:
    patterns: dict[tuple[bytes, ...], set] = {}
    for item, text in rows:
        words = words_of(text)
        for at in range(max(1, len(words) - window + 1) if words else 0):
            patterns.setdefault(tuple(words[at:at + window]), set()).add("null" if item is None else str(item))
    return patterns


def benchmark_blocks(benchmark: DataFrame, window: int = WINDOW):
    """Yield the patterns of one bounded block of benchmark items after the other."""
    items = benchmark.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()  # a repeated row adds no window
    chars = items.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    if blocks == 1:
        yield item_windows([tuple(r) for r in items.collect()], window)
    elif blocks > 1:
        # Twice the blocks that the average needs, dealt by hash of the item.
        dealt = stored(items.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks))), "benchmark")
        for k in range(2 * blocks):
            yield item_windows([tuple(r) for r in dealt.filter(F.col("block") == k).select("item_id", "text").collect()], window)


def _covered(spans: list[tuple[int, int]]) -> list[int]:
    """Merged spans, flat: start, end, start, end..."""
    out: list[int] = []
    for start, end in sorted(spans):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


FOUND = "struct<n_words:long,spans:array<int>,items:array<string>>"


def window_finder(tables):
    """A column function: n_words, merged hit spans (in words) and sorted item ids of a text."""

    def search(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machine = tables.value
        for batch in batches:
            rows = []
            for text in batch.tolist():
                words = words_of(text)
                spans, items = machine.search(words) if words else ((), ())
                rows.append((len(words), _covered(spans), sorted(items)))
            yield pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return F.pandas_udf(search, FOUND)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``docs`` (with a column text) plus ``found``: n_words, spans (merged, word positions) and items (sorted as strings)."""
    spark = docs.sparkSession
    machines = [WuManber(p) for p in benchmark_blocks(benchmark, window)] or [WuManber({})]
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    finders = [window_finder(spark.sparkContext.broadcast(m)) for m in machines]
    if len(finders) == 1:
        return docs.withColumn("found", finders[0](text))
    # Several blocks: one pass of the texts per block; narrow results meet by a row number that a written table fixes.
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "decontam-docs")
    parts = None
    for finder in finders:
        part = rows.select("__row", finder(text).alias("found")).select("__row", "found.*")
        parts = part if parts is None else parts.unionByName(part)

    @F.pandas_udf("array<int>")
    def unite(column: pd.Series) -> pd.Series:
        return pd.Series([_covered([p for part in parts for p in zip(part[::2], part[1::2])]) for parts in column])

    merged = parts.groupBy("__row").agg(F.max("n_words").alias("n_words"), F.collect_list("spans").alias("spans"),
                                        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = merged.select("__row", F.struct("n_words", unite("spans").alias("spans"), "items").alias("found"))
    return rows.join(merged, "__row").drop("__row")


def contamination_digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of contamination() rows."""
    n_hit = F.aggregate("found.spans", F.struct(F.lit(0).cast("long").alias("sum"), F.lit(-1).cast("long").alias("sign")),
                        lambda s, x: F.struct((s["sum"] + s["sign"] * x).alias("sum"), (-s["sign"]).alias("sign")),
                        lambda s: s["sum"])
    return found.select("doc_id", "found.n_words", n_hit.alias("n_hit"), F.size("found.items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
                        (F.size("found.spans") > 0).alias("contaminated"))


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(10, len(ws)) AS m,
              array_to_string(ws[k:k + least(10, len(ws)) - 1], ' ') AS win
       FROM (SELECT item_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS k FROM b WHERE len(ws) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT rid, k, m, array_to_string(ws[k:k + m - 1], ' ') AS win
       FROM (SELECT rid, ws, m, unnest(generate_series(1, len(ws) - m + 1)) AS k FROM d, ms WHERE len(ws) >= m)),
hits AS (SELECT dw.rid, dw.k, dw.m, bw.item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m),
pos AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(k, k + m - 1)) AS p FROM hits) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
        FROM (SELECT DISTINCT rid, item_id FROM hits) GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (rid) LEFT JOIN its USING (rid)
"""


@register("op3_benchmark_decontamination", ORACLE)
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return contamination_digest(contamination(docs, read_table(spark, sf_dir, "benchmark")))
