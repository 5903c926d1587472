"""Ranked lexical search by NRA, sequential reads of impact-sorted lists (operator 12).

A first pass over the whole texts counts every document's terms and keeps, of the
terms that some query names, the number of occurrences.  With the collection's
statistics the score that a term adds to a document (its impact) is fixed.

Documents are then read in shards of bounded size.  A shard's postings form one
list per term, sorted by falling impact, and every query reads its lists block
by block, never at random.  What is read gives each document an interval:

* lower: the sum of the impacts read so far;
* upper: lower plus, for every list in which the document was not yet met, the
  impact at that list's reading position.

Reading goes on while any document that may still enter the best ``k`` (its upper
is not below the k-th largest lower) has an open interval.  What then remains has
final scores, ties included.  The k-th best of a task's earlier shards counts as a
lower bound in its later ones; the tasks' best rows are merged per query.

Queries are dealt into blocks of bounded text, so the broadcast terms and query
lists never grow with the input.  Scores are 64-bit integers.

Null and empty texts, and texts without terms, take no part and are not counted.
Queries without terms, or whose terms occur nowhere, have no rows.  A repeated
query row (same id, same text) is one query; rows that share an id but not the
text are ranked apart.  Every document row is a document of its own, also where
ids repeat; null ids come last among equal scores.  Empty tables on either side
give no rows.  Very long texts are read whole.  Other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, slices, stored
from .decontam import words_of
from .registry import register

TOP = 50
#: Most characters of query text per block (all terms of a block are broadcast).
BLOCK_CHARS = 8_000_000
#: A shard ends with the document that brings it to this many postings or documents.
SHARD_POSTINGS, SHARD_DOCS = 1_000_000, 16_384
#: Postings of a list that a query reads first; each further read is as long as all before.
FIRST_READ = 256

MATCHED = "doc_id long, n long, terms array<int>, tfs array<int>"
BEST = "query int, doc_id long, score long"


def matched_terms(docs: DataFrame, numbers) -> DataFrame:
    """doc_id, n (terms with repeats), and the ascending numbers and occurrences of the queries' terms in a document."""

    def match(batches):
        number = numbers.value.get
        for batch in slices(batches):
            kept, sizes, ends, terms, tfs = [], [], [0], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                words = words_of(text)
                if not words:
                    continue
                kept.append(row)
                sizes.append(len(words))
                found = Counter(map(number, words))
                found.pop(None, None)
                for term in sorted(found):
                    terms.append(term)
                    tfs.append(found[term])
                ends.append(len(terms))
            offsets = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(kept, pa.int64())), pa.array(sizes, pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(terms, pa.int32())),
                 pa.ListArray.from_arrays(offsets, pa.array(tfs, pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(match, MATCHED)


class Impacts:
    """Integer impacts of a collection: ``documents`` with terms, ``length`` terms in all, documents per term."""

    def __init__(self, documents: int, length: int, document_counts: np.ndarray):
        self.documents, self.length = documents, length
        self.weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(df) + 1))) for df in document_counts],
                                dtype=np.int64)

    def of(self, terms: np.ndarray, tfs: np.ndarray, n: np.ndarray) -> np.ndarray:
        m = 50 + (50 * n * self.documents) // self.length
        return self.weights[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 20 * m))


class Shard:
    """Impact-sorted lists of a bounded set of documents (given in the order in which ties rank)."""

    def __init__(self, n_docs: int, n_terms: int, terms: np.ndarray, docs: np.ndarray, impacts: np.ndarray):
        order = np.lexsort((-impacts, terms))
        self.n_docs, self.docs, self.impacts = n_docs, docs[order], impacts[order]
        self.first = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def search(self, terms: np.ndarray, k: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """The best ``k`` documents that reach a score of ``least``, best first, and their scores."""
        begin, end = self.first[terms], self.first[terms + 1]
        begin, end = begin[begin < end], end[begin < end]
        lower = np.zeros(self.n_docs, dtype=np.int64)
        docs_read, lists_read, depth, step = [], [], 0, FIRST_READ
        while len(begin):
            lo, hi = np.minimum(begin + depth, end), np.minimum(begin + depth + step, end)
            sizes = hi - lo
            of_list = np.repeat(np.arange(len(begin)), sizes)
            at = np.arange(sizes.sum()) + np.repeat(lo - (np.cumsum(sizes) - sizes), sizes)
            lower += np.bincount(self.docs[at], weights=self.impacts[at], minlength=self.n_docs).astype(np.int64)
            docs_read.append(self.docs[at])
            lists_read.append(of_list)
            depth, step = depth + step, depth + step
            head = np.where(hi < end, self.impacts[np.minimum(hi, len(self.impacts) - 1)], 0)
            if not head.any():
                break  # every list is read
            met = np.bincount(np.concatenate(docs_read), weights=head[np.concatenate(lists_read)], minlength=self.n_docs)
            upper = lower + (head.sum() - met.astype(np.int64))
            bar = max(least, self._kth(lower, k))
            if not ((upper >= bar) & (upper > lower)).any():
                break  # membership, ties and scores are final
        bar = max(least, self._kth(lower, k), 1)
        found = np.flatnonzero(lower >= bar)
        found = found[np.argsort(-lower[found], kind="stable")][:k]
        return found, lower[found]

    @staticmethod
    def _kth(values: np.ndarray, k: int) -> int:
        return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def best_of_tasks(matched: DataFrame, queries, impacts, k: int) -> DataFrame:
    """query, doc_id, score: per task of ``matched`` and query the best ``k`` of the task's documents."""

    def search(batches):
        asked, table = queries.value, impacts.value
        best = [(np.empty(0, np.int64), np.empty(0, bool), np.empty(0, np.int64))] * len(asked)  # ids, id is null, scores

        def close(shard):
            ids, nulls, n, sizes, terms, tfs = (np.concatenate(part) for part in zip(*shard))
            place = np.lexsort((ids, nulls))
            rank = np.empty(len(place), dtype=np.int64)
            rank[place] = np.arange(len(place))
            rows = np.repeat(np.arange(len(ids)), sizes)
            lists = Shard(len(ids), len(table.weights), terms, rank[rows], table.of(terms, tfs, n[rows]))
            for q, of_query in enumerate(asked):
                had = best[q]
                found, scores = lists.search(of_query, k, int(had[2][-1]) if len(had[2]) == k else 0)
                if len(found):
                    found = place[found]
                    merged = [np.concatenate(x) for x in zip(had, (ids[found], nulls[found], scores))]
                    top = np.lexsort((merged[0], merged[1], -merged[2]))[:k]
                    best[q] = tuple(x[top] for x in merged)

        shard, postings, docs = [], 0, 0
        for batch in slices(batches):
            ids, n = batch.column(0), batch.column(1).to_numpy().astype(np.int64)
            terms, tfs = batch.column(2), batch.column(3)
            shard.append((ids.fill_null(0).to_numpy().astype(np.int64), ids.is_null().to_numpy(zero_copy_only=False), n,
                          terms.value_lengths().to_numpy().astype(np.int64), terms.flatten().to_numpy().astype(np.int64),
                          tfs.flatten().to_numpy().astype(np.int64)))
            postings, docs = postings + len(shard[-1][4]), docs + len(n)
            if postings >= SHARD_POSTINGS or docs >= SHARD_DOCS:
                close(shard)
                shard, postings, docs = [], 0, 0
        if docs:
            close(shard)
        for q, (ids, nulls, scores) in enumerate(best):
            if len(ids):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), q, np.int32)), pa.array(ids, mask=nulls), pa.array(scores)], ["query", "doc_id", "score"])

    return matched.mapInArrow(search, BEST)


def query_blocks(items: DataFrame):
    """Yield lists of (item_id, text): one bounded block of distinct queries after the other."""
    asked = items.select("item_id", "text").filter(F.col("text").isNotNull()).distinct()
    chars = asked.agg(F.sum(F.char_length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    if blocks == 1:
        yield [tuple(r) for r in asked.collect()]
    elif blocks > 1:
        dealt = stored(asked.withColumn("block", F.pmod(F.xxhash64("item_id", "text"), F.lit(2 * blocks))), "queries")
        for k in range(2 * blocks):
            yield [tuple(r) for r in dealt.filter(F.col("block") == k).select("item_id", "text").collect()]


def search_block(docs: DataFrame, rows: list[tuple], item_type, k: int) -> DataFrame:
    spark = docs.sparkSession
    numbers: dict[bytes, int] = {}
    queries = [sorted({numbers.setdefault(w, len(numbers)) for w in words_of(text)}) for _, text in rows]
    sent = spark.sparkContext.broadcast(numbers)
    matched = stored(matched_terms(docs, sent), "search-postings")
    documents, length = matched.agg(F.count("*"), F.sum("n")).first()
    # At most one row per term of the block.
    counts = np.zeros(len(numbers), dtype=np.int64)
    for term, df in matched.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        counts[term] = df
    sent.unpersist()
    impacts = spark.sparkContext.broadcast(Impacts(documents, length or 1, counts))
    asked = spark.sparkContext.broadcast([np.array(q, dtype=np.int64) for q in queries])
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    best = (best_of_tasks(matched, asked, impacts, k).withColumn("rank", F.row_number().over(order))
            .filter(F.col("rank") <= k))
    names = spark.createDataFrame([(q, item) for q, (item, _) in enumerate(rows)], f"query int, item_id {item_type}")
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` best of ``docs`` (doc_id, text) for each of ``items`` (item_id, text)."""
    item_type = dict(items.dtypes)["item_id"]
    out = docs.sparkSession.createDataFrame([], f"item_id {item_type}, rank int, doc_id long, score long")
    for rows in query_blocks(items):
        # Written block by block: one block's terms and queries are held at a time.
        out = out.unionByName(stored(search_block(docs, rows, item_type, k), "search-found"))
    return out


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
q AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ws
      FROM (SELECT DISTINCT item_id, text FROM benchmark)),
qt AS (SELECT DISTINCT item_id, term FROM (SELECT item_id, unnest(ws) AS term FROM q)),
c AS (SELECT count(*) AS nn, sum(len(ws))::BIGINT AS ll FROM d WHERE len(ws) > 0),
tf AS (SELECT rid, term, count(*) AS tf FROM (SELECT rid, unnest(ws) AS term FROM d) GROUP BY rid, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * nn + 2)::DOUBLE / (2 * df + 1))) AS BIGINT) AS w
      FROM (SELECT term, count(*) AS df FROM tf GROUP BY term), c),
m AS (SELECT rid, doc_id, 50 + (50 * len(ws) * nn) // ll AS m FROM d, c WHERE len(ws) > 0),
s AS (SELECT item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
      FROM qt JOIN w USING (term) JOIN tf USING (term) JOIN m USING (rid) GROUP BY item_id, rid, doc_id)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT item_id, doc_id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank
      FROM s WHERE score > 0)
WHERE rank <= 50
"""


@register("op12_ranked_search", ORACLE)
def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return ranked_search(docs, read_table(spark, sf_dir, "benchmark"))
