"""Merkle manifest of a dataset by bitmap-rank indexing (operator 11).

Every row is a leaf: the SHA-256 of its fields, each with its length.  The leaves
of one group (source) ascend by doc_id; runs of three become their digest until
one is left, the group's subroot; the subroots, by group, give the root likewise.

Where a leaf stands is found without sorting the leaves:

* each task turns its ids into compressed bitmaps, one per group and chunk of
  65,536 ids; the bitmaps of all tasks are merged by (group, chunk);
* a merged bitmap keeps a popcount directory, and the number of rows in earlier
  chunks of its group, so the rank of an id is one look into the directory and a
  count inside one 64-bit word;
* rank div 2,187 (seven levels) is the key of a slot array, rank mod 2,187 the
  slot: one grouping reduces seven levels.  The arrays' digests are the leaves of
  the next pass, so the passes grow with the logarithm of the largest group.

Proofs go down the same way: a slot array adds its siblings to the path of its
own digest, so a leaf's path is never shuffled.

Ids may repeat: a bitmap then also keeps its repeated ids and their counts.  Their
rows alone are put in order of (leaf, row) by a range partition; rows with equal
leaves are interchangeable.  A null id comes first in its group, a null group
first of all.  Null fields are "-"; an empty text is "0:".  A group that holds a
third of all rows is spread over the parts of its chunks and over its slot arrays.  Very long texts
only pass the digest.  An empty table gives no rows and no root.  Other columns
are ignored.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored
from .registry import register

ARITY = 3
#: Levels that one slot array reduces (2,187 slots).
LEVELS = 7
CHUNK_BITS = 16
#: Ids whose rows are asked for in one task: a sixteenth of a chunk.
PART_BITS = 12
#: Chunk of the null id: before the chunks of all 64-bit ids.
NULL_CHUNK = -(1 << (63 - CHUNK_BITS)) - 1
#: Ids that a task gathers before it emits their bitmaps.
GATHERED_IDS = 1 << 20
#: A bitmap of up to this many ids is a plain list of 16-bit numbers.
LISTED_IDS = 4096

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PART = "group string, chunk long, bits binary, repeated binary, extra binary"
INDEX = "group string, chunk long, rows long, parts array<int>, bits binary, directory binary, repeated binary, extra binary"
NODES = "group string, rank long, total long, digest string"
PATHS = "group string, rank long, path array<string>, subroot string"


def digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


# ---------------------------------------------------------------- leaves

def leaf_digest(*fields: Column) -> Column:
    """Digest of fields in order, each ``-`` if null, else its UTF-8 length, a colon and its text."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.when(t.isNull(), "-").otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]), 256)


def leaf_table(docs: DataFrame, claimed_text: Column | None = None) -> DataFrame:
    """Narrow leaves of ``docs``: group, chunk, low, doc_id, leaf and ``claimed``, the leaf with another text where it differs."""
    fields = [F.col(c) for c in FIELDS]
    leaf = leaf_digest(*fields)
    claimed = F.lit(None).cast("string")
    if claimed_text is not None:
        claimed = F.when(~claimed_text.eqNullSafe(F.col("text")), leaf_digest(*fields[:-1], claimed_text))
    # Groups without nulls, in the same order: a null group before all others.
    group = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), F.col("source").cast("string")))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(
        group.alias("group"), F.coalesce(F.shiftright(doc_id, CHUNK_BITS), F.lit(NULL_CHUNK)).alias("chunk"),
        F.coalesce(doc_id.bitwiseAND((1 << CHUNK_BITS) - 1), F.lit(0)).cast("int").alias("low"),
        doc_id.alias("doc_id"), leaf.alias("leaf"), claimed.alias("claimed"), F.monotonically_increasing_id().alias("row"))


# ---------------------------------------------------------------- bitmaps

def pack_bits(lows: np.ndarray) -> bytes:
    """Ascending distinct 16-bit numbers as runs, as a list or as a bitmap, whichever is shortest."""
    breaks = np.flatnonzero(np.diff(lows.astype(np.int32)) != 1)
    starts, ends = np.concatenate([[0], breaks + 1]), np.concatenate([breaks, [len(lows) - 1]])
    if 2 * len(starts) < min(len(lows), LISTED_IDS):
        return b"r" + np.stack([lows[starts], lows[ends]], axis=1).astype("<u2").tobytes()
    if len(lows) <= LISTED_IDS:
        return b"l" + lows.astype("<u2").tobytes()
    words = np.zeros(1 << CHUNK_BITS, dtype=np.uint8)
    words[lows] = 1
    return b"b" + np.packbits(words, bitorder="little").tobytes()


def unpack_bits(bits: bytes) -> np.ndarray:
    kind, data = bits[:1], np.frombuffer(bits, dtype=np.uint8, offset=1)
    if kind == b"b":
        return np.flatnonzero(np.unpackbits(data, bitorder="little"))
    numbers = data.view("<u2").astype(np.int64)
    if kind == b"l":
        return numbers
    return np.concatenate([np.arange(a, b + 1) for a, b in numbers.reshape(-1, 2)])


def directory_of(lows: np.ndarray) -> bytes:
    """Ids before each 64-bit word of the chunk."""
    per_word = np.bincount(lows >> 6, minlength=(1 << CHUNK_BITS) // 64)
    return (np.cumsum(per_word) - per_word).astype("<u2").tobytes()


def rank_in_chunk(bits: bytes, directory: bytes, asked: np.ndarray) -> np.ndarray:
    """How many ids of the bitmap are smaller than each of ``asked``."""
    if bits[:1] != b"b":
        return np.searchsorted(unpack_bits(bits), asked)
    word = np.frombuffer(bits, dtype=np.uint8, offset=1).view("<u8")[asked >> 6]
    below = word & ((np.uint64(1) << (asked & 63).astype(np.uint64)) - np.uint64(1))
    return np.frombuffer(directory, dtype="<u2")[asked >> 6].astype(np.int64) + np.bitwise_count(below)


def partial_bitmaps(leaves: DataFrame) -> DataFrame:
    """Compressed bitmaps of the ids that each task reads, with the ids that it met more than once."""

    def gather(batches):
        held, ids = defaultdict(list), 0

        def emit():
            rows = []
            for (group, chunk), parts in held.items():
                lows, counts = np.unique(np.concatenate(parts), return_counts=True)
                more = counts > 1
                rows.append((group, chunk, pack_bits(lows), lows[more].astype("<u2").tobytes(), (counts[more] - 1).astype("<i8").tobytes()))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), ARROW_PART)],
                                              ["group", "chunk", "bits", "repeated", "extra"])

        for batch in batches:
            groups = batch.column(0).dictionary_encode()
            chunk, low = batch.column(1).to_numpy(), batch.column(2).to_numpy().astype(np.uint16)
            names, code = groups.dictionary.to_pylist(), groups.indices.to_numpy()
            order = np.lexsort((chunk, code))
            code, chunk, low = code[order], chunk[order], low[order]
            cuts = np.flatnonzero((np.diff(code) != 0) | (np.diff(chunk) != 0)) + 1
            for at, part in zip(np.concatenate([[0], cuts]).tolist(), np.split(low, cuts)):
                if len(part):
                    held[names[code[at]], int(chunk[at])].append(part)
            ids += batch.num_rows
            if ids >= GATHERED_IDS:
                yield emit()
                ids = 0
        if held:
            yield emit()

    return leaves.select("group", "chunk", "low").mapInArrow(gather, PART)


ARROW_PART = [pa.string(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]


def merge_bitmaps(table: pa.Table) -> pa.Table:
    """All tasks' bitmaps of one group and chunk as one, with its popcount directory."""
    counts = np.zeros(1 << CHUNK_BITS, dtype=np.int64)
    for bits, repeated, extra in zip(*(table.column(c).to_pylist() for c in ("bits", "repeated", "extra"))):
        counts[unpack_bits(bits)] += 1
        counts[np.frombuffer(repeated, dtype="<u2")] += np.frombuffer(extra, dtype="<i8")
    lows, more = np.flatnonzero(counts), np.flatnonzero(counts > 1)
    row = (table.column("group")[0].as_py(), table.column("chunk")[0].as_py(), int(counts.sum()),
           np.unique(lows >> PART_BITS).tolist(), pack_bits(lows), directory_of(lows), more.astype("<u2").tobytes(), (counts[more] - 1).astype("<i8").tobytes())
    types = [pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
    names = ["group", "chunk", "rows", "parts", "bits", "directory", "repeated", "extra"]
    return pa.table([pa.array([v], t) for v, t in zip(row, types)], names=names)


def running_totals(rows: DataFrame, keys: list[str], order: list[str], value: Column, label: str) -> DataFrame:
    """``rows`` with ``before`` (sum of ``value`` over the rows of equal keys that come earlier) and ``total`` per key.

    Rows are range partitioned by keys and order; each range starts from the sums of
    the ranges before, so a key that holds most rows is spread over many tasks.
    """
    spread = stored(rows.withColumn("__value", value).repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()), label)
    sums = spread.groupBy(*keys, "__range").agg(F.sum("__value").alias("__sum"))
    earlier = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    starts = sums.select(*keys, "__range", F.coalesce(F.sum("__sum").over(earlier), F.lit(0)).alias("__start"),
                         F.sum("__sum").over(Window.partitionBy(*keys)).alias("total"))
    inside = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = spread.withColumn("__inside", F.coalesce(F.sum("__value").over(inside), F.lit(0)))
    return placed.join(starts, [*keys, "__range"]).select(
        *rows.columns, (F.col("__start") + F.col("__inside")).alias("before"), "total")


def bitmap_index(leaves: DataFrame) -> DataFrame:
    """One row per group and chunk: merged bitmap, directory, repeated ids, rows before it and of its group."""
    merged = partial_bitmaps(leaves).groupBy("group", "chunk").applyInArrow(merge_bitmaps, INDEX)
    return stored(running_totals(merged, ["group"], ["chunk"], F.col("rows"), "bitmap-parts"), "bitmap-index")


# ---------------------------------------------------------------- coordinates

RANKED = NODES + ", doc_id long, claimed string"


def place_leaves(rows: pa.Table, index: pa.Table) -> pa.Table:
    """Rank queries of the rows of one part of a chunk against its bitmap."""
    if not rows.num_rows:
        return pa.table({f: pa.array([], t) for f, t in (("group", pa.string()), ("rank", pa.int64()), ("total", pa.int64()),
                                                         ("digest", pa.string()), ("doc_id", pa.int64()), ("claimed", pa.string()))})
    low = rows.column("low").to_numpy().astype(np.int64)
    at = {c: index.column(c)[0].as_py() for c in ("bits", "directory", "repeated", "extra", "before", "total")}
    extra = np.concatenate([[0], np.cumsum(np.frombuffer(at["extra"], dtype="<i8"))])
    rank = (at["before"] + rank_in_chunk(at["bits"], at["directory"], low)
            + extra[np.searchsorted(np.frombuffer(at["repeated"], dtype="<u2"), low)])
    return pa.table({"group": rows.column("group"), "rank": rank, "total": np.full(len(low), at["total"], np.int64),
                     "digest": rows.column("leaf"), "doc_id": rows.column("doc_id"), "claimed": rows.column("claimed")})


def repeated_ids(index: DataFrame) -> DataFrame:
    """group, chunk, low, base (rank of the first row), total of the ids that more than one row holds."""

    def spell(batches):
        for batch in batches:
            for row in batch.to_pylist():
                low, extra = np.frombuffer(row["repeated"], "<u2").astype(np.int64), np.frombuffer(row["extra"], "<i8")
                base = row["before"] + rank_in_chunk(row["bits"], row["directory"], low) + np.cumsum(extra) - extra
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["group"]] * len(low)), pa.array(np.full(len(low), row["chunk"], np.int64)), pa.array(low.astype(np.int32)),
                     pa.array(base), pa.array(np.full(len(low), row["total"], np.int64))], ["group", "chunk", "low", "base", "total"])

    held = index.filter(F.octet_length("repeated") > 0)
    return held.mapInArrow(spell, "group string, chunk long, low int, base long, total long")


def ranked_leaves(leaves: DataFrame, index: DataFrame) -> DataFrame:
    """group, rank, total, digest, doc_id, claimed: every leaf with its place in its group."""
    key = ["group", "chunk"]
    single, tied = leaves, None
    if not index.filter(F.octet_length("repeated") > 0).isEmpty():
        repeated = stored(repeated_ids(index), "repeated-ids")
        single = leaves.join(repeated, [*key, "low"], "left_anti")
        # A plain join: a hot id is split by the skew handling of the exchange.
        tied = running_totals(leaves.join(repeated.withColumnRenamed("total", "of_group"), [*key, "low"]),
                              [*key, "low"], ["leaf", "row"], F.lit(1).cast("long"), "repeated-rows")
        tied = tied.select("group", (F.col("base") + F.col("before")).alias("rank"), F.col("of_group").alias("total"),
                           F.col("leaf").alias("digest"), "doc_id", "claimed")
    part = F.shiftright("low", PART_BITS).alias("part")
    bitmaps = index.select(*key, "bits", "directory", "repeated", "extra", "before", "total", F.explode("parts").alias("part"))
    placed = (single.select(*key, part, "low", "doc_id", "leaf", "claimed").groupBy(*key, "part")
              .cogroup(bitmaps.groupBy(*key, "part")).applyInArrow(place_leaves, RANKED))
    return stored(placed if tied is None else placed.unionByName(tied), "ranked-leaves")


# ---------------------------------------------------------------- tree

def siblings(levels: list[list[str]], slot: int) -> list[str]:
    """Left and right siblings of a slot, level by level."""
    path = []
    for nodes in levels[:-1]:
        first = slot - slot % ARITY
        path += ["".join(nodes[first:slot]), "".join(nodes[slot + 1:first + ARITY])]
        slot //= ARITY
    return path


def fold(leaf: str, path: list[str]) -> str:
    for k in range(0, len(path), 2):
        leaf = digest(path[k], leaf, path[k + 1])
    return leaf


@dataclass(frozen=True)
class Slots:
    """Slot arrays that reduce up to ``levels`` levels at once."""

    levels: int = LEVELS

    @property
    def width(self) -> int:
        return ARITY ** self.levels

    def levels_of(self, total: int) -> int:
        """Levels that an array reduces in a group of ``total`` nodes."""
        levels, held = 0, 1
        while held < total and levels < self.levels:
            levels, held = levels + 1, held * ARITY
        return levels

    def filled(self, ranks: np.ndarray, digests: list[str], total: int) -> list[list[str]]:
        """A slot array and the levels above it, the last of them one node."""
        slots = [""] * len(digests)
        for slot, one in zip((ranks % self.width).tolist(), digests):
            slots[slot] = one
        levels = [slots]
        for _ in range(self.levels_of(total)):
            below = levels[-1]
            levels.append([digest(*below[k:k + ARITY]) for k in range(0, len(below), ARITY)])
        return levels

    def of_table(self, nodes: pa.Table) -> tuple[list[int], list[list[str]]]:
        ranks = nodes.column("rank").to_numpy()
        return (ranks % self.width).tolist(), self.filled(ranks, nodes.column("digest").to_pylist(), nodes.column("total")[0].as_py())

    def reduce(self, nodes: pa.Table) -> pa.Table:
        top = self.of_table(nodes)[1][-1]
        return pa.table({"group": nodes.column("group").slice(0, 1), "rank": [nodes.column("rank")[0].as_py() // self.width],
                         "total": [-(-nodes.column("total")[0].as_py() // self.width)], "digest": top})

    def extend(self, nodes: pa.Table, upper: pa.Table) -> pa.Table:
        """Paths of one array's nodes: their siblings inside it, then the path of its digest."""
        slots, levels = self.of_table(nodes)
        above = upper.column("path")[0].as_py()
        return pa.table({"group": nodes.column("group"), "rank": nodes.column("rank"),
                         "path": pa.array([siblings(levels, s) + above for s in slots], pa.list_(pa.string())),
                         "subroot": pa.array([upper.column("subroot")[0].as_py()] * len(slots), pa.string())})

    def keyed(self, nodes: DataFrame):
        return nodes.withColumn("slots", F.expr(f"rank div {self.width}")).groupBy("group", "slots")

    def with_upper(self, nodes: DataFrame, upper: DataFrame):
        """Every array of ``nodes`` beside the path of its own digest."""
        return self.keyed(nodes).cogroup(upper.withColumnRenamed("rank", "slots").groupBy("group", "slots"))

    def climb(self, nodes: DataFrame) -> list[DataFrame]:
        """``nodes`` and, pass by pass, the digests of their slot arrays until every group has one node."""
        passes, largest = [nodes], nodes.agg(F.max("total")).first()[0] or 1
        while largest > 1:
            below = self.keyed(passes[-1].select("group", "rank", "total", "digest"))
            passes.append(stored(below.applyInArrow(lambda nodes: self.reduce(nodes), NODES), "merkle-nodes"))
            largest = -(-largest // self.width)
        return passes

    def descend(self, passes: list[DataFrame], top: DataFrame) -> DataFrame:
        """Paths of the slot arrays of the lowest pass, from the paths of the groups' single nodes."""
        upper = top
        for nodes in reversed(passes[1:-1]):
            upper = stored(self.with_upper(nodes, upper).applyInArrow(lambda nodes, upper: self.extend(nodes, upper), PATHS), "merkle-paths")
        return upper


@dataclass
class Manifest:
    """Coordinates of all leaves, the passes above them, group paths and the root (None: no rows)."""

    passes: list[DataFrame]
    groups: DataFrame  # PATHS: the way from each group's subroot to the root
    root: str | None
    slots: Slots


def build_manifest(leaves: DataFrame, slots: Slots = Slots()) -> Manifest:
    """The tree over rows of leaf_table(); every table of it is written, so a lost executor costs one pass."""
    spark = leaves.sparkSession
    leaves = stored(leaves, "merkle-leaves")
    passes = slots.climb(ranked_leaves(leaves, bitmap_index(leaves)))
    subroots = running_totals(passes[-1].select(F.lit("").alias("all"), "group", "digest"), ["all"], ["group"],
                              F.lit(1).cast("long"), "subroots")
    subroots = stored(subroots.select("all", "group", F.col("before").alias("rank"), "total", "digest"), "subroots")
    tops = slots.climb(subroots.select(F.col("all").alias("group"), "rank", "total", "digest"))
    root = tops[-1].select("digest").first()
    start = spark.createDataFrame([("", 0, [], None)], PATHS)
    if root is None:
        return Manifest(passes, spark.createDataFrame([], PATHS), None, slots)
    ways = slots.with_upper(tops[0], slots.descend(tops, start)).applyInArrow(lambda nodes, upper: slots.extend(nodes, upper), PATHS)
    groups = subroots.select("group", "rank", "digest").join(ways.select("rank", "path"), "rank").select(
        "group", F.lit(0).cast("long").alias("rank"), "path", F.col("digest").alias("subroot"))
    return Manifest(passes, stored(groups, "merkle-groups"), root.digest, slots)


VERIFIED = ("doc_id long, leaf string, subroot string, root string, proof array<string>, proof_sha256 string, "
            "folded_root string, verified boolean")


def verify_leaves(manifest: Manifest) -> DataFrame:
    """Every leaf with its proof (left and right siblings up to the root), and the root that its claimed leaf folds to."""
    spark = manifest.groups.sparkSession
    if manifest.root is None:
        return spark.createDataFrame([], VERIFIED)
    root, slots = manifest.root, manifest.slots

    def check(nodes: pa.Table, upper: pa.Table) -> pa.Table:
        own, (places, levels) = nodes.column("digest").to_pylist(), slots.of_table(nodes)
        above, roots, proofs, folded = upper.column("path")[0].as_py(), {}, [], []
        for slot, leaf, claim in zip(places, own, nodes.column("claimed").to_pylist()):
            path = siblings(levels, slot)
            node = fold(leaf if claim is None else claim, path)
            if node not in roots:  # most leaves of an array fold to its own digest
                roots[node] = fold(node, above)
            folded.append(roots[node])
            proofs.append(path + above)
        folded, subroot = pa.array(folded), upper.column("subroot")[0].as_py()
        return pa.table({"doc_id": nodes.column("doc_id"), "leaf": own, "subroot": [subroot] * len(own), "root": [root] * len(own),
                         "proof": pa.array(proofs, pa.list_(pa.string())), "proof_sha256": [digest(*p) for p in proofs],
                         "folded_root": folded, "verified": pc.equal(folded, root)})

    return slots.with_upper(manifest.passes[0], slots.descend(manifest.passes, manifest.groups)).applyInArrow(check, VERIFIED)


ORACLE = r"""
WITH RECURSIVE
bits AS (SELECT list(list_reduce([i] || [0, 1, 2, 3, 4, 5, 6, 7], lambda x, k: xor(x >> 1, 3988292384 * (x & 1))) ORDER BY i) AS tbl
         FROM (SELECT unnest(range(256)) AS i)),
e AS (SELECT row_number() OVER () AS rid, doc_id, source, lang, n_chars, text,
        CASE WHEN xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: ascii(c)::BIGINT),
                        lambda a, b: xor(a >> 8, tbl[(xor(a, b) & 255) + 1])), 4294967295) % 2 = 0
             THEN replace(text, chr(10), '') ELSE text END AS told FROM documents, bits),
f AS (SELECT rid, doc_id, source, text, told,
        coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
        || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head FROM e),
h AS (SELECT rid, doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
        sha256(head || coalesce(strlen(told) || ':' || told, '-')) AS claimed FROM f),
l AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, rid) - 1 AS pos,
        count(*) OVER (PARTITION BY source) AS n FROM h),
s(lvl, source, idx, digest, cnt) AS (
  SELECT 0, source, pos, leaf, n FROM l
  UNION ALL
  SELECT lvl + 1, source, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 2) // 3
  FROM s WHERE cnt > 1 GROUP BY lvl, source, idx // 3, cnt),
sub AS (SELECT source, digest AS subroot, lvl AS depth, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
          count(*) OVER () AS n FROM s WHERE cnt = 1),
t(lvl, idx, digest, cnt) AS (
  SELECT 0, pos, subroot, n FROM sub
  UNION ALL
  SELECT lvl + 1, idx // 3, sha256(string_agg(digest, '' ORDER BY idx)), (cnt + 2) // 3
  FROM t WHERE cnt > 1 GROUP BY lvl, idx // 3, cnt),
r AS (SELECT digest AS root, lvl AS height FROM t WHERE cnt = 1),
sides AS (
  SELECT a.lvl, a.source, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
  FROM s a JOIN s b ON a.lvl = b.lvl AND a.source IS NOT DISTINCT FROM b.source AND a.idx // 3 = b.idx // 3
  WHERE a.cnt > 1 GROUP BY a.lvl, a.source, a.idx),
tops AS (
  SELECT a.lvl, a.idx, coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx < a.idx), '') AS lft,
         coalesce(string_agg(b.digest, '' ORDER BY b.idx) FILTER (b.idx > a.idx), '') AS rgt
  FROM t a JOIN t b ON a.lvl = b.lvl AND a.idx // 3 = b.idx // 3 WHERE a.cnt > 1 GROUP BY a.lvl, a.idx),
up(rid, source, lvl, idx, node, proof) AS (
  SELECT rid, source, 0, pos, claimed, '' FROM l
  UNION ALL
  SELECT up.rid, up.source, up.lvl + 1, up.idx // 3, sha256(lft || node || rgt), proof || lft || rgt
  FROM up JOIN sides x ON up.lvl = x.lvl AND up.idx = x.idx AND up.source IS NOT DISTINCT FROM x.source),
gone AS (SELECT up.rid, sub.subroot, sub.pos, up.node, up.proof FROM up JOIN sub
           ON up.source IS NOT DISTINCT FROM sub.source AND up.lvl = sub.depth),
fin(rid, subroot, lvl, idx, node, proof) AS (
  SELECT rid, subroot, 0, pos, node, proof FROM gone
  UNION ALL
  SELECT fin.rid, fin.subroot, fin.lvl + 1, fin.idx // 3, sha256(lft || node || rgt), proof || lft || rgt
  FROM fin JOIN tops x ON fin.lvl = x.lvl AND fin.idx = x.idx)
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, node AS folded_root, node = root AS verified
FROM fin JOIN r ON fin.lvl = r.height JOIN h USING (rid)
"""


@register("op11_merkle_manifest", ORACLE)
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    even = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    told = F.when(even, F.translate("text", "\n", "")).otherwise(F.col("text"))
    return verify_leaves(build_manifest(leaf_table(docs, told))).drop("proof")
