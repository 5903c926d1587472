"""N-gram Jaccard join by a token-group matrix (operator 9).

A document is the set of its distinct 3-word shingles (64-bit hashes); two
documents link when their Jaccard similarity reaches a threshold.  Steps:

1. Equal sets are one node, so exact copies cost one row however many there are.
2. Grouping.  Linked sets a, b of size at most U differ in at most
   D = (100 - t)(|a| + |b|) / (100 + t) shingles, so when shingles are dealt by
   hash into D + 1 parts, one part holds the same shingles in both.  Each node
   emits a hash of every part (in the family of its size class, and of the next
   class where a partner may lie there).  Nodes without a shared part link with
   nothing.  The others form groups under the smallest node that they share a
   part with, cut into chunks of bounded token count.
3. Inside a group all pairs are compared.
   (A link leaves more than one part alike where sets are smaller than their
   class allows; nodes and groups with fewer shared parts are not looked at.)
4. Across groups: the token-group matrix.  Tokens that no other component holds
   bound the sizes of the partners that a node may still link with; a node without
   a possible size is done.  Of two nodes the larger must meet a smaller one if it
   may link with nothing of its own size; otherwise the one of the smaller component
   asks.  So the members of a large component are asked, they do not ask, and a node
   asks another group's members of one size class only if it shares enough parts with
   them.  The task holds the token union of the group's members in question; a query node whose overlap with that union is below what a link needs
   is refuted at once, and only for the others the group is opened and its
   members compared.  Tasks emit a spanning set of links, never all pairs.
5. Components of the links by alternating large and small stars.

Every pair of nodes that could link is compared or already connected, so the
components are exact (up to 64-bit hash collisions).

Null texts and texts without words are empty sets and link with nothing.  Rows
without id link with nothing and get no component.  Rows that repeat an id are one
document: whatever they link with is linked.  Empty tables give no rows.  Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, slices, stored
from .registry import register

WORDS, THRESHOLD = 3, 90
#: Below, a linked set may lie beyond the next size class (classes grow by the factor 1.5).
LEAST_THRESHOLD = 67
#: Bounds of one group: members, and tokens of all members together.
GROUP_MEMBERS, GROUP_TOKENS = 256, 2_000_000
#: Most candidate nodes (16 bytes each) that are broadcast to fetch their texts; beyond, the fetch is shuffled.
BROADCAST_NODES = 400_000
WORD_MEMO = 500_000

_LOWER = bytes(c + 32 if 0x41 <= c <= 0x5A else c for c in range(256))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(29))


class Shingler:
    """Distinct shingle hashes of whole texts, ascending."""

    def __init__(self, words: int = WORDS):
        self.words, self.memo = words, {}

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        import xxhash
        memo, digest = self.memo, xxhash.xxh64_intdigest
        if len(memo) > WORD_MEMO:
            memo.clear()
        parts = [t.encode().translate(_LOWER).split() if t else [] for t in texts]
        for w in {w for p in parts for w in p if w not in memo}:
            memo[w] = digest(w)
        hashes = np.array([memo[w] for p in parts for w in p], dtype=np.uint64)
        ends = np.cumsum([0, *map(len, parts)])
        k = self.words
        room = max(0, len(hashes) - k + 1)
        rolled = np.zeros(room, np.uint64)
        for j in range(k):
            rolled = _mix(rolled + _A) ^ (hashes[j:j + room] * _B)
        rolled = _mix(rolled)
        out = []
        for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist()):
            if hi - lo >= k:
                out.append(np.unique(rolled[lo:hi - k + 1]))
            elif hi > lo:  # the whole short sequence is one shingle
                x = np.array([hi - lo], dtype=np.uint64)
                for j in range(lo, hi):
                    x = _mix(x * _C + hashes[j:j + 1])
                out.append(x)
            else:
                out.append(np.zeros(0, np.uint64))
        return out


def set_id(tokens: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(tokens.tobytes(), digest_size=8).digest(), "little", signed=True)


def size_classes(most: int) -> list[int]:
    """Upper ends of the size classes up to the one that holds ``most``."""
    ends = [1]
    while ends[-1] < most:
        ends.append(max(ends[-1] + 1, ends[-1] * 3 // 2))
    return ends


def part_hashes(tokens: np.ndarray, ends: list[int], threshold: int) -> np.ndarray:
    """One hash per part of the set, in the family of its class and, near the upper end, of the next."""
    n = len(tokens)
    own = int(np.searchsorted(ends, n))
    families = [own]
    if own + 1 < len(ends) and 100 * n >= threshold * (ends[own] + 1):
        families.append(own + 1)
    mixed, out = _mix(tokens + _C), []
    for family in families:
        parts = 2 * ends[family] * (100 - threshold) // (100 + threshold) + 1
        part = ((tokens * _A) >> np.uint64(24)) % np.uint64(parts)
        total = np.zeros(parts, np.uint64)
        np.add.at(total, part.astype(np.int64), mixed)
        place = np.arange(parts, dtype=np.uint64) * _A + np.full(parts, family + 1, np.uint64) * _B
        out.append(_mix(total + _mix(place)))
    return np.concatenate(out)


def least_shared(n: int, ends: list[int], threshold: int) -> int:
    """Parts that a set of ``n`` tokens shares at least with any set it links with.

    Each shingle by which two sets differ spoils one part of the family in which they meet, so a link
    leaves the parts of the family less the differences that a partner of the largest size may bring.
    """
    own = int(np.searchsorted(ends, n))
    needs = []
    for family, partner in ((own, min(100 * n // threshold, ends[own])), (own + 1, 100 * n // threshold)):
        if family == own or (family < len(ends) and partner > ends[own]):
            parts = 2 * ends[family] * (100 - threshold) // (100 + threshold) + 1
            needs.append(parts - (100 - threshold) * (n + partner) // (100 + threshold))
    return max(1, min(needs))


def document_sets(docs: DataFrame, threshold: int, words: int) -> DataFrame:
    """doc_id, n, node (id of the set), the parts it must share to link, and the part hashes of every row."""

    def sets(batches):
        shingler = Shingler(words)
        for batch in slices(batches):
            found = shingler.sets(batch.column(1).to_pylist())
            # The class after the set's own is needed for its upper end.
            ends = size_classes(3 * max([1, *map(len, found)]))
            hashes = [part_hashes(s, ends, threshold) if len(s) else np.zeros(0, np.uint64) for s in found]
            offsets = pa.array(np.cumsum([0, *map(len, hashes)]).astype(np.int32))
            values = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in found], pa.int64()),
                 pa.array([set_id(s) if len(s) else None for s in found], pa.int64()),
                 pa.array([least_shared(len(s), ends, threshold) if len(s) else None for s in found], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(values))], ["doc_id", "n", "node", "need", "parts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        sets, "doc_id long, n long, node long, need long, parts array<long>")


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: int) -> np.ndarray:
    return 100 * inter >= threshold * (a + b - inter)


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of ``left`` and ``right``, by blocks of an incidence matrix."""
    tokens = np.concatenate([*left, *right])
    owner = np.repeat(np.arange(len(left) + len(right)), [len(s) for s in (*left, *right)])
    _, column, count = np.unique(tokens, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    column = np.cumsum(np.concatenate([[0], np.diff(column) != 0])) if len(column) else column
    out = np.zeros((len(left), len(right)))
    width = 4096
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        lo, hi = np.searchsorted(column, [at, at + width])
        x = np.zeros((len(left) + len(right), width), np.float32)
        x[owner[lo:hi], column[lo:hi] - at] = 1
        out += x[:len(left)] @ x[len(left):].T
    return out.astype(np.int64)


def spanning(pairs: np.ndarray, start: np.ndarray) -> list[tuple[int, int]]:
    """The pairs (i, j) that join something not yet joined, given start labels."""
    root = list(range(len(start)))
    first: dict[int, int] = {}

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, label in enumerate(start.tolist()):
        root[i] = first.setdefault(label, i)
    out = []
    for i, j in pairs.tolist():
        a, b = find(i), find(j)
        if a != b:
            root[max(a, b)] = min(a, b)
            out.append((i, j))
    return out


def _token_lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
    ends = np.cumsum([0, *column.value_lengths().to_pylist()])
    return [values[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


LINK = "a long, b long"


def links_inside(members: DataFrame, threshold: int) -> DataFrame:
    """Spanning links of every group (label, chunk, node, tokens): all its pairs are compared."""

    def compare(table: pa.Table) -> pa.Table:
        nodes, sets = table.column("node").to_pylist(), _token_lists(table.column("tokens"))
        sizes = np.array([len(s) for s in sets])
        hit = linked(overlaps(sets, sets), sizes[:, None], sizes[None, :], threshold)
        found = spanning(np.argwhere(np.triu(hit, 1)), np.arange(len(sets)))
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return members.groupBy("label", "chunk").applyInArrow(compare, LINK)


def partner_sizes(nodes: DataFrame, threshold: int) -> DataFrame:
    """node, n, component, weight, least, most of the ``nodes`` (node, component, n, tokens) that may link with another component.

    Only tokens that a second component holds can be shared with a partner, so they bound its size: from ``least`` to ``most``.
    ``weight`` puts large components first.
    """
    tokens = nodes.select("node", F.explode("tokens").alias("token"), "component")
    common = tokens.groupBy("token").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("token")
    shared = tokens.join(common, "token", "left_semi").groupBy("node").agg(F.count(F.lit(1)).alias("shared"))
    sizes = nodes.groupBy("component").agg((-F.count(F.lit(1))).alias("rank"))
    # 100 i >= t (n + m - i) with at most i = shared tokens, and at most i = m.
    found = nodes.drop("tokens").join(shared, "node").join(sizes, "component")
    found = found.withColumn("least", F.expr(f"({threshold} * n + 99) div 100")).withColumn("most", F.expr(f"({100 + threshold} * shared) div {threshold} - n"))
    return found.filter("least <= most").select("node", "n", "component", F.struct("rank", "component").alias("weight"), "least", "most")


def meetings(at: DataFrame, sides: DataFrame) -> DataFrame:
    """label, chunk, size, block, node, component, query: the members of a group's size class and the nodes that ask them.

    ``at`` has a row (part, node, need, label, chunk) per node and part, ``sides`` what ``partner_sizes`` gives.
    """
    at = stored(at.join(sides, "node"), "sided-hits")
    # What may link with its own size can be the smaller one of a link; only that is asked.
    asked = at.filter("most >= n").withColumn("size", F.floor(F.log("n") * 100).cast("long"))
    groups = asked.groupBy("part", F.col("label").alias("to_label"), F.col("chunk").alias("to_chunk"), F.col("size").alias("to_size")).agg(
        F.min("n").alias("smallest"), F.max("n").alias("largest"), F.min("weight").alias("first"),
        F.min("component").alias("low"), F.max("component").alias("high"))
    elsewhere = (F.col("label") != F.col("to_label")) | (F.col("chunk") != F.col("to_chunk"))
    other = (F.col("low") != F.col("high")) | (F.col("low") != F.col("component"))
    may = (F.col("least") <= F.col("largest")) & (F.col("smallest") <= F.col("most")) & F.when(
        F.col("most") >= F.col("n"), F.col("first") < F.col("weight")).otherwise(other)
    target = [F.col("to_" + c).alias(c) for c in ("label", "chunk", "size")]
    asks = stored(at.join(groups, "part").filter(elsewhere & may).groupBy("node", "n", "need", "component", "to_label", "to_chunk", "to_size")
                  .agg(F.count(F.lit(1)).alias("parts")).filter("parts >= need").select(*target, "node", "n", "component"), "asks")
    room = F.greatest(F.lit(8), F.least(F.lit(GROUP_MEMBERS), F.floor(F.lit(GROUP_TOKENS) / F.max("n"))))
    blocks = stored(asks.groupBy("label", "chunk", "size").agg(F.ceil(F.count(F.lit(1)) / room).cast("int").alias("blocks")), "ask-blocks")
    members = asked.select("label", "chunk", "size", "node", "component").distinct().join(blocks, ["label", "chunk", "size"])
    members = members.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    asks = asks.join(blocks, ["label", "chunk", "size"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    columns = ["label", "chunk", "size", "block", "node", "component"]
    return asks.select(*columns, F.lit(True).alias("query")).unionByName(members.select(*columns, F.lit(False).alias("query")))


def links_across(meetings: DataFrame, threshold: int) -> DataFrame:
    """Spanning links of every block of queries and the group they ask (label, chunk, size, block, query, node, component, tokens).

    The group's token union bounds what a query can share with any member.
    """

    def compare(table: pa.Table) -> pa.Table:
        nodes, labels = np.array(table.column("node").to_pylist()), np.array(table.column("component").to_pylist())
        asks = np.array(table.column("query").to_pylist(), dtype=bool)
        sets = _token_lists(table.column("tokens"))
        group = np.flatnonzero(~asks)
        none = pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        if not len(group) or len(set(labels.tolist())) == 1:
            return none
        union = np.unique(np.concatenate([sets[k] for k in group]))
        least, most = (f(len(sets[k]) for k in group) for f in (min, max))
        opened = []
        for q in np.flatnonzero(asks).tolist():
            n = len(sets[q])
            if 100 * n < threshold * least or 100 * most < threshold * n:
                continue
            at = np.minimum(np.searchsorted(union, sets[q]), len(union) - 1)
            if 100 * int((union[at] == sets[q]).sum()) >= threshold * n:  # a link shares threshold % of the larger set
                opened.append(q)
        if not opened:
            return none
        opened = np.array(opened)
        sizes = np.array([len(s) for s in sets])
        inter = overlaps([sets[k] for k in opened], [sets[k] for k in group])
        hit = np.argwhere(linked(inter, sizes[opened][:, None], sizes[group][None, :], threshold))
        found = spanning(np.stack([opened[hit[:, 0]], group[hit[:, 1]]], 1), labels)
        return pa.table({"a": pa.array([int(nodes[i]) for i, _ in found], pa.int64()),
                         "b": pa.array([int(nodes[j]) for _, j in found], pa.int64())})

    return meetings.groupBy("label", "chunk", "size", "block").applyInArrow(compare, LINK)


def components(links: DataFrame) -> DataFrame:
    """node, component (its smallest node) of every node of ``links`` (a, b), by alternating stars."""
    edges = stored(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")), "star")  # plain on both sides of the join: may be split
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stored(large.distinct(), "large-star")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "star")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = stored(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        # Done when every node has one parent and no parent has one itself.
        torn = edges.groupBy("u").agg(F.min("v").alias("v"), F.max("v").alias("w")).filter("v < w").select("u")
        deep = edges.join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").select("u")
        if torn.unionByName(deep).isEmpty():
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def open_sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """node, tokens of the wanted ``nodes`` (node, doc_id), from the whole texts."""
    wanted = nodes.select("node", F.col("doc_id").alias("wanted_id"))
    # 16 bytes a row: broadcast only below a counted bound, otherwise hashed per partition.
    side = F.broadcast(wanted) if wanted.count() <= BROADCAST_NODES else wanted.hint("shuffle_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(side, texts["doc_id"] == side["wanted_id"]).select("node", "text")

    def tokens(batches):
        shingler = Shingler(words)
        for batch in slices(batches):
            nodes, sets = batch.column(0).to_pylist(), shingler.sets(batch.column(1).to_pylist())
            kept = [(n, s) for n, s in zip(nodes, sets) if len(s) and set_id(s) == n]  # an id may repeat with another text
            offsets = pa.array(np.cumsum([0, *(len(s) for _, s in kept)]).astype(np.int32))
            values = np.concatenate([s for _, s in kept]).view(np.int64) if kept else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array([n for n, _ in kept], pa.int64()), pa.array([len(s) for _, s in kept], pa.int64()),
                 pa.ListArray.from_arrays(offsets, pa.array(values))], ["node", "n", "tokens"])

    opened = texts.mapInArrow(tokens, "node long, n long, tokens array<long>")
    return stored(opened, "opened")


def similar_documents(docs: DataFrame, threshold: int = THRESHOLD, words: int = WORDS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs`` (doc_id, text)."""
    if not LEAST_THRESHOLD <= threshold <= 100:
        raise ValueError(f"threshold {threshold}: the size classes cover {LEAST_THRESHOLD} to 100")
    sets = stored(document_sets(docs, threshold, words), "sets")
    named = sets.filter("node IS NOT NULL AND doc_id IS NOT NULL")
    nodes = stored(named.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.max("need").alias("need")), "nodes")
    # One row per node and part: the row of the node's smallest id stands for its copies.
    posted = (named.select("node", "doc_id", "parts").join(nodes.select("node", "doc_id").hint("shuffle_hash"), ["node", "doc_id"])
              .select("node", F.explode("parts").alias("part")))
    shared = stored(posted.groupBy("part").agg(F.min("node").alias("lead"), F.max("node").alias("last"))
                    .filter("lead < last").select("part", "lead"), "shared-parts")
    hits = stored(posted.join(shared, "part").distinct(), "hits")
    # A node that shares fewer parts with all others together than a link leaves has no link.
    able = stored(hits.groupBy("node").agg(F.count(F.lit(1)).alias("parts")).join(nodes, "node").filter("parts >= need")
                  .select("node", "need"), "able")
    hits = stored(hits.join(able, "node"), "able-hits")

    labels = stored(hits.groupBy("node").agg(F.min("lead").alias("label")), "labels")
    wanted = stored(labels.select("node").join(nodes, "node"), "wanted")
    opened = open_sets(docs, wanted, words).dropDuplicates(["node"])
    opened = stored(opened, "open-sets")
    sized = labels.join(opened.select("node", "n"), "node")
    room = F.greatest(F.lit(8), F.least(F.lit(GROUP_MEMBERS), F.floor(F.lit(GROUP_TOKENS) / F.max("n"))))
    chunks = stored(sized.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / room).alias("chunks")), "chunks")
    group = stored(labels.join(chunks, "label").select(
        "label", F.pmod(F.xxhash64("node"), F.col("chunks")).alias("chunk"), "node"), "groups")
    # The label's own node joins every chunk of its group: a member may link with nothing else there.
    anchors = group.select("label", "chunk").distinct().select("label", "chunk", F.col("label").alias("node"))
    inside = stored(links_inside(group.unionByName(anchors).distinct().join(opened.drop("n"), "node"), threshold), "links-inside")

    joined = components(inside)
    placed = stored(group.join(joined, "node", "left").select(
        "label", "chunk", "node", F.coalesce("component", "node").alias("component")), "placed")
    at = stored(hits.select("part", "node", "need").join(placed, "node"), "placed-hits")
    mixed = stored(at.groupBy("part").agg(F.min("component").alias("low"), F.max("component").alias("high"),
                                          F.min(F.struct("label", "chunk")).alias("first"), F.max(F.struct("label", "chunk")).alias("last"))
                   .filter("low < high AND first < last").select("part"), "mixed-parts")
    at = stored(at.join(mixed, "part", "left_semi"), "mixed-hits")
    # Nodes against other groups: enough shared parts for a link, all of them in parts of several components.
    # A part in which the other group only has nodes of the node's own component counts for nothing.
    sides = stored(partner_sizes(at.select("node", "component").distinct().join(opened, "node"), threshold), "sides")
    meet = stored(meetings(at.select("part", "node", "need", "label", "chunk"), sides), "meetings")
    across = links_across(meet.join(opened.drop("n"), "node"), threshold)

    reached = components(inside.unionByName(stored(across, "links-across")))
    smallest = reached.join(nodes, "node").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    named_nodes = nodes.join(reached, "node", "left").join(smallest, "component", "left").select(
        "node", F.coalesce("component_id", "doc_id").alias("component_id"))
    named_nodes = _same_id_one_component(sets, stored(named_nodes, "node-components"))
    out = sets.select("doc_id", F.col("n").alias("n_shingles"), "node").join(named_nodes, "node", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def _same_id_one_component(sets: DataFrame, named_nodes: DataFrame) -> DataFrame:
    """Rows that repeat an id with another text tie the components of their nodes."""
    twice = (sets.filter("node IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
             .agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc_id"))
    if twice.isEmpty():
        return named_nodes
    ids = sets.join(twice, "doc_id", "left_semi").select("doc_id", "node").distinct().join(named_nodes, "node")
    ties = ids.groupBy("doc_id").agg(F.min("component_id").alias("a")).join(ids, "doc_id").select("a", F.col("component_id").alias("b"))
    tied = components(ties)
    return stored(named_nodes.join(tied, named_nodes["component_id"] == tied["node"], "left").select(
        named_nodes["node"], F.coalesce("component", "component_id").alias("component_id")), "tied-components")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(ws[k:k + 2], ' ')) AS sh
      FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(1, len(ws) - 2))) AS k FROM d WHERE len(ws) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
r AS (SELECT s.doc_id, sh, n, row_number() OVER (PARTITION BY s.doc_id ORDER BY f, sh) AS k
      FROM s JOIN c USING (doc_id) JOIN (SELECT sh, count(*) AS f FROM s GROUP BY sh) USING (sh)),
p AS (SELECT * FROM r WHERE k <= n - (90 * n + 99) // 100 + 1),
cand AS (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.sh = b.sh AND a.doc_id < b.doc_id
         WHERE 100 * a.n >= 90 * b.n AND 100 * b.n >= 90 * a.n),
i AS (SELECT cand.a, cand.b, count(*) AS i FROM cand JOIN s x ON x.doc_id = cand.a JOIN s y ON y.doc_id = cand.b AND y.sh = x.sh
      GROUP BY cand.a, cand.b),
l AS (SELECT a, b FROM i JOIN c ca ON ca.doc_id = a JOIN c cb ON cb.doc_id = b WHERE 100 * i >= 90 * (ca.n + cb.n - i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
w(x, y) AS (SELECT a, a FROM e UNION SELECT w.x, e.b FROM w JOIN e ON e.a = w.y),
m AS (SELECT x, min(y) AS component_id FROM w GROUP BY x)
SELECT d.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN m ON m.x = d.doc_id
"""


@register("op9_ngram_jaccard_join", ORACLE)
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_documents(read_table(spark, sf_dir, "documents"))
