"""Homomorphic multiset hash of documents (operator 13, DataFrame functions only).

A text is the multiset of its paragraphs (lines).  Each paragraph is hashed to a
wide vector, and a document's fingerprint is the sum of its paragraphs' vectors:

* identity: the SHA-512 of the paragraph as 16 numbers (the CRC-32 of each four of its
  bytes, a one-to-one map), added modulo 2^32;
* likeness: 128 bits per sentence of the paragraph, drawn from its 64-bit hash and
  counted modulo 2^32, with the number of sentences.  A bit stands for a sign, and
  sums of random signs keep inner products, so how much two texts share can be read
  off their fingerprints.

Addition is commutative and can be undone: texts with the same paragraphs in any
order have equal fingerprints, inserting or deleting a paragraph adds or subtracts
its vector (add_vectors, subtract_vectors), no text has to be read again.

likeness() is 2ab / (aa + bb) of the sums of signs: 1 for equal fingerprints, about
the share of common sentences (counted in both texts) otherwise, with a standard
error of about 0.09 for unrelated texts, kept between 0 and 1.  The hash is meant
for equality and likeness of ordinary data, not against texts made to collide.

A null text is empty; an empty text has one empty paragraph.  Very long texts are
taken whole: their sentences are rows of an aggregate.  Rows stay one by one, so
repeated rows give repeated results.  Other columns cannot clash.

The next document is found by range blocks of falling doc_id: the texts pass one
exchange, and each block gets a copy of the first document of the next block.  Of
rows with one id the order is that of a text hash; a null id ranks as the
smallest 64-bit number.  An id, or an id and text, that holds many rows is cut
into blocks of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, stored, text_or_empty
from .registry import register

IDENTITY_LANES = 16
#: 64-bit hashes per sentence, each giving 64 bits.
SIGN_HASHES = 2
SIGN_LANES = 64 * SIGN_HASHES
PARAGRAPH_END = "\n"
#: What a sentence ends with, and what stands there instead before the text is split at line ends (ideographic marks need no space).
SENTENCE_ENDS = [(". ", ".\n"), ("! ", "!\n"), ("? ", "?\n"), ("。", "。\n"), ("！", "！\n"), ("？", "？\n")]
#: Text bytes of a block, and most blocks (beyond, blocks grow; they may spill).
BLOCK_BYTES, MOST_BLOCKS = 32 << 20, 100_000
HALF = (1 << 32) - 1
#: Both bits of one position in the two halves of a 64-bit hash: counted at once in the halves of a sum.
PAIR = (1 << 32) + 1


# ---------------------------------------------------------------- vectors

def text_units(text: Column) -> Column:
    """Array of the hash of every sentence (h) and the digest of every paragraph (d) of a text."""
    ended = text
    for mark, end in SENTENCE_ENDS:
        ended = F.replace(ended, F.lit(mark), F.lit(end))
    sentences = F.transform(F.split(ended, PARAGRAPH_END, -1), lambda s: F.struct(F.xxhash64(s).alias("h"), F.lit(None).cast("binary").alias("d")))
    paragraphs = F.transform(F.split(text, PARAGRAPH_END, -1), lambda p: F.struct(F.lit(None).cast("long").alias("h"), F.unhex(F.sha2(p, 512)).alias("d")))
    return F.concat(sentences, paragraphs)


def unit_vectors(units: DataFrame, keys: list[str]) -> DataFrame:
    """keys and ``vector`` (n, identity, counts) summed over the rows of ``units`` (keys, h, d).

    Below a hundred columns, so that Spark compiles the aggregate as a whole.
    """
    hashes = [F.when(F.col("h").isNull(), 0).otherwise(F.xxhash64("h", F.lit(k))).alias(f"__h{k}") for k in range(SIGN_HASHES)]
    lanes = [F.coalesce(F.crc32(F.substring("d", 4 * k + 1, 4)), F.lit(0)).alias(f"__d{k}") for k in range(IDENTITY_LANES)]
    counts = [F.sum(F.shiftrightunsigned(F.col(f"__h{k}"), bit).bitwiseAND(F.lit(PAIR))).alias(f"__c{k}_{bit}")
              for k in range(SIGN_HASHES) for bit in range(32)]
    sums = units.select(*keys, F.col("h").isNotNull().cast("long").alias("__n"), *hashes, *lanes).groupBy(*keys).agg(
        F.sum("__n").alias("__n"), *[F.sum(f"__d{k}").alias(f"__d{k}") for k in range(IDENTITY_LANES)], *counts)
    return sums.select(*keys, F.struct(
        F.col("__n").alias("n"), F.array(*[F.col(f"__d{k}").bitwiseAND(HALF) for k in range(IDENTITY_LANES)]).alias("identity"),
        F.array(*[F.col(f"__c{k}_{bit}") for k in range(SIGN_HASHES) for bit in range(32)]).alias("counts")).alias("vector"))


def text_vectors(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys (unique per row) and the ``vector`` of the text column."""
    return unit_vectors(rows.select(*keys, F.explode(text_units(text_or_empty(text))).alias("__u")).select(*keys, "__u.h", "__u.d"), keys)


def _high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def _combined(a: Column, b: Column, sign: int) -> Column:
    low = lambda x, y: (x + sign * y).bitwiseAND(HALF)
    pair = lambda x, y: F.shiftleft(low(_high(x), _high(y)), 32).bitwiseOR(low(x.bitwiseAND(HALF), y.bitwiseAND(HALF)))
    return F.struct(low(a["n"], b["n"]).alias("n"), F.zip_with(a["identity"], b["identity"], low).alias("identity"),
                    F.zip_with(a["counts"], b["counts"], pair).alias("counts"))


def add_vectors(a: Column, b: Column) -> Column:
    """Vector of the union of two multisets of paragraphs."""
    return _combined(a, b, 1)


def subtract_vectors(a: Column, b: Column) -> Column:
    """Vector of ``a`` without the paragraphs of ``b``."""
    return _combined(a, b, -1)


def fingerprint(vector: Column) -> Column:
    """The vector as text: base64 of the number of sentences, the identity and the counts, most significant byte first."""
    digits = lambda numbers, n: F.array_join(F.transform(numbers, lambda x: F.lpad(F.hex(x), n, "0")), "")
    return F.base64(F.unhex(F.concat(F.lpad(F.hex(vector["n"]), 8, "0"), digits(vector["identity"], 8), digits(vector["counts"], 16))))


def dot(a: Column, b: Column) -> Column:
    """Inner product of two vectors' sums of signs (a sign is 1 for a set bit, else -1)."""
    signs = lambda count, n: (2 * count - n).cast("double")
    pair = lambda x, y: (signs(x.bitwiseAND(HALF), a["n"]) * signs(y.bitwiseAND(HALF), b["n"])
                         + signs(_high(x), a["n"]) * signs(_high(y), b["n"]))
    return F.aggregate(F.zip_with(a["counts"], b["counts"], pair), F.lit(0.0), lambda s, x: s + x)


def likeness(a: Column, b: Column, norms: tuple[Column, Column] | None = None) -> Column:
    """Likeness of two vectors from 0 to 1 (1: equal); ``norms`` are their dot products with themselves."""
    own = norms or (dot(a, a), dot(b, b))
    total = own[0] + own[1]
    return F.when(total == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * dot(a, b) / total)))


# ---------------------------------------------------------------- order

def _below(x: Column, cuts: list[int]) -> Column:
    """How many of the ascending ``cuts`` are smaller than ``x``: first among every n-th, then among n."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    parts = [cuts[k:k + step] for k in range(0, len(cuts), step)]
    literal = lambda numbers: F.array(*[F.lit(n).cast("long") for n in numbers])
    heads = F.size(F.filter(literal([p[0] for p in parts]), lambda c: c < x))
    inside = F.size(F.filter(F.element_at(F.array(*map(literal, parts)), heads), lambda c: c < x))
    return F.when(heads == 0, 0).otherwise((heads - 1) * step + inside)


PLACE = ["block", "sub", "part", "piece"]


def in_blocks(docs: DataFrame) -> DataFrame:
    """doc_id, text, rank (ascending with falling id), h (text hash) and the place of a row's block, in the order of the blocks."""
    spark = docs.sparkSession
    rows = docs.select("doc_id", text_or_empty().alias("text")).select(
        "doc_id", "text", F.bitwise_not(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).alias("rank"), F.xxhash64("text").alias("h"))
    count, size = rows.agg(F.count("*"), F.sum(F.octet_length("text").cast("long"))).first()
    blocks = max(1, min(MOST_BLOCKS, -(-(size or 0) // BLOCK_BYTES), count))
    cuts = []
    if blocks > 1:
        shares = [k / blocks for k in range(1, blocks)]
        cuts = rows.agg(F.percentile_approx("rank", shares, max(10_000, 10 * blocks))).first()[0]
    hot = {rank: n for rank, n in Counter(cuts).items() if n > 1}  # an id that fills blocks shows as often among the cuts
    placed = rows.withColumn("block", _below(F.col("rank"), sorted(set(cuts))))
    if not hot:
        return placed.select("*", *[F.lit(0).alias(c) for c in PLACE[1:]])
    # At most one row per cut; of the texts of hot ids at most one per block that they fill.
    ids = spark.createDataFrame(sorted(hot.items()), "rank long, subs int")
    limit = -(-count // blocks)
    copies = (rows.select("rank", "h").join(F.broadcast(ids), "rank").groupBy("rank", "h").count().filter(F.col("count") > limit)
              .select("rank", F.struct("h", F.ceil(F.col("count") / limit).cast("int").alias("pieces")).alias("copy"))
              .groupBy("rank").agg(F.array_sort(F.collect_list("copy")).alias("copies")))
    plan = F.broadcast(ids.join(copies, "rank", "left"))
    own = F.filter("copies", lambda c: c["h"] == F.col("h"))
    is_copy = F.coalesce(F.size(own) > 0, F.lit(False))
    return placed.join(plan, "rank", "left").select(
        *rows.columns, "block",
        # Equal widths of the hash, highest bit flipped so that its order is the signed one.
        F.coalesce((F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 34) * F.col("subs") / (1 << 30)).cast("int"), F.lit(0)).alias("sub"),
        F.coalesce(2 * F.size(F.filter("copies", lambda c: c["h"] < F.col("h"))) + is_copy.cast("int"), F.lit(0)).alias("part"),
        F.when(is_copy, F.pmod(F.monotonically_increasing_id(), F.element_at(own, 1)["pieces"])).otherwise(0).cast("int").alias("piece"))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of in_blocks() with ``next_text``, the document after (after the last the first), ``at`` in the block, and ``copied``.

    Copied rows are the first ones of the next block, held once more at the end of a block.
    """
    rows = in_blocks(docs)
    firsts = rows.groupBy(*PLACE).agg(F.min(F.struct("rank", "h")).alias("first"))
    along = Window.orderBy(*PLACE)  # one row per block
    follow = F.coalesce(F.lead("first").over(along), F.first("first").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    ends = stored(firsts.select(*PLACE, follow.alias("first")).select(*PLACE, "first.rank", "first.h"), "block-ends")
    wanted = F.broadcast(ends.select("rank", "h").distinct())
    texts = rows.select("rank", "h", "doc_id", "text").join(wanted, ["rank", "h"]).dropDuplicates(["rank", "h"])
    copies = stored(ends.join(texts, ["rank", "h"]), "block-copies")  # at most one text per block
    columns = ["doc_id", "text", "rank", "h", *PLACE]
    both = rows.select(*columns, F.lit(False).alias("copied")).unionByName(copies.select(*columns, F.lit(True).alias("copied")))
    order = Window.partitionBy(*PLACE).orderBy("copied", "rank", "h")
    return both.select(*columns, "copied", F.lead("text").over(order).alias("next_text"), F.row_number().over(order).alias("at"))


def edited_text(text: Column, following: Column) -> Column:
    """``text`` with the last half of its code points replaced by as many first ones (or all) of ``following``."""
    n, half = F.char_length(text), F.expr("int(0)") + F.floor(F.char_length(text) / 2).cast("int")
    return F.concat(F.substring(text, 1, n - half), F.substring(following, 1, half))


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, vectors and norms of a document, its edited text and the next document."""
    rows = with_next(docs).withColumn("edited", F.when(~F.col("copied"), edited_text(F.col("text"), F.col("next_text"))))
    keys = [*PLACE, "at", "doc_id", "copied", "n_chars", "edited_sha256"]
    both = F.concat(F.transform(text_units(F.col("text")), lambda u: F.struct(F.lit(0).alias("which"), u["h"].alias("h"), u["d"].alias("d"))),
                    F.when(F.col("copied"), F.array().cast("array<struct<which:int,h:bigint,d:string>>")).otherwise(
                        F.transform(text_units(F.col("edited")), lambda u: F.struct(F.lit(1).alias("which"), u["h"].alias("h"), u["d"].alias("d")))))
    # Columns beside an explode are computed for every row that it makes: these are computed before.
    units = rows.select(*PLACE, "at", "doc_id", "copied", F.char_length("text").cast("long").alias("n_chars"),
                        F.sha2(F.col("edited"), 256).alias("edited_sha256"), both.alias("units")).select(*keys, F.explode("units").alias("u"))
    vectors = unit_vectors(units.select(*keys, "u.which", "u.h", "u.d"), [*keys, "which"])
    vectors = vectors.withColumn("norm", dot(F.col("vector"), F.col("vector")))
    # Original and edited of one document follow one another, then the original of the next.
    order = Window.partitionBy(*PLACE).orderBy("at", "which")
    state = F.struct("vector", "norm")
    out = vectors.select(*keys, "which", state.alias("own"), F.lead(state, 1).over(order).alias("edited"), F.lead(state, 2).over(order).alias("next"))
    return out.filter(~F.col("copied") & (F.col("which") == 0)).select("doc_id", "n_chars", "edited_sha256", "own", "edited", "next")


@register("op13_multiset_fingerprints")
def op13_multiset_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = edited_fingerprints(read_table(spark, sf_dir, "documents"))
    near = lambda other: likeness(F.col("own.vector"), F.col(f"{other}.vector"), (F.col("own.norm"), F.col(f"{other}.norm")))
    return found.select("doc_id", "n_chars", "edited_sha256", fingerprint(F.col("own.vector")).alias("fingerprint"),
                        fingerprint(F.col("edited.vector")).alias("edited_fingerprint"), near("edited").alias("near_edited"), near("next").alias("near_next"))
