"""Splittable reading of quoted CSV.

A quoted field may hold line ends, so a byte range of a file does not know by
itself where its first record begins.  It is read in two steps:

1. Every range (the splits of the text source) is run through the quote
   automaton from both possible starts, "at a record" and "inside a quoted field",
   which gives its transition function.  Functions are composed along a file by a
   prefix over its ranges, so each range gets its own start.  The same scan tells
   whether all lines are valid UTF-8, else the file is Latin-1.
2. Every range puts its lines together to records from its own start.  What a
   range leaves open is closed by the ranges after it: these few fragments are
   joined per file.

Where no line ends inside a quoted field, each line is a record and Spark's own
line reader is used instead of step 2; the rows are the same.

Blank records are skipped.  A field that is still open at the end of the file ends
there.  Quotes count only at the start of a field (after blanks), are doubled
inside, and what follows a closing quote up to the separator belongs to the field.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

STATES = "file string, start long, from_record boolean, from_quoted boolean, opened boolean, valid boolean"
PIECES = "file string, start long, at int, kind string, record string"


def ends_open(line: bytes, quoted: bool) -> bool:
    """Whether a line that begins at a record (or inside a quoted field) ends inside a quoted field."""
    at, size = 0, len(line)
    while True:
        if not quoted:  # at the start of a field
            while at < size and line[at] in b" \t":
                at += 1
            if at < size and line[at] == 0x22:
                quoted, at = True, at + 1
        if quoted:
            while True:
                at = line.find(b'"', at)
                if at < 0:
                    return True
                if line[at + 1:at + 2] != b'"':
                    break
                at += 2
            quoted, at = False, at + 1
        at = line.find(b",", at)
        if at < 0:
            return False
        at += 1


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, start of the range, line (bytes, without its line feed), in the order of the file within a range."""
    return spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("line"))


def _ranges(batches):
    """(file, start, lines) of the ranges of a partition, batch by batch; ``lines`` of one range may come in several parts."""
    for batch in batches:
        names, starts, texts = (batch.column(k) for k in range(3))
        names, starts, texts = names.to_pylist(), starts.to_pylist(), texts.to_pylist()
        begin = 0
        for at in range(1, len(texts) + 1):
            if at == len(texts) or (names[at], starts[at]) != (names[begin], starts[begin]):
                yield names[begin], starts[begin], texts[begin:at]
                begin = at


def transitions(spark: SparkSession, path: str) -> DataFrame:
    """One row per range: state after it from either start, whether a line ended open, whether all lines are UTF-8."""

    def scan(batches):
        found = {}
        for file, start, texts in _ranges(batches):
            record, quoted, opened, valid = found.get((file, start), (False, True, False, True))
            for line in texts:
                if b'"' in line:
                    record, quoted = ends_open(line, record), ends_open(line, quoted)
                    opened = opened or record
                if valid and not line.isascii():
                    try:
                        line.decode()
                    except UnicodeDecodeError:
                        valid = False
            found[file, start] = record, quoted, opened, valid
        if found:
            columns = list(zip(*[(*k, *v) for k, v in found.items()]))
            types = [pa.string(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)],
                                             ["file", "start", "from_record", "from_quoted", "opened", "valid"])

    return lines(spark, path).mapInArrow(scan, STATES)


def range_starts(states: DataFrame) -> DataFrame:
    """file, start, quoted: whether the range begins inside a quoted field.

    The composition of all functions before a range, applied to "at a record": the last range that does not pass
    its start on (its function is constant) decides, and every swap after it turns the state over.
    """
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    constant = F.col("from_record") == F.col("from_quoted")
    swap = F.col("from_record") & ~F.col("from_quoted")
    swaps = F.coalesce(F.sum(swap.cast("long")).over(earlier), F.lit(0))
    last = F.max(F.when(constant, F.struct("start", "from_record", (F.col("swaps")).alias("swaps")))).over(earlier)
    counted = states.withColumn("swaps", swaps).withColumn("last", last)
    since = F.col("swaps") - F.coalesce(F.col("last.swaps"), F.lit(0))
    return counted.select("file", "start", (F.coalesce(F.col("last.from_record"), F.lit(False)) != (since % 2 == 1)).alias("quoted"))


def _pieces(rows: DataFrame, encoding: str) -> DataFrame:
    """Records that lie in one range, and the open pieces at its ends (kinds tail, head, through)."""

    def assemble(batches):
        last, open_lines, first, number, out = None, [], False, 0, []

        def close(kind):
            nonlocal open_lines, number
            text = b"\n".join(open_lines)
            out.append((*last[:2], number, kind, (text[:-1] if text.endswith(b"\r") and kind in ("record", "head") else text).decode(encoding)))
            open_lines, number = [], number + 1

        def finish():
            if open_lines:
                close("through" if first else "tail")

        def batch_of():
            columns = list(zip(*out))
            out.clear()
            types = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["file", "start", "at", "kind", "record"])

        for batch in batches:
            begun = batch.column(3).to_pylist()
            at = 0
            for file, start, texts in _ranges([batch.select([0, 1, 2])]):
                if last is None or last[:2] != (file, start):
                    finish()
                    last, first, number = (file, start), begun[at], 0
                    quoted = first
                at += len(texts)
                for line in texts:
                    open_lines.append(line)
                    quoted = ends_open(line, quoted) if b'"' in line else quoted
                    if not quoted:
                        close("head" if first else "record")
                        first = False
            if out:
                yield batch_of()
        finish()
        if out:
            yield batch_of()

    return rows.mapInArrow(assemble, PIECES)


def records(spark: SparkSession, path: str, starts: DataFrame, encoding: str) -> DataFrame:
    """file, first (it is the file's first record), record: the text of every record that is not blank."""
    # One row per split of the files, as in Spark's own list of splits.
    rows = lines(spark, path).join(F.broadcast(starts), ["file", "start"]).select("file", "start", "line", "quoted")
    python_codec = "utf-8" if encoding == "UTF-8" else "latin-1"
    pieces = _pieces(rows, python_codec)
    whole = pieces.filter(F.col("kind") == "record").select("file", ((F.col("start") == 0) & (F.col("at") == 0)).alias("first"), "record")
    if not starts.filter("quoted").isEmpty():
        order = Window.partitionBy("file").orderBy("start", "at")  # at most two pieces per range
        broken = pieces.filter(F.col("kind") != "record").withColumn("n", F.sum((F.col("kind") == "tail").cast("long")).over(order))
        parts = F.array_sort(F.collect_list(F.struct("start", "at", "record")))
        joined = broken.groupBy("file", "n").agg(parts.alias("parts")).select(
            "file", ((F.col("parts")[0]["start"] == 0) & (F.col("parts")[0]["at"] == 0)).alias("first"),
            F.array_join(F.transform("parts", lambda p: p["record"]), "\n").alias("record"))
        whole = whole.unionByName(joined)
    else:  # open at the end of its file
        tail = pieces.filter(F.col("kind") == "tail").select("file", ((F.col("start") == 0) & (F.col("at") == 0)).alias("first"), "record")
        whole = whole.unionByName(tail)
    return whole.filter(F.col("record").rlike(r"\S"))
