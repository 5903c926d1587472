"""Secret scans over an incremental blob ledger (operator 1, DataFrame functions only).

Every historical version of a file is addressed by the SHA-256 of its content.
The ledger (Parquet, append only) holds one row per scanned pair of blob and rule
version, also where nothing was found, so a scan opens only blobs that lack some
current rule version; a blob under a thousand paths is opened once.  Findings
are joined back to every path that holds the blob.

Spans are in code points, end exclusive.  A rule's matches are the leftmost
non-overlapping matches of its pattern; those whose counted part is too short
are dropped afterwards, so they still cover the text they matched.

Null content is the empty string.  Paths may be null, repeated or share blobs.
An empty table gives an empty result (and an unchanged ledger).  Only the path
and content columns are used; other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, scratch, stored
from .registry import register


@dataclass(frozen=True)
class Rule:
    """A kind of secret: Java pattern, and the least length of ``group`` (0: the match)."""

    kind: str
    pattern: str
    least: int
    group: int = 0

    @property
    def version(self) -> str:
        """Changes with the rule, so that a changed rule meets only unseen pairs."""
        return hashlib.sha256(f"{self.kind}\0{self.pattern}\0{self.least}\0{self.group}".encode()).hexdigest()[:16]


# The three base kinds, in the order in which ties are listed.  The
# quantifiers of access and hex hold their least length: a match of the open
# pattern is a maximal run, so a short run has no long match inside.
BASE_RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 8, 1),
    Rule("access", r"AKIA[A-Z0-9]{12,}", 16),
    Rule("hex", r"[0-9a-f]{32,}", 32),
)

SPANS = "array<struct<start:int,end:int>>"
LEDGER = T.StructType([T.StructField("blob", T.BinaryType()), T.StructField("rule_version", T.StringType()),
                       T.StructField("kind", T.StringType()),
                       T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()),
                                                                        T.StructField("end", T.IntegerType())])))])


def blob_id(content: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(content.cast("string"), F.lit("")), 256))


def rule_spans(content: Column, rule: Rule) -> Column:
    """Spans of the rule's matches in ``content``, in code points.

    ``split`` gives the gaps and ``regexp_extract_all`` the matches of the same
    scan, so running lengths of gap and match are the positions.
    """
    pattern = F.lit(rule.pattern)
    gaps, matches = F.split(content, rule.pattern, -1), F.regexp_extract_all(content, pattern, F.lit(0))
    parts = F.zip_with(gaps, matches, lambda gap, match: F.struct(
        F.char_length(gap).alias("gap"), F.char_length(F.coalesce(match, F.lit(""))).alias("size"),
        F.char_length(F.regexp_extract(F.coalesce(match, F.lit("")), rule.pattern, rule.group)).alias("counted")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def step(state, part):
        begin = state["at"] + part["gap"]
        found = F.array(F.struct(begin.alias("start"), (begin + part["size"]).alias("end")))
        return F.struct((begin + part["size"]).alias("at"),
                        F.when(part["counted"] >= rule.least, F.concat(state["spans"], found))
                        .otherwise(state["spans"]).alias("spans"))

    spans = F.aggregate(parts, start, step, lambda state: state["spans"])
    return F.when(content.rlike(rule.pattern), spans).otherwise(F.array().cast(SPANS))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        return spark.createDataFrame([], LEDGER)
    return spark.read.schema(LEDGER).parquet(path)


def scan_unseen(versions: DataFrame, addressed: DataFrame, ledger_path: str, rules: tuple[Rule, ...]) -> None:
    """Append to the ledger the pairs of ``addressed`` blobs and ``rules`` that it lacks.

    ``versions`` (path, content) is read for the texts of blobs still to open;
    ``addressed`` is the narrow (path, blob) table of the same rows.
    """
    spark = versions.sparkSession
    current = [r.version for r in rules]
    seen = (read_ledger(spark, ledger_path).filter(F.col("rule_version").isin(current))
            .groupBy("blob").agg(F.collect_set("rule_version").alias("seen")))  # at most one entry per rule
    # One path per blob stands for all its paths.
    first = addressed.groupBy("blob").agg(F.min(F.struct("path")).alias("at"))
    unseen = (first.join(seen, "blob", "left")
              .select("blob", F.col("at.path").alias("path"),
                      F.array_except(F.array(*map(F.lit, current)), F.coalesce("seen", F.array().cast("array<string>"))).alias("todo"))
              .filter(F.size("todo") > 0))
    texts = versions.select("path", F.coalesce(F.col("content").cast("string"), F.lit("")).alias("content"))
    texts = texts.withColumn("blob", blob_id(F.col("content")))
    # The narrow side is hashed; the texts stream past it unsorted.
    opened = (texts.alias("t").join(unseen.hint("shuffle_hash").alias("u"),
                                    (F.col("t.blob") == F.col("u.blob")) & F.col("t.path").eqNullSafe(F.col("u.path")))
              .select("t.blob", "todo", "content"))
    nothing = F.lit(None).cast(SPANS)
    scanned = opened.select("blob", F.array(*[
        F.struct(F.lit(r.version).alias("rule_version"), F.lit(r.kind).alias("kind"),
                 F.when(F.array_contains("todo", r.version), rule_spans(F.col("content"), r)).otherwise(nothing).alias("spans"))
        for r in rules]).alias("results"))
    rows = scanned.select("blob", F.inline("results")).filter(F.col("spans").isNotNull())
    rows.dropDuplicates(["blob", "rule_version"]).write.mode("append").parquet(ledger_path)


def scan_versions(versions: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """Findings of every row of ``versions`` (path, content): path, blob and spans per kind.

    Returns path, blob, findings: array of (start, end, rank, kind) sorted by
    start, then by the order of ``rules``, then by end.
    """
    spark = versions.sparkSession
    addressed = stored(versions.select("path", blob_id(F.col("content")).alias("blob")), "blobs")
    scan_unseen(versions, addressed, ledger_path, rules)
    return addressed.join(blob_findings(spark, ledger_path, rules), "blob", "left").select(
        "path", "blob", F.coalesce("findings", F.array().cast(FINDINGS)).alias("findings"))


FINDINGS = "array<struct<start:int,rank:int,end:int,kind:string>>"


def blob_findings(spark: SparkSession, ledger_path: str, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, findings of the blobs in which the current rules found something."""
    found = read_ledger(spark, ledger_path).filter(
        F.col("rule_version").isin([r.version for r in rules]) & (F.size("spans") > 0))
    rank = F.create_map(*[x for k, r in enumerate(rules) for x in (F.lit(r.version), F.lit(k))])
    found = found.select("blob", "rule_version", F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), rank[F.col("rule_version")].alias("rank"), s["end"].alias("end"),
        F.col("kind").alias("kind"))).alias("part"))
    found = found.dropDuplicates(["blob", "rule_version"])  # a scan that was run twice appended the same rows
    merged = found.groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("part"))).cast(FINDINGS).alias("findings"))
    return stored(merged, "findings")  # few rows; a plain shuffle on both sides lets skewed blobs be split


def span_string(findings: Column) -> Column:
    return F.array_join(F.transform(findings, lambda f: F.concat_ws(":", f["kind"], f["start"], f["end"])), ",")


def secret_digest(found: DataFrame, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """doc_id, n_<kind> of the base kinds, base_sha256 and spans of scan_versions() rows."""
    findings = F.col("findings")
    base = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter(findings, lambda f: f["kind"] == kind)).cast("long")
    of_base = F.filter(findings, lambda f: f["kind"].isin(base))
    return found.select(F.col("path").alias("doc_id"), *[count(k).alias(f"n_{k}") for k in base],
                        F.sha2(span_string(of_base), 256).alias("base_sha256"), span_string(findings).alias("spans"))


def redact(content: Column, findings: Column, mask: str = "[REDACTED]") -> Column:
    """``content`` with every found span, overlaps merged, replaced by ``mask``."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state, f):
        end = F.greatest(state["at"], f["end"])
        gap = F.substring(content, state["at"] + 1, F.greatest(f["start"] - state["at"], F.lit(0)))
        return F.struct(end.alias("at"), F.when(f["start"] < state["at"], state["out"])
                        .otherwise(F.concat(state["out"], gap, F.lit(mask))).alias("out"))

    return F.aggregate(findings, start, step,
                       lambda s: F.concat(s["out"], F.substring(content, s["at"] + 1, F.char_length(content))))


#: Most blobs with findings that are broadcast to their texts; beyond, the texts are shuffled to them.
BROADCAST_BLOBS = 50_000


def redact_documents(docs: DataFrame, ledger_path: str, rules: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """``docs`` (doc_id, text, ...) with every found span masked; n_chars, where there is one, follows the text."""
    versions = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    scan_unseen(versions, stored(versions.select("path", blob_id(F.col("content")).alias("blob")), "blobs"), ledger_path, rules)
    found = blob_findings(docs.sparkSession, ledger_path, rules).withColumnsRenamed({"blob": "__blob", "findings": "__findings"})
    found = F.broadcast(found) if found.count() <= BROADCAST_BLOBS else found.hint("shuffle_hash")
    marked = docs.withColumn("__blob", blob_id(F.col("text"))).join(found, "__blob", "left")
    hit = F.col("__findings").isNotNull()
    out = marked.withColumn("text", F.when(hit, redact(F.col("text"), F.col("__findings"))).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(hit, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


# RE2 knows no code-point-safe case folding switch for ASCII alone, so letters are spelled out.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS rid FROM documents),
m AS (
  SELECT rid, 'assign' AS kind, 0 AS rank, text,
         regexp_extract_all(text, '{assign}') AS ms FROM d
  UNION ALL SELECT rid, 'access', 1, text, regexp_extract_all(text, 'AKIA[A-Z0-9]+') FROM d
  UNION ALL SELECT rid, 'hex', 2, text, regexp_extract_all(text, '[0-9a-f]{{32,}}') FROM d),
e AS (SELECT rid, kind, rank, text, unnest(ms) AS hit, generate_subscripts(ms, 1) AS k FROM m WHERE len(ms) > 0),
w AS (
  WITH RECURSIVE r(rid, kind, rank, text, k, hit, start, stop) AS (
    SELECT rid, kind, rank, text, k, hit, CAST(instr(text, hit) - 1 AS BIGINT), CAST(instr(text, hit) - 1 + length(hit) AS BIGINT)
    FROM e WHERE k = 1
    UNION ALL
    SELECT e.rid, e.kind, e.rank, e.text, e.k, e.hit, r.stop + instr(substr(e.text, r.stop + 1), e.hit) - 1,
           r.stop + instr(substr(e.text, r.stop + 1), e.hit) - 1 + length(e.hit)
    FROM r JOIN e ON e.rid = r.rid AND e.kind = r.kind AND e.k = r.k + 1)
  SELECT rid, kind, rank, start, stop FROM r
  WHERE (kind = 'assign' AND length(regexp_extract(hit, '{assign}', 2)) >= 8)
     OR (kind = 'access' AND length(hit) >= 16) OR kind = 'hex'),
g AS (SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex,
             string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop) AS spans
      FROM w GROUP BY rid)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g USING (rid)
""".format(assign=r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""")


@register("op1_secret_scans", ORACLE)
def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    versions = docs.select(F.col("doc_id").alias("path"), F.col("text").alias("content"))
    return secret_digest(scan_versions(versions, scratch(spark, "secret-ledger")))
