"""License scans by a trained paragraph classifier (operator 10, DataFrame functions only).

Paragraphs are lines, and blocks of several lines between blank lines (a wrapped
notice), joined by spaces without the comment markers at line starts.  A block is
reported, by its first line, if it is confirmed and no line in it is confirmed for
the same family alone.  Training draws lines only.  A multinomial logistic regression over sparse word n-grams
names the licence family of a paragraph or "unknown"; the classifier is trained
with Spark ML on variants of the templates below and on a bounded draw of
ordinary paragraphs of the table itself.  A held-out part calibrates the unknown
class: a family counts only above the highest family probability that a held-out
ordinary paragraph reached.  A prediction is confirmed when the paragraph contains
enough of one of the family's templates (share of the template's word pairs).

The features are the template n-grams that hold at least one word which the drawn
ordinary paragraphs do not use (an anchor).  A paragraph without any anchor has no
feature, so only paragraphs with an anchor are scored: all others are "unknown"
by the model itself.

Rows that share a doc_id are one document (null is one id too).  Null and empty
texts have no paragraphs.  Empty tables give no rows.  Extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, text_or_empty
from .registry import register

# Public licence statements and notices by family.
TEMPLATES = {
    "AGPL": ["licensed under the gnu affero general public license",
             "either version 3 of the gnu affero general public license or at your option any later version"],
    "Apache-2.0": ["licensed under the apache license version 2.0",
                   "you may not use this file except in compliance with the license",
                   "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
                   "released under the apache license 2.0", "spdx license identifier apache 2.0"],
    "BSD": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
            "released under the bsd 3 clause license", "licensed under the bsd license",
            "use of this source code is governed by a bsd style license that can be found in the license file"],
    "CC-BY": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "CC-BY-NC": ["licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CC-BY-SA": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CC0": ["released under cc0 1.0 universal public domain dedication",
            "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "GPL": ["this work is licensed under the gnu general public license version 3",
            "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
            "you should have received a copy of the gnu general public license along with this program",
            "released under the gnu general public license version 2 or later", "spdx license identifier gpl 3.0 or later"],
    "ISC": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
            "released under the isc license"],
    "LGPL": ["licensed under the gnu lesser general public license",
             "under the terms of the gnu lesser general public license as published by the free software foundation"],
    "MIT": ["released under the mit license", "licensed under the mit license",
            "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
            "spdx license identifier mit"],
    "MPL-2.0": ["this source code form is subject to the terms of the mozilla public license v 2.0",
                "licensed under the mozilla public license version 2.0"],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
}
UNKNOWN = "unknown"
# Statements about rights that name no family: hard cases of the unknown class.
NO_FAMILY = ["all rights reserved", "copyright by the author all rights reserved", "a driving license is required",
             "the license was revoked by the public office", "see the license file", "this version is released today",
             "general terms and conditions apply", "the software is subject to change without notice",
             "licensed to practise in the state", "free of charge for members", "permission is required to enter",
             "released under embargo", "the public license office is closed", "source and binary", "mit hat die version released"]


@dataclass(frozen=True)
class Settings:
    """``ordinary`` bounds the drawn paragraphs, ``variants`` the copies of each template with words left out."""

    ordinary: int = 4000
    oversampling: int = 8
    variants: int = 24
    drop_percent: int = 12
    containment: float = 0.75
    notice: float = 0.3
    least_threshold: float = 0.5
    ridge: float = 0.0005


def paragraph_words(text: Column) -> Column:
    """Lower-case words: runs of letters and digits, dots inside numbers and names kept ("4.0")."""
    words = F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}.]+|\.(?![\p{L}\p{N}])|(?<![\p{L}\p{N}])\.", " "), " ")
    return F.filter(words, lambda w: w != "")


def ngrams(words: Column) -> Column:
    """Distinct word 1-, 2- and 3-grams."""
    def joined(n):
        at = F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1)))
        return F.filter(F.transform(at, lambda k: F.array_join(F.slice(words, k, n), " ")),
                        lambda g: F.size(F.split(g, " ")) == n)
    return F.array_distinct(F.concat(words, joined(2), joined(3)))


def pairs(words: Column) -> Column:
    """Distinct pairs of consecutive words."""
    at = F.sequence(F.lit(1), F.greatest(F.size(words) - 1, F.lit(1)))
    return F.array_distinct(F.transform(at, lambda k: F.array_join(F.slice(words, k, 2), " ")))


def _share(templates: Column, own: Column) -> Column:
    """The largest share of any template's pairs that ``own`` pairs hold."""
    return F.array_max(F.transform(templates, lambda t: F.size(F.array_intersect(t, own)) / F.size(t)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, line (from 0), paragraph (not blank) of every document."""
    lines = docs.select(F.col("doc_id").alias("doc_id"), F.posexplode(F.split(text_or_empty(), r"\r?\n")).alias("line", "raw"))
    return lines.select("doc_id", "line", F.trim("raw").alias("paragraph")).filter(F.length("paragraph") > 0)


#: Signs that start a comment line, or frame one: they are no part of a notice.
MARKERS = r"(?i)^(?:(?:<!--|//++|/\*++|\*++/?|#++|;++|--++|%++|>++|(?:rem|dnl)(?=\s|$))[ \t]*+){1,3}|(?<!\*)\*++/?$|(?<!#)#++$|-->$"


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, line (its first), last, paragraph of every run of two or more lines between blank lines of a document."""
    lines = F.transform(F.split(text_or_empty(), r"\r?\n"), lambda x, k: F.struct(
        k.alias("line"), F.trim(F.regexp_replace(F.trim(F.regexp_replace(x, r"\s", " ")), MARKERS, "")).alias("words")))
    # One string per document, lines that follow a blank one start a block; no line holds a line end.
    numbered = F.array_join(F.transform(lines, lambda x: F.when(x["words"] == "", "").otherwise(
        F.concat(x["line"].cast("string"), F.lit("\t"), x["words"]))), "\n")
    found = docs.select("doc_id", F.explode(F.split(numbered, "\n{2,}")).alias("block"))
    found = found.select("doc_id", F.split(F.regexp_replace("block", r"^\n+|\n+$", ""), "\n").alias("rows")).filter(F.size("rows") > 1)

    def number(row):
        return F.substring_index(row, "\t", 1).cast("int")

    return found.select("doc_id", number(F.element_at("rows", 1)).alias("line"), number(F.element_at("rows", -1)).alias("last"),
                        F.array_join(F.transform("rows", lambda r: F.regexp_replace(r, r"^\d+\t", "")), " ").alias("paragraph"))


def _template_rows(spark: SparkSession) -> DataFrame:
    rows = [(family, k, t) for family, ts in TEMPLATES.items() for k, t in enumerate(ts)]
    rows += [(UNKNOWN, k, t) for k, t in enumerate(NO_FAMILY)]
    return spark.createDataFrame(rows, "family string, number int, template string").select(
        "family", "number", paragraph_words(F.col("template")).alias("words"))


def training_table(spark: SparkSession, docs: DataFrame, s: Settings) -> tuple[DataFrame, list[str], list[str]]:
    """family, held_out, grams of the training rows; the features (a few per template word); the anchors."""
    templates = _template_rows(spark)
    known_words = [r[0] for r in templates.filter(F.col("family") != UNKNOWN).select(F.explode("words")).distinct().collect()]
    # Only hashes below a bound that leaves some tens of thousands of paragraphs come near the smallest ones.
    share = min(1.0, s.oversampling * s.ordinary / max(1, docs.count()))
    low = min((1 << 63) - 1, int(share * (1 << 64)) - (1 << 63))
    # The draw: paragraphs with the smallest hashes; one that holds a licence word may be a notice and teaches nothing.
    drawn = (paragraphs(docs).filter(~F.lower("paragraph").rlike("licen[sc]|copyright|copyleft|spdx|creativecommons"))
             .withColumn("draw", F.xxhash64("paragraph")).filter(F.col("draw") < low).select("paragraph", "draw").distinct()
             .orderBy("draw", "paragraph").limit(s.ordinary))
    ordinary = drawn.select(F.lit(UNKNOWN).alias("family"), "draw", paragraph_words(F.col("paragraph")).alias("words"))
    # A drawn paragraph that shares much with a template is a notice itself.
    notices = [r["pairs"] for r in templates.filter(F.col("family") != UNKNOWN).select(pairs(F.col("words")).alias("pairs")).collect()]
    every = F.array(*map(F.lit, sorted({p for ps in notices for p in ps})))
    own = F.array_intersect(pairs(F.col("words")), every)  # few are left to hold against each template
    ordinary = ordinary.withColumn("own", own).filter(_share(F.array(*[F.array(*map(F.lit, ps)) for ps in notices]), F.col("own")) < s.notice)
    ordinary = ordinary.select("family", "draw", "words").cache()
    try:
        common = [r[0] for r in ordinary.select(F.explode("words").alias("w")).filter(F.col("w").isin(known_words)).distinct().collect()]
        anchors = sorted(set(known_words) - set(common))
        variant = templates.select("family", "number", "words", F.explode(F.sequence(F.lit(0), F.lit(s.variants - 1))).alias("v"))
        dropped = F.filter("words", lambda w, k: (F.col("v") == 0) | (F.pmod(F.xxhash64(w, k, F.col("v")), F.lit(100)) >= s.drop_percent))
        positive = variant.select("family", F.xxhash64("family", "number", "v").alias("draw"), dropped.alias("words"))
        rows = positive.unionByName(ordinary).select("family", (F.pmod(F.col("draw"), F.lit(4)) == 0).alias("held_out"), ngrams(F.col("words")).alias("grams"))
        grams = (rows.filter(F.col("family") != UNKNOWN).select(F.explode("grams").alias("g")).distinct()
                 .filter(F.arrays_overlap(F.split("g", " "), F.array(*map(F.lit, anchors)))) if anchors else rows.select(F.lit("").alias("g")).limit(0))
        vocabulary = sorted(r[0] for r in grams.collect())  # templates are fixed, so this is too
        # At most variants x templates + ordinary rows, with the features they hold.
        rows = rows.withColumn("grams", F.array_intersect("grams", F.array(*map(F.lit, vocabulary)).cast("array<string>")))
        return spark.createDataFrame(rows.collect(), rows.schema), vocabulary, anchors
    finally:
        ordinary.unpersist()


@dataclass
class Classifier:
    vectors: CountVectorizerModel
    model: LogisticRegressionModel
    families: list[str]
    threshold: float
    anchors: list[str]


def train_classifier(docs: DataFrame, s: Settings = Settings()) -> Classifier | None:
    """None when the table has no paragraph that could teach the unknown class apart from the templates."""
    spark = docs.sparkSession
    rows, vocabulary, anchors = training_table(spark, docs, s)
    if not vocabulary:
        return None
    families = sorted(TEMPLATES) + [UNKNOWN]
    number = F.create_map(*[x for k, f in enumerate(families) for x in (F.lit(f), F.lit(float(k)))])
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="grams", outputCol="features", binary=True)
    data = vectors.transform(rows).select(number[F.col("family")].alias("label"), "held_out", "features").cache()
    try:
        model = LogisticRegression(family="multinomial", regParam=s.ridge, maxIter=60).fit(data.filter(~F.col("held_out")))
        share = F.array_max(F.slice(vector_to_array(F.col("probability")), 1, len(families) - 1))
        seen = model.transform(data.filter(F.col("held_out") & (F.col("label") == len(families) - 1))).agg(F.max(share)).first()[0]
        return Classifier(vectors, model, families, max(s.least_threshold, seen or 0.0), anchors)
    finally:
        data.unpersist()


def scan_licenses(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, line, last, family, probability, containment, confirmed of every paragraph with a feature of the classifier.

    ``last`` is the last line of a block, null for a line; only blocks that hold enough of a template are scored.
    """
    classifier = train_classifier(docs, s)
    spark = docs.sparkSession
    schema = "line int, last int, family string, probability double, containment double, confirmed boolean"
    if classifier is None:
        return spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, {schema}")
    anchor = "(?<![\\p{L}\\p{N}])(?:" + "|".join(a.replace(".", "\\.") for a in classifier.anchors) + ")(?![\\p{L}\\p{N}])"
    templates = {r["family"]: r["all"] for r in _template_rows(spark).filter(F.col("family") != UNKNOWN).select(
        "family", pairs(F.col("words")).alias("pairs")).groupBy("family").agg(F.collect_list("pairs").alias("all")).collect()}
    by_family = F.create_map(*[x for f, ts in sorted(templates.items()) for x in (
        F.lit(f), F.array(*[F.array(*map(F.lit, t)) for t in ts]))])
    every = F.array(*map(F.lit, sorted({p for ts in templates.values() for t in ts for p in t})))
    notices = F.array(*[F.array(*map(F.lit, t)) for f, ts in sorted(templates.items()) for t in ts])
    held = docs.filter(F.lower("text").rlike(anchor))
    lines = paragraphs(held).filter(F.lower("paragraph").rlike(anchor)).select(
        "doc_id", "line", F.lit(None).cast("int").alias("last"), paragraph_words(F.col("paragraph")).alias("words"))
    # Only blocks that hold enough of some template can be confirmed.
    # explode: the filters stay above the words, which are then made once.
    joined = blocks(held).filter(F.lower("paragraph").rlike(anchor)).select(
        "doc_id", "line", "last", F.explode(F.array(paragraph_words(F.col("paragraph")))).alias("words"))
    joined = joined.select("*", F.explode(F.array(F.array_intersect(pairs(F.col("words")), every))).alias("own")).filter(
        _share(notices, F.col("own")) >= s.containment).drop("own")
    scored = classifier.model.transform(classifier.vectors.transform(lines.unionByName(joined).withColumn("grams", ngrams(F.col("words")))))
    names = F.array(*map(F.lit, classifier.families[:-1]))
    found = scored.select("doc_id", "line", "last", "words", F.slice(vector_to_array(F.col("probability")), 1, len(classifier.families) - 1).alias("p"))
    found = found.select("doc_id", "line", "last", pairs(F.col("words")).alias("pairs"), F.array_max("p").alias("probability"),
                         F.element_at(names, F.array_position("p", F.array_max("p")).cast("int")).alias("best"))
    found = found.withColumn("containment", _share(by_family[F.col("best")], F.col("pairs")).cast("double"))
    known = F.col("probability") > classifier.threshold
    return found.select("doc_id", "line", "last", F.when(known, F.col("best")).otherwise(UNKNOWN).alias("family"), "probability", "containment",
                        (known & (F.col("containment") >= s.containment)).alias("confirmed"))


def document_licenses(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, n_licenses, n_unconfirmed, families and findings ("line:family", in line order) per document."""
    found = scan_licenses(docs, s).select("doc_id", F.when(F.col("confirmed"), F.struct("line", "family", "last")).alias("hit"),
                                          (F.col("last").isNull() & (F.col("family") != UNKNOWN) & ~F.col("confirmed")).cast("long").alias("open"))
    every = docs.select("doc_id", F.lit(None).cast("struct<line:int,family:string,last:int>").alias("hit"), F.lit(0).cast("long").alias("open"))
    hits = F.array_sort(F.collect_set("hit"))
    grouped = every.unionByName(found).groupBy("doc_id").agg(hits.alias("every"), F.sum("open").alias("n_unconfirmed"))
    alone = F.filter("every", lambda h: h["last"].isNull())
    # A block that one of its own lines stands for says nothing new.
    new = F.filter("every", lambda h: h["last"].isNull() | ~F.exists(alone, lambda x: (x["family"] == h["family"]) & x["line"].between(h["line"], h["last"])))
    grouped = grouped.select("doc_id", "n_unconfirmed", F.array_sort(F.array_distinct(F.transform(new, lambda h: F.struct(
        h["line"].alias("line"), h["family"].alias("family"))))).alias("hits"))
    return grouped.select("doc_id", F.size("hits").cast("long").alias("n_licenses"), "n_unconfirmed",
                          F.array_join(F.array_sort(F.array_distinct(F.col("hits.family"))), ",").alias("families"),
                          F.array_join(F.transform("hits", lambda h: F.concat_ws(":", h["line"], h["family"])), ",").alias("findings"))


@register("op10_license_scans")
def op10_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_licenses(read_table(spark, sf_dir, "documents"))
