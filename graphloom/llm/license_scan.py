"""License scans with a trained paragraph classifier, in DataFrame and SQL operations only.

Paragraphs (lines, and lines in a row that are a wrapped notice together) are classified by a multinomial logistic regression over sparse word n-grams (one to three words), trained
here on notices of known licence families, whole and with words left out, against ordinary paragraphs of the corpus and
sentences that speak of licences without granting one. The chance of the best family is calibrated on notices held back, and
below the calibrated level a paragraph is ``unknown``. A prediction counts only if the paragraph also shares enough word
pairs with one of the family's templates.

Only n-grams with at least one *telling* word (a word of a template that is not a stop word) are features. A paragraph
without any telling word therefore has no feature at all, gets the score of an empty paragraph, which is ``unknown``, and
needs no further work.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, StopWordsRemover
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

UNKNOWN = "unknown"

#: Short public notices of each family.
TEMPLATES: dict[str, list[str]] = {
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "This project is released under the Apache 2.0 license."],
    "mit": ["Released under the MIT License.", "Licensed under the MIT license. See the license file for details.", "This software is distributed under the terms of the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "Released under the GPL version 3."],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Released under the terms of the GNU GPL version 2 only."],
    "lgpl": ["This library is licensed under the GNU Lesser General Public License, version 2.1.", "Released under the GNU Lesser General Public License, version 3."],
    "agpl-3.0": ["Licensed under the GNU Affero General Public License, version 3."],
    "bsd": ["Licensed under the BSD 3-Clause License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Released under the 2-clause BSD license."],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, version 2.0.", "Licensed under the Mozilla Public License 2.0."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work, and dedicates it to the public domain."],
    "isc": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "proprietary": ["Copyright. All rights reserved. No part of this publication may be reproduced without prior written permission.", "All rights reserved. Unauthorized copying of this file is strictly prohibited and confidential."],
}
#: Sentences with the same words that grant nothing.
OTHER = ["My driving licence was released last week.", "The general public is free to visit the foundation.", "A copy of the version was modified by the author.", "Please read the terms before you use the software.", "The apache helicopter landed near the institute.", "This work was published by a university.", "Version 3 of the program adds new source files.", "Creative work is common in the international school."]

NOISE = ["see", "here", "project", "file", "code", "2019", "2024", "by", "authors", "the", "and"]
#: Words of which a paragraph with any may be a notice itself, so it doesn't teach what is ordinary.
GRANTS = ["license", "licence", "licensed", "licenses", "licences", "licensing", "sublicense", "copyright", "gpl", "lgpl", "agpl", "bsd", "mit", "mpl", "isc", "cc", "cc0", "creative", "permission", "reserved"]
BACKGROUND = 2000  #: paragraphs of the corpus that the classifier learns as ordinary, at most
COPIES = 12  #: altered copies of each notice
SHARE = 0.5  #: of a paragraph's or a template's word pairs that must agree


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_pairs(w: Column) -> Column:
    """Each word with the next; a slice for each pair would copy a long paragraph again and again."""
    pairs = F.zip_with(w, F.slice(w, F.lit(2), F.greatest(F.size(w), F.lit(1))), lambda x, y: F.when(y.isNotNull(), F.concat(x, F.lit(" "), y)))
    return F.filter(pairs, lambda p: p.isNotNull())


def telling_ngrams(w: Column, telling: list[str]) -> Column:
    """The distinct n-grams of one to three words with a telling word: those around each, so that long paragraphs cost little."""
    known = F.array(*map(F.lit, telling))
    hits = F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(known, x), i + 1)), lambda i: i.isNotNull())

    def around(i: Column) -> Column:
        runs = [(i - back, n) for n in (1, 2, 3) for back in range(n)]
        return F.array(*[F.when((start >= 1) & (start + n - 1 <= F.size(w)), F.concat_ws(" ", *[F.get(w, start - 1 + k) for k in range(n)])) for start, n in runs])

    return F.array_distinct(F.filter(F.flatten(F.transform(hits, around)), lambda g: g.isNotNull()))


def telling_words(spark: SparkSession) -> list[str]:
    stop = set(StopWordsRemover.loadDefaultStopWords("english"))
    notices = spark.createDataFrame([(t,) for ts in TEMPLATES.values() for t in ts], "t string")
    return sorted(r["w"] for r in notices.select(F.explode(words(F.col("t"))).alias("w")).distinct().collect() if r["w"] not in stop)


@dataclass
class Classifier:
    families: list[str]
    telling: list[str]
    weights: DataFrame  #: term, w: one weight a class; as many rows as the notices have n-grams
    bias: list[float]
    least: float  #: the calibrated chance below which a paragraph is unknown
    temperature: float


def _training(spark: SparkSession, paragraphs: DataFrame, telling: list[str]) -> DataFrame:
    """label, fold and words of altered notices and of ordinary paragraphs."""
    known = [(f, t) for f, ts in TEMPLATES.items() for t in ts] + [(UNKNOWN, t) for t in OTHER]
    base = spark.createDataFrame(known, "label string, t string").select("label", words(F.col("t")).alias("w"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("copy"))
    chance = lambda *x: F.pmod(F.xxhash64(*x), F.lit(1000))
    drop = F.filter("w", lambda x, i: (F.col("copy") == 0) | (chance(x, i, F.col("copy")) >= 120))
    extra = F.transform(F.sequence(F.lit(1), F.col("copy") % 4 + 1), lambda i: F.get(F.array(*map(F.lit, NOISE)), (F.pmod(F.xxhash64(i, "copy", "label"), F.lit(len(NOISE)))).cast("int")))
    altered = F.when(F.col("copy") % 3 == 1, F.concat(extra, drop)).when(F.col("copy") % 3 == 2, F.concat(drop, extra)).otherwise(drop)
    notices = base.select("label", (F.col("copy") % 4 == 3).alias("held"), altered.alias("w"))
    # ordinary paragraphs that share words with notices teach most, so the sample prefers them
    sample = paragraphs.select(F.xxhash64("paragraph").alias("o"), words(F.col("paragraph")).alias("w")).where(F.size("w").between(3, 60)).withColumn("n", F.size(F.array_intersect("w", F.array(*map(F.lit, telling)))))
    ordinary = sample.where((F.col("n") > 0) & ~F.arrays_overlap("w", F.array(*map(F.lit, GRANTS)))).orderBy("o").limit(BACKGROUND)
    return notices.unionByName(ordinary.select(F.lit(UNKNOWN).alias("label"), (F.pmod("o", F.lit(4)) == 3).alias("held"), "w"))


def train(paragraphs: DataFrame) -> Classifier:
    """Fit on the notices and on a bounded sample of ``paragraphs`` (doc_id, at, paragraph)."""
    spark = paragraphs.sparkSession
    telling = telling_words(spark)
    families = [*sorted(TEMPLATES), UNKNOWN]
    terms = telling_ngrams(F.col("w"), telling)
    data = _training(spark, paragraphs, telling).select((F.array_position(F.array(*map(F.lit, families)), F.col("label")) - 1).cast("double").alias("y"), "held", terms.alias("terms")).persist()
    counts = CountVectorizer(inputCol="terms", outputCol="x", binary=True, minDF=2).fit(data.where(~F.col("held")))
    fitted = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=0.002, elasticNetParam=0.2, maxIter=80).fit(counts.transform(data.where(~F.col("held"))))
    matrix, bias = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    rows = [(t, [float(v) for v in matrix[:, i]]) for i, t in enumerate(counts.vocabulary) if abs(matrix[:, i]).max() > 0]
    weights = spark.createDataFrame(rows, "term string, w array<double>")
    c = Classifier(families, telling, weights, [float(b) for b in bias], 0.5, 1.0)
    # calibration on what was held back: the temperature with the best likelihood, then the level between right notices and the rest
    held = data.where("held").select(F.monotonically_increasing_id().alias("i"), "y", "terms").persist()
    logits = _logits(held.select("i", F.explode_outer(F.array_distinct("terms")).alias("term")), ["i"], c).join(held.select("i", "y"), "i").select("y", "z").collect()
    held.unpersist()
    data.unpersist()
    import numpy as np

    y, z = np.array([int(r["y"]) for r in logits]), np.array([r["z"] for r in logits])
    soft = lambda t: np.exp(z / t - (z / t).max(axis=1, keepdims=True)) / np.exp(z / t - (z / t).max(axis=1, keepdims=True)).sum(axis=1, keepdims=True)
    c.temperature = float(min((0.5, 0.7, 1.0, 1.4, 2.0), key=lambda t: -np.log(np.maximum(soft(t)[np.arange(len(y)), y], 1e-12)).sum()))
    p = soft(c.temperature)
    best, known = p[:, :-1].max(axis=1), y < len(families) - 1
    right = best[known & (p[:, :-1].argmax(axis=1) == y)]
    wrong = best[~known]
    low, high = (np.quantile(right, 0.01) if len(right) else 0.5), (np.quantile(wrong, 0.99) if len(wrong) else 0.0)
    c.least = float(np.clip((low + high) / 2 if low > high else low, 0.2, 0.9))
    return c


def _logits(terms: DataFrame, key: list[str], c: Classifier) -> DataFrame:
    """z: the classes' scores of each key from its exploded terms; the weights have a bounded number of rows."""
    n = len(c.families)
    hit = terms.join(F.broadcast(c.weights), "term", "left")
    sums = hit.groupBy(*key).agg(*[F.sum(F.get("w", F.lit(i))).alias(f"z{i}") for i in range(n)])
    return sums.select(*key, F.array(*[F.coalesce(F.col(f"z{i}"), F.lit(0.0)) + c.bias[i] for i in range(n)]).alias("z"))


def telling_paragraphs(docs: DataFrame, telling: list[str]) -> DataFrame:
    """The paragraphs with at least one telling word; the rest have no feature."""
    known = F.array(*map(F.lit, telling))
    split = docs.select("doc_id", common.text_key(F.col("text")).alias("h"), F.split(F.coalesce("text", F.lit("")), "\n").alias("lines"))
    lines = split.select("doc_id", "h", F.posexplode("lines").alias("at", "paragraph"))
    return lines.where(F.arrays_overlap(F.split(F.lower("paragraph"), r"[^\p{L}\p{N}]+"), known))


def _confirmed(paragraphs: DataFrame, c: Classifier) -> DataFrame:
    """The rows of ``paragraphs`` (doc_id, h, at, paragraph) with a family that a template confirms: also family and chance."""
    spark, key = paragraphs.sparkSession, ["doc_id", "h", "at"]
    # terms go without their paragraph, which may be long
    terms = paragraphs.select(*key, words(F.col("paragraph")).alias("w")).select(*key, F.explode(telling_ngrams(F.col("w"), c.telling)).alias("term"))
    n = len(c.families)
    sums = terms.join(F.broadcast(c.weights), "term").groupBy(*key).agg(*[F.sum(F.get("w", F.lit(i))).alias(f"z{i}") for i in range(n)])
    z = F.array(*[(F.col(f"z{i}") + c.bias[i]) / c.temperature for i in range(n)])
    scored = sums.select(*key, z.alias("z")).withColumn("top", F.array_max("z"))
    scored = scored.withColumn("e", F.transform("z", lambda v: F.exp(v - F.col("top"))))
    total = F.aggregate("e", F.lit(0.0), lambda a, v: a + v)
    known = F.slice("e", F.lit(1), F.lit(n - 1))
    best = F.array_max(known)
    names = F.array(*map(F.lit, c.families))
    picked = scored.select(*key, F.get(names, (F.array_position(known, best) - 1).cast("int")).alias("family"), (best / total).alias("chance")).where(F.col("chance") >= c.least)
    templates = spark.createDataFrame([(f, t) for f, ts in TEMPLATES.items() for t in ts], "family string, t string").select("family", F.array_distinct(word_pairs(words(F.col("t")))).alias("g"))
    k, t = picked.alias("k"), paragraphs.alias("t")
    found = k.join(t, F.col("k.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("k.h") == F.col("t.h")) & (F.col("k.at") == F.col("t.at"))).select("k.*", "t.paragraph")
    own = F.array_distinct(word_pairs(words(F.col("paragraph"))))
    shared = F.size(F.array_intersect(own, F.col("g")))
    agree = F.greatest(shared / F.greatest(F.size("g"), F.lit(1)), F.when(shared >= 3, shared / F.greatest(F.size(own), F.lit(1))).otherwise(0.0))
    # a handful of templates for each paragraph
    matched = found.join(F.broadcast(templates), "family").withColumn("agree", agree).where(F.col("agree") >= SHARE)
    return matched.dropDuplicates(key).select(*key, "paragraph", "family", "chance")


def wrapped(lines: DataFrame) -> DataFrame:
    """Two and more lines in a row (doc_id, h, at, paragraph) as one paragraph at the first of them, with ``lines``, their number.

    Lines without a telling word, blank ones among them, are not in ``lines`` and so part paragraphs.
    """
    # the telling lines of one document
    place = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("at"))
    runs = lines.withColumn("run", F.col("at") - place).groupBy("doc_id", "h", "run").agg(F.sort_array(F.collect_list(F.struct("at", "paragraph"))).alias("l")).where(F.size("l") > 1)
    return runs.select("doc_id", "h", F.col("l")[0]["at"].alias("at"), F.array_join(F.transform("l", lambda x: x["paragraph"]), " ").alias("paragraph"), F.size("l").alias("lines"))


def scan(docs: DataFrame, classifier: Classifier | None = None) -> DataFrame:
    """Paragraphs with a confirmed licence: doc_id, at (the first line), lines, paragraph, family, chance.

    A paragraph is a line, of any length; where no line of several in a row is confirmed by itself, these are one paragraph, as
    a notice that is wrapped. Null and empty texts have no licence. Repeated rows give one result for each distinct (doc_id,
    text). A paragraph has one family: that of the highest chance, and of equal ones the first by name. Any of the family's
    templates confirms it, so equal ones make no difference.
    """
    telling = classifier.telling if classifier else telling_words(docs.sparkSession)
    lines = common.written(telling_paragraphs(docs, telling).dropDuplicates(["doc_id", "h", "at"]), "lines")
    c = classifier or train(lines)
    single = common.written(_confirmed(lines, c).withColumn("lines", F.lit(1)), "single")
    runs = wrapped(lines)
    r, s = runs.alias("r"), single.alias("s")
    within = F.col("r.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("r.h") == F.col("s.h")) & F.col("s.at").between(F.col("r.at"), F.col("r.at") + F.col("r.lines") - 1)
    rest = common.written(r.join(s, within, "left_anti"), "runs")
    several = _confirmed(rest.drop("lines"), c).alias("c")
    k = rest.select("doc_id", "h", "at", "lines").alias("k")
    several = several.join(k, F.col("c.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("c.h") == F.col("k.h")) & (F.col("c.at") == F.col("k.at"))).select("c.*", "k.lines")
    return single.unionByName(several).select("doc_id", "h", "at", "lines", "paragraph", "family", "chance")


def document_licences(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_paragraphs (lines), n_licensed (paragraphs with a licence), families (sorted, comma-joined; ``unknown`` if none).

    Every input row gives one row; null texts count as one empty paragraph. Other columns are ignored.
    """
    rows = docs.select("doc_id", "text")
    found = scan(rows).groupBy("doc_id", "h").agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_set("family")), ",").alias("families"))
    base = rows.select("doc_id", common.text_key(F.col("text")).alias("h"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).cast("long").alias("n_paragraphs"))
    b, f = base.alias("b"), found.alias("f")
    out = b.join(f, F.col("b.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("b.h") == F.col("f.h")), "left")
    return out.select("b.doc_id", "n_paragraphs", F.coalesce("n", F.lit(0)).cast("long").alias("n_licensed"), F.coalesce("families", F.lit(UNKNOWN)).alias("families"))
