"""Each operator against brute force, an exact round trip or held-out accuracy, and on awkward tables."""

import hashlib
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom.llm import bpe, chat, common, decontam, hpylm, license_scan, near_dup, pretok, quality, queries, token_counts, topk, wavelet
from oracle import assert_same, connection

SF = "/root/testdata/sf0.001"
JSON, MULTI = P.path("byte_bpe_50k.json"), P.path("byte_bpe_multi_50k.tiktoken")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns named like the operators' own."""
    long_ = "ab " * 20000 + "x" * 5000
    rows = [(1, None), (2, ""), (3, "a"), (4, long_), (5, "same text of seven words in all"), (5, "same text of seven words in all"), (5, "another text with this id, quite different"), (None, "no id at all here"), (None, None), (6, " \n\t "), (7, "Same text of  seven words\nin all"), (8, "日本語 テキスト é")]
    d = spark.createDataFrame([(i, t) for i, t in rows], "doc_id bigint, text string")
    for c in ("score", "n_hit", "h", "ref", "node", "t", "terms", "pos", "family", "ids", "__text"):
        d = d.withColumn(c, F.lit(1))
    return d


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def con():
    return connection(SF)


def assert_equal_rows(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_against_sql(spark, con, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE[name], con, SF)


# 1


def test_licences_are_found(docs, texts):
    got = {r["doc_id"]: (r["n_licensed"], r["families"]) for r in license_scan.document_licences(docs).collect()}
    family = {"Licensed under the Apache License, Version 2.0.": "apache-2.0", "Released under the MIT License.": "mit", "This work is licensed under the GNU General Public License, version 3.": "gpl-3.0", "Licensed under CC BY-NC 4.0.": "cc-by-nc"}
    for i, t in texts.items():
        want = [family[x] for x in t.split("\n") if x in family]
        assert got[i] == (len(want), ",".join(sorted(set(want))) or "unknown")


def test_licences_of_odd_tables(spark, odd, empty, docs):
    c = license_scan.train(license_scan.telling_paragraphs(docs, license_scan.telling_words(spark)))
    assert license_scan.scan(odd, c).count() == 0 and license_scan.scan(empty, c).count() == 0
    more = [(1, "x\nReleased under the MIT License, see here.\ny"), (2, "My driving licence was released."), (3, "Redistribution and use in source and binary forms, with or without modification, are permitted")]
    got = {(r["doc_id"], r["at"]): r["family"] for r in license_scan.scan(spark.createDataFrame(more, "doc_id bigint, text string"), c).collect()}
    assert got == {(1, 1): "mit", (3, 0): "bsd"}
    assert license_scan.document_licences(odd).count() == odd.count()


PARAPHRASES = [
    ("apache-2.0", "This program is made available under the Apache License, Version 2.0 by its authors."),
    ("apache-2.0", "You may use this code under the terms of the Apache 2.0 license."),
    ("apache-2.0", "(c) 2021 Acme. Licensed under the Apache License, Version 2.0; see LICENSE for the full text."),
    ("mit", "The code in this directory is released under the MIT License."),
    ("mit", "Copyright 2020 Jane Doe, distributed under the MIT License."),
    ("mit", "This tool is licensed under the MIT license, which is quoted below."),
    ("gpl-3.0", "The driver is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0", "You can redistribute it and/or modify it under the terms of the GNU General Public License, either version 3 of the License, or (at your option) any later version."),
    ("gpl-2.0", "All kernel parts are licensed under the GNU General Public License, version 2."),
    ("gpl-2.0", "Our patches are released under the terms of the GNU GPL version 2 only, as is the kernel."),
    ("lgpl", "The shared library is licensed under the GNU Lesser General Public License, version 2.1, for all users."),
    ("agpl-3.0", "The server is licensed under the GNU Affero General Public License, version 3."),
    ("bsd", "Our fork is licensed under the BSD 3-Clause License."),
    ("bsd", "Redistribution and use in source or binary forms, with or without modification, are permitted as long as the following conditions are met:"),
    ("mpl-2.0", "These files are subject to the terms of the Mozilla Public License, version 2.0."),
    ("cc-by", "All photographs are licensed under CC BY 4.0."),
    ("cc-by", "The text is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "The figures are licensed under CC BY-SA 4.0."),
    ("cc-by-sa", "The atlas is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "The recordings are licensed under CC BY-NC 4.0."),
    ("cc0", "The data are released under CC0 1.0 Universal."),
    ("cc0", "To the extent possible under law, the museum has waived all copyright and related rights to these scans."),
    ("isc", "The parser is licensed under the ISC License."),
    ("isc", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is granted to everyone."),
    ("proprietary", "Copyright 2019. All rights reserved. No part of this work may be reproduced without written permission."),
]
ORDINARY = [
    "She renewed her fishing licence before the season and drove north.",
    "The general ordered a public review of version 3 of the plan.",
    "MIT professors published a study of bees last spring.",
    "A copy of the letter was kept, with permission, in the archive.",
    "Please see the file in the source directory and use either version.",
    "The Apache people lived in the southwest for centuries.",
    "The library is open to the public free of charge on Sundays.",
    "No part of the bridge may be closed without notice to the city.",
    "Common rights to the creek were granted by the crown in 1604.",
    "The foundation distributed software to schools in the region.",
]


WRAPPED = [
    ("mit", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation\nfiles (the \"Software\"), to deal in the Software without\nrestriction, including without limitation the rights to use it."),
    ("bsd", "Redistribution and use in source and\nbinary forms, with or without\nmodification, are permitted provided\nthat the following conditions are met:"),
    ("gpl-3.0", "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU\nGeneral Public License as published by the Free Software\nFoundation, either version 3 of the License."),
]


def test_wrapped_notices_are_one_paragraph(spark, docs):
    c = license_scan.train(license_scan.telling_paragraphs(docs, license_scan.telling_words(spark)))
    rows = [(k, f"A first line of prose.\n\n{t}\n\nAnd a last one, quite ordinary.") for k, (_, t) in enumerate(WRAPPED)] + [(9, "Released under the MIT License.\nThe general public came.")]
    got = license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), c).collect()
    assert {r["doc_id"]: r["family"] for r in got} == {k: f for k, (f, _) in enumerate(WRAPPED)} | {9: "mit"}
    assert all(r["paragraph"] == " ".join(dict(rows)[r["doc_id"]].split("\n")[r["at"] : r["at"] + r["lines"]]) for r in got)
    assert any(r["lines"] > 1 for r in got) and [r["lines"] for r in got if r["doc_id"] == 9] == [1]


def plain_scan(c, text):
    """Families of a text's lines, and of rows of lines without any, in plain Python from the fitted weights: {first line: family}."""
    weights, telling = {r["term"]: r["w"] for r in c.weights.collect()}, set(c.telling)
    split = lambda t: [w for w in re.split(r"[^0-9a-z\u00aa-\uffff]+|[\u2010-\u2027\u00ab\u00bb\u00bf\u00d7]+", t.lower()) if w]
    pairs = lambda w: {f"{x} {y}" for x, y in zip(w, w[1:])}

    def family(t):
        w = split(t)
        grams = {" ".join(w[i : i + n]) for n in (1, 2, 3) for i in range(len(w) - n + 1) if telling & set(w[i : i + n])} & set(weights)
        if not grams:
            return None
        z = [(sum(weights[g][k] for g in sorted(grams)) + b) / c.temperature for k, b in enumerate(c.bias)]
        e = [math.exp(x - max(z)) for x in z]
        k = max(range(len(e) - 1), key=lambda i: (e[i], -i))
        if e[k] / sum(e) < c.least:
            return None
        own = pairs(w)
        for template in license_scan.TEMPLATES[c.families[k]]:
            of = pairs(split(template))
            shared = len(own & of)
            if shared / max(1, len(of)) >= 0.5 or (shared >= 3 and shared / max(1, len(own)) >= 0.5):
                return c.families[k]
        return None

    lines = text.split("\n")
    tells = [bool(telling & set(re.split(r"[^0-9a-z\u00aa-\uffff]+", x.lower()))) for x in lines]
    out, at = {}, 0
    while at < len(lines):
        end = at
        while end < len(lines) and tells[end]:
            end += 1
        found = {i: f for i in range(at, end) if (f := family(lines[i]))}
        if not found and end - at > 1 and (f := family(" ".join(lines[at:end]))):
            found = {at: f}
        out |= found
        at = max(end, at + 1)
    return out


def test_scan_against_a_plain_scorer(spark, docs, texts):
    c = license_scan.train(license_scan.telling_paragraphs(docs, license_scan.telling_words(spark)))
    more = {10_000 + k: t for k, (_, t) in enumerate([*PARAPHRASES, *WRAPPED, *((None, t) for t in ORDINARY)])}
    more[20_000] = "\n".join(t for _, t in PARAPHRASES[:6]) + "\n" + "\n".join(ORDINARY)
    every = {i: t for i, t in texts.items() if t} | more
    got = defaultdict(dict)
    for r in license_scan.scan(spark.createDataFrame(list(every.items()), "doc_id bigint, text string"), c).collect():
        got[r["doc_id"]][r["at"]] = r["family"]
    want = {i: f for i, t in every.items() if (f := plain_scan(c, t))}
    assert dict(got) == want and len(want) > 25


def test_licences_of_held_out_paraphrases(spark, docs):
    """Notices that stand in no template word for word: how many are found, and how many of what is found is right."""
    c = license_scan.train(license_scan.telling_paragraphs(docs, license_scan.telling_words(spark)))
    texts = [*PARAPHRASES, *((license_scan.UNKNOWN, t) for t in ORDINARY)]
    templates = {t for ts in license_scan.TEMPLATES.values() for t in ts}
    assert not templates & {t for _, t in texts}
    long_ = "word " * 60_000 + "Released under the MIT License." + " word" * 60_000
    rows = [(i, t) for i, (_, t) in enumerate(texts)] + [(1000, long_)]
    got = {r["doc_id"]: r["family"] for r in license_scan.scan(spark.createDataFrame(rows, "doc_id bigint, text string"), c).collect()}
    assert got.pop(1000, "mit") == "mit"  # one long line: a notice in it or none, but no other
    right = sum(got.get(i) == f for i, (f, _) in enumerate(PARAPHRASES))
    print(f"recall {right / len(PARAPHRASES):.2f}, precision {right / max(1, len(got)):.2f}", {i: (texts[i], got.get(i)) for i in range(len(texts)) if got.get(i, license_scan.UNKNOWN) != texts[i][0]})
    assert right >= 0.8 * len(PARAPHRASES) and right >= 0.95 * len(got)


# 2


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    s, y = got.score.to_numpy(), got.quality.to_numpy()
    wins = (s[y == 1][:, None] > s[y == 0][None, :]).mean()
    assert wins > 0.98 and ((s >= 0) & (s <= 1)).all()


def test_quality_uses_no_held_out_label(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    flipped = labels.withColumn("quality", F.when(common.fold(F.col("doc_id"), 3) == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, quality.classify(docs, x).collect())) for x in (labels, flipped))
    assert a == b


def test_quality_scores_are_the_models(spark, docs, texts):
    """Every score is that of a plain pass over whole texts: sizes by the library, weights as fitted."""
    import zstandard

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(docs.select("doc_id", "text"), labels, common.fold(F.col("doc_id"), 3) != 1)
    size = lambda d, t: sum(len(zstandard.ZstdCompressor(level=3, dict_data=d and zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False).compress(t[i : i + 16384])) - 6 for i in range(0, len(t), 16384))
    got = {r["doc_id"]: r["score"] for r in quality.classify(docs, labels).collect()}
    for i, t in texts.items():
        t = t.encode()
        good, bad, none = (float(max(1, size(d, t))) for d in (model.good, model.bad, None))
        n, difference, ratio = len(t), (bad - good) / (bad + good), math.log((none + 8) / (len(t) + 8))
        long_ = math.log1p(n) / 10
        x = [1, difference, difference * abs(difference), ratio, ratio**2, math.log((min(good, bad) + 8) / (none + 8)), long_, difference * long_, long_**2, ratio * long_]
        assert got[i] == pytest.approx(1 / (1 + math.exp(-sum(a * b for a, b in zip(x, model.weights)))), abs=1e-6)


def test_dictionaries_see_whole_texts():
    assert quality._pieces(b"x" * 2500) == [b"x" * 1024, b"x" * 1024, b"x" * 452] and quality._pieces(b"") == []
    t = bytes(range(256)) * 400
    assert b"".join(quality._pieces(t)) == t


def test_quality_by_the_difference_alone(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    got = quality.classify(spark.read.parquet(f"{d}/documents.parquet"), labels).join(labels, "doc_id").where("held_out").toPandas()
    assert got.difference_score.between(0, 1).all() and ((got.difference_score >= 0.5) == got.quality).mean() > 0.9


def test_quality_of_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 0), (5, 1, 0), (5, 0, 0), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    got = quality.classify(odd, labels)
    assert got.count() == odd.count() and got.where("score IS NULL OR score < 0 OR score > 1").count() == 0
    assert quality.classify(empty, labels).count() == 0
    assert quality.classify(odd, labels.limit(0)).where("score <> 0.5").count() == 0


# 3


@pytest.mark.parametrize("normal", [True, False])
def test_top_k_against_brute_force(spark, normal):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(3000, 12)) * (1 if normal else rng.lognormal(0, 1.5, size=(3000, 1)))
    if normal:
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    v[100:120] = v[50]
    rows = [(i, [float(np.float32(x)) for x in r], 1) for i, r in enumerate(v)]
    rows += [(i, [float(np.float32(x)) for x in rng.normal(size=12)], 1) for i in (0, 0, 3, 3, 60, 100)]  # ids that repeat, with other vectors
    n = len(rows)
    rows += [(5000, None, 1), (5001, [1.0, None] + [0.0] * 10, 1), (5002, [float("nan")] * 12, 1), (5003, [float("inf")] * 12, 1), (5004, [], 1), (None, [0.5] * 12, 1)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 50 == 0).collect()))
    q = np.floor(256 * np.array([r[1] for r in rows[:n]])).astype(np.int64)
    ids, want = np.array([r[0] for r in rows[:n]]), []
    for i in np.flatnonzero(ids % 50 == 0):
        s = q @ q[i]
        s[i] = -(10**15)
        want += [(int(ids[i]), rank, int(ids[a]), int(s[a])) for rank, a in enumerate(np.lexsort((ids, -s))[:5], 1)]
    assert got == sorted(want)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": [r[0] for r in rows], "embedding": pa.array([r[1] for r in rows], pa.list_(pa.float64()))}))
    assert got == sorted(con.execute(queries.ORACLE["op3_exact_top_k"]).fetchall())


def test_top_k_with_an_id_twice(spark):
    rows = [(0, [1.0, 0.5]), (1, [0.9, 0.1]), (1, [0.2, 0.8])]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 62080), (0, 2, 1, 39168)]


def test_top_k_of_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert topk.top_k(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).count() == 0
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema), F.col("vec_id") % 50 == 0).count() == 0
    got = topk.top_k(spark.createDataFrame([(0, [0.0]), (1, [0.0]), (2, [1.0, 1.0])], schema), F.col("vec_id") % 50 == 0).collect()
    assert [tuple(r) for r in got] == [(0, 1, 1, 0)]


def test_top_k_of_huge_components(spark):
    rows = [(0, [1e300, 1.0]), (1, [1e300, -1.0]), (2, [-1e300, 2.0]), (3, [1e17, 5.0]), (4, [0.0, 1e9]), (50, [2.0**40, 3.0]), (6, [2.0**41, 3.0])]
    got = sorted(tuple(r) for r in topk.top_k(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") % 50 == 0).collect())
    near = lambda x: max(-(2**63), min(2**63 - 1, x))
    v = {i: [near(math.floor(256 * x)) for x in e] for i, e in rows}
    want = []
    for q in (0, 50):
        score = {i: near(sum(x * y for x, y in zip(v[q], v[i]))) for i in v if i != q}
        want += [(q, k, i, score[i]) for k, i in enumerate(sorted(score, key=lambda i: (-score[i], i))[:5], 1)]
    assert got == want


# 4


def test_edits_keep_trees_right(monkeypatch):
    c = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    monkeypatch.setattr(token_counts, "RUN", 3)
    monkeypatch.setattr(token_counts, "FULL", 9)
    rng = random.Random(4)
    parts = [" ", "  ", "\n", "\t", "a", "Bc", "é", "1", "'", "s", "re", "!", "word", "　"]
    make = lambda n: "".join(rng.choice(parts) for _ in range(rng.randint(0, n)))
    for _ in range(400):
        t = token_counts.SegmentTree(make(80), c)
        for _ in range(6):
            t.edit(rng.randint(0, len(t.text)), rng.choice([0, 0, 1, 2, 9, 50]), make(rng.choice([0, 2, 12])))
            fresh = token_counts.SegmentTree(t.text, c)
            assert [w for r in t.runs for w in r[0]] == [w for r in fresh.runs for w in r[0]]
            assert t.n_tokens == fresh.n_tokens and t.sums[0][1] == len(t.text)
            t = token_counts.SegmentTree.load(c, *t.columns()[:4])


def test_an_edit_recounts_little():
    c = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    t = token_counts.SegmentTree("some words again " * 5000, c)
    t.edit(40000, 3, "xyz")
    assert t.recounted < 10 and t.n_tokens == token_counts.SegmentTree(t.text, c).n_tokens


def test_whole_texts_are_cut_as_the_pattern_cuts_them():
    c = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    other = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), r"[\s\S]{3}|[\s\S]+")
    rng = random.Random(14)
    parts = [" ", " ", "  ", "\n", "\t", "\u00a0", "\u3000", "\x1c", "a", "Bc", "é", "日本", "1", "'", "s", "'ll", "!", ".", "word", "x" * 300]
    for c in (c, other):
        for _ in range(3000):
            text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 30)))
            pieces = c.cut.findall(text)
            assert c.whole(text) == (list(map(len, pieces)), [len(bpe.merge(p.encode(), c.ranks)) for p in pieces])


def test_counts_of_frequent_pieces_stay(monkeypatch):
    """More distinct pieces than are remembered don't make those forgotten that came first."""
    monkeypatch.setattr(token_counts, "CACHE", 50)
    c = token_counts.Counter(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)
    c.counts([" first"])
    for i in range(300):
        c.counts([f" w{chr(97 + i % 26)}{chr(97 + i // 26)}q"])
    merged, merge = [], bpe.merge
    monkeypatch.setattr(bpe, "merge", lambda piece, ranks: merged.append(piece) or merge(piece, ranks))
    c.counts([" first"])
    assert not merged


def test_a_merge_looks_up_the_pairs_beside_it_only():
    class Watched(dict):
        looks = 0

        def get(self, *a):
            Watched.looks += 1
            return super().get(*a)

    ranks = bpe.load_ranks(P.path("byte_bpe_50k.tiktoken"))
    word = b" ofantherhetionortiandthorlyndofononnthareonbletion"
    assert bpe.merge(word, Watched(ranks)) == bpe.merge(word, ranks) and Watched.looks <= 3 * len(word)


def test_counts_need_no_state(docs):
    """Trees are edited where they were built: no text or tree leaves a task."""
    ranks = P.path("byte_bpe_50k.tiktoken")
    out = token_counts.edited_counts(docs, ranks, P.PATTERN)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    state = token_counts.build(docs, ranks, P.PATTERN)
    by_state = token_counts.edit(state, token_counts.sample_edits(F.col("doc_id"), F.col("text")), ranks, P.PATTERN).select(*out.columns)
    assert sorted(out.collect()) == sorted(by_state.collect())


def test_token_counts_query_and_log(spark, docs, odd, empty, texts):
    from tokenizers import Tokenizer

    ranks = P.path("byte_bpe_50k.tiktoken")
    library = Tokenizer.from_file(JSON)
    got = {r["doc_id"]: r for r in token_counts.edited_counts(docs, ranks, P.PATTERN).collect()}
    for i, t in texts.items():
        h = zlib.crc32(str(i).encode())
        words = ["", " ", "an edited phrase ", "\n\n", "x", "'s"]
        e = t
        for at, cut, new in ((0, h % 3, words[h % 6]), (h % (len(t) + 1), h % 29, words[(h >> 3) % 6]), (len(t), 0, " end.")):
            at = min(at, len(e))
            e = e[:at] + new + e[at + cut :]
        assert got[i]["n_tokens_before"] == len(library.encode(t, add_special_tokens=False).ids) and got[i]["n_tokens"] == len(library.encode(e, add_special_tokens=False).ids)
    assert token_counts.edited_counts(odd, ranks, P.PATTERN).count() == odd.count() and token_counts.edited_counts(empty, ranks, P.PATTERN).count() == 0
    log = spark.createDataFrame([(0, 2, 0, 1, "B"), (0, 1, 0, 0, "A"), (10**9, 1, 0, 0, "?")], "doc_id bigint, seq int, offset int, deleted int, inserted string")
    state = token_counts.build(docs.where("doc_id < 3"), ranks, P.PATTERN)
    after = {r["doc_id"]: r["text"] for r in token_counts.apply_log(state, log, ranks, P.PATTERN).collect()}
    assert after == {0: "B" + texts[0], 1: texts[1], 2: texts[2]}
    twice = spark.createDataFrame([(0, "same"), (0, "same"), (0, "other"), (None, "none"), (None, None), (1, "")], "doc_id bigint, text string")
    log = log.unionAll(spark.createDataFrame([(None, 1, 0, 0, "?"), (1, None, None, None, None)], log.schema))
    after = token_counts.apply_log(token_counts.build(twice, ranks, P.PATTERN), log, ranks, P.PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in after) == [("0", "Bother"), ("0", "Bsame"), ("0", "Bsame"), ("1", ""), ("None", ""), ("None", "none")]
    assert all(r["n_tokens"] == len(library.encode(r["text"], add_special_tokens=False).ids) for r in after)


# 5


def test_contamination_of_odd_tables(spark, odd, empty):
    bench = spark.createDataFrame([(1, "Same text of seven words in all"), (10, "a"), (2, None), (3, ""), (None, "日本語"), (4, "ab " * 10), (4, "ab " * 10)], "item_id bigint, text string")
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontam.contamination(odd, bench).collect()]
    want = [(1, 0, 0, 0, False), (2, 0, 0, 0, False), (3, 1, 1, 1, True), (4, 20001, 20000, 1, True), (5, 7, 7, 1, True), (5, 7, 7, 1, True), (5, 7, 0, 0, False), (None, 5, 0, 0, False), (None, 0, 0, 0, False), (6, 0, 0, 0, False), (7, 7, 7, 1, True), (8, 3, 1, 0, True)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(odd, bench.limit(0)).where("contaminated").count() == 0
    sha = decontam.contamination(odd.where("doc_id = 3"), bench).first()["items_sha256"]
    assert sha == hashlib.sha256(b"10").hexdigest()
    assert decontam.clean(odd, bench).columns == odd.columns and decontam.clean(odd, bench).count() == 6


def test_proximity(spark):
    d = spark.createDataFrame([(1, "alpha x x beta"), (2, "beta alpha"), (3, "alpha x x x x beta")], "doc_id bigint, text string")
    index = decontam.PositionalIndex(d, spark.createDataFrame([("alpha",), ("beta",)], "term string"))
    near = index.near(spark.createDataFrame([(7, "alpha", "beta")], "pair_id long, a string, b string"), 3)
    assert sorted((r["doc_id"], r["pos"], r["other"]) for r in near.collect()) == [(1, 0, 3), (2, 1, 0)]


def test_proximity_in_odd_tables(spark):
    rows = [(1, "alpha beta"), (1, "alpha beta"), (None, "alpha beta"), (2, None), (3, ""), (4, "alpha " * 20000 + "beta"), (5, "alpha")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    index = decontam.PositionalIndex(d, spark.createDataFrame([("alpha",), ("beta",), (None,)], "term string"))
    pairs = spark.createDataFrame([(7, "alpha", "beta"), (8, "alpha", None), (9, "alpha", "gamma"), (None, "beta", "alpha")], "pair_id long, a string, b string")
    near = sorted((str(r["pair_id"]), str(r["doc_id"]), r["pos"], r["other"]) for r in index.near(pairs.where("pair_id IS NOT NULL"), 2).collect())
    assert near == [("7", "1", 0, 1), ("7", "4", 19998, 20000), ("7", "4", 19999, 20000), ("7", "None", 0, 1)]
    assert index.near(pairs.limit(0), 2).count() == 0
    assert decontam.PositionalIndex(d.limit(0), spark.createDataFrame([("alpha",)], "term string")).near(pairs, 2).count() == 0


# 6


def test_encoders_agree_with_the_libraries():
    import tiktoken
    from tokenizers import Tokenizer

    mine, library = wavelet.Encoder(JSON, P.PATTERN), Tokenizer.from_file(JSON)
    ranks = bpe.load_ranks(MULTI)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words, plain = bpe._Words(ranks, P.PATTERN, {}, mark=True), bpe._Words(ranks, P.PATTERN, {})

    def ids(t):
        marked, fresh = words.marked(t)
        return np.frombuffer(bpe._filled(marked, [np.array(bpe.merge(w.encode(), ranks)) for w in fresh]), "<u4").tolist()

    rng = random.Random(5)
    parts = [" ", "  ", "\n", "\t", "a", "B", "é", "1", "'s", "'re", "!", "word", "　", "\xa0", "'", "日", "\x1c", "\x85", "²", "<|endoftext|>", ",", "."]
    for _ in range(6000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert np.frombuffer(mine.encode(t), "<u2").tolist() == library.encode(t, add_special_tokens=False).ids, t
        assert ids(t) == np.frombuffer(plain.encode(t), "<u4").tolist() == other.encode_ordinary(t), t
    for t in ("a" * 3000, "abcabd" * 300, "!?" * 500, "日本" * 200):
        assert bpe.merge(t.encode(), ranks) == other.encode_ordinary(t)


@pytest.mark.parametrize("n", [1, 7, 512, 513, 3000])
def test_wavelet_matrix(n):
    rng = np.random.default_rng(n)
    ids = rng.integers(0, 50257, n)
    ids[::3] = 11
    w = wavelet.WaveletMatrix(n, 16, *wavelet.build(ids, 16))
    assert (w.all() == ids).all() and all(w.access(i) == ids[i] for i in range(0, n, 1 + n // 50))
    a, z = n // 5, n - n // 7
    assert w.count(11, a, z) == (ids[a:z] == 11).sum() and w.count(99_999) == 0
    assert w.occurrences(11, a, z) == [i for i in range(a, z) if ids[i] == 11]


def test_token_output(spark, docs, odd, empty, texts, monkeypatch):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(JSON)
    path = common.scratch(spark, "test-tokens")
    wavelet.write(docs, path, JSON, P.PATTERN, 2)
    got = wavelet.documents(spark, path).orderBy("doc_id").collect()
    at = 0
    for r, i in zip(got, sorted(texts), strict=True):
        ids = [*library.encode(texts[i], add_special_tokens=False).ids, 2]
        assert tuple(r) == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert wavelet.lookup(spark, path, [2]).agg(F.sum("n")).first()[0] == len(texts)
    for d in (odd, empty):
        path = common.scratch(spark, "test-tokens")
        wavelet.write(d, path, JSON, P.PATTERN, 2)
        rows = wavelet.documents(spark, path).orderBy("start").collect()
        assert len(rows) == d.count()
        ids = [r["doc_id"] for r in rows]
        assert ids == sorted(ids, key=lambda x: (x is not None, x or 0)) and [r["start"] for r in rows] == np.cumsum([0] + [r["n_tokens"] for r in rows])[:-1].tolist()


# 7


def test_fold_in_expressions(spark):
    import tiktoken

    ranks = bpe.load_ranks(MULTI)
    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    words = [" zzzqx", " ünïcode", "日本語の", "!?!?!", " thereforewith", "\n \t", "é", "x" * 300, "日é!" * 40, "abcab" * 30, "\x00\x01"]
    words = [w for w in words if w.encode() not in ranks]
    rows = spark.createDataFrame([(1, words), (2, []), (3, None)], "k int, words array<string>").withColumn("words", F.transform("words", bpe.bytes_of))
    got = bpe.fold_words(rows, "words", bpe._constant(spark, ranks))
    got = {r["k"]: r["folded"] for r in got.collect()}
    assert got[1] == [other._encode_single_piece(w.encode()) for w in words] and got[2] == [] and got[3] is None


def test_the_dictionary_has_the_words_used_most(spark):
    d = spark.createDataFrame([("a b b c c c d",), (None,), ("",), ("c d d d",)], "text string")
    assert {r["word"]: r["uses"] for r in bpe.word_uses(d, P.PATTERN).collect()} == {" a": 1, " b": 2, " c": 4, " d": 4, " ": 1}
    assert {r["word"] for r in bpe.frequent_words(d, P.PATTERN, 2).collect()} == {" c", " d"}
    assert {r["word"] for r in bpe.frequent_words(d, P.PATTERN, 9).collect()} == {" b", " c", " d"} and bpe.frequent_words(d, P.PATTERN, 1).count() == 0


def test_round_trip(docs, odd, empty, texts):
    import tiktoken

    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(MULTI), special_tokens={})
    # every word by the fold, and with hardly a dictionary
    assert_equal_rows(bpe.round_trip(docs, MULTI, P.PATTERN), bpe.round_trip(docs, MULTI, P.PATTERN, everywhere=True))
    assert_equal_rows(bpe.round_trip(docs, MULTI, P.PATTERN), bpe.round_trip(docs, MULTI, P.PATTERN, dictionary=1))
    for r in bpe.decode(bpe.encode(docs.withColumn("score `x", F.lit("y")), MULTI, P.PATTERN, ["score `x", "doc_id"]), MULTI).collect():
        assert (r[0], np.frombuffer(r["ids"], "<u4").tolist(), bytes(r["decoded"]).decode()) == ("y", other.encode_ordinary(texts[r["doc_id"]]), texts[r["doc_id"]])
    for r in bpe.round_trip(docs, MULTI, P.PATTERN).collect():
        ids = other.encode_ordinary(texts[r["doc_id"]])
        assert tuple(r)[1:] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    got = bpe.round_trip(odd, MULTI, P.PATTERN).collect()
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    assert sorted((str(r["doc_id"]), r["decoded_sha256"]) for r in got) == sorted((str(r["doc_id"]), sha(r["text"])) for r in odd.collect())
    assert bpe.round_trip(empty, MULTI, P.PATTERN).count() == 0


# 8


def test_preferences(spark):
    t = lambda *x: [{"turn": i, "role": r, "text": s} for i, (r, s) in enumerate(x)]
    u, a, b = ("user", "hi"), ("assistant", "yes"), ("assistant", None)
    rows = [(1, t(u, a), t(u, b)), (2, t(u, a), t(u, a)), (3, t(u), t(a)), (4, None, t(u)), (5, t(u, a, u), t(u, a))]
    d = spark.createDataFrame(rows, "pair_id long, chosen array<struct<turn:int,role:string,text:string>>, rejected array<struct<turn:int,role:string,text:string>>")
    got = {r["pair_id"]: r for r in chat.format_pairs(d).collect()}
    assert [got[i]["n_common"] for i in (1, 2, 3, 4, 5)] == [1, 2, 0, 0, 2]
    r = got[1]
    assert r["prompt"] == "<|im_start|>user\nhi<|im_end|>\n" and r["rejected"] == "<|im_start|>assistant\n<|im_end|>\n"
    assert [r["chosen"][s["start"] : s["end"]] for s in r["chosen_learn"]] == ["yes<|im_end|>\n"]
    assert got[2]["chosen"] == "" and got[4]["chosen"] == "" and got[5]["chosen_learn"] == []
    turns = spark.createDataFrame([(1, 0, "user", "q", 1), (1, 0, "user", "q", 2), (1, 1, None, None, 1), (None, 0, "user", "x", 1), (2, None, "user", "x", 1)], "conv_id bigint, turn int, role string, text string, prompt int")
    assert [len(r["turns"]) for r in chat.conversations(turns).collect()] == [2]
    assert chat.format_pairs(chat.next_answer_pairs(turns)).count() == 1 and chat.format_pairs(chat.next_answer_pairs(turns.limit(0))).count() == 0


def test_preferences_of_a_long_conversation(spark):
    n, long = 20001, "word " * 100000
    turns = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").cast("int").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.when(F.col("id") == 7, long).otherwise(F.concat(F.lit("turn "), "id")).alias("text"))
    r = chat.conversations(turns).first()
    assert len(r["turns"]) == n
    both = chat.conversations(turns).select(F.lit(1).alias("pair_id"), F.slice("turns", 1, n - 1).alias("chosen"), F.concat(F.slice("turns", 1, n - 2), F.slice("turns", n, 1)).alias("rejected"))
    got = chat.format_pairs(both).first()
    assert got["n_common"] == n - 2 and long in got["prompt"] and got["prompt"].count("<|im_start|>") == n - 2
    assert f"turn {n - 2}" in got["chosen"] and f"turn {n - 1}" in got["rejected"]


# 9


def _tokens(t):
    return [*(t or "").encode().lower().split(), b""]


def test_language_model(docs, texts):
    got = {r["doc_id"]: r for r in hpylm.scores(docs).collect()}
    c = Counter(w for i, t in texts.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in _tokens(t))
    n, v = sum(c.values()), len(c)
    better = Counter()
    for i, t in texts.items():
        r, w = got[i], _tokens(t)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 7 == 2) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w))
        if r["held_out"]:
            better.update(model=r["score"], base=r["base_score"])
    assert better["model"] > better["base"]


def test_language_model_of_odd_tables(odd, empty):
    got = hpylm.scores(odd).collect()
    assert len(got) == odd.count() and all(r["score"] <= 1e-9 and r["n_tokens"] >= 1 for r in got)
    # two rows are the same, a third has the id only; crc32("5") % 7 is not 2, so they are learnt from
    same = [r for r in got if r["doc_id"] == 5]
    assert sorted(r["n_tokens"] for r in same) == [8, 8, 8] and len({r["score"] for r in same}) == 2 and all(r["n_known"] == 8 for r in same)
    assert all(r["n_tokens"] == 1 for r in got if r["doc_id"] in (1, 2, 6))
    assert hpylm.scores(empty).count() == 0


def test_predictions_sum_to_one(docs):
    m = hpylm.Model(docs.select("text"))
    rows = {r["bucket"]: r for r in m.keys.collect()}
    keys, own = [], []
    for k, r in rows.items():
        d, c = hpylm._unpack(r["data"], ("<i8", r["n"]), ("<i8", r["n"]))
        keys.append(np.cumsum(d))
        own.append(hpylm._own(m.samples, np.cumsum(d), c, m.n_dishes, k))
    keys, own = np.concatenate(keys), np.concatenate(own)
    for u in (0, m.n_contexts - 1, m.n_contexts - 2):
        w = np.arange(m.n_dishes)
        backed = np.mean([after.backed_off(np.full(len(w), u), w) for _, after in m.samples], axis=0)
        assert backed.sum() + own[keys // m.n_dishes == u].sum() == pytest.approx(1.0, abs=1e-6)


def test_scores_against_brute_force(spark):
    """Every token's chance from the drawn seatings, one at a time, words above and below the dishes' share."""
    rng = random.Random(1)
    words = [f"w{k}" for k in range(60)]
    texts = {i: " ".join(words[int(60 * rng.random() ** 3)] + rng.choice(["", "", ".", str(rng.randint(0, 999))]) for _ in range(rng.randint(0, 60))) for i in range(150)}
    old, hpylm.DISH_SHARE = hpylm.DISH_SHARE, 1e-3
    try:
        d = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
        m = hpylm.Model(d.where("doc_id < 120").select("text"))
        got = {r["doc_id"]: (r["n_known"], r["score"]) for r in m.score(d).collect()}
    finally:
        hpylm.DISH_SHARE = old
    c = Counter(w for i, t in texts.items() if i < 120 for w in _tokens(t))
    dishes, n = m.coder.value, sum(c.values())
    ids = {w: k for k, w in enumerate(dishes)}
    assert set(dishes) == {w for w in c if c[w] >= max(1, n * 1e-3)} and 0 < len(dishes) < len(c)
    rare = len(dishes)
    counts, own = Counter(), {}
    for i, t in texts.items():
        x = [ids.get(w, rare) for w in _tokens(t)]
        if i < 120:
            counts.update(zip([rare + 1, *x], x))
    for r in m.keys.collect():
        k, v = hpylm._unpack(r["data"], ("<i8", r["n"]), ("<i8", r["n"]))
        k = np.cumsum(k)
        assert all(counts[divmod(int(a), rare + 1)] == b for a, b in zip(k, v))
        own |= dict(zip(k.tolist(), hpylm._own(m.samples, k, v, rare + 1, r["bucket"])))
    assert len(own) == len(counts)
    n_rare, v_rare = sum(c[w] for w in c if w not in ids), sum(w not in ids for w in c)
    for i, t in texts.items():
        total, before = 0.0, rare + 1
        for w in _tokens(t):
            k = ids.get(w, rare)
            p = own.get(before * (rare + 1) + k, 0.0) + np.mean([(x.strength + x.discount * x.tables[before]) / (x.strength + x.customers[before]) * x.root[k] for _, x in m.samples])
            total += math.log10(p) + (math.log10((c[w] + 1) / (n_rare + v_rare + 1)) if k == rare else 0)
            before = k
        assert got[i] == (sum(c[w] > 0 for w in _tokens(t)), pytest.approx(total, rel=1e-5, abs=1e-5))


def _log_stirling(c, d):
    row = [0.0]
    for n in range(1, c):
        row = [np.logaddexp(row[t - 1] if t else -np.inf, (row[t] if t < n else -np.inf) + math.log(n - d * (t + 1)) if t < n else -np.inf) for t in range(n + 1)]
    return np.array(row)


@pytest.mark.parametrize("c", [2, 10, 48, 49, 300])
def test_table_counts_follow_their_conditional(c):
    rng, d, m = np.random.default_rng(0), 0.6, 1.5
    drawn = hpylm.draw_tables(np.full(6000, c), np.full(6000, m), d, rng)
    w = _log_stirling(c, d) + np.arange(1, c + 1) * math.log(m)
    p = np.exp(w - w.max())
    p /= p.sum()
    t = np.arange(1, c + 1)
    mean = (p * t).sum()
    sd = math.sqrt((p * (t - mean) ** 2).sum())
    assert drawn.min() >= 1 and drawn.max() <= c
    assert drawn.mean() == pytest.approx(mean, abs=4 * sd / math.sqrt(6000) + 1e-9) and drawn.std() == pytest.approx(sd, rel=0.05)


def test_seatings_of_a_restaurant_follow_their_posterior():
    """Many chains of one restaurant, from one table a dish, against the posterior enumerated over all table counts."""
    d, a, share, customers, chains = 0.6, 1.5, np.array([0.4, 0.25]), np.array([10, 3]), 20000
    logs = [_log_stirling(int(c), d) for c in customers]
    rising = lambda t: sum(math.log(a + d * i) for i in range(1, t))
    weight = {(i, j): logs[0][i - 1] + logs[1][j - 1] + i * math.log(share[0]) + j * math.log(share[1]) + rising(i + j) for i in range(1, 11) for j in range(1, 4)}
    total = np.logaddexp.reduce(list(weight.values()))
    p = {k: math.exp(w - total) for k, w in weight.items()}
    mean = np.array([sum(q * k[i] for k, q in p.items()) for i in (0, 1)])
    variance = sum(q * (k[0] + k[1]) ** 2 for k, q in p.items()) - mean.sum() ** 2
    rng, dish, context = np.random.default_rng(4), np.tile([0, 1], chains), np.repeat(np.arange(chains), 2)
    tables = np.full(chains, 2.0)
    for _ in range(12):
        level = hpylm.Level(share, share, np.full(chains, 13.0), tables, d, a, rng)
        t = hpylm.draw_tables(np.tile(customers, chains), level.new_table(context, dish), d, rng)
        tables = np.bincount(context, weights=t)
    assert [t[dish == i].mean() for i in (0, 1)] == pytest.approx(mean, abs=0.05)
    assert tables.var() == pytest.approx(variance, rel=0.05)
    # the share of each pair of counts, not their moments only
    seen = Counter(zip(t[0::2].tolist(), t[1::2].tolist()))
    assert max(abs(seen[k] / chains - q) for k, q in p.items()) < 0.015


def test_root_shares_follow_their_posterior():
    rng = np.random.default_rng(5)
    truth = rng.dirichlet(np.full(400, 0.5))
    customers = rng.multinomial(50_000, truth)
    draws = [hpylm.draw_root(customers, rng) for _ in range(200)]
    drawn, expected = np.array([x for x, _ in draws]), np.mean([y for _, y in draws], axis=0)
    assert drawn.sum(axis=1) == pytest.approx(np.ones(200)) and expected.sum() == pytest.approx(1.0)
    assert drawn.mean(axis=0) == pytest.approx(expected, abs=4e-4)
    # a strength of 200 made these shares, half a count a dish
    rare = np.flatnonzero(customers == 0)
    assert len(rare) == 0 or 0.2 / 50_000 < expected[rare].mean() < 1.0 / 50_000


def test_perplexity(docs):
    got = {r["held_out"]: r for r in hpylm.perplexity(hpylm.scores(docs)).collect()}
    assert got[True]["model"] < 0.8 * got[True]["base"] and got[False]["model"] < got[True]["model"]


def test_many_customers_are_seated(monkeypatch):
    drawn = hpylm.draw_tables(np.full(500, 5000), np.full(500, 2.0), 0.5, np.random.default_rng(0))
    assert drawn.min() >= 1 and drawn.max() <= 5000
    assert hpylm._log_gamma(np.array([0.1, 1.0, 7.5, 200.0])) == pytest.approx([math.lgamma(x) for x in (0.1, 1.0, 7.5, 200.0)], abs=1e-8)


@pytest.mark.parametrize("d", [0.2, 0.6])
@pytest.mark.parametrize("m", [0.5, 30.0, 2e4])
def test_tables_of_many_customers_follow_their_conditional(d, m):
    c = 1500
    (_, row), t = next(hpylm._ratio_rows(d, np.array([c]))), np.arange(1, c + 1)
    exact = row + math.lgamma(c - d) - math.lgamma(1 - d)
    assert hpylm._log_stirling(np.full(c, c), t, d) == pytest.approx(exact, abs=1e-6)
    p = np.exp(row + t * math.log(m) - (row + t * math.log(m)).max())
    p /= p.sum()
    drawn = hpylm.draw_tables(np.full(2000, c), np.full(2000, m), d, np.random.default_rng(0))
    mean = (p * t).sum()
    sd = math.sqrt((p * (t - mean) ** 2).sum())
    assert drawn.mean() == pytest.approx(mean, abs=4 * sd / math.sqrt(2000)) and drawn.std() == pytest.approx(sd, rel=0.08)
    # of any size
    assert hpylm._log_stirling(10**9, 1, d) == pytest.approx(math.lgamma(10**9 - d) - math.lgamma(1 - d), rel=1e-9)


def test_dishes_of_any_number_of_customers_tell_the_discount():
    """Sums of the logarithms of all dishes, which are up to 48, up to 1,024 and more customers large, are those of each."""
    counts, tables = np.array([30, 48, 49, 700, 1024, 1025, 4000]), np.array([3, 1, 7, 40, 2, 90, 300])
    histogram, larger = hpylm._histogram(counts, tables).reshape(hpylm.LARGE + 1, -1), hpylm._larger(counts, tables) * hpylm.UNIT
    for d, more in list(zip(hpylm.DISCOUNTS, larger))[::8]:
        one = sum((row + math.lgamma(c - d) - math.lgamma(1 - d))[t - 1] for c, t in zip(counts.tolist(), tables.tolist()) for _, row in hpylm._ratio_rows(d, np.array([c])))
        assert hpylm._log_seatings(histogram, d) + more == pytest.approx(one, abs=1e-4)


def test_parameters_are_found_again():
    """Seatings drawn by one discount and strength are explained by about these."""
    rng, d, a = np.random.default_rng(2), 0.6, 4.0
    tables, customers, histogram = [], [], np.zeros((49, 49), dtype=np.int64)
    for _ in range(300):
        sizes = []
        for n in range(40):
            k = rng.choice(len(sizes) + 1, p=np.array([*(s - d for s in sizes), a + d * len(sizes)]) / (n + a))
            sizes = [*sizes, 1] if k == len(sizes) else [s + (i == k) for i, s in enumerate(sizes)]
        tables.append(len(sizes))
        customers.append(40)
        for s in sizes:  # each table a dish of its own
            histogram[s, 1] += 1
    got = [hpylm.draw_parameters(histogram, np.array(tables), np.array(customers), 0.5, 1.0, rng)]
    for _ in range(20):
        got.append(hpylm.draw_parameters(histogram, np.array(tables), np.array(customers), *got[-1], rng))
    assert np.mean([x for x, _ in got[5:]]) == pytest.approx(d, abs=0.08) and np.median([y for _, y in got[5:]]) == pytest.approx(a, rel=0.5)


# 10


def _classes(texts, least=0.8):
    sets = {}
    for i, t in texts.items():
        w = WORD.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    shared = Counter((a, b) for ids in where.values() for k, a in enumerate(ids) for b in ids[k + 1 :])
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for (a, b), n in shared.items():
        if n / (len(sets[a]) + len(sets[b]) - n) >= least:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {i: find(i) for i in sets}


def test_near_duplicates(docs, texts):
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(docs).collect()}
    assert got == _classes(texts)


def test_near_duplicates_of_a_larger_table(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(d).collect()}
    assert got == _classes({r["doc_id"]: r["text"] or "" for r in d.select("doc_id", "text").collect()})


def test_near_duplicates_of_a_large_group(spark):
    rng = random.Random(8)
    base = [f"w{rng.randint(0, 10**6)}" for _ in range(300)]
    texts = {}
    for i in range(400):
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"v{rng.randint(0, 10**6)}"
        texts[i] = " ".join(w)
    texts |= {1000 + i: " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(100)) for i in range(100)}
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == _classes(texts)


def test_near_duplicates_of_a_template(spark):
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    base = words(240)
    # the first two share 236 of 280 shingles, any others 236 of 308 or 336
    texts = [(i, " ".join(base + words(22 if i < 2 else 50))) for i in range(900)]
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    assert got == {i: 0 if i < 2 else i for i in range(900)}


def test_near_duplicates_with_repeated_passages(spark):
    rng = random.Random(10)
    words = lambda n: [f"w{rng.randint(0, 10**6)}" for _ in range(n)]
    texts = {}
    for i in range(12):
        own, passage = words(180), words(24)
        texts[i], texts[1000 + i] = " ".join(own + passage), " ".join(own + passage * 50)
    got = {r["doc_id"]: r["class_id"] for r in near_dup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")).collect()}
    assert got == _classes(texts) == {i: i % 1000 for i in texts}


def test_near_duplicates_of_odd_tables(odd, empty):
    got = [(r["doc_id"], r["class_id"], r["n_class"]) for r in near_dup.near_duplicates(odd).collect()]
    want = [(1, 1, 1), (2, 2, 1), (3, 3, 1), (4, 4, 1), (5, 5, 3), (5, 5, 3), (5, 5, 1), (None, None, 1), (None, None, 1), (6, 6, 1), (7, 5, 3), (8, 8, 1)]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert near_dup.near_duplicates(empty).count() == 0
    kept = near_dup.deduplicated(odd)
    assert kept.columns == odd.columns and kept.count() == 10


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(1)
    h = rng.integers(1, 2**63, 300).astype(np.uint64)
    x, y = rng.integers(1, 6, 300).astype(float), rng.integers(1, 6, 300).astype(float)
    m = 4096
    sig = near_dup.registers(np.r_[np.zeros(200, int), np.ones(200, int)], np.r_[h[:200], h[100:]], np.r_[x[:200], y[100:]], 2, m)
    x[200:], y[:100] = 0, 0
    own = [1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in range(300)) for i in range(100, 200)]
    assert (sig[0] == sig[1]).mean() == pytest.approx(sum(own), abs=0.03)
    a, b = np.sort(h[:200]), np.sort(h[100:])
    both = near_dup.similarity(a, x[:200][np.argsort(h[:200])].astype(int), b, y[100:][np.argsort(h[100:])].astype(int))
    assert both == pytest.approx(max(sum(own), 100 / 300))


def test_the_cutter_is_unicodes():
    assert pretok.cutter(P.PATTERN).findall("a\x1cb") == ["a", "\x1c", "b"]


def test_large_classes_of_a_bucket_meet_each_other(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    node = lambda c, i: bytes([c]) * 8 + i.to_bytes(8, "big")
    sets = {node(c, i): np.arange(100, dtype="<u8") + (1000 * (100 * c + i) if i else 10 * c) for c in (1, 2, 3) for i in range(20)}
    sets[node(3, 0)] += np.uint64(10**6)
    rows = [(0, 0, n, node(n[0], 0)) for n in sets]
    labelled = spark.createDataFrame(rows, "band int, key long, node binary, comp binary")
    several = spark.createDataFrame([(0, 0, len(rows))], "band int, key long, n long")
    dealt = near_dup._dealt(labelled, several, spark.createDataFrame([(n, 100) for n in sets], "node binary, size long"))
    assert dealt.where("whole IS NULL").isEmpty()
    found = near_dup._block_links(dealt, spark.createDataFrame([(n, h.tobytes(), None) for n, h in sets.items()], "node binary, h binary, n binary"))
    assert [(bytes(r["a"]), bytes(r["b"])) for r in found.collect()] == [(node(1, 0), node(2, 0))]


def test_deduplication_shuffles_no_texts_while_few_go_or_few_stay(spark, monkeypatch):
    from graphloom.llm import decontam, near_dup

    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 5)
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(20))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for texts, kept in ([text(i) for i in range(12)] + [text(3)] * 2, list(range(12))), ([text(i % 3) for i in range(12)], [0, 1, 2]):
            out = near_dup.deduplicated(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert sorted(r["doc_id"] for r in out.collect()) == kept
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
