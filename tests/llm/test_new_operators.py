"""Flat graph, fill-in-middle and phrases against brute force, their SQL and awkward tables."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import common, fim, flat_graph, phrases, queries
from oracle import FOLDER, assert_same, connection


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    common.ship(spark)


@pytest.fixture(scope="module")
def con():
    return connection()


@pytest.mark.parametrize("name", ["op12_fill_in_middle", "op13_phrase_collocations"])
def test_sql(spark, con, name):
    assert_same(spark, queries.QUERIES[name], queries.ORACLE[name], con)


# fill-in-middle


@pytest.mark.parametrize("n,share", [(0, 0.5), (1, 1.0), (7, 0.3), (512, 0.5), (513, 0.01), (5000, 0.9), (5000, 0.0)])
def test_rank_and_select_equal_a_plain_count(n, share):
    mask = np.random.default_rng(n).random(n) < share
    bits = fim.Bits(mask)
    at = np.arange(n + 1)
    assert bits.total == mask.sum()
    assert (bits.rank(at) == np.concatenate([[0], np.cumsum(mask)])).all()
    if mask.any():
        assert (bits.select(np.arange(1, bits.total + 1)) == np.flatnonzero(mask)).all()


def plain_fim(doc_id, text):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    i, j = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")):
        return n, "plain", None, None, text
    if h4 % 100 < 50:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_fill_in_middle_of_odd_texts(spark):
    rng = random.Random(3)
    texts = [None, "", "\n", "\n\n", "a", "a\n", "\na", "é\n日本\n", "<P>\nx\n", "x<S>", "<M", "P>\n<", "<P\n>", "<S<\nS>", "\r\n x \x85 y\n z", "long line " * 50000, "l\n" * 70000]
    texts += ["".join(rng.choice("ab\n\né<>PSM日") for _ in range(rng.randrange(200))) for _ in range(300)]
    ids = [None if k == 5 else k // 2 for k in range(len(texts))]
    d = spark.createDataFrame(list(zip(ids, texts)), "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("n", "form", "output", "own_digest", "h1")})
    out = fim.fill_in_middle(d).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    got = Counter((r["doc_id"], r["text"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) for r in out)
    assert got == Counter((i, t or "", *plain_fim(i, t)) for i, t in zip(ids, texts))
    assert all(r["back"] == r["text"] for r in out)


def test_fill_in_middle_shares_and_markers(spark):
    d = spark.range(400).select(F.col("id").alias("doc_id"), F.concat(F.lit("a\nb\n<P>"), "id").alias("text"))
    marks = fim.Markers("[p]", "[s]", "[m]")
    out = fim.fill_in_middle(d, seed="x", percent=50, spm_percent=0, markers=marks)
    forms = Counter(r["form"] for r in out.collect())
    assert set(forms) == {"plain", "psm"} and 140 < forms["psm"] < 260
    assert out.where(fim.restored(F.col("output"), F.col("form"), marks) != F.col("text")).isEmpty()
    assert fim.digests(fim.fill_in_middle(d.limit(0))).count() == 0


# phrases


def plain_phrases(rows_, least=10, longest=3, top=2000):
    n, f = Counter(), defaultdict(Counter)
    for lang, text in rows_:
        lang = "und" if lang is None else lang
        text = re.sub(r"[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang][tuple(words[i : i + m])] += 1
    out = []
    for lang, counts in f.items():
        cand = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        covered = set()
        for p, a in cand.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    q = p[i : i + m]
                    if 100 * a >= 50 * counts[q]:
                        covered.add(q)
        scored = []
        for p, a in cand.items():
            if p not in covered:
                score, k = min((1000000 * a * a // (counts[p[:k]] * counts[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), counts[p[:k]], counts[p[k:]]))
        for rank, (score, a, p, left, right) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, p.decode(), -a, left, right, n[lang], -score))
    return sorted(out)


def some_texts(seed=5, n=200):
    rng = random.Random(seed)
    words = ["new", "york", "New", "city", "of", "the", "é", "日本", "a-b", "x\x00y", "z z", "\x85"]
    return [(rng.choice(["en", "en", "fr", None, ""]), " ".join(rng.choices(words, weights=range(12, 0, -1), k=rng.randrange(60))).replace("of", rng.choice([".", "\n", "of", "of\t", " , "]))) for _ in range(n)]


@pytest.mark.parametrize("words", [2, 3, 4])
def test_phrases_equal_brute_force(spark, words):
    data = some_texts()
    d = spark.createDataFrame(data, "lang string, text string").repartition(5)
    got = sorted(tuple(r) for r in phrases.collocations(d, least=10, words=words).collect())
    assert got == plain_phrases(data, longest=words) and len(got) > 10


def test_phrases_of_many_shards_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(phrases, "WAYS", 3)
    data = some_texts(6, 300)
    d = spark.createDataFrame(data, "lang string, text string").repartition(11)
    assert sorted(tuple(r) for r in phrases.collocations(d, least=5, top=40).collect()) == plain_phrases(data, least=5, top=40)


def test_trie_survives_cutting_and_serialising():
    words = "a b a c a b d a b a".split()
    names = sorted(set(words), reverse=True)
    ids = np.array([names.index(w) + 1 for w in words] + [0] + [names.index(w) + 1 for w in words])
    whole = phrases.Trie.of(ids, [w.encode() for w in names], 3)
    parts = [phrases.Trie.load(t.dump()) for t in whole.cut(0, 5) if t is not None]
    again = phrases.Trie.merged(parts)
    assert again.words == whole.words
    for a, b in zip(again.counts, whole.counts):
        assert a.tolist() == b.tolist()
    assert [k[1].tolist() for k in again.keys] == [k[1].tolist() for k in whole.keys]
    twice = phrases.Trie.merged([whole, again])
    assert [c.tolist() for c in twice.counts] == [(2 * c).tolist() for c in whole.counts]


def test_phrases_of_odd_tables(spark):
    odd = spark.createDataFrame([(None, None), ("en", ""), ("en", " \t "), ("en", "..!"), ("en", "one"), ("xx", "go " * 40000)], "lang string, text string")
    odd = odd.withColumns({c: F.lit(1) for c in ("range", "shard", "ways", "phrase", "a", "words", "rank")})
    assert [tuple(r) for r in phrases.collocations(odd).collect()] == [("xx", 1, "go go go", 39998, 40000, 39999, 40000, 1_000_000 * 39998**2 // (40000 * 39999))]
    assert phrases.collocations(odd.limit(0)).count() == 0


# flat graph


def brute(vectors):
    """vec_id, n_links, component_id, kept of (vec_id, vector), from all pairs."""
    ok = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v) for _, v in vectors]
    unit = [np.array(v) / np.linalg.norm(v) if o else None for (_, v), o in zip(vectors, ok)]
    near = [[j for j in range(len(unit)) if j != i and ok[i] and ok[j] and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= 0.95] for i in range(len(unit))]
    comp = list(range(len(unit)))
    for start in range(len(unit)):
        if comp[start] == start:
            stack = [start]
            while stack:
                for j in near[stack.pop()]:
                    if comp[j] > start:
                        comp[j] = start
                        stack.append(j)
    low = {}
    for i, c in enumerate(comp):
        known = [x for x in (low.get(c), vectors[i][0]) if x is not None]
        low[c] = min(known) if known else None
    return sorted(((v, len(near[i]), low[comp[i]], v == low[comp[i]]) for i, (v, _) in enumerate(vectors)), key=str)


def planted(seed, n, dim=24):
    """Random vectors, tight groups, a chain whose ends are far apart, copies and multiples."""
    rng = np.random.default_rng(seed)
    out = list(rng.normal(size=(n, dim)))
    for size, noise in ((40, 0.02), (90, 0.035), (5, 0.03)):
        c = rng.normal(size=dim)
        out += list(c + noise * np.linalg.norm(c) * rng.normal(size=(size, dim)))
    a, b = rng.normal(size=(2, dim))
    a, b = a / np.linalg.norm(a), b - (b @ a) / (a @ a) * a
    b /= np.linalg.norm(b)
    out += [np.cos(t) * a + np.sin(t) * b for t in np.arange(0, 1.5, 0.2)]
    out += [out[3], out[3], 5 * out[4], out[n + 1], out[n + 1]]
    order = rng.permutation(len(out))
    return [(int(k), out[i].tolist()) for k, i in enumerate(order)]


def found(df):
    return sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in df.collect()), key=str)


def test_flat_graph_equals_brute_force(spark):
    data = planted(1, 300)
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(3)
    assert found(flat_graph.near_duplicates(d)) == brute(data)


def test_flat_graph_over_split_shards(spark, monkeypatch):
    monkeypatch.setattr(flat_graph, "LIMIT", 100)
    monkeypatch.setattr(flat_graph, "TARGET", 300)
    monkeypatch.setattr(flat_graph, "CHUNK", 64)
    data = planted(2, 500)
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").repartition(3)
    got, want = found(flat_graph.near_duplicates(d)), brute(data)
    links = sum(w[1] for w in want)
    assert sum(min(g[1], w[1]) for g, w in zip(got, want)) >= 0.98 * links
    assert all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[2] == w[2] for g, w in zip(got, want)) >= 0.99 * len(want)


def test_flat_graph_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    data = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (7, [1.0, 0.0]), (7, [0.0, 1.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (8, [1e300, 1e298]), (9, [1e-300, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0, 0.0, 0.0]), (12, [-0.0, 1.0]), (13, [5.0]), (14, [-5.0])]
    d = spark.createDataFrame(data, "vec_id bigint, embedding array<double>").withColumns({c: F.lit(1) for c in ("node", "row", "v", "n", "key", "ok", "shard", "label")})
    big = [(i, [x / 1e300 * 1e2 for x in v] if i == 8 else [x * 1e300 for x in v] if i == 9 else v) for i, v in data]
    assert found(flat_graph.near_duplicates(d)) == brute(big)
    assert flat_graph.near_duplicates(d.limit(0)).count() == 0


def test_flat_graph_registered_query(spark):
    data = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    assert found(queries.QUERIES["op11_embedding_near_duplicates"](spark, FOLDER)) == brute(data)


