import hashlib
from collections import defaultdict

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from graphloom.llm import common, quality
from test_operators import LOWER, WORD, _classes

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit(1)).withColumn("__t `x", F.lit("y"))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(common.written(stage(spark, out[-1], SF), name))
    return out


def test_columns_stay(stages):
    assert all(s.columns == stages[0].columns for s in stages[:-1])


def test_quality_rejects_what_the_query_predicts_bad(spark, stages):
    from graphloom.llm import queries

    good = {r["doc_id"] for r in queries.op2_quality_classifier(spark, SF).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in stages[1].collect()} == good


def test_one_document_of_each_class_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[1].collect()}
    assert {r["doc_id"] for r in stages[2].collect()} == set(_classes(texts).values())


def test_contaminated_documents_go(spark, stages):
    from graphloom.llm import decontam

    left = stages[2]
    bad = {r["doc_id"] for r in decontam.contamination(left, spark.read.parquet(f"{SF}/benchmark.parquet")).where("contaminated").collect()}
    assert {r["doc_id"] for r in stages[3].collect()} == {r["doc_id"] for r in left.collect()} - bad


def test_run_gives_the_stages_result(spark, stages):
    import tiktoken

    from graphloom.llm import bpe

    other = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})
    texts = {r["doc_id"]: r["text"] for r in stages[3].collect()}
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(texts)
    assert all(got[i]["n_tokens"] == len(other.encode_ordinary(t)) and got[i]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items())


def _hit(text, windows):
    w = WORD.findall((text or "").translate(LOWER))
    return any(tuple(w[k : k + n]) in of for n, of in windows.items() for k in range(len(w) - n + 1))


def test_the_chain_against_brute_force(spark, stages):
    """Every stage by plain Python on what the one before it left."""
    texts = [{r["doc_id"]: r["text"] for r in s.collect()} for s in stages[:-1]]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(stages[0].select("doc_id", "text"), labels, common.fold(F.col("doc_id"), 3) != 1)
    ids = sorted(texts[0])
    score = dict(zip(ids, model.score([(texts[0][i] or "").encode() for i in ids])))
    assert set(texts[1]) == {i for i in ids if score[i] >= 0.5}
    assert set(texts[2]) == set(_classes(texts[1]).values())
    windows = defaultdict(set)
    for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect():
        w = WORD.findall((r["text"] or "").translate(LOWER))
        for k in range(max(1, len(w) - 9)) if w else ():
            windows[min(10, len(w))].add(tuple(w[k : k + 10]))
    assert set(texts[3]) == {i for i, t in texts[2].items() if not _hit(t, windows)} != set(texts[2])


NAMES = ["__score", "__ref", "__d", "__h", "own_0", "OWN_1", "score", "node", "comp", "t", "c0", "marked", "a `b", "x.y"]


@pytest.fixture
def odd(spark):
    """Nulls, empty and long texts, rows and ids that repeat, and columns with the operators' own names."""
    prose = "the quick brown fox jumps over the lazy dog and runs away from here to there "
    rows = [(1, prose * 3), (1, prose * 3), (2, prose * 3 + "again"), (3, None), (3, None), (3, ""), (4, ""), (None, None), (None, prose + "once more"), (5, prose * 4000), (6, "x" * 100_000), (7, " \n ")]
    d = spark.createDataFrame(rows, "doc_id bigint, text string")
    for k, c in enumerate(NAMES):
        d = d.withColumn(c, F.when(F.lit(k % 2 == 0), F.lit(c)))
    return d


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_odd_rows_pass_each_stage(spark, odd, name):
    got = common.written(dict(corpus_pipeline.STAGES)[name](spark, odd, SF), name)
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    if name == "byte_level_bpe":
        n = sorted((str(r["doc_id"]), r["n_tokens"] == 0, r["decoded_sha256"]) for r in got.collect())
        assert n == sorted((str(i), not t, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
        return
    assert got.columns == odd.columns
    kept = got.collect()
    assert all(r[c] == (c if k % 2 == 0 else None) for r in kept for k, c in enumerate(NAMES))
    left = [(r["doc_id"], r["text"]) for r in kept]
    if name == "near_dedup":
        prose = rows[0]
        assert sorted(map(str, left)) == sorted(map(str, [prose, (3, None), (3, ""), (4, ""), (None, None), rows[8], rows[10], rows[11]]))
    elif name == "benchmark_decontamination":
        assert sorted(map(str, left)) == sorted(map(str, rows))
    else:
        for i, t in rows:  # the same text has one fate
            assert sum(x[1] == t or not (x[1] or t) for x in left) in (0, sum(x[1] == t or not (x[1] or t) for x in rows))


def test_an_empty_table_passes_all_stages(spark, stages):
    docs = stages[0].limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = common.written(stage(spark, docs, SF), name)
    assert docs.count() == 0
