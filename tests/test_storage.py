"""The text index, committed snapshots and both layouts of edges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as text_fn
from graphloom.model import Graph, degrees, with_defaults
from graphloom.operators import graph, text
from graphloom.sources import snapshots, text_index

WORDS = ["Bolt", "bolts", "BOLT", "red", "Red fish", "blue-green", "É té", "it's", "a", "ab", "abc", "ΟΔΟΣ", "x" * 30, "日本 語", "o.k.", "fishing/rod"]


def made(spark, n=400, seed=1):
    rng = random.Random(seed)
    edges = spark.createDataFrame([(rng.randrange(n), rng.randrange(n), rng.choice(["L", "R"]), rng.randrange(1, 9), "X") for _ in range(n * 6)], "pre_id bigint, post_id bigint, region string, weight bigint, edge_type string")
    edges = edges.groupBy("pre_id", "post_id", "region").agg(F.max("weight").alias("weight"), F.max("edge_type").alias("edge_type"))
    rows = [(i, " ".join(rng.choices(WORDS, k=rng.randrange(1, 4))), [" ".join(rng.choices(WORDS, k=rng.randrange(1, 4))) for _ in range(rng.randrange(3))]) for i in range(n)]
    nodes = spark.createDataFrame(rows, "root_id bigint, class string, label array<string>")
    regions = [{"region": r, "description": r, "hemisphere": "Left", "category": "x"} for r in "LR"]
    return Graph(with_defaults(nodes.join(degrees(edges), "root_id", "left")), edges, regions=regions, edge_types={"X": "x"})


@pytest.fixture(scope="module")
def both(spark, tmp_path_factory):
    plain = made(spark)
    plain.nodes, plain.edges = plain.nodes.persist(), plain.edges.persist()
    path = str(tmp_path_factory.mktemp("store"))
    snapshots.commit(plain, path, "v1")
    return plain, snapshots.checkout(spark, path, "v1", verify=True), path


def rows(df):
    return sorted(map(str, df.collect()))


def leaves(df):
    """The scans of a plan after it ran."""
    df.collect()
    out, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        p = todo.pop()
        if p.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif hasattr(p, "plan") and p.getClass().getSimpleName().endswith("QueryStageExec"):
            todo.append(p.plan())
        else:
            children = p.children()
            todo += [children.apply(i) for i in range(children.size())]
            if not children.size():
                out.append(p)
    return out


def read_rows(df):
    metrics = [p.metrics() for p in leaves(df)]
    return sum(m.apply("numOutputRows").value() for m in metrics if m.contains("numOutputRows"))


@pytest.mark.parametrize("case_sensitive", [False, True])
@pytest.mark.parametrize("word_match", [False, True])
def test_index_answers_as_the_search_of_all_labels(both, case_sensitive, word_match):
    plain, stored, _ = both
    for term in ["bolt", "BOLT", "Bo", "o", "ol", "olt", "olts", "red fish", "d fi", "blue", "een", "it's", "é", "É té", "ΟΔ", "οδος", "語", "本 語", "x" * 30, "xxxx", "x" * 31, "nothing", "k.", "/", "fishing/rod", "12"]:
        assert rows(text.lookup(stored, term, case_sensitive, word_match)) == rows(text.lookup(plain, term, case_sensitive, word_match)), term
    for phrase in ["red bolt", '"Red fish"', "*", "", "fish BOLT é"]:
        assert rows(text.search(stored, phrase, case_sensitive, word_match)) == rows(text.search(plain, phrase, case_sensitive, word_match)), phrase


def test_index_suggests_as_a_comparison_with_all_words(both):
    plain, stored, _ = both
    rng = random.Random(2)
    words = [w for x in WORDS for w in text_fn.tokens_text(x)]
    for _ in range(8):
        w = list(rng.choice(words))
        for _ in range(rng.randrange(5)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randrange(2)] = rng.choice(["", "q", "o"])
        term = "".join(w) or "z"
        for cased in (False, True):
            assert rows(text.closest_token(stored, term, cased)) == rows(text.closest_token(plain, term, cased)), term


def test_words_within_two_edits_share_a_deletion():
    rng = random.Random(4)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randrange(14))]
        b = list(a)
        for _ in range(2):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice([[], ["a"], ["d"]])[:1]
        if abs(len(a) - len(b)) <= 2 and _distance(a, b) <= 2:
            assert set(text_index.deletions_text("".join(a))) & set(text_index.deletions_text("".join(b)))


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_deletions_are_the_same_in_spark_and_python(spark):
    words = ["", "a", "ab", "aab", "日本語テキスト処理です", "abcdefghij"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", F.sort_array(text_index._deletions(F.col("w"))).alias("d")).collect()
    assert {r["w"]: sorted(r["d"]) for r in got} == {w: text_index.deletions_text(w) for w in words}


def test_a_look_up_reads_part_of_the_index(spark, tmp_path):
    n = 60_000
    labels = spark.range(n).select(F.col("id").alias("root_id"), F.array(F.concat(F.lit("w"), F.md5(F.col("id").cast("string"))), F.concat(F.substring(F.md5(F.col("id").cast("string")), 3, 6), F.lit("tail"))).alias("label"))
    g = Graph(with_defaults(labels), spark.createDataFrame([], snapshots.EDGES))
    text_index.build(g, str(tmp_path / "index"))
    index = text_index.TextIndex(spark, str(tmp_path / "index"))
    label = labels.where("root_id = 777").first()["label"][1]
    prefix, part = index.tokens(label[:4], prefix=True), index.labels_with(label[1:7])
    for df in (prefix, part):
        plan = df._jdf.queryExecution().toString()
        assert "PartitionFilters: [isnotnull(head" in plan or "PartitionFilters: [head" in plan
    assert "StringStartsWith(token_lc" in prefix._jdf.queryExecution().toString()
    assert 0 < read_rows(prefix) < index.table("tokens").count() / 4
    assert 0 < read_rows(part) < index.table("grams").count() / 4
    assert [r["root_id"] for r in index.lookup(label).where("tier = 1").collect()] == [777]


# commits


def test_commit_and_checkout(spark, both):
    plain, stored, path = both
    assert rows(stored.nodes) == rows(plain.nodes) and rows(stored.edges) == rows(plain.edges) and rows(stored.pairs) == rows(plain.pairs)
    assert stored.regions == plain.regions and stored.edge_types == plain.edge_types
    assert snapshots.versions(spark, path) == ["v1"] and snapshots.Catalogue.of(spark, path).get().nodes.count() == 400
    with pytest.raises(snapshots.UnknownSnapshot):
        snapshots.checkout(spark, path, "v2")


def test_a_broken_off_commit_is_never_seen(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "store")
    a, b = made(spark, 40, 5), made(spark, 50, 6)
    snapshots.commit(a, path, "v1", with_text=False)
    reader = snapshots.checkout(spark, path, "v1")
    done, real = [], snapshots.checksum

    def breaks(df):
        if len(done) == 2:
            raise KeyboardInterrupt("killed between tables")
        done.append(1)
        return real(df)

    monkeypatch.setattr(snapshots, "checksum", breaks)
    for version in ("v1", "v2"):
        done.clear()
        with pytest.raises(KeyboardInterrupt):
            snapshots.commit(b, path, version, with_text=False)
    monkeypatch.undo()
    assert snapshots.versions(spark, path) == ["v1"]
    assert snapshots.checkout(spark, path, "v1", verify=True).nodes.count() == 40
    assert len(snapshots.sweep(spark, path)) == 2 and reader.edges.count() == a.edges.count()


def test_a_reader_stays_with_its_commit(spark, tmp_path):
    path = str(tmp_path / "store")
    snapshots.commit(made(spark, 40, 5), path, "v1", with_text=False)
    before = snapshots.checkout(spark, path, "v1")
    snapshots.commit(made(spark, 50, 6), path, "v1", with_text=False)
    assert before.nodes.count() == 40 and snapshots.checkout(spark, path, "v1").nodes.count() == 50


def test_changed_tables_are_found_out(spark, tmp_path):
    path = str(tmp_path / "store")
    m = snapshots.commit(made(spark, 40, 5), path, "v1", with_text=False)
    at = f"{path}/{m['folder']}/pairs/by_pre_id"
    spark.createDataFrame([(1, 2, 3)], "pre_id bigint, post_id bigint, weight bigint").write.mode("append").parquet(at)
    with pytest.raises(snapshots.BrokenSnapshot):
        snapshots.checkout(spark, path, "v1", verify=True)
    spark.createDataFrame([("x",)], "pre_id string").write.mode("overwrite").parquet(at)
    with pytest.raises(snapshots.BrokenSnapshot):
        snapshots.checkout(spark, path, "v1")
    assert json.loads(snapshots.Files(spark, path).text("manifests/v1.json"))["tables"]["nodes"]["rows"] == 40


def test_edges_of_a_node_come_from_both_layouts(spark, both, tmp_path):
    plain, stored, _ = both
    for x in (0, 7, 399, 1000):
        assert rows(graph.incident(stored, x)) == rows(graph.incident(plain, x))
        assert rows(graph.upstream(stored, x)) == rows(graph.upstream(plain, x))
        assert rows(graph.upstream(stored, x, {"L"})) == rows(graph.upstream(plain, x, {"L"}))
        assert rows(graph.upstream(stored, x, least=4)) == rows(graph.upstream(plain, x, least=4))
    wide = spark.range(400_000).select(F.col("id").alias("pre_id"), F.pmod(F.xxhash64("id"), F.lit(400_000)).alias("post_id"), F.lit("L").alias("region"), F.lit(1).cast("bigint").alias("weight"), F.lit("X").alias("edge_type"))
    g = Graph(with_defaults(spark.createDataFrame([(1,)], "root_id bigint")), wide)
    path = str(tmp_path / "store")
    snapshots.commit(g, path, "v", with_text=False)
    found = graph.incident(snapshots.checkout(spark, path, "v"), 5)
    assert read_rows(found) <= 800_000 / 3


def test_rows_of_one_key_are_several_tasks_work(spark, tmp_path):
    from graphloom.sources import text_index

    rows = spark.range(40_000).select(F.lit("bolt").alias("token_lc"), F.lit("bolt").alias("token"), F.col("id").alias("root_id"))
    text_index._write(rows, "token_lc", str(tmp_path / "tokens"), "root_id")
    assert len(list((tmp_path / "tokens").rglob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "tokens")).distinct().count() == 40_000
