"""Small graphs with known answers."""

import math

import pytest
from pyspark.sql import functions as F

from graphloom.functions import regions, text
from graphloom.model import Graph, degrees, with_defaults
from graphloom.operators import analytics, graph, ingest, labels, network, ordering, similarity
from graphloom.operators import text as text_ops
from graphloom.operators.motif import Motif
from graphloom.plans import compiler
from graphloom.plans.language import QueryError
from graphloom.sources import csv_tables, driver_tables, snapshots
from graphloom.storage import numbered, shared_folder

REGIONS = [dict(zip(("region", "description", "hemisphere", "category"), r)) for r in [("AL_L", "antennal lobe", "Left", "x"), ("AL_R", "antennal lobe", "Right", "x"), ("EB", "ellipsoid body", "Center", "y")]]
TYPES = {"ACH": "acetylcholine", "GABA": "gamma"}
EDGES = [(1, 2, "EB", 5, "ACH"), (1, 2, "AL_L", 6, "ACH"), (2, 3, "EB", 7, "GABA"), (3, 1, "EB", 8, "ACH"), (2, 1, "AL_R", 9, "ACH"), (4, 4, "EB", 3, "ACH"), (3, 4, "EB", 20, "ACH")]


@pytest.fixture(scope="module")
def g(spark):
    edges = spark.createDataFrame(EDGES, "pre_id bigint, post_id bigint, region string, weight bigint, edge_type string")
    nodes = spark.createDataFrame([(1, "a", ["red fish", "X-1"], "left"), (2, "a", ["blue"], "right"), (3, "b", [], ""), (4, None, ["red"], "left"), (5, "b", ["Fish"], "left")], "root_id bigint, class string, label array<string>, side string")
    sim = spark.createDataFrame([(1, 2, 5), (1, 3, 3)], "src bigint, dst bigint, score int")
    return Graph(with_defaults(nodes.join(degrees(edges), "root_id", "left")), edges, shape_sim=sim, regions=REGIONS, edge_types=TYPES)


def ids(df):
    return sorted(r[0] for r in df.select("root_id").collect())


@pytest.mark.parametrize(
    "query, want",
    [
        ("class == A", [1, 2]), ("class != a", [3, 4, 5]), ("!$ class", [4]), ("label >> FISH", [1, 5]), ("label !> fish", [2, 3, 4]), ("^^ 1", [2, 3]), ("!^ 4", [4]), ("^v 1", [2]), ("^v 4", []),
        ("al_l !R 1", [2]), ("left ^R 1", []), ("input_regions == ellipsoid body", [1, 2, 3, 4]), ("1 -> 4", [1, 2, 3, 4]), ("1 -> 5", []), ("1 -> 1", []), ("class == a && ^^ 1", [2]), ("class == a || !^ 4", [1, 2, 4]),
        ("~~ 1", [1, 2]), ("root_id << 1,3,9", [1, 3]), ("", [1, 2, 3, 4, 5]), ("red fish", [1, 4, 5]), ('"red fish"', [1]), ("!^ 99", []),
    ],
)
def test_search(g, query, want):
    assert ids(compiler.search(g, query)) == want


@pytest.mark.parametrize("query", ["nothing == 1", "^^ x", "mars ^R 1"])
def test_search_errors(g, query):
    with pytest.raises(QueryError):
        compiler.search(g, query)


def test_traversal(g):
    assert {r["root_id"]: r["depth"] for r in graph.distances_from(g, 1).collect()} == {1: 0, 2: 1, 3: 2, 4: 3}
    m = {(r["source"], r["target"]): r["hops"] for r in graph.distance_matrix(g, [1, 5], [4, 5]).collect()}
    assert m == {(1, 4): 3, (1, 5): -1, (5, 4): -1, (5, 5): 0}
    assert graph.hop_histogram(graph.distances_from(g, 1), 5).orderBy("hops").collect()[-1]["percent"] == 60
    assert sorted(map(tuple, graph.path_edges(g, 1, 4).select("pre_id", "post_id", "weight").collect())) == [(1, 2, 11), (2, 3, 7), (3, 4, 20)]
    assert graph.distance_table(graph.distance_matrix(g, [1], [2, 4]), [2, 4]).columns == ["source", "2", "4"]


def test_thresholds_of_rows_and_pairs(g):
    assert ids(graph.downstream(g, 1, least=10)) == [2]
    assert graph.connections(g, g.nodes.where("root_id = 1"), least=10).count() == 0
    with pytest.raises(QueryError):
        graph.connections(g, g.nodes, edge_type="none")


def test_similarity(g):
    s = {r["root_id"]: r["score"] for r in similarity.similar_connectivity(g, 1).collect()}
    assert s[1] == 1.0
    assert ids(similarity.similar_connectivity(g, 1, same=("class",))) == [i for i in ids(similarity.similar_connectivity(g, 1)) if i in (1, 2)]


def test_motifs(g):
    m = Motif(g).node("A").node("B").node("C").edge("A", "B").edge("B", "C").edge("C", "A")
    # 2 -> 1 is there too, so the cycle is not induced
    assert m.matches().count() == 0
    pair = Motif(g).node("A", "class == a").node("B").edge("A", "B").edge("B", "A")
    assert sorted(map(tuple, pair.matches().collect())) == [(1, 2), (2, 1)]
    assert "AL_R" in pair.matches(with_edges=True).where("A = 1").first()["edges"]
    form = {"queryA": "*", "queryB": "", "enabledAB": "on", "regionAB": "EB", "minSynapseCountAB": ""}
    assert sorted(map(tuple, Motif.from_form(g, form).matches().collect())) == [(1, 2), (2, 3), (3, 1), (3, 4)]
    with pytest.raises(QueryError):
        Motif(g).node("A").node("B").matches()
    with pytest.raises(QueryError):
        Motif(g).node("A").edge("A", "A")


def test_network_cap_counts_no_loops(g):
    rows = network.capped(g.edges, 2)
    assert sorted((r["pre_id"], r["post_id"]) for r in rows.collect()) == [(1, 2), (3, 4)]
    assert network.capped(g.edges, 0).count() == 6


def test_orders(g):
    assert [r["root_id"] for r in ordering.sort(g, g.nodes, "-labels").collect()] == [1, 2, 4, 5, 3]
    assert ordering.inferred("^^ 1") == "upstream_synapse_count:1" and ordering.inferred("fish") is None and ordering.inferred("") == "item_count:label"
    assert [r["root_id"] for r in ordering.sort(g, g.nodes, "distance_from:1").collect()] == [1, 2, 3, 4, 5]
    assert ordering.page_bounds(45, 9, 20) == {"page": 3, "size": 20, "pages": 3, "first": 40, "last": 45, "links": [1, 2, 3], "previous": True, "next": False}
    with pytest.raises(QueryError):
        ordering.sort(g, g.nodes, "colour")


def test_wide_sums(spark):
    n = spark.createDataFrame([(i, 9_000_000_000_000_000_000) for i in range(3)], "root_id bigint, size_nm bigint")
    assert int(analytics.summary(with_defaults(n)).first()["size_nm"]) == 27_000_000_000_000_000_000
    big = with_defaults(spark.createDataFrame([(720575940600000001, "g", 9), (720575940600000002, "g", 1)], "root_id bigint, group string, input_cells bigint"))
    assert {r["root_id"] % 10: r["name"] for r in ingest.named(big).collect()} == {1: "g.1", 2: "g.2"}


def test_text_functions(spark):
    d = spark.createDataFrame([("lobe-x t4a", "see doi: 10.1/x. 'a'", 125)], "a string, b string, n bigint")
    r = d.select(text.title_case(F.col("a")).alias("t"), text.links(F.col("b")).alias("l"), text.web_safe(F.col("b")).alias("w"), text.base62(F.col("n")).alias("s"), text.percentage(F.col("n"), F.lit(0)).alias("p"), text.tokens(F.lit("'a.b' (c)-d")).alias("k"),
                 text.shown(F.lit("none")).alias("u"), text.significant(F.lit(0.0123456)).alias("g"), text.truncated(F.lit("abcdef"), 3, True).alias("c"), text.micros(F.lit(1_234_567)).alias("m"), text.voxel(F.lit("[2 6 100]")).alias("v")).first()
    assert r["t"] == "Lobe-X T4A" and r["l"] == ["https://doi.org/10.1/x"] and r["w"] == "see doi: 10.1/x. `a`"
    assert r["s"] == "21" and r["p"] == 100 and r["k"] == ["a.b", "c", "d"] and r["u"] == "Unknown" and r["g"] == 0.0123 and r["c"] == "a..(6)"
    assert r["m"] == "1,235 &#181;m" and r["v"] == [0, 2, 2]
    assert text.tokens_text("'a.b' (c)-d") == ["a.b", "c", "d"]
    assert regions.region_set("AL", REGIONS) == {"AL_L", "AL_R"} and regions.region_set("right", REGIONS) == {"AL_R"} and regions.region_set("lobe left", REGIONS) == {"AL_L"}
    assert regions.edge_type("g", TYPES) == "GABA" and regions.edge_type("zzz", TYPES) == "zzz"


def test_label_cleaning(spark):
    cases = [
        (["Putative fish; ab", "fish", "fish.", "left fish", "Correction: cat", "old"], ["fish; ab", "cat"]),
        (["Correction: " * 4 + "foo", "older"], ["foo"]),
        (["a; cat"], ["a; cat"]),
        (["neuron; big neuron", "x1; x1: y", "p, q p, r"], ["big neuron", "x1: y", "q p, r"]),
        (["Fish", "fish", "T1-2", "T12", "ab-c", "ab.c", "abc d"], ["Fish", "fish", "T1-2", "T12", "ab-c", "abc d"]),
        (["foo_left", "bar-LHS", "gr_l", "hu_R; ki", "ab_L_L_L_L", "right_ ; left"], ["foo", "bar", "gr", "hu; ki", "ab"]),
        (["foo;;;;,,::"], ["foo"]),
        (["foo bar", "foo", "foo_x", "fu", "fué"], ["foo bar", "foo_x", "fué"]),
        (["X; y1", "Gamma ;cat", "gaba"], ["y1", "cat"]),
        (["putative putative putative cat"], ["cat"]),
        (["one", "two (corrected)", "Tm16 is wrong. this is: three", "four"], ["one", "two"]),
        (["two; L1 label is wrong", "one"], ["two"]),
        (["#wrong_prediction x", "720000000000000001", "Correction - not optic lobe", "", None, "k", "  kk  "], ["kk"]),
        (["b, c,d;e", 'say "so"'], ["b, c, d; e", "say `so`"]),
        ([], []),
        (None, []),
    ]
    rows = [(i, x, "x", "GABA") for i, (x, _) in enumerate(cases)]
    n = with_defaults(spark.createDataFrame(rows, "root_id bigint, label array<string>, class string, nt_type string"))
    out = labels.clean(n, edge_types=TYPES)
    assert out.columns == n.columns
    assert {r["root_id"]: r["label"] for r in out.collect()} == {i: want for i, (_, want) in enumerate(cases)}
    again = labels.clean(out, edge_types=TYPES)
    assert {r["root_id"]: r["label"] for r in again.collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_labels_are_whole_texts(spark, tmp_path):
    start = "a long label that goes on and on, well past sixty characters of it, "
    rows = [(7, start + "cat", "s", "en", 3), (14, start + "dog (correction)", "s", "en", 2), (21, "old", "s", "en", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    n = with_defaults(spark.createDataFrame([(0,)], "root_id bigint"))
    found = labels.grouped(driver_tables._label_log(spark, str(tmp_path), 7), n)
    assert labels.clean(found.join(n.drop("label"), "root_id")).first()["label"] == [start + "cat", start + "dog"]


def test_shape_scores_have_every_source(spark, tmp_path):
    v = {i: [float(1 + i % 3), float(i % 7), float(i % 5)] for i in range(0, 120, 2)}
    spark.createDataFrame(list(v.items()), "vec_id bigint, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    score = lambda a, b: math.floor(10 * dot(a, b) / math.sqrt(dot(a, a)) / math.sqrt(dot(b, b)) + 1e-9)
    want = sorted((a, b, score(v[a], v[b])) for a in v for b in v if a != b and score(v[a], v[b]) >= 2)
    assert sorted(map(tuple, driver_tables._shape_sim(spark, str(tmp_path)).collect())) == want


def test_snapshot_round_trip(spark, g, tmp_path):
    g.label_log = None
    snapshots.write(g, str(tmp_path / "v1"))
    c = snapshots.Catalogue(spark, {"v1": str(tmp_path / "v1")})
    again = c.get()
    assert sorted(map(tuple, again.edges.collect())) == sorted(EDGES) and again.regions and again.edge_types == TYPES
    assert ids(compiler.search(again, "^^ 1")) == [2, 3]
    with pytest.raises(snapshots.UnknownSnapshot):
        c.get("v2")


CSV = {
    "neurons": [("10", "g,h", "ach", "", "", "", "", "", "", ""), ("11", "g", "gaba", "", "", "", "", "", "", "")],
    "classification": [("10", "out", "", "k", "", "", "left", ""), ("99", "x", "", "", "", "", "", "")],
    "cell_types": [("10", "T1", ""), ("10", "T0", "")],
    "labels": [("10", "new", "1", "", "0", "2", "2024-02-01", "ann", "lab"), ("10", "old", "1", "", "0", "1", "2023-02-01", "bob", "lab"), ("98", "lost", "1", "", "0", "3", "2024", "ann", "lab")],
    "connections": [("10", "11", "eb", "7", "ach")],
    "nblast": [("10", "11:5;12:9;10:10")],
}


def test_ingest_from_csv(spark, tmp_path):
    for name, rows in CSV.items():
        csv_tables.write_csv(spark.createDataFrame(rows, csv_tables.SCHEMAS[name]), str(tmp_path / f"{name}.csv"))
    built, report = ingest.build(spark, csv_tables.read_sources(spark, str(tmp_path)), REGIONS, TYPES)
    n = {r["root_id"]: r for r in built.nodes.collect()}
    assert n[10]["label"] == ["new", "old"] and n[10]["cell_type"] == ["T0", "T1"] and n[10]["output_synapses"] == 7 and n[10]["side"] == "left" and n[11]["label"] == []
    assert n[10]["nt_type"] == "ACH" and n[11]["input_neuropils"] == ["EB"]
    assert report.orphans["classification"] == 1 and report.orphans["labels"] == 1
    assert [tuple(r) for r in built.shape_sim.collect()] == [(10, 11, 5)]
    bad = csv_tables.read_sources(spark, str(tmp_path)) | {"connections": spark.createDataFrame([("10", "77", "EB", "1", "ACH")], csv_tables.SCHEMAS["connections"])}
    with pytest.raises(ingest.IngestError):
        ingest.build(spark, bad, REGIONS, TYPES)


def test_export_guard(spark):
    with pytest.raises(csv_tables.TooLarge):
        csv_tables.guarded(spark.range(11), 10)
    assert csv_tables.guarded(spark.range(10), 10).count() == 10


def test_highlight_spans(spark):
    cases = [("red fish", ["red"], [("exact", 0, 3)]), ("infrared; RED-fish", ["red", "fi"], [("part", 5, 8), ("exact", 10, 13), ("part", 14, 16)]), ("redred", ["red"], [("part", 0, 3)]), ("reda", ["red", "da"], [("part", 0, 3)]), ("", ["x"], []), ("a b", [], []), ("T1-2", ["t1 x"], [("exact", 0, 2)])]
    for t, words, want in cases:
        r = spark.createDataFrame([(t,)], "t string").select(text_ops.highlight_spans(F.col("t"), words).alias("s"), text_ops.highlighted(F.col("t"), words).alias("h")).first()
        assert [tuple(x) for x in r["s"]] == want
        assert r["h"].replace("</span>", "").replace('<span class="highlight-green">', "").replace('<span class="highlight-yellow">', "") == t
    assert spark.createDataFrame([("infrared; RED",)], "t string").select(text_ops.highlighted(F.col("t"), ["red"]).alias("h")).first()["h"] == 'infra<span class="highlight-yellow">red</span>; <span class="highlight-green">RED</span>'


def test_nested_counts_for_display(spark):
    d = spark.createDataFrame([({"a": {"x": 1234567, "y": 5}, "b": {}},)], "m map<string,map<string,bigint>>")
    assert d.select(text.counts_for_display(F.col("m")).alias("m")).first()["m"] == {"a": {"x": "1,234,567", "y": "5"}, "b": {}}


def test_places_are_numbered_in_order(spark):
    d = spark.range(0, 1000, 1, 7).select("id", (F.col("id") % 10).alias("k"))
    got = numbered(d, (F.desc("k"), F.asc("id")), "place").collect()
    want = {r["id"]: i + 1 for i, r in enumerate(sorted(got, key=lambda r: (-r["k"], r["id"])))}
    assert {r["id"]: r["place"] for r in got} == want and numbered(d.limit(0), (F.asc("id"),), "place").count() == 0


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    from types import SimpleNamespace as Some

    unset = Some(conf=Some(get=lambda *_: None), sparkContext=Some(master="spark://x", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        shared_folder(unset)
