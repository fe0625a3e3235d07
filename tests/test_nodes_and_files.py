"""Conditions, accessors, composed queries, kept pages, and what files cannot give."""

import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph, with_defaults
from graphloom.operators import conditions, ingest, labels, network, nodes, ordering
from graphloom.plans import compiler, language
from graphloom.plans.language import QueryError
from graphloom.sources import csv_tables
from graphloom.storage import numbered

from test_engine import CSV, REGIONS, TYPES, g, ids  # noqa: F401


def test_conditions_are_those_of_the_language(g):  # noqa: F811
    cases = [
        (conditions.equal(g, "class", "A"), "class == A"), (conditions.not_equal(g, "Class", "a"), "class != a"), (conditions.lacks(g, "class"), "!$ class"), (conditions.has(g, "label"), "$$ label"),
        (conditions.contains(g, "labels", "FISH"), "label >> FISH"), (conditions.not_contains(g, "label", "fish"), "label !> fish"), (conditions.starts_with(g, "label", "x"), "label ^* x"),
        (conditions.is_in(g, "root_id", ["1", "3", "9"]), "root_id << 1,3,9"), (conditions.not_in(g, "side", "left, right"), "side !< left, right"),
        (conditions.equal(g, "input_regions", "ellipsoid body"), "input_regions == ellipsoid body"), (conditions.is_in(g, "input_regions", "left"), "input_regions << left"),
    ]
    for column, query in cases:
        assert ids(g.nodes.where(column)) == ids(compiler.search(g, query)), query
    assert ids(g.nodes.where(conditions.equal(g, "label", "fish", case_sensitive=True))) == []
    assert ids(g.nodes.where(conditions.is_in(g, "class", []))) == []
    with pytest.raises(QueryError):
        conditions.equal(g, "klass", "a")


def test_composed_queries(g):  # noqa: F811
    q = language.Query().and_(language.term("==", "class", "a")).but(language.term("contains", "label", "blue"))
    assert q.text() == "class == a && label !> blue" and ids(compiler.search(g, q.text())) == [1]
    q = language.Query().or_(language.term("{in}", "root_id", [1, 5])).or_(language.term("has", "class"))
    assert language.parse(q.text()) == q and ids(compiler.search(g, q.text())) == [1, 2, 3, 5]
    assert language.opposite(language.opposite(language.term("!$", "class"))) == language.term("not", "class")
    assert language.Query().and_(language.term(None, "a == b")).text() == '"a == b"'
    for bad in (lambda: language.term("==", "class"), lambda: language.term("&&", "a"), lambda: language.term("==", "class", "a && b"), lambda: language.term("==", "klass", "a"), lambda: q.and_(language.term("has", "class")), lambda: language.opposite(language.term("^^", 1))):
        with pytest.raises(QueryError):
            bad()


def test_one_node(g):  # noqa: F811
    assert nodes.is_known(g, 1) and not nodes.is_known(g, 99)
    assert nodes.node_data(g, 1)["class"] == "a" and nodes.node_data(g, 99) == {} and nodes.node(g, 99).count() == 0
    typed = Graph(with_defaults(g.spark.createDataFrame([(1, ["T2", "T1", "T2", ""])], "root_id bigint, cell_type array<string>")), g.edges)
    assert [r["cell_type"] for r in nodes.cell_types(typed, 1).collect()] == ["T1", "T2"] and nodes.cell_types(typed, 2).count() == 0
    assert nodes.labels_date(g) is None


def written_sources(spark, path, **other):
    for name, rows in (CSV | other).items():
        csv_tables.write_csv(spark.createDataFrame(rows, csv_tables.SCHEMAS[name]), str(path / f"{name}.csv"))


def test_files_and_their_dates(spark, tmp_path):
    written_sources(spark, tmp_path)
    sources = csv_tables.read_with_facts(spark, str(tmp_path))
    built, _ = ingest.build(spark, sources, REGIONS, TYPES)
    plain, _ = ingest.build(spark, csv_tables.read_sources(spark, str(tmp_path)), REGIONS, TYPES)
    assert sorted(map(str, built.nodes.collect())) == sorted(map(str, plain.nodes.collect()))
    facts = built.extra["files"]().where("source = 'labels'").collect()
    assert sum(r["rows"] for r in facts) == 3 and all(r["file"].endswith(".csv") and r["modified"].year >= 2020 for r in facts)
    assert nodes.labels_date(built) == max(r["modified"] for r in facts).strftime("%Y-%m-%d")
    assert built.extra["rejects"]().count() == 0


def test_rejects_name_file_and_reason(spark, tmp_path):
    written_sources(spark, tmp_path, cell_stats=[("10", "5", "x7", ""), ("", "1", "1", "1")], nblast=[("10", "11:5;12:nine;13;;11:")])
    (tmp_path / "connections.csv").rename(tmp_path / "kept")
    (tmp_path / "connections.csv").write_text("pre_root_id,post_root_id,neuropil,syn_count,nt_type\n10,11,EB,7,ACH\n10,11,EB\n10,11,EB,many,ACH,extra\n")
    got = csv_tables.read_with_facts(spark, str(tmp_path))
    rows = ingest.rejects(got).collect()
    faults = sorted((r["source"], r["reason"], r["column"] or "", r["value"] or "") for r in rows)
    assert faults == [
        ("cell_stats", "id", "root_id", ""), ("cell_stats", "number", "area_nm", "x7"), ("connections", "number", "syn_count", "many"), ("connections", "row", "", "10,11,EB"), ("connections", "row", "", "10,11,EB,many,ACH,extra"),
        ("nblast", "score", "scores", "11:"), ("nblast", "score", "scores", "12:nine"), ("nblast", "score", "scores", "13"),
    ]
    assert all(r["file"].endswith(".csv") for r in rows) and any('"area_nm":"x7"' in r["row"] for r in rows)
    assert ingest.rejects(csv_tables.read_sources(spark, str(tmp_path))).where("reason <> 'row'").count() == 6


def test_pages_read_their_own_rows(spark, tmp_path, monkeypatch):
    from test_storage import read_rows

    monkeypatch.setattr(ordering.Pages, "PART", 500)
    ranked = numbered(spark.range(20_000).select(F.col("id").alias("root_id"), (F.col("id") * 7 % 1000).alias("sort_value")), (F.desc("sort_value"), F.asc("root_id")), "rank")
    pages = ordering.Pages.keep(ranked, str(tmp_path / "pages"))
    want = [r["root_id"] for r in ranked.orderBy("rank").collect()]
    for number in (1, 13, 25, 26, 999, 1000, 1001):
        assert [r["root_id"] for r in pages.page(number, 20).collect()] == want[(number - 1) * 20 : number * 20]
    assert [r["root_id"] for r in pages.after(495, 10).collect()] == want[495:505]
    # one partition of ranks, which a sort reads twice
    assert read_rows(pages.page(1)) == read_rows(pages.page(1000)) <= 1000


def test_short_list(spark):
    d = spark.range(150).select(F.col("id").alias("root_id"), (150 - F.col("id")).alias("rank"))
    assert tuple(ordering.short_list(d.where("root_id < 3")).first()) == ("2,1,0", 3)
    assert tuple(ordering.short_list(d).first()) == (None, 101) and tuple(ordering.short_list(d, 200).first())[1] == 150
    assert tuple(ordering.short_list(d.limit(0)).first()) == ("", 0)


def test_drawing(g, spark):  # noqa: F811
    few = {(r["pre_id"], r["post_id"]): (r["width"], r["label"]) for r in network.drawn_edges(g.pairs).collect()}
    assert few[1, 2] == (2.0, "11") and few[4, 4] == (1.0, "3")
    big = spark.createDataFrame([(1, 2, 2500), (1, 3, 3500), (1, 4, 400), (2, 3, 5_000_000)], "pre_id bigint, post_id bigint, weight bigint")
    drawn = {(r["pre_id"], r["post_id"]): (r["width"], r["label"], r["title"]) for r in network.drawn_edges(big).collect()}
    assert drawn[1, 2] == (0.025, "2K", "2,500 synapses") and drawn[1, 3][1] == "4K" and drawn[1, 4][1] == "400" and drawn[2, 3] == (10.0, "5,000K", "5,000,000 synapses")
    assert network.drawn_edges(big.limit(0)).count() == 0
    layered = {r["weight"]: r["width"] for r in network.drawn_edges(g.pairs, layered=True).collect()}
    assert layered[20] == 10.0 and layered[3] == 7.5
    named = Graph(g.nodes.withColumn("name", F.concat(F.lit("n"), "root_id")), g.edges)
    shown = {r["root_id"]: r for r in network.drawn_nodes(named, g.pairs, g.nodes.where("root_id = 5").select("root_id"), marks={5: "X"}).collect()}
    assert shown[5]["caption"] == "(X) n5" and shown[5]["size"] == 21 and shown[1]["caption"] == "n1" and shown[1]["size"] == 5


def test_cleaning_that_never_ends_is_an_error(spark, monkeypatch):
    n = with_defaults(spark.createDataFrame([(1, ["a"]), (2, [])], "root_id bigint, label array<string>"))
    turns = lambda own, rules: [lambda a: F.transform(a, lambda x: F.when(x == "a", "b").otherwise("a"))]
    monkeypatch.setattr(labels, "_steps", turns)
    monkeypatch.setattr(labels, "ROUNDS", 3)
    with pytest.raises(ValueError, match="after 3 rounds"):
        labels.clean(n)


def test_cleaning_takes_as_many_rounds_as_labels_get_shorter_in(spark, monkeypatch):
    n = with_defaults(spark.createDataFrame([(1, ["abc" + ":" * 8]), (2, ["de"])], "root_id bigint, label array<string>"))
    monkeypatch.setattr(labels, "ROUNDS", 3)
    assert {r["root_id"]: r["label"] for r in labels.clean(n).collect()} == {1: ["abc"], 2: ["de"]}


def test_a_table_of_an_ingest_costs_no_other(spark, tmp_path):
    from graphloom.sources import driver_tables

    driver_tables.csv_sources(spark, "/root/testdata/sf0.001", str(tmp_path))
    sources = csv_tables.read_with_facts(spark, str(tmp_path))
    made = ingest.Tables(spark, {k: sources[k] for k in ("neurons", "nblast")}, driver_tables.REGIONS, driver_tables.EDGE_TYPES)
    assert made.shapes.count() > 0 and not {"edges", "label_log", "coordinates"} & set(made.__dict__)
    with pytest.raises(KeyError):
        made.edges


@pytest.mark.parametrize("name", ["labels_latest_first", "orphan_report", "orphans_of_a_part"])
def test_labels_of_known_nodes_need_no_edges(spark, name):
    from graphloom import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "p_partkey" in plan and "l_partkey" not in plan


@pytest.mark.parametrize("name,derived", [("filter_similar_upstream_weighted", "input_synapses")])
def test_sets_of_ids_need_no_other_columns_of_the_nodes(spark, name, derived):
    from graphloom import queries

    plan = queries.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert derived not in plan
