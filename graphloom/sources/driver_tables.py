"""A graph over the TPC-H-like test tables: parts are nodes, consecutive parts of an order are edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import Graph, degrees, with_defaults
from graphloom.operators import ingest, shapes
from graphloom.sources import csv_tables, snapshots
from graphloom.storage import scratch

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate", "l_returnflag", "l_linestatus"]
REGIONS = [
    {"region": "A_L", "description": "accepted lines", "hemisphere": "Left", "category": "closed"},
    {"region": "N", "description": "new lines", "hemisphere": "Center", "category": "open"},
    {"region": "R_R", "description": "returned lines", "hemisphere": "Right", "category": "closed"},
]
EDGE_TYPES = {"F": "finished", "O": "open"}

_graphs: dict[tuple[str, str, str], Graph] = {}
_ingests: dict[tuple[str, str], ingest.Tables] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def consecutive(lineitem: DataFrame, key: str) -> DataFrame:
    """Edges between the ``key`` values of neighbouring lines of an order, summed by region; dealt by start, so that what is grouped by it needs no shuffle."""
    n = max(1, int(lineitem.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    after = F.lead(key).over(Window.partitionBy("l_orderkey").orderBy(*ORDER))
    region = F.when(F.col("l_returnflag") == "A", "A_L").when(F.col("l_returnflag") == "R", "R_R").otherwise(F.col("l_returnflag"))
    seq = lineitem.select(F.col(key).alias("pre_id"), after.alias("post_id"), region.alias("region"), F.col("l_linestatus").alias("edge_type"), "l_quantity")
    return seq.where("post_id IS NOT NULL").repartition(n, "pre_id").groupBy("pre_id", "post_id", "region").agg(F.sum("l_quantity").cast("bigint").alias("weight"), F.max("edge_type").alias("edge_type"))


def nodes_of(part: DataFrame, edges: DataFrame) -> DataFrame:
    heaviest = edges.groupBy("pre_id", "edge_type").agg(F.sum("weight").alias("w")).groupBy(F.col("pre_id").alias("root_id")).agg(F.min_by("edge_type", F.struct(-F.col("w"), "edge_type")).alias("nt_type"))
    side = F.when(F.col("p_partkey") % 3 == 0, "left").when(F.col("p_partkey") % 3 == 1, "right").otherwise("center")
    base = part.select(
        F.col("p_partkey").alias("root_id"), F.col("p_type").alias("super_class"), F.col("p_brand").alias("class"), F.col("p_size").cast("string").alias("sub_class"),
        F.split("p_name", " ").alias("label"), F.concat("p_type", F.lit("."), "p_brand").alias("group"), F.round(F.col("p_retailprice") * 100).cast("bigint").alias("size_nm"), side.alias("side"),
    )
    return with_defaults(base.join(degrees(edges), "root_id", "left").join(heaviest, "root_id", "left"))


def _label_log(spark: SparkSession, sf_dir: str, n_parts: int) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("label_id"), (F.col("doc_id") % n_parts).alias("root_id"), F.col("text").alias("label"), F.col("source").alias("user_name"), F.col("lang").alias("user_affiliation"), F.col("n_chars").cast("string").alias("date_created"))


def _shape_sim(spark: SparkSession, sf_dir: str, least: int = 2, sources: Column | None = None) -> DataFrame:
    """Scores of all vectors against all others, or of those whose ``src`` meets a condition: floor(10 * cosine), for those of at least ``least``."""
    return shapes.scores(read(spark, sf_dir, "embeddings"), sources, least)


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The part graph of a folder, made once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir, "part")
    if key not in _graphs:
        edges = consecutive(read(spark, sf_dir, "lineitem"), "l_partkey").persist()
        part = read(spark, sf_dir, "part")
        g = Graph(nodes_of(part, edges).persist(), edges, regions=REGIONS, edge_types=EDGE_TYPES, persist=True, node_ids=part.select(F.col("p_partkey").alias("root_id")))
        g.label_log = _label_log(spark, sf_dir, part.count())
        g.shape_scores = lambda sources: _shape_sim(spark, sf_dir, sources=sources)
        _graphs[key] = g
    return _graphs[key]


def supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The denser graph of consecutive suppliers, for similarity in both directions."""
    key = (spark.sparkContext.applicationId, sf_dir, "supplier")
    if key not in _graphs:
        edges = consecutive(read(spark, sf_dir, "lineitem"), "l_suppkey").persist()
        nodes = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("root_id"), F.col("s_name").alias("name"))
        _graphs[key] = Graph(with_defaults(nodes.join(degrees(edges), "root_id", "left")), edges, regions=REGIONS, edge_types=EDGE_TYPES, persist=True, node_ids=nodes.select("root_id"))
    return _graphs[key]


def strong_supplier_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The supplier graph of its heavier pairs: those above three quarters of all in weight, without regions."""
    key = (spark.sparkContext.applicationId, sf_dir, "strong")
    if key not in _graphs:
        g = supplier_graph(spark, sf_dir)
        bound = g.pairs.agg(F.expr("percentile_disc(0.75) WITHIN GROUP (ORDER BY weight)").cast("bigint").alias("bound"))
        strong = g.pairs.crossJoin(F.broadcast(bound)).where("weight >= bound").select("pre_id", "post_id", F.lit("N").alias("region"), "weight", F.lit("O").alias("edge_type")).persist()
        nodes = g.nodes.select("root_id", "name").join(degrees(strong), "root_id", "left")
        _graphs[key] = Graph(with_defaults(nodes), strong, regions=REGIONS, edge_types=EDGE_TYPES, persist=True, node_ids=g.ids)
    return _graphs[key]


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The part graph as a committed snapshot with its text index and both layouts of edges, made once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir, "stored")
    if key not in _graphs:
        g = graph(spark, sf_dir)
        path = scratch(spark, "snapshots")
        snapshots.commit(Graph(g.nodes, g.edges, regions=g.regions, edge_types=g.edge_types), path, "1")
        _graphs[key] = snapshots.checkout(spark, path, "1")
    return _graphs[key]


def csv_sources(spark: SparkSession, sf_dir: str, folder: str) -> None:
    """The nine CSV sources of the part graph: nodes from ``part``, edges from ``lineitem``, labels from ``documents``; some cells and ids are faulty."""
    g = graph(spark, sf_dir)
    n, part, docs = g.nodes, read(spark, sf_dir, "part"), read(spark, sf_dir, "documents")
    total = part.count()
    key, text = F.col("p_partkey"), lambda c: c.cast("string")
    # of every fiftieth node the area is no number, and every fortieth row of a source has an unknown node
    known = lambda c: F.when(c % 40 == 39, c + 10 * total).otherwise(c)
    tables = {
        "neurons": n.select(text(F.col("root_id")), "group", F.lower("nt_type"), text(F.col("size_nm") / 1000.0), *[F.lit("0.5") for _ in range(6)]),
        "classification": part.select(text(known(key)), F.lit("flow"), "p_type", "p_brand", F.concat(F.lit(" "), text(F.col("p_size"))), F.lit(""), F.lit("le'ft"), F.lit("")),
        "cell_types": part.select(text(key), F.concat(F.lit("T"), text(key % 7)), F.lit("")).unionAll(part.where(key % 5 == 0).select(text(key), F.concat(F.lit("S"), text(key % 3)), F.lit(""))),
        "cell_stats": part.select(text(known(key)), text(F.col("p_size") * 1000), F.when(key % 50 == 0, "n/a").otherwise(text(F.col("p_size"))), text(F.col("p_size") * 7)),
        "labels": docs.select(text(F.col("doc_id") % (total + 50)), F.concat("lang", F.lit(" "), "source"), text(F.col("doc_id") % 9), F.lit("[1 2 3]"), F.lit("5"), text(F.col("doc_id")), F.lpad(text(F.col("n_chars")), 9, "0"), "source", "lang"),
        "connections": g.edges.select(text(F.col("pre_id")), text(F.col("post_id")), F.lower("region"), text(F.col("weight")), F.lower("edge_type")),
        "connectivity_tags": part.where("p_size > 40").select(text(known(key)), F.concat(F.lit("rich, size "), text(F.col("p_size")), F.lit(",,"))),
        "coordinates": part.select(text(key), F.concat(F.lit("["), text(key + 1), F.lit(" 7 8]")), text(key + 100)).unionAll(part.select(text(key), F.lit("[0 1 2]"), text(key + 9))),
        "nblast": part.select(text(key), F.concat(text((key + 1) % total), F.lit(":"), text(key % 11), F.lit(";"), text((key + 2) % total), F.lit(":4;x"), F.lit(";"), text(key), F.lit(":10;"), text(key + 10 * total), F.lit(":5"))),
    }
    for name, df in tables.items():
        csv_tables.write_csv(df.toDF(*[c.split(" ")[0] for c in csv_tables.SCHEMAS[name].split(", ")]), f"{folder}/{name}.csv", compress=name == "labels")


def csv_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph that ingest makes of :func:`csv_sources`, made once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir, "csv")
    if key not in _graphs:
        _graphs[key], _ = csv_ingest(spark, sf_dir).graph()
    return _graphs[key]


def csv_ingest(spark: SparkSession, sf_dir: str) -> ingest.Tables:
    """The tables of :func:`csv_sources`, which are written once for each application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ingests:
        folder = scratch(spark, "csv")
        csv_sources(spark, sf_dir, folder)
        _ingests[key] = ingest.Tables(spark, csv_tables.read_with_facts(spark, folder), REGIONS, EDGE_TYPES)
    return _ingests[key]
