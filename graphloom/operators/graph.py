"""Neighbourhoods, edge queries and traversal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import reach
from graphloom.plans.language import QueryError


def pairs_over(g: Graph, least: int = 0, by_end: bool = False) -> DataFrame:
    """Pair weights of at least ``least``; 0 keeps all. ``by_end``: from the layout by end, where there is one."""
    pairs = g.pairs_by_post if by_end and g.pairs_by_post is not None else g.pairs
    return pairs.where(F.col("weight") >= least) if least else pairs


def ending(g: Graph) -> DataFrame:
    """The edges from the layout by end, where there is one."""
    return g.edges_by_post if g.edges_by_post is not None else g.edges


def upstream(g: Graph, x: int, regions: set[str] | None = None, least: int = 0) -> DataFrame:
    """root_id of the nodes with an edge into x; ``least`` bounds the pair's weight."""
    e = ending(g).where(F.col("region").isin(*regions)) if regions is not None else pairs_over(g, least, by_end=True)
    return e.where(F.col("post_id") == x).select(F.col("pre_id").alias("root_id")).distinct()


def downstream(g: Graph, x: int, regions: set[str] | None = None, least: int = 0) -> DataFrame:
    e = g.edges.where(F.col("region").isin(*regions)) if regions is not None else pairs_over(g, least)
    return e.where(F.col("pre_id") == x).select(F.col("post_id").alias("root_id")).distinct()


def reciprocal(g: Graph, x: int) -> DataFrame:
    """Upstream and downstream of x. A loop of x is downstream only, so x is never in it."""
    return upstream(g, x).intersect(downstream(g, x)).where(F.col("root_id") != x)


def neighbour_sets(g: Graph, least: int = 0) -> DataFrame:
    """root_id, inputs and outputs (sorted arrays); nodes without either have empty ones."""
    p = pairs_over(g, least)
    into = p.groupBy(F.col("post_id").alias("root_id")).agg(F.sort_array(F.collect_set("pre_id")).alias("inputs"))
    out = p.groupBy(F.col("pre_id").alias("root_id")).agg(F.sort_array(F.collect_set("post_id")).alias("outputs"))
    none = F.array().cast("array<bigint>")
    return g.nodes.select("root_id").join(into, "root_id", "left").join(out, "root_id", "left").select("root_id", F.coalesce("inputs", none).alias("inputs"), F.coalesce("outputs", none).alias("outputs"))


def region_weights(g: Graph) -> DataFrame:
    """Weight of every node by region and direction."""
    both = F.explode(F.array(F.struct(F.col("post_id").alias("root_id"), F.lit("in").alias("direction")), F.struct(F.col("pre_id").alias("root_id"), F.lit("out").alias("direction"))))
    return g.edges.select(both.alias("x"), "region", "weight").groupBy("x.root_id", "x.direction", "region").agg(F.sum("weight").alias("weight"))


def up_down(g: Graph, x: int) -> DataFrame:
    """Neighbours of x by direction and region, as arrays."""
    rows = incident(g, x)
    up = rows.where((F.col("post_id") == x) & (F.col("pre_id") != x)).select(F.lit("up").alias("direction"), "region", F.col("pre_id").alias("other"))
    down = rows.where(F.col("pre_id") == x).select(F.lit("down"), "region", F.col("post_id"))
    return up.unionAll(down).groupBy("direction", "region").agg(F.sort_array(F.collect_list("other")).alias("neighbours"))


def incident(g: Graph, x: int) -> DataFrame:
    """The edge rows of one node: with a layout by end, those that start there and those that only end there, each from its own."""
    if g.edges_by_post is None:
        return g.edges.where((F.col("pre_id") == x) | (F.col("post_id") == x))
    return g.edges.where(F.col("pre_id") == x).unionAll(g.edges_by_post.where((F.col("post_id") == x) & (F.col("pre_id") != x)))


def edge_filter(edges: DataFrame, g: Graph, least: int = 0, edge_type: str | None = None, regions: set[str] | None = None) -> DataFrame:
    """Row by row: ``least`` bounds the weight of a region's row, not of the pair. 0, None and no regions don't filter."""
    if edge_type:
        if edge_type not in g.edge_types:
            raise QueryError(f"unknown edge type {edge_type!r}; there are {', '.join(g.edge_types)}.")
        edges = edges.where(F.col("edge_type") == edge_type)
    if least:
        edges = edges.where(F.col("weight") >= least)
    if regions:
        edges = edges.where(F.col("region").isin(*regions))
    return edges


def touching(edges: DataFrame, ids: DataFrame) -> DataFrame:
    """Edges with an end in ``ids`` (root_id): those whose start is, then those whose end only is, so none comes twice."""
    ids = ids.select("root_id").distinct()
    pre = edges.join(ids, F.col("pre_id") == F.col("root_id"), "left_semi")
    post = edges.join(ids, F.col("post_id") == F.col("root_id"), "left_semi").join(ids, F.col("pre_id") == F.col("root_id"), "left_anti")
    return pre.unionAll(post)


def between(edges: DataFrame, sources: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges from ``sources`` to ``targets``."""
    s, t = sources.select(F.col("root_id").alias("s")).distinct(), targets.select(F.col("root_id").alias("t")).distinct()
    return edges.join(s, F.col("pre_id") == F.col("s"), "left_semi").join(t, F.col("post_id") == F.col("t"), "left_semi")


def connections(g: Graph, ids: DataFrame, induced: bool = False, least: int = 0, edge_type: str | None = None, regions: set[str] | None = None) -> DataFrame:
    edges = edge_filter(g.edges, g, least, edge_type, regions)
    return between(edges, ids, ids) if induced else touching(edges, ids)


def _from(spark: SparkSession, ids: list[int]) -> DataFrame:
    return spark.createDataFrame([(i, i) for i in ids], "source bigint, root_id bigint")


def distances_from(g: Graph, x: int, *, up: bool = False, least: int = 0, max_depth: int | None = None, stop_at: int | None = None) -> DataFrame:
    return reach.distances(pairs_over(g, least), _from(g.spark, [x]), up=up, max_depth=max_depth, stop_at=stop_at).select("root_id", "depth")


def hop_histogram(reached: DataFrame, total: int) -> DataFrame:
    """Cumulative number of nodes and whole percent of ``total`` within each hop from 1; sources don't count."""
    by = reached.where("depth > 0").groupBy("depth").agg(F.count("*").alias("n"))
    # a row for each hop, so one ordered partition is small
    running = F.sum("n").over(Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    return by.select(F.col("depth").alias("hops"), running.alias("reached")).withColumn("percent", F.floor(F.col("reached") * 100 / F.lit(max(1, total))).cast("int"))


def path_nodes(g: Graph, source: int, target: int, least: int = 0, max_hops: int | None = None) -> DataFrame:
    """root_id and depth of the nodes on any shortest path; empty if there is none (of at most ``max_hops``) or both ends are one."""
    return reach.between(g, source, target, least, max_hops).nodes


def path_edges(g: Graph, source: int, target: int, least: int = 0, max_hops: int | None = None) -> DataFrame:
    """Pairs between consecutive layers of the shortest paths: pre_id, post_id, weight, depth (of the start)."""
    n = path_nodes(g, source, target, least, max_hops)
    a, b = n.select(F.col("root_id").alias("pre_id"), "depth"), n.select(F.col("root_id").alias("post_id"), F.col("depth").alias("to"))
    return pairs_over(g, least).join(a, "pre_id").join(b, "post_id").where(F.col("to") == F.col("depth") + 1).select("pre_id", "post_id", "weight", "depth")


def sorted_layers(g: Graph, source: int, target: int, least: int = 0, max_hops: int | None = None) -> DataFrame:
    """Nodes of the shortest paths with their place in their layer: by the strongest link to the layer before, then id."""
    n, e = path_nodes(g, source, target, least, max_hops), path_edges(g, source, target, least, max_hops)
    best = e.groupBy(F.col("post_id").alias("root_id")).agg(F.max("weight").alias("strongest"))
    place = F.row_number().over(Window.partitionBy("depth").orderBy(F.desc_nulls_last("strongest"), "root_id"))
    return n.join(best, "root_id", "left").select("root_id", "depth", place.alias("place"))


def distance_matrix(g: Graph, sources: list[int], targets: list[int], least: int = 0, max_depth: int | None = None) -> DataFrame:
    """source, target, hops of every pair of two short lists: -1 if unreachable (in ``max_depth`` hops), 0 for itself."""
    d = reach.distances(pairs_over(g, least), _from(g.spark, sources), max_depth=max_depth, targets=g.spark.createDataFrame([(t,) for t in set(targets)], "root_id bigint"))
    grid = g.spark.createDataFrame([(s, t) for s in sorted(set(sources)) for t in sorted(set(targets))], "source bigint, target bigint")
    return grid.join(d.withColumnRenamed("root_id", "target"), ["source", "target"], "left").select("source", "target", F.coalesce("depth", F.lit(-1)).alias("hops"))


def distance_table(matrix: DataFrame, targets: list[int]) -> DataFrame:
    """The matrix with a column for each target, as it is exported."""
    return matrix.groupBy("source").pivot("target", sorted(set(targets))).agg(F.first("hops"))


def rollups(g: Graph, x: int) -> DataFrame:
    """The weights of one node by region, hemisphere and input type, in and out, in one pass of grouping sets."""
    from graphloom.functions.regions import hemisphere

    rows = incident(g, x)
    side = F.explode(F.filter(F.array(F.when(F.col("post_id") == x, "in"), F.when(F.col("pre_id") == x, "out")), lambda d: d.isNotNull()))
    r = rows.withColumn("direction", side).withColumn("hemisphere", hemisphere(F.col("region")))
    sets = [[F.col("direction"), F.col("region")], [F.col("direction"), F.col("hemisphere")], [F.col("direction"), F.col("edge_type")], [F.col("direction")]]
    out = r.groupingSets(sets, "direction", "region", "hemisphere", "edge_type").agg(F.sum("weight").alias("weight"), F.grouping_id().alias("gid"))
    kind: Column = F.when(F.col("gid") == 3, "region").when(F.col("gid") == 5, "hemisphere").when(F.col("gid") == 6, "edge_type").otherwise("total")
    return out.select("direction", kind.alias("kind"), F.coalesce("region", "hemisphere", "edge_type", F.lit("All")).alias("value"), "weight").where((F.col("kind") != "edge_type") | (F.col("direction") == "in"))


