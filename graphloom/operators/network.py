"""Networks for display: capped, grouped and by region."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.regions import hemisphere
from graphloom.functions.text import with_commas
from graphloom.model import BY_NAME, Graph


def capped(edges: DataFrame, cap: int = 50, by_region: bool = False) -> DataFrame:
    """The heaviest rows of (pre_id, post_id[, region]) until ``cap`` of them are no loops; 0 keeps all.

    With a cap, a row stays if fewer than ``cap`` rows between different nodes come before it. Those are found from the
    heaviest ``cap`` such rows alone, so nothing but a threshold passes a single task.
    """
    keys = ["pre_id", "post_id", *(["region"] if by_region else [])]
    total = edges.groupBy(*keys).agg(F.sum("weight").alias("weight"))
    if not cap:
        return total
    order = [F.desc("weight"), *map(F.col, keys)]
    last = total.where("pre_id <> post_id").orderBy(*order).limit(cap)
    n_last = last.agg(F.count("*").alias("n"), F.max(F.struct((-F.col("weight")).alias("w"), *keys)).alias("edge"))
    place = F.struct((-F.col("weight")).alias("w"), *keys)
    return total.crossJoin(F.broadcast(n_last)).where((F.col("n") < cap) | (place <= F.col("edge"))).select(*keys, "weight")


def grouped(g: Graph, edges: DataFrame, name: str, cap: int = 50, with_side: bool = False, hemispheres: bool = False) -> DataFrame:
    """Edges between the groups of an attribute: pre_group, post_group[, region], weight; missing values are ``Unassigned name``."""
    a = BY_NAME[name]
    value = F.when(a.present(), F.array_join(a.column(), ", ") if a.kind == "array" else a.column().cast("string")).otherwise(F.lit(f"Unassigned {name}"))
    if with_side:
        value = F.when(F.col("side") != "", F.concat(value, F.lit(" "), F.col("side"))).otherwise(value)
    groups = g.nodes.select("root_id", value.alias("grp"))
    pre, post = groups.withColumnsRenamed({"root_id": "pre_id", "grp": "pre_group"}), groups.withColumnsRenamed({"root_id": "post_id", "grp": "post_group"})
    region = hemisphere(F.col("region")) if hemispheres else F.col("region")
    rows = edges.join(pre, "pre_id").join(post, "post_id").select(F.col("pre_group").alias("pre_id"), F.col("post_group").alias("post_id"), region.alias("region"), "weight")
    return capped(rows, cap, hemispheres).withColumnsRenamed({"pre_id": "pre_group", "post_id": "post_group"})


def group_shares(g: Graph, name: str, of: DataFrame) -> DataFrame:
    """Size of each group in ``of`` (root_id) and its rounded share in percent."""
    rows = g.nodes.join(of.select("root_id").distinct(), "root_id", "left_semi").select(F.when(BY_NAME[name].present(), BY_NAME[name].column().cast("string")).otherwise(f"Unassigned {name}").alias("grp"))
    n = rows.groupBy("grp").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("grp", "n", F.bround(100.0 * F.col("n") / F.col("total")).cast("int").alias("percent"))


def bipartite(edges: DataFrame) -> DataFrame:
    """Weights from nodes into regions and from regions to nodes: kind, node, region, weight; one pass of grouping sets."""
    out = edges.groupingSets([[F.col("pre_id"), F.col("region")], [F.col("region"), F.col("post_id")]], "pre_id", "region", "post_id").agg(F.sum("weight").alias("weight"), F.grouping("post_id").alias("into"))
    return out.select(F.when(F.col("into") == 1, "into").otherwise("out").alias("kind"), F.when(F.col("into") == 1, F.col("pre_id")).otherwise(F.col("post_id")).alias("node"), "region", "weight")


def loops_and_crossings(edges: DataFrame) -> DataFrame:
    kind = F.when(F.col("pre_id") == F.col("post_id"), "loop").otherwise("crossing")
    return edges.groupBy(kind.alias("kind")).agg(F.sum("weight").alias("weight"), F.count("*").alias("rows"))


def legend(edges: DataFrame, top: int = 5) -> DataFrame:
    """The heaviest pairs of either kind."""
    p = edges.groupBy("pre_id", "post_id").agg(F.sum("weight").alias("weight")).withColumn("kind", F.when(F.col("pre_id") == F.col("post_id"), "loop").otherwise("crossing"))
    loops = p.where("kind = 'loop'").orderBy(F.desc("weight"), "pre_id", "post_id").limit(top)
    return loops.unionAll(p.where("kind = 'crossing'").orderBy(F.desc("weight"), "pre_id", "post_id").limit(top))


def shown_nodes(edges: DataFrame, centres: DataFrame, cap: int = 0) -> DataFrame:
    """The ends of edges, and centres while there are fewer nodes than ``cap``; with the number of edges at each and its drawn size."""
    ends = edges.select(F.explode(F.array("pre_id", "post_id")).alias("root_id")).groupBy("root_id").agg(F.count("*").alias("edges"))
    more = centres.select("root_id").distinct().join(ends, "root_id", "left_anti").withColumn("edges", F.lit(0).cast("bigint"))
    if cap:
        more = more.orderBy("root_id").limit(max(0, cap - ends.count()))
    return ends.unionAll(more).withColumn("size", F.round(F.pow(F.col("edges").cast("double"), F.lit(0.25)), 6))


LARGE = 50_000  #: total weight from which weights are shown in thousands (a fixed value)


def drawn_edges(edges: DataFrame, layered: bool = False) -> DataFrame:
    """How the pairs of shown edges (pre_id, post_id, weight) are drawn: width, label and title.

    From a total of 50,000 on, a label is in thousands with a K (below half a thousand in full) and a width goes with the share
    of the heaviest row, at most 10, as it does in layers; else a width is the number of digits.
    """
    sums = edges.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("total"), F.coalesce(F.max("weight"), F.lit(0)).alias("most"))
    pairs = edges.groupBy("pre_id", "post_id").agg(F.sum("weight").alias("weight")).crossJoin(F.broadcast(sums))
    large, weight = F.col("total") >= LARGE, F.col("weight")
    thousands = F.bround(weight / 1000).cast("bigint")
    label = F.when(large & (thousands > 0), F.concat(with_commas(thousands), F.lit("K"))).otherwise(with_commas(weight))
    share = F.least(F.lit(10.0), 50 * weight / F.when(F.col("most") == 0, 1).otherwise(F.col("most")))
    width = F.when(large | F.lit(layered), share).otherwise(F.length(weight.cast("string")).cast("double"))
    return pairs.select("pre_id", "post_id", "weight", width.alias("width"), label.alias("label"), F.concat(with_commas(weight), F.lit(" synapses")).alias("title"))


def drawn_nodes(g: Graph, edges: DataFrame, centres: DataFrame, cap: int = 50, marks: dict[int, str] | None = None) -> DataFrame:
    """How the nodes of shown edges are drawn: root_id, centre, name, caption, size and mass.

    Captions are a node's name, behind its mark in brackets if it has one; they are left blank beside centres where ten or more
    nodes are shown. Centres share the size of 20 nodes.
    """
    shown = shown_nodes(edges, centres, cap).select("root_id").join(centres.select("root_id", F.lit(True).alias("centre")).distinct(), "root_id", "left")
    names = shown.join(g.nodes.select("root_id", "name"), "root_id", "left").select("root_id", F.coalesce("centre", F.lit(False)).alias("centre"), F.coalesce("name", F.lit("")).alias("name"))
    counts = names.agg(F.count("*").alias("n")).crossJoin(centres.select("root_id").distinct().agg(F.count("*").alias("n_centres")))
    mark = F.create_map(*[x for k, v in (marks or {}).items() for x in (F.lit(k), F.lit(v))])[F.col("root_id")] if marks else F.lit(None).cast("string")
    caption = F.coalesce(F.concat(F.lit("("), mark, F.lit(") "), F.col("name")), F.col("name"))
    share = F.when(F.col("centre"), F.greatest(F.lit(1.0), F.floor(20 / F.greatest("n_centres", F.lit(1))))).otherwise(F.lit(1.0))
    size = F.bround(F.when(F.col("centre"), 10).otherwise(5) * F.sqrt(F.sqrt(share))).cast("int")
    return names.crossJoin(F.broadcast(counts)).select("root_id", "centre", "name", F.when(F.col("centre") | (F.col("n") < 10), caption).otherwise(F.lit(" ")).alias("caption"), size.alias("size"), F.when(F.col("centre"), 3).otherwise(1).alias("mass"))


def drawn_groups(g: Graph, name: str, of: DataFrame) -> DataFrame:
    """How the groups of an attribute among nodes ``of`` are drawn: grp, n, caption, title and size."""
    shares = group_shares(g, name, of)
    caption = F.concat("grp", F.lit(" "), F.when(F.col("percent") > 0, F.col("percent").cast("string")).otherwise("<1"), F.lit("%"))
    title = F.concat(F.lit(f"Queried nodes for which '{BY_NAME[name].title}' equals '"), F.col("grp"), F.lit("', "), F.col("n").cast("string"), F.lit(" cells"))
    size = F.bround(10 * F.sqrt(F.sqrt((1 + F.col("percent")).cast("double")))).cast("int")
    return shares.select("grp", "n", caption.alias("caption"), title.alias("title"), size.alias("size"))
