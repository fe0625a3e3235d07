"""Counts, categories, group matrices and leaderboards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.text import shown
from graphloom.model import BY_NAME, Graph
from graphloom.storage import numbered

CATEGORY_ATTRIBUTES = ("super_class", "class", "sub_class", "side", "nt_type", "group", "label", "input_neuropils", "output_neuropils", "cell_type", "flow", "hemilineage")
ALL = "All"


def _values(name: str) -> Column:
    """An attribute's present values as an array of text."""
    a = BY_NAME[name]
    one = a.column() if a.kind == "array" else F.array(a.column().cast("string"))
    return F.filter(F.coalesce(one, F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))


def global_counts(g: Graph) -> DataFrame:
    """nodes, weight, pairs, labels and nodes with a label or type, in one row."""
    n = g.nodes.agg(F.count("*").alias("nodes"), F.sum(F.size("label")).cast("bigint").alias("labels"), F.count_if((F.size("label") > 0) | (F.size("cell_type") > 0)).alias("identified"))
    e = g.pairs.agg(F.sum("weight").alias("weight"), F.count("*").alias("pairs"))
    return n.crossJoin(e)


def unique_values(g: Graph, name: str) -> DataFrame:
    return g.nodes.select(F.explode(_values(name)).alias("value")).distinct().orderBy("value")


def melted(nodes: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """root_id, attribute, value: a row for each present value, in one scan."""
    entries = F.array(*[F.struct(F.lit(n).alias("attribute"), F.array_distinct(_values(n)).alias("values")) for n in names])
    return nodes.select("root_id", F.explode(entries).alias("e")).select("root_id", "e.attribute", F.explode("e.values").alias("value"))


def category_counts(g: Graph, names: tuple[str, ...] = CATEGORY_ATTRIBUTES, top: int | None = None) -> DataFrame:
    """attribute, value, n, rank: how many nodes have a value, the most frequent first."""
    counts = melted(g.nodes, names).groupBy("attribute", "value").agg(F.count("*").alias("n"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("n"), "value")))
    return ranked.where(F.col("rank") <= top) if top else ranked


def category_sizes(g: Graph, names: tuple[str, ...] = CATEGORY_ATTRIBUTES) -> DataFrame:
    """attribute, assigned nodes and distinct values."""
    return melted(g.nodes, names).groupBy("attribute").agg(F.countDistinct("root_id").alias("assigned"), F.countDistinct("value").alias("distinct_values"))


def low_cardinality(g: Graph, names: tuple[str, ...] = CATEGORY_ATTRIBUTES, cap: int = 40) -> DataFrame:
    """The values, by frequency, of attributes with fewer than ``cap`` of them."""
    counts = melted(g.nodes, names).groupBy("attribute", "value").agg(F.count("*").alias("n"))
    few = counts.groupBy("attribute").agg(F.count("*").alias("k")).where(F.col("k") < cap).select("attribute")
    return counts.join(few, "attribute", "left_semi").withColumn("rank", F.row_number().over(Window.partitionBy("attribute").orderBy(F.desc("n"), "value")))


def multi_valued(nodes: DataFrame, names: tuple[str, ...] = ("super_class", "class", "sub_class", "side", "nt_type", "group", "flow", "hemilineage")) -> DataFrame:
    """attribute and number of distinct values, missing being one, where there are several; one scan."""
    wide = nodes.agg(*[F.countDistinct(F.coalesce(BY_NAME[n].column().cast("string"), F.lit(""))).alias(n) for n in names])
    long_ = wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("attribute"), F.col(f"`{n}`").alias("n")) for n in names])).alias("x")).select("x.*")
    return long_.where("n > 1")


def non_uniform(result: DataFrame, page: DataFrame, name: str) -> DataFrame:
    """Values of an array attribute on a page that some row of the result lacks."""
    values = page.select(F.explode(_values(name)).alias("value")).distinct()
    have = result.select("root_id", F.explode(F.array_distinct(_values(name))).alias("value")).join(values, "value").groupBy("value").agg(F.count("*").alias("n"))
    return have.crossJoin(F.broadcast(result.agg(F.count("*").alias("total")))).where("n < total").select("value")


def majority_type(g: Graph) -> DataFrame:
    """The edge type of the most weight leaving each node, ties alphabetical."""
    by = g.edges.groupBy("pre_id", "edge_type").agg(F.sum("weight").alias("w"))
    return by.groupBy(F.col("pre_id").alias("root_id")).agg(F.min_by("edge_type", F.struct(-F.col("w"), "edge_type")).alias("majority"))


# group matrices


def _grouped(pairs: DataFrame, g: Graph, name: str, keep: list[str]) -> DataFrame:
    groups = g.nodes.select("root_id", shown(BY_NAME[name].column()).alias("grp"))
    a, b = groups.withColumnsRenamed({"root_id": "pre_id", "grp": "from_group"}), groups.withColumnsRenamed({"root_id": "post_id", "grp": "to_group"})
    return pairs.join(a, "pre_id").join(b, "post_id").select("from_group", "to_group", *keep)


def group_cube(g: Graph, name: str, count: str = "weight") -> DataFrame:
    """from_group, to_group, n over all pairs of groups and All on either side. ``count``: weight, pairs or reciprocal."""
    pairs = g.pairs
    if count == "reciprocal":
        # both ways of two nodes meet under one key, so pairs are shuffled once; a loop is its own way back
        way = F.when(F.col("pre_id") == F.col("post_id"), 3).when(F.col("pre_id") < F.col("post_id"), 1).otherwise(2)
        two = pairs.select(F.least("pre_id", "post_id").alias("u"), F.greatest("pre_id", "post_id").alias("v"), way.alias("way")).groupBy("u", "v").agg(F.bit_or("way").alias("ways")).where("ways = 3")
        ends = F.array_distinct(F.array(F.struct(F.col("u").alias("pre_id"), F.col("v").alias("post_id")), F.struct(F.col("v").alias("pre_id"), F.col("u").alias("post_id"))))
        pairs = two.select(F.inline(ends)).withColumn("weight", F.lit(1))
    rows = _grouped(pairs, g, name, ["weight"])
    n = F.sum("weight") if count == "weight" else F.count("*").cast("double") if count == "reciprocal" else F.count("*")
    label = lambda c: F.when(F.grouping(c) == 1, ALL).otherwise(F.col(c)).alias(c + "_")
    cube = rows.cube("from_group", "to_group").agg(n.alias("n"), label("from_group"), label("to_group"))
    return cube.select(F.col("from_group_").alias("from_group"), F.col("to_group_").alias("to_group"), "n")


def group_sizes(g: Graph, name: str) -> DataFrame:
    groups = g.nodes.select(shown(BY_NAME[name].column()).alias("grp"))
    return groups.rollup("grp").agg(F.count("*").alias("n"), F.grouping("grp").alias("all")).select(F.when(F.col("all") == 1, ALL).otherwise(F.col("grp")).alias("grp"), "n")


def density(g: Graph, name: str, count: str = "pairs") -> DataFrame:
    """The cube with its densities and places: per possible ordered pair for ``pairs``, per connected pair for others, and percent of the total."""
    counts, sizes = group_cube(g, name, count), group_sizes(g, name)
    order = (F.when(F.col("grp") == ALL, 1).otherwise(0).desc(), F.desc("n"), F.asc("grp"))
    sizes = numbered(sizes, order, "place").withColumn("place", F.col("place") - 1)
    a, b = sizes.select(F.col("grp").alias("from_group"), F.col("n").alias("fn"), F.col("place").alias("from_place")), sizes.select(F.col("grp").alias("to_group"), F.col("n").alias("tn"), F.col("place").alias("to_place"))
    # Spark broadcasts the sizes itself where they are small enough; a grouping by labels may have many groups
    rows = counts.join(a, "from_group").join(b, "to_group")
    if count == "pairs":
        norm = F.when(F.col("from_group") == F.col("to_group"), F.col("fn") * (F.col("fn") - 1)).otherwise(F.col("fn") * F.col("tn"))
    else:
        rows = rows.join(group_cube(g, name, "pairs").withColumnRenamed("n", "connected"), ["from_group", "to_group"], "left")
        norm = F.coalesce("connected", F.lit(0))
    total = counts.where((F.col("from_group") == ALL) & (F.col("to_group") == ALL)).select(F.col("n").alias("total")).limit(1)
    out = rows.crossJoin(F.broadcast(total))
    return out.select("from_group", "to_group", "n", (F.col("n") / F.greatest(F.lit(1), norm)).alias("density"), (100.0 * F.col("n") / F.greatest(F.lit(1), F.col("total"))).alias("percent"), F.col("from_place").cast("int"), F.col("to_place").cast("int"))


COLD, HOT = "#AAAAAA", "#00FF00"


def heat_color(value: Column, low: float, middle: float, high: float) -> Column:
    """A colour with its opacity, 0 to 99, which grows as the root of the distance from the middle."""
    cold = value <= middle
    far = F.when(cold, (middle - value) / max(0.1, middle - low)).otherwise((value - middle) / max(0.1, high - middle))
    opacity = F.greatest(F.lit(0), F.least(F.lit(99), F.bround(F.sqrt(far) * 100).cast("int")))
    return F.concat(F.when(cold, COLD).otherwise(HOT), opacity.cast("string"))


# statistics of a result


def summary(nodes: DataFrame) -> DataFrame:
    """One row: nodes, labelled, classified, and sums of length, area and volume, which exceed 64 bits."""
    total = lambda c: F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias(c)
    return nodes.agg(F.count("*").alias("nodes"), F.count_if(F.size("label") > 0).alias("labelled"), F.count_if(F.col("class") != "").alias("classified"), total("length_nm"), total("area_nm"), total("size_nm"))


def top_labels(nodes: DataFrame, top: int = 10) -> DataFrame:
    return nodes.select(F.explode("label").alias("label")).groupBy("label").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(top)


def bar_chart(nodes: DataFrame, name: str, top: int = 10) -> DataFrame:
    """The most frequent values, arrays value by value: value, n, rank."""
    n = nodes.select(F.explode(_values(name)).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(top)
    return n.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def donut_chart(nodes: DataFrame, name: str) -> DataFrame:
    """All values by key, missing ones as Unknown: value, n."""
    return nodes.select(shown(BY_NAME[name].column()).alias("value")).groupBy("value").agg(F.count("*").alias("n")).orderBy("value")


def charts(nodes: DataFrame, donuts: tuple[str, ...] = ("side", "flow", "super_class"), bars: tuple[str, ...] = ("class", "sub_class", "group", "nt_type", "label", "input_neuropils", "output_neuropils")) -> DataFrame:
    """All charts of a result as one long table: chart, value, n."""
    all_ = [donut_chart(nodes, d).select(F.lit(d).alias("chart"), "value", "n") for d in donuts] + [bar_chart(nodes, b).select(F.lit(b).alias("chart"), "value", "n") for b in bars]
    return reduce(DataFrame.unionAll, all_)


# label log


def label_log(g: Graph, ids: DataFrame | None = None, user: str = "", lab: str = "") -> DataFrame:
    """The log's rows of a result, by parts of the contributor's and the laboratory's name, in any case."""
    log = g.label_log
    if ids is not None:
        log = log.join(ids.select("root_id").distinct(), "root_id", "left_semi")
    if user:
        log = log.where(F.lower("user_name").contains(user.lower()))
    return log.where(F.lower("user_affiliation").contains(lab.lower())) if lab else log


def leading_labs(log: DataFrame, top: int = 20) -> DataFrame:
    """Laboratories by labels, with their contributors; names with ``members`` in them are groups and left out."""
    named = log.where(F.col("user_affiliation").isNotNull() & (F.col("user_affiliation") != "") & ~F.lower("user_affiliation").contains("members"))
    out = named.groupBy(F.col("user_affiliation").alias("lab")).agg(F.count("*").alias("n"), F.countDistinct("user_name").alias("users"))
    return out.orderBy(F.desc("n"), "lab").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "lab")))


def leading_users(log: DataFrame, top: int = 20, latest: int | None = None) -> DataFrame:
    """Contributors by labels, of all or of the ``latest`` label ids."""
    rows = log.orderBy(F.desc("label_id")).limit(latest) if latest else log
    out = rows.where(~F.lower("user_name").contains("members")).groupBy(F.col("user_name").alias("user")).agg(F.count("*").alias("n"))
    return out.orderBy(F.desc("n"), "user").limit(top).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "user")))


def labelled_share(g: Graph, ids: DataFrame) -> DataFrame:
    """How many nodes of a result have a row in the log, of how many."""
    have = g.label_log.select("root_id").distinct().withColumn("has", F.lit(1))
    return ids.select("root_id").distinct().join(have, "root_id", "left").agg(F.count("has").alias("labelled"), F.count("*").alias("total"))
