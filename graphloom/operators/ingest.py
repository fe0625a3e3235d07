"""From the CSV sources to a graph's tables."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.functions.text import web_safe
from graphloom.model import Graph, degrees, with_defaults
from graphloom.operators import labels as label_ops
from graphloom.sources.csv_tables import file_facts
from graphloom.storage import written

SHAPE_LEAST = 4
SCORES = ("nt_type_score", "ach_avg", "gaba_avg", "glut_avg", "ser_avg", "oct_avg", "da_avg")


class IngestError(ValueError):
    pass


def decoded(c: Column, kind: str) -> Column:
    """A cell: web-safe, empty as the type's empty value, arrays split at commas, numbers cast."""
    text = F.trim(web_safe(F.coalesce(c, F.lit(""))))
    if kind == "array":
        return F.filter(F.transform(F.split(text, ","), lambda x: F.trim(x)), lambda x: x != "")
    if kind == "string":
        return text
    return F.coalesce(text.try_cast("bigint" if kind == "long" else "double"), F.lit(0 if kind == "long" else 0.0))


#: Cells of each source that are whole numbers (l) or numbers (d); ids must be there, others may be empty.
NUMBERS = {
    "neurons": {"root_id": "l", **{c: "d" for c in SCORES}}, "classification": {"root_id": "l"}, "cell_types": {"root_id": "l"}, "connectivity_tags": {"root_id": "l"}, "nblast": {"root_id": "l"},
    "cell_stats": {"root_id": "l", "length_nm": "l", "area_nm": "l", "size_nm": "l"}, "labels": {"root_id": "l", "user_id": "l", "supervoxel_id": "l", "label_id": "l"},
    "connections": {"pre_root_id": "l", "post_root_id": "l", "syn_count": "l"}, "coordinates": {"root_id": "l", "supervoxel_id": "l"},
}
IDS = ("root_id", "pre_root_id", "post_root_id")


def rejects(sources: dict[str, DataFrame]) -> DataFrame:
    """What of the sources cannot be read: source, file, reason, column, value and the row as JSON; one row for each fault.

    Reasons are ``row`` (other than the source's number of cells; the value is the row as it stands), ``number`` (a cell that is
    none, which :func:`decoded` takes for 0), ``id`` (a missing or unreadable id, whose row is left out) and ``score`` (an item of
    a list of scores that is no pair of numbers). Sources that were read with their facts also name the file.
    """
    out = []
    for name, df in sources.items():
        kept = [c for c in df.columns if not c.startswith("own_")]
        text = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
        fault = lambda test, reason, c, value: F.when(test, F.struct(F.lit(reason).alias("reason"), F.lit(c).cast("string").alias("column"), value.alias("value")))
        faults = []
        if "own_corrupt" in df.columns:
            faults.append(fault(F.col("own_corrupt").isNotNull(), "row", None, F.col("own_corrupt")))
        for c, kind in NUMBERS.get(name, {}).items():
            unreadable = text(c).try_cast("bigint" if kind == "l" else "double").isNull()
            faults.append(fault(unreadable, "id", c, F.col(c)) if c in IDS else fault(unreadable & (text(c) != ""), "number", c, F.col(c)))
        listed = F.filter(F.array(*faults), lambda f: f.isNotNull())
        if name == "nblast":
            pair = lambda x: F.split_part(x, F.lit(":"), F.lit(1)).try_cast("bigint").isNotNull() & F.split_part(x, F.lit(":"), F.lit(2)).try_cast("int").isNotNull()
            items = F.filter(F.split(F.coalesce("scores", F.lit("")), ";"), lambda x: (F.trim(x) != "") & ~F.coalesce(pair(x), F.lit(False)))
            listed = F.concat(listed, F.transform(items, lambda x: F.struct(F.lit("score").alias("reason"), F.lit("scores").alias("column"), x.alias("value"))))
        file = F.col("own_file") if "own_file" in df.columns else F.lit(None).cast("string")
        rows = df.select(F.lit(name).alias("source"), file.alias("file"), F.to_json(F.struct(*kept)).alias("row"), F.explode(listed).alias("f"))
        out.append(rows.select("source", "file", F.col("f.reason").alias("reason"), F.col("f.column").alias("column"), F.col("f.value").alias("value"), "row"))
    return reduce(DataFrame.unionAll, out)


def _unique(df: DataFrame, *keys: str) -> DataFrame:
    twice = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").limit(5).collect()
    if twice:
        raise IngestError(f"{', '.join(keys)} not unique: {[tuple(r)[:-1] for r in twice]}")
    return df


def _keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("root_id", F.col("root_id").try_cast("bigint")).where(F.col("root_id").isNotNull())


def orphans(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of unknown nodes."""
    return df.join(nodes.select("root_id"), "root_id", "left_anti")


def base_nodes(neurons: DataFrame) -> DataFrame:
    scores = [decoded(F.col(c), "double").alias(c) for c in SCORES]
    rows = _keyed(neurons).select("root_id", decoded(F.col("group"), "string").alias("group"), F.upper(decoded(F.col("nt_type"), "string")).alias("nt_type"), *scores)
    # every other table looks at the nodes, so they are decoded once
    return _unique(written(rows, "neurons")[0], "root_id")


def coordinates(rows: DataFrame) -> DataFrame:
    """position and supervoxel_id arrays of each node, each (position, id) once, none with a zero."""
    r = _keyed(rows).select("root_id", F.trim("position").alias("position"), F.col("supervoxel_id").try_cast("bigint").alias("supervoxel_id"))
    r = r.where((F.col("supervoxel_id") != 0) & ~F.col("position").rlike(r"(^|[\[ ,])0([\] ,]|$)")).dropDuplicates(["root_id", "position", "supervoxel_id"])
    both = F.sort_array(F.collect_list(F.struct("supervoxel_id", "position")))
    return r.groupBy("root_id").agg(both.alias("b")).select("root_id", F.transform("b", lambda x: x["position"]).alias("position"), F.transform("b", lambda x: x["supervoxel_id"]).alias("supervoxel_id"))


def coordinate_rows(coords: DataFrame) -> DataFrame:
    return coords.select("root_id", F.explode(F.arrays_zip("position", "supervoxel_id")).alias("z")).select("root_id", "z.position", "z.supervoxel_id")


def shapes(nblast: DataFrame, nodes: DataFrame, least: int = SHAPE_LEAST) -> DataFrame:
    """src, dst, score of ``id:score;id:score`` lists: scores from ``least`` to 9, known targets only."""
    pairs = _keyed(nblast).select(F.col("root_id").alias("src"), F.explode(F.split("scores", ";")).alias("p")).where(F.col("p").contains(":"))
    both = pairs.select("src", F.split_part("p", F.lit(":"), F.lit(1)).try_cast("bigint").alias("dst"), F.split_part("p", F.lit(":"), F.lit(2)).try_cast("int").alias("score"))
    good = both.where((F.col("score") >= least) & (F.col("score") < 10) & (F.col("src") != F.col("dst")))
    return good.join(nodes.select(F.col("root_id").alias("dst")), "dst", "left_semi").select("src", "dst", "score").dropDuplicates(["src", "dst"])


def edges_of(connections: DataFrame, nodes: DataFrame, regions: list[str], edge_types: list[str]) -> DataFrame:
    """Checked edges: codes in upper case, both ends known, region and type of their domains, one row a region."""
    e = connections.select(
        F.col("pre_root_id").try_cast("bigint").alias("pre_id"), F.col("post_root_id").try_cast("bigint").alias("post_id"), F.upper(F.trim("neuropil")).alias("region"),
        F.col("syn_count").try_cast("bigint").alias("weight"), F.upper(F.trim("nt_type")).alias("edge_type"),
    )
    # decoded once for all checks and whatever reads them
    e, _ = written(e, "connections")
    known = nodes.select("root_id")
    for end in ("pre_id", "post_id"):
        lost = e.join(known, F.col(end) == F.col("root_id"), "left_anti").limit(3).collect()
        if lost:
            raise IngestError(f"edges of unknown nodes: {lost}")
    bad = e.where(~F.col("region").isin(*regions) | ~F.col("edge_type").isin(*edge_types) | F.col("weight").isNull()).limit(3).collect()
    if bad:
        raise IngestError(f"edges of an unknown region or type, or without a weight: {bad}")
    return _unique(e, "pre_id", "post_id", "region")


def named(nodes: DataFrame) -> DataFrame:
    """``group.N``: N counts a group's nodes by partners times id, the largest first. The product needs more than 64 bits."""
    big = (F.col("input_cells") + F.col("output_cells")).cast("decimal(20,0)") * F.col("root_id").cast("decimal(18,0)")
    n = F.row_number().over(Window.partitionBy("group").orderBy(F.desc(big), "root_id"))
    return nodes.withColumn("name", F.concat("group", F.lit("."), n.cast("string")))


@dataclass
class Report:
    """Rows of each source that belong to no node."""

    orphans: dict[str, int]


class Tables:
    """What is made of a folder's sources. Each table is decoded and checked when it is first asked for, so that one of them costs no other."""

    def __init__(self, spark: SparkSession, sources: dict[str, DataFrame], regions: list[dict], edge_types: dict[str, str]):
        self.spark, self.sources, self.regions, self.edge_types = spark, sources, regions, edge_types

    @cached_property
    def nodes(self) -> DataFrame:
        return base_nodes(self.sources["neurons"])

    def known(self, name: str) -> DataFrame:
        """The rows of a source that belong to a node."""
        return _keyed(self.sources[name]).join(self.nodes.select("root_id"), "root_id", "left_semi")

    def lost(self, name: str) -> int:
        return orphans(_keyed(self.sources[name]), self.nodes).count()

    @cached_property
    def edges(self) -> DataFrame:
        return edges_of(self.sources["connections"], self.nodes, [r["region"].upper() for r in self.regions], list(self.edge_types))

    @cached_property
    def label_log(self) -> DataFrame:
        return self.known("labels").select(F.col("label_id").try_cast("bigint").alias("label_id"), "root_id", web_safe(F.col("label")).alias("label"), F.col("user_id").try_cast("bigint").alias("user_id"), "user_name", "user_affiliation", "date_created")

    @cached_property
    def shapes(self) -> DataFrame:
        return shapes(self.sources["nblast"], self.nodes)

    @cached_property
    def coordinates(self) -> DataFrame:
        return coordinates(self.sources["coordinates"])

    def rejects(self) -> DataFrame:
        return rejects(self.sources)

    def files(self) -> DataFrame:
        return file_facts(self.sources)

    def graph(self, rules: label_ops.Rules = label_ops.Rules()) -> tuple[Graph, Report]:
        """All of it. Unknown ids are skipped and counted; those of cell types, and edges', are errors."""
        lost = {name: self.lost(name) for name in ("classification", "cell_types", "connectivity_tags", "cell_stats", "labels")}
        if lost["cell_types"]:
            raise IngestError(f"cell_types: {lost['cell_types']} rows of unknown nodes")
        text = ("flow", "super_class", "class", "sub_class", "hemilineage", "side", "nerve")
        cls = _unique(self.known("classification"), "root_id").select("root_id", *[decoded(F.col(c), "string").alias(c) for c in text])
        types = self.known("cell_types").where(F.trim("primary_type") != "").groupBy("root_id").agg(F.sort_array(F.collect_set(F.trim("primary_type"))).alias("cell_type"))
        tags = self.known("connectivity_tags").dropDuplicates(["root_id"]).select("root_id", decoded(F.col("connectivity_tag"), "array").alias("connectivity_tag"))
        stats = self.known("cell_stats").dropDuplicates(["root_id"]).select("root_id", *[decoded(F.col(c), "long").alias(c) for c in ("length_nm", "area_nm", "size_nm")])
        full = self.nodes
        for part in (cls, types, tags, stats, label_ops.grouped(self.label_log, self.nodes), degrees(self.edges)):
            full = full.join(part, "root_id", "left")
        full = named(with_defaults(label_ops.clean(with_defaults(full), rules, self.edge_types)))
        g = Graph(full, self.edges, label_log=self.label_log, shape_sim=self.shapes, regions=self.regions, edge_types=self.edge_types)
        g.extra["coordinates"] = lambda: self.coordinates
        g.extra["rejects"] = self.rejects
        if all("own_file" in df.columns for df in self.sources.values()):
            g.extra["files"] = self.files
        return g, Report(lost)


def build(spark: SparkSession, sources: dict[str, DataFrame], regions: list[dict], edge_types: dict[str, str], rules: label_ops.Rules = label_ops.Rules()) -> tuple[Graph, Report]:
    """The graph of a folder's sources, as :class:`Tables` has it."""
    return Tables(spark, sources, regions, edge_types).graph(rules)
