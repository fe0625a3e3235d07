"""The data model: an annotated, weighted, directed multigraph as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attribute:
    """A node attribute that queries can name."""

    name: str
    kind: str  #: string, array, long or double
    aliases: tuple[str, ...] = ()
    convert: str | None = None  #: the graph's converter for right-hand sides: "edge_type" or "region"
    title: str = ""

    def column(self) -> Column:
        return F.col(f"`{self.name}`")

    def present(self) -> Column:
        """Not null, not the empty text, array or number 0."""
        c = self.column()
        if self.kind == "array":
            return F.coalesce(F.size(c) > 0, F.lit(False))
        if self.kind == "string":
            return F.coalesce(c != "", F.lit(False))
        return F.coalesce(c != 0, F.lit(False))


#: The attributes of a node table, in order. Missing values are null or the type's empty value.
ATTRIBUTES = (
    Attribute("root_id", "long", ("id",), title="Id"),
    Attribute("name", "string", title="Name"),
    Attribute("group", "string", title="Group"),
    Attribute("label", "array", ("labels", "annotation"), title="Labels"),
    Attribute("cell_type", "array", ("type",), title="Cell types"),
    Attribute("marker", "array", title="Markers"),
    Attribute("connectivity_tag", "array", ("tag",), title="Connectivity tags"),
    Attribute("flow", "string", title="Flow"),
    Attribute("super_class", "string", title="Super class"),
    Attribute("class", "string", title="Class"),
    Attribute("sub_class", "string", title="Sub class"),
    Attribute("hemilineage", "string", title="Hemilineage"),
    Attribute("nerve", "string", title="Nerve"),
    Attribute("side", "string", title="Side"),
    Attribute("nt_type", "string", ("nt",), "edge_type", "Edge type"),
    *(Attribute(n, "double", title=t) for n, t in (("nt_type_score", "Edge type score"), ("ach_avg", "ACH score"), ("gaba_avg", "GABA score"), ("glut_avg", "GLUT score"), ("ser_avg", "SER score"), ("oct_avg", "OCT score"), ("da_avg", "DA score"))),
    Attribute("input_neuropils", "array", ("input_regions",), "region", "Input regions"),
    Attribute("output_neuropils", "array", ("output_regions",), "region", "Output regions"),
    Attribute("input_cells", "long", ("in_degree",), title="Input partners"),
    Attribute("output_cells", "long", ("out_degree",), title="Output partners"),
    Attribute("input_synapses", "long", title="Input weight"),
    Attribute("output_synapses", "long", title="Output weight"),
    Attribute("length_nm", "long", title="Length"),
    Attribute("area_nm", "long", title="Area"),
    Attribute("size_nm", "long", ("size", "volume"), title="Volume"),
)
BY_NAME = {n: a for a in ATTRIBUTES for n in (a.name, *a.aliases)}

SPARK_TYPE = {"string": "string", "array": "array<string>", "long": "bigint", "double": "double"}


@dataclass
class Graph:
    """The tables of one snapshot. ``edges`` has one row for each (pre_id, post_id, region)."""

    nodes: DataFrame
    edges: DataFrame  #: pre_id, post_id, region, weight, edge_type
    label_log: DataFrame | None = None  #: label_id, root_id, label, user_id, user_name, user_affiliation, date_created
    shape_sim: DataFrame | None = None  #: src, dst, score
    regions: list[dict] = field(default_factory=list)  #: region, description, hemisphere, category
    edge_types: dict[str, str] = field(default_factory=dict)  #: code -> name
    persist: bool = False
    text_index: object | None = None  #: a :class:`graphloom.sources.text_index.TextIndex`, which free text then uses
    edges_by_post: DataFrame | None = None  #: the edges once more, laid out by their end
    pairs_by_post: DataFrame | None = None
    node_ids: DataFrame | None = None  #: root_id of every node, once, where that is known without the nodes' other columns
    shape_scores: Callable[[Column | None], DataFrame] | None = None  #: makes the rows of ``shape_sim`` whose src meets a condition, where no table has them
    extra: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    def _kept(self, df: DataFrame) -> DataFrame:
        return df.persist() if self.persist else df

    @property
    def spark(self):
        return self.nodes.sparkSession

    @property
    def ids(self) -> DataFrame:
        """root_id of every node; does not make the nodes' other columns where the source tells ids by themselves."""
        return self.nodes.select("root_id") if self.node_ids is None else self.node_ids

    def shapes(self, sources: Column | None = None) -> DataFrame | None:
        """Shape scores (src, dst, score), of the sources that meet a condition on ``src`` if one is given; scores that no table has are made for these only."""
        if self.shape_sim is None:
            return None if self.shape_scores is None else self.shape_scores(sources)
        return self.shape_sim if sources is None else self.shape_sim.where(sources)

    @cached_property
    def pairs(self) -> DataFrame:
        """Weights summed over regions: pre_id, post_id, weight."""
        return self._kept(self.edges.groupBy("pre_id", "post_id").agg(F.sum("weight").alias("weight")))

    @cached_property
    def labels(self) -> DataFrame:
        """The labels of nodes, one row each: root_id, label."""
        return self.nodes.select("root_id", F.explode("label").alias("label")).where("label <> ''")

    @cached_property
    def region_table(self) -> DataFrame:
        return self.spark.createDataFrame(self.regions, "region string, description string, hemisphere string, category string")


def degrees(edges: DataFrame) -> DataFrame:
    """Distinct partners, weight sums and sorted regions of either side, for every node with an edge.

    Each side is dealt by its node first, so that distinct partners are counted where they are; edges that are dealt by start
    already stay there.
    """
    n = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    inward = edges.select("pre_id", "post_id", "region", "weight").repartition(n, "post_id").groupBy(F.col("post_id").alias("root_id")).agg(F.countDistinct("pre_id").alias("input_cells"), F.sum("weight").alias("input_synapses"), F.sort_array(F.collect_set("region")).alias("input_neuropils"))
    outward = edges.groupBy(F.col("pre_id").alias("root_id")).agg(F.countDistinct("post_id").alias("output_cells"), F.sum("weight").alias("output_synapses"), F.sort_array(F.collect_set("region")).alias("output_neuropils"))
    return inward.join(outward, "root_id", "full_outer")


def with_defaults(nodes: DataFrame) -> DataFrame:
    """All attributes in order; absent ones are added empty, nulls become the type's empty value."""
    empty = {"string": F.lit(""), "array": F.array().cast("array<string>"), "long": F.lit(0).cast("bigint"), "double": F.lit(0.0)}
    have = set(nodes.columns)
    return nodes.select(*[(F.coalesce(a.column().cast(SPARK_TYPE[a.kind]), empty[a.kind]) if a.name in have else empty[a.kind]).alias(a.name) for a in ATTRIBUTES])
