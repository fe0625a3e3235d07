"""What is known of one node, and of the label log as a whole. A missing node gives empty results, never an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph


def node(g: Graph, x: int) -> DataFrame:
    """The node's row, or none."""
    return g.nodes.where(F.col("root_id") == x)


def is_known(g: Graph, x: int) -> bool:
    return not node(g, x).select("root_id").limit(1).isEmpty()


def node_data(g: Graph, x: int) -> dict:
    """The node's attributes by name; an empty dictionary if there is no such node."""
    row = node(g, x).first()
    return {} if row is None else row.asDict()


def cell_types(g: Graph, x: int) -> DataFrame:
    """The node's types, one a row and each once, in order: root_id, cell_type."""
    return node(g, x).select("root_id", F.explode(F.sort_array(F.array_distinct("cell_type"))).alias("cell_type")).where("cell_type <> ''")


def label_rows(g: Graph, x: int) -> DataFrame:
    """The rows of the label log of the node."""
    return g.label_log.where(F.col("root_id") == x)


def labelled(g: Graph) -> DataFrame:
    """root_id of the nodes with a row in the label log."""
    return g.label_log.select("root_id").distinct()


def labels_date(g: Graph) -> str | None:
    """The day that the label files were changed last, as yyyy-mm-dd; None if the graph doesn't come from files."""
    facts = g.extra.get("files")
    if facts is None:
        return None
    last = facts().where("source = 'labels'").agg(F.max("modified").alias("m")).first()["m"]
    return last.strftime("%Y-%m-%d") if last is not None else None
