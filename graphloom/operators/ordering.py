"""Orders of results, pages, and ranks as a column. Every order ends with root_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import graph as graph_ops
from graphloom.operators import similarity
from graphloom.plans.language import BY_OPERATOR, QueryError, parse
from graphloom.storage import numbered

_REGIONS = lambda: F.size("input_neuropils") + F.size("output_neuropils")
_PARTNERS = lambda: F.col("input_cells") + F.col("output_cells")
#: key -> (column, descending)
SIMPLE: dict[str, tuple[Callable[[], Column], bool]] = {
    "-size": (lambda: F.col("size_nm"), True),
    "size": (lambda: F.col("size_nm"), False),
    "-partners": (_PARTNERS, True),
    "partners": (_PARTNERS, False),
    "-synapse_neuropils": (_REGIONS, True),
    "synapse_neuropils": (_REGIONS, False),
    "-labels": (lambda: F.size("label"), True),
    "labels": (lambda: F.size("label"), False),
    "nt_type": (lambda: F.col("nt_type"), False),
}
OPTIONS = {
    "": "Default", "-size": "Volume, largest first", "size": "Volume, smallest first", "-partners": "Partners, most first", "partners": "Partners, fewest first",
    "-synapse_neuropils": "Regions, most first", "synapse_neuropils": "Regions, fewest first", "-labels": "Labels, most first", "labels": "Labels, fewest first",
    "similar_shape_cells": "Nodes of similar shape, most first", "nt_type": "Edge type", "random": "Random",
}
#: operators whose single use in a query decides the order
_INFERRED = {
    "upstream": "upstream_synapse_count", "downstream": "downstream_synapse_count", "reciprocal": "reciprocal_synapse_count", "pathways": "distance_from", "similar_shape": "nblast_score",
    "similar_connectivity": "jaccard_similarity", "similar_upstream": "jaccard_similarity_upstream", "similar_downstream": "jaccard_similarity_downstream",
}
PAGE_SIZES = (10, 20, 50, 100)


def inferred(query: str) -> str | None:
    """The order that a query asks for by itself."""
    q = parse(query)
    sortable = [t for t in q.terms if t.op in _INFERRED]
    if len(sortable) == 1:
        t = sortable[0]
        return f"{_INFERRED[t.op]}:{t.lhs if t.op == 'pathways' else t.rhs}"
    if not sortable and all(t.op for t in q.terms):
        return "item_count:label"
    return None


def sort_key(g: Graph, ids: DataFrame, key: str, seed: int = 0, max_depth: int | None = None) -> tuple[DataFrame, bool]:
    """``ids`` with the order's column ``sort_value``, and whether it descends. Nodes without a value come last, those beyond ``max_depth`` hops too."""
    ids = ids.select("root_id")
    if key in SIMPLE:
        column, descending = SIMPLE[key]
        return ids.join(g.nodes.select("root_id", column().alias("sort_value")), "root_id", "left"), descending
    if key == "random":
        return ids.withColumn("sort_value", F.xxhash64("root_id", F.lit(seed))), False
    if key == "similar_shape_cells":
        n = g.shapes().where("src <> dst").groupBy(F.col("src").alias("root_id")).agg(F.count("*").alias("sort_value"))
        return ids.join(n, "root_id", "left").select("root_id", F.coalesce("sort_value", F.lit(0)).alias("sort_value")), True
    name, _, arg = key.partition(":")
    if key == "item_count:label":
        return sort_key(g, ids, "-labels")
    if not arg.lstrip("-").isdigit():
        raise QueryError(f"{key!r} is no order; there are {', '.join(OPTIONS)}.")
    x = int(arg)
    if name in ("downstream_synapse_count", "upstream_synapse_count", "reciprocal_synapse_count"):
        fixed, other = ("pre_id", "post_id") if name.startswith("down") else ("post_id", "pre_id")
        w = g.pairs.where(F.col(fixed) == x).select(F.col(other).alias("root_id"), F.col("weight").alias("sort_value"))
        return ids.join(w, "root_id", "left").select("root_id", F.coalesce("sort_value", F.lit(0)).alias("sort_value")), True
    if name == "distance_from":
        return ids.join(graph_ops.distances_from(g, x, max_depth=max_depth).withColumnRenamed("depth", "sort_value"), "root_id", "left"), False
    if name == "nblast_score":
        return ids.join(similarity.similar_shape(g, x, least=1).withColumnRenamed("score", "sort_value"), "root_id", "left"), True
    if name.startswith("jaccard_similarity"):
        scores = similarity.similar_connectivity(g, x, up=not name.endswith("downstream"), down=not name.endswith("upstream"))
        return ids.join(scores.withColumnRenamed("score", "sort_value"), "root_id", "left"), True
    raise QueryError(f"{key!r} is no order; there are {', '.join(OPTIONS)}.")


def _by(descending: bool) -> list[Column]:
    return [F.desc_nulls_last("sort_value") if descending else F.asc_nulls_last("sort_value"), F.col("root_id")]


def sort(g: Graph, ids: DataFrame, key: str | None = None, query: str = "", seed: int = 0) -> DataFrame:
    """root_id and sort_value, ordered by ``key``, else as the query asks, else by root_id."""
    key = key or inferred(query)
    if not key:
        return ids.select("root_id").withColumn("sort_value", F.lit(None).cast("int")).orderBy("root_id")
    keyed, descending = sort_key(g, ids, key, seed)
    return keyed.orderBy(*_by(descending))


def ranked(g: Graph, ids: DataFrame, key: str, max_depth: int | None = None) -> DataFrame:
    """root_id, sort_value and its place as ``rank`` (from 1): a range-partitioned sort and the sizes of its partitions, without one task for all."""
    keyed, descending = sort_key(g, ids, key, max_depth=max_depth)
    first = F.desc_nulls_last("sort_value") if descending else F.asc_nulls_last("sort_value")
    return numbered(keyed, (first, F.asc("root_id")), "rank").select("root_id", "sort_value", "rank")


def page_bounds(total: int, page: int = 1, size: int = 20) -> dict:
    """The page's bounds and links: sizes are held to the offered ones, pages to those there are; three links to either side."""
    size = size if size in PAGE_SIZES else min(PAGE_SIZES, key=lambda s: (abs(s - size), s))
    pages = max(1, -(-total // size))
    page = min(max(1, page), pages)
    return {"page": page, "size": size, "pages": pages, "first": (page - 1) * size, "last": min(total, page * size), "links": list(range(max(1, page - 3), min(pages, page + 3) + 1)), "previous": page > 1, "next": page < pages}


def page(ordered: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page of an ordered result."""
    return ordered.offset((max(1, number) - 1) * size).limit(size)


class Pages:
    """A ranked result (root_id, sort_value, rank) that is kept, so that any page reads its own rows only.

    Ranks are dealt to partitions of ``PART`` in a row and sorted within, so a page reads one or two partitions, the first as the
    thousandth.
    """

    PART = 10_000

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    @classmethod
    def keep(cls, ranked: DataFrame, path: str) -> Pages:
        n = max(1, int(ranked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        rows = ranked.withColumn("part", F.floor((F.col("rank") - 1) / cls.PART).cast("bigint"))
        rows.repartitionByRange(n, "rank").sortWithinPartitions("rank").write.partitionBy("part").parquet(path)
        return cls(ranked.sparkSession, path)

    def page(self, number: int = 1, size: int = 20) -> DataFrame:
        first = (max(1, number) - 1) * size
        parts = range(first // self.PART, (first + size - 1) // self.PART + 1)
        rows = self.spark.read.parquet(self.path).where(F.col("part").isin(*parts) & F.col("rank").between(first + 1, first + size))
        return rows.drop("part").orderBy("rank")

    def after(self, last: int, size: int = 20) -> DataFrame:
        """The rows behind the place ``last``, as a reader who has seen that many asks for them."""
        parts = range(last // self.PART, (last + size - 1) // self.PART + 1)
        return self.spark.read.parquet(self.path).where(F.col("part").isin(*parts) & F.col("rank").between(last + 1, last + size)).drop("part").orderBy("rank")


def short_list(ids: DataFrame, most: int = 100) -> DataFrame:
    """One row: ids, comma-joined in order of ``rank``, if there are at most ``most``, else null; and n, exact up to one more than that."""
    some = ids.select("root_id", "rank").orderBy("rank").limit(most + 1)
    out = some.agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("rank", "root_id"))).alias("rows"))
    return out.select(F.when(F.col("n") <= most, F.array_join(F.transform("rows", lambda r: r["root_id"].cast("string")), ",")).alias("ids"), "n")


def sample(ids: DataFrame, n: int = 100, seed: int = 0) -> DataFrame:
    """A repeatable sample of at most ``n`` nodes, by id."""
    return ids.select("root_id").orderBy(F.xxhash64("root_id", F.lit(seed)), "root_id").limit(n).orderBy("root_id")


def sortable_operators() -> dict[str, str]:
    return {BY_OPERATOR[o].sign: k for o, k in _INFERRED.items()}
