"""From a query's terms to one DataFrame of root_id and rank.

Attribute terms fold into one condition on the node table; every other term is a set of ids that joins by ``left_semi``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.regions import region_set
from graphloom.model import Graph
from graphloom.operators import conditions, similarity, text
from graphloom.operators import graph as graph_ops
from graphloom.plans.language import Query, QueryError, Term, parse

SHAPE_LEAST = 4
CONDITIONS = {
    "has": conditions.has, "not": conditions.lacks, "in": conditions.is_in, "not_in": conditions.not_in, "equal": conditions.equal, "not_equal": conditions.not_equal,
    "starts_with": conditions.starts_with, "contains": conditions.contains, "not_contains": conditions.not_contains,
}


def _node_id(t: str) -> int:
    try:
        return int(t)
    except ValueError:
        raise QueryError(f"{t!r} is no node id.") from None


class Compiler:
    def __init__(self, g: Graph, case_sensitive: bool = False, word_match: bool = False, shape_least: int = SHAPE_LEAST, path_hops: int | None = None):
        self.g, self.case_sensitive, self.word_match, self.shape_least, self.path_hops = g, case_sensitive, word_match, shape_least, path_hops

    def condition(self, t: Term) -> Column | None:
        """The condition of an attribute term, None for other terms."""
        if t.op not in CONDITIONS:
            return None
        operands = (t.rhs,) if t.op in ("has", "not") else (t.lhs, t.rhs)
        return CONDITIONS[t.op](self.g, *operands, case_sensitive=self.case_sensitive)

    # sets of ids

    def ids(self, t: Term) -> DataFrame:
        g = self.g
        if t.op is None:
            return text.search(g, t.rhs, self.case_sensitive, self.word_match, literal=t.literal)
        if t.op in ("upstream_region", "downstream_region"):
            regions = region_set(t.lhs, g.regions)
            if not regions:
                raise QueryError(f"no region answers {t.lhs!r}; there are {', '.join(r['region'] for r in g.regions)}.")
            return (graph_ops.upstream if t.op == "upstream_region" else graph_ops.downstream)(g, _node_id(t.rhs), regions)
        if t.op == "pathways":
            return graph_ops.path_nodes(g, _node_id(t.lhs), _node_id(t.rhs), max_hops=self.path_hops).select("root_id")
        x = _node_id(t.rhs)
        if t.op in ("upstream", "downstream", "reciprocal"):
            return getattr(graph_ops, t.op)(g, x)
        if t.op == "similar_shape":
            return similarity.similar_shape(g, x, self.shape_least)
        what, _, weighted = t.op.removeprefix("similar_").partition("_")
        return similarity.similar_connectivity(g, x, up=what != "downstream", down=what != "upstream", weighted=bool(weighted))

    def compile(self, q: Query) -> DataFrame:
        """root_id and rank; nodes of equal rank are in no order. Only a single free-text term ranks its hits."""
        no_rank = F.struct(F.lit(0).alias("group"), F.lit(0).alias("place"), F.lit(0).alias("tier"))
        nodes = self.g.nodes
        if not q.terms:
            return nodes.select("root_id", F.struct((-(F.col("input_cells") + F.col("output_cells"))).cast("int").alias("group"), F.lit(0).alias("place"), F.lit(0).alias("tier")).alias("rank"))
        if len(q.terms) == 1 and q.terms[0].op is None:
            return self.ids(q.terms[0])
        tests, sets = [], []
        for t in q.terms:
            c = self.condition(t)
            (sets if c is None else tests).append(self.ids(t).select("root_id") if c is None else c)
        if q.chain == "or":
            parts = [nodes.where(reduce(lambda a, b: a | b, tests)).select("root_id")] if tests else []
            known = [s.join(self.g.ids, "root_id", "left_semi") for s in sets]
            return reduce(DataFrame.unionAll, parts + known).distinct().withColumn("rank", no_rank)
        out = nodes.where(reduce(lambda a, b: a & b, tests)) if tests else self.g.ids
        for s in sets:
            out = out.join(s, "root_id", "left_semi")
        return out.select("root_id").withColumn("rank", no_rank)


def search(g: Graph, query: str, case_sensitive: bool = False, word_match: bool = False, **how) -> DataFrame:
    """The nodes that answer a query: root_id and rank."""
    return Compiler(g, case_sensitive, word_match, **how).compile(parse(query))


def nodes_of(g: Graph, query: str, **how) -> DataFrame:
    """The node rows that answer a query."""
    return g.nodes.join(search(g, query, **how).select("root_id"), "root_id", "left_semi")
