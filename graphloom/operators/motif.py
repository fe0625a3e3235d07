"""Patterns of one to three nodes with constrained edges."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.regions import edge_type, region_list
from graphloom.model import Graph
from graphloom.operators import patterns
from graphloom.plans import compiler
from graphloom.plans.language import QueryError, parse
from graphloom.storage import written

DEFAULT_WEIGHT = 5


@dataclass(frozen=True)
class Edge:
    start: str
    end: str
    regions: tuple[str, ...] = ()
    least: int = 0
    edge_type: str | None = None

    def condition(self) -> Column:
        c = F.lit(True)
        if self.regions:
            c = c & F.col("region").isin(*self.regions)
        if self.least:
            c = c & (F.col("weight") >= self.least)
        if self.edge_type:
            c = c & (F.col("edge_type") == self.edge_type)
        return c


@dataclass
class Motif:
    """Up to three nodes, each a query, and directed edges between them."""

    graph: Graph
    nodes: dict[str, str] = field(default_factory=dict)
    edges: dict[tuple[str, str], Edge] = field(default_factory=dict)

    def node(self, name: str, query: str = "*") -> Motif:
        if name in self.nodes or len(self.nodes) == 3:
            raise QueryError(f"node {name!r} is there already, or is the fourth.")
        parse(query)
        self.nodes[name] = query
        return self

    def edge(self, start: str, end: str, regions: str | None = None, least: int = 0, type_: str | None = None) -> Motif:
        if start == end or (start, end) in self.edges or not {start, end} <= set(self.nodes):
            raise QueryError(f"an edge {start}-{end} joins two different nodes of the pattern, once.")
        if least < 0:
            raise QueryError("a weight is not negative.")
        found = region_list(regions, self.graph.regions) if regions else set()
        if regions and not found:
            raise QueryError(f"no region answers {regions!r}.")
        code = edge_type(type_, self.graph.edge_types) if type_ else None
        if code and code not in self.graph.edge_types:
            raise QueryError(f"unknown edge type {type_!r}.")
        self.edges[start, end] = Edge(start, end, tuple(sorted(found)), least, code)
        return self

    @classmethod
    def from_form(cls, g: Graph, form: dict) -> Motif:
        """A form's fields: queryA.. and, for each ordered pair, enabledAB, regionAB, minSynapseCountAB, ntTypeAB."""
        m = cls(g)
        names = [n for n in "ABC" if f"query{n}" in form]
        for n in names:
            m.node(n, form[f"query{n}"] or "*")
        for a, b in permutations(names, 2):
            if form.get(f"enabled{a}{b}"):
                least = form.get(f"minSynapseCount{a}{b}")
                m.edge(a, b, form.get(f"region{a}{b}") or None, DEFAULT_WEIGHT if least in (None, "") else int(least), form.get(f"ntType{a}{b}") or None)
        return m

    def _candidates(self, name: str) -> DataFrame | None:
        q = self.nodes[name]
        return None if q.strip() in ("", "*") else compiler.search(self.graph, q).select(F.col("root_id").alias(name)).distinct()

    def _requested(self, e: Edge) -> DataFrame:
        rows = self.graph.edges.where(e.condition()).select(F.col("pre_id").alias(e.start), F.col("post_id").alias(e.end)).distinct()
        for n in (e.start, e.end):
            c = self._candidates(n)
            if c is not None:
                rows = rows.join(c, n, "left_semi")
        return rows

    def matches(self, limit: int | None = None, with_edges: bool = False) -> DataFrame:
        """A column for each node of the pattern.

        With two nodes a direction without an edge may be anything, and both may be one node by its loop. With three, an edge
        that is not in the pattern must not be there, and the nodes differ. A node without edges stands beside the rest of the
        pattern by its own query, so that case needs a ``limit``. ``with_edges``: with ``nodes`` and ``edges`` as JSON.
        """
        g, names = self.graph, list(self.nodes)
        if not names:
            raise QueryError("a pattern has a node at least.")
        if len(names) > 1 and not self.edges:
            raise QueryError("a pattern of several nodes has an edge at least.")
        touched = {n for pair in self.edges for n in pair}
        free = [n for n in names if n not in touched]
        if len(names) > 1 and free and not limit:
            raise QueryError(f"node {free[0]} has no edge; give a limit.")
        if len(names) == 1:
            c = self._candidates(names[0])
            out = c if c is not None else g.nodes.select(F.col("root_id").alias(names[0]))
        elif len(names) == 2:
            out = self._pair(names)
        elif free:
            out = self._beside(self._pair([n for n in names if n in touched]), free[0], limit)
        else:
            out = patterns.three(g, names, {pair: e.condition() for pair, e in self.edges.items()}, {n: self._candidates(n) for n in names})
        out = out.select(*names)
        if limit:
            out = out.limit(limit)
        return self._told(out) if with_edges else out

    def _pair(self, names: list[str]) -> DataFrame:
        rows = [self._requested(e) for e in self.edges.values()]
        return rows[0] if len(rows) == 1 else rows[0].join(rows[1], names)

    def _beside(self, pairs: DataFrame, name: str, limit: int) -> DataFrame:
        """Pairs of different nodes with a node that is neither of them nor a neighbour of either.

        ``limit`` pairs and as many free nodes as these and their neighbours can exclude, and ``limit`` more, are tried first;
        only if those have too few matches are all pairs and nodes.
        """
        a, b = [n for n in self.nodes if n != name]
        g, c = self.graph, self._candidates(name)
        if (a, b) not in self.edges or (b, a) not in self.edges:
            back = g.pairs.select(F.col("pre_id").alias(b), F.col("post_id").alias(a)) if (a, b) in self.edges else g.pairs.select(F.col("pre_id").alias(a), F.col("post_id").alias(b))
            pairs = pairs.join(back, [a, b], "left_anti")
        pairs = pairs.where(F.col(a) != F.col(b))
        free = c if c is not None else g.nodes.select(F.col("root_id").alias(name))
        ways = g.pairs.select(F.col("pre_id").alias("x"), F.col("post_id").alias(name)).unionAll(g.pairs.select("post_id", "pre_id"))

        def apart(p: DataFrame, f: DataFrame) -> DataFrame:
            out = p.crossJoin(f).where((F.col(name) != F.col(a)) & (F.col(name) != F.col(b)))
            for n in (a, b):
                out = out.join(ways.withColumnRenamed("x", n), [n, name], "left_anti")
            return out

        few, _ = written(pairs.limit(limit), "few")
        ends = few.select(F.explode(F.array(a, b)).alias("x")).distinct()
        most = ways.join(ends, "x", "left_semi").groupBy("x").count().agg(F.max("count")).first()[0] or 0
        tried, _ = written(apart(few, free.limit(limit + 2 * most + 2)).limit(limit), "tried")
        return tried if tried.count() == limit else apart(pairs, free)

    def _told(self, found: DataFrame) -> DataFrame:
        """Matches with ``nodes`` (id and name of each, in order) and ``edges`` (all rows that satisfy an edge of the pattern) as JSON."""
        names, g = list(self.nodes), self.graph
        found, _ = written(found, "matches")
        named = found
        for n in names:
            named = named.join(g.nodes.select(F.col("root_id").alias(n), F.col("name").alias(f"name_{n}")), n, "left")
        out = named.select(*names, F.to_json(F.array(*[F.struct(F.col(n).cast("string").alias("id"), F.col(f"name_{n}").alias("name")) for n in names])).alias("nodes"))
        rows = []
        for e in self.edges.values():
            r = g.edges.where(e.condition()).select(F.col("pre_id").alias(e.start), F.col("post_id").alias(e.end), "region", "weight", "edge_type")
            row = F.struct(F.col(e.start).cast("string").alias("from"), F.col(e.end).cast("string").alias("to"), "region", "weight", "edge_type")
            rows.append(found.join(r, [e.start, e.end]).select(*names, row.alias("e")))
        if not rows:
            return out.withColumn("edges", F.lit("[]"))
        all_rows = reduce(DataFrame.unionAll, rows)
        return out.join(all_rows.groupBy(*names).agg(F.to_json(F.sort_array(F.collect_list("e"))).alias("edges")), names, "left")
