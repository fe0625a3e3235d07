"""Similar nodes: by precomputed shape scores and by shared partners."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.storage import numbered, written

SELF_SCORE = 10


def similar_shape(g: Graph, x: int, least: int = 4, top: int | None = None, with_self: bool = True) -> DataFrame:
    """root_id and score of nodes shaped like x, the best first; x itself scores 10."""
    found = g.shapes(F.col("src") == x).where(F.col("score") >= least).select(F.col("dst").alias("root_id"), "score")
    if with_self:
        found = found.where(F.col("root_id") != x).unionAll(g.spark.createDataFrame([(x, SELF_SCORE)], "root_id bigint, score int"))
    found = found.orderBy(F.desc("score"), "root_id")
    return found.limit(top) if top else found


def _jaccard(pairs: DataFrame, own: str, other: str, x: int, weighted: bool, name: str) -> DataFrame:
    """Of every node that shares a partner with x: its Jaccard similarity. Only partners of x are ever matched."""
    p = pairs.select(F.col(own).alias("root_id"), F.col(other).alias("partner"), "weight")
    mine = p.where(F.col("root_id") == x).select("partner", F.col("weight").alias("mine"))
    total = F.sum("weight") if weighted else F.count("*")
    shared = p.join(mine, "partner").groupBy("root_id").agg((F.sum(F.least("weight", "mine")) if weighted else F.count("*")).alias("shared"))
    # totals are asked for only of nodes that share a partner
    shared, _ = written(shared, "shared")
    all_of = p.join(shared.select("root_id"), "root_id", "left_semi").groupBy("root_id").agg(total.alias("all"))
    of_x = mine.agg((F.sum("mine") if weighted else F.count("*")).alias("all_x"))
    return shared.join(all_of, "root_id").crossJoin(F.broadcast(of_x)).select("root_id", (F.col("shared") / (F.col("all") + F.col("all_x") - F.col("shared"))).alias(name))


def similar_connectivity(
    g: Graph, x: int, *, up: bool = True, down: bool = True, weighted: bool = False, same: tuple[str, ...] = (), good: float = 0.2, least: float = 0.1, first: int = 20, ratio: float | None = None
) -> DataFrame:
    """root_id and score: the mean Jaccard similarity to x of inputs, outputs or both.

    Kept are scores of at least ``least`` that are ``good`` or among the ``first`` best. In both directions at once, a
    direction without a shared partner counts 0. ``ratio`` leaves out nodes whose number of partners differs from x's by more
    than that factor in a chosen direction (lossless for one direction only, so off unless asked for); ``same`` keeps nodes
    that agree with x in these attributes.
    """
    sides = [_jaccard(g.pairs, own, other, x, weighted, name) for wanted, own, other, name in ((up, "post_id", "pre_id", "i"), (down, "pre_id", "post_id", "o")) if wanted]
    both = sides[0]
    for s in sides[1:]:
        both = both.join(s, "root_id", "full_outer")
    names = [c for c in both.columns if c != "root_id"]
    scored = both.select("root_id", (sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0)) / len(names)).alias("score"))
    if ratio:
        n = g.nodes.select("root_id", "input_cells", "output_cells")
        me = n.where(F.col("root_id") == x).first()
        columns = [c for c, wanted in (("input_cells", up), ("output_cells", down)) if wanted]
        for c in columns:
            mine = max(1, me[c] if me else 0)
            n = n.where((F.col(c) * ratio >= mine) & (F.col(c) <= mine * ratio))
        scored = scored.join(n, "root_id", "left_semi")
    if same:
        me = g.nodes.where(F.col("root_id") == x).select(*[F.col(f"`{a}`").alias(f"own_{i}") for i, a in enumerate(same)])
        match = [F.col(f"`{a}`").eqNullSafe(F.col(f"own_{i}")) for i, a in enumerate(same)]
        alike = g.nodes.crossJoin(F.broadcast(me.limit(1))).where(sum_and(match)).select("root_id")
        scored = scored.join(alike, "root_id", "left_semi")
    kept, _ = written(scored.where(F.col("score") >= least), "similar")
    # the rows above the lowest score are few; good ones pass without a place
    best = kept.orderBy(F.desc("score"), "root_id").limit(first)
    return kept.where(F.col("score") >= good).unionAll(best.where(F.col("score") < good))


def sum_and(conditions):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


HUB = 20_000  #: pairs of a shared partner that one key of the join holds, about


def _shared(pairs: DataFrame, queries: DataFrame, own: str, other: str, weighted: bool, name: str) -> DataFrame:
    """query, root_id and Jaccard similarity of every node that shares a partner with a query.

    Partners with many pairs are dealt to several keys, to each of which the queries' rows go too; sums of a query and node are
    partial before they are shuffled.
    """
    p = pairs.select(F.col(own).alias("root_id"), F.col(other).alias("partner"), "weight")
    mine = p.join(queries.select(F.col("root_id")), "root_id", "left_semi").select(F.col("root_id").alias("query"), "partner", F.col("weight").alias("mine"))
    hubs = p.groupBy("partner").agg(F.ceil(F.count("*") / F.lit(HUB)).cast("int").alias("parts")).where("parts > 1")
    parts = F.coalesce("parts", F.lit(1))
    dealt = p.join(hubs, "partner", "left").withColumn("part", F.pmod(F.xxhash64("root_id"), parts).cast("int")).drop("parts")
    asked = mine.join(hubs.withColumnRenamed("parts", "n"), "partner", "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("n", F.lit(1)) - 1))).drop("n")
    one = F.least("weight", "mine") if weighted else F.lit(1)
    shared = dealt.join(asked, ["partner", "part"]).groupBy("query", "root_id").agg(F.sum(one).alias("shared"))
    total = p.groupBy("root_id").agg((F.sum("weight") if weighted else F.count("*")).alias("all"))
    of_query = total.select(F.col("root_id").alias("query"), F.col("all").alias("all_query"))
    return shared.join(total, "root_id").join(of_query, "query").select("query", "root_id", (F.col("shared") / (F.col("all") + F.col("all_query") - F.col("shared"))).alias(name))


def similar_many(g: Graph, queries: DataFrame, *, up: bool = True, down: bool = True, weighted: bool = False, good: float = 0.2, least: float = 0.1, first: int = 20) -> DataFrame:
    """query, root_id and score for all of ``queries`` (root_id) at once, as :func:`similar_connectivity` has them for one node."""
    asked = queries.select("root_id").distinct()
    sides = [_shared(g.pairs, asked, own, other, weighted, name) for wanted, own, other, name in ((up, "post_id", "pre_id", "i"), (down, "pre_id", "post_id", "o")) if wanted]
    both = reduce(lambda a, b: a.join(b, ["query", "root_id"], "full_outer"), sides)
    names = [c for c in both.columns if c not in ("query", "root_id")]
    scored = both.select("query", "root_id", (sum((F.coalesce(F.col(c), F.lit(0.0)) for c in names), F.lit(0.0)) / len(names)).alias("score")).where(F.col("score") >= least)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "root_id"))
    return scored.withColumn("place", place).where((F.col("score") >= good) | (F.col("place") <= first)).drop("place")


def similar_to_any(g: Graph, ids: list[int], same: tuple[str, ...] = (), ratio: float | None = None, **how) -> DataFrame:
    """The union of what is similar to each of some nodes, with the best score; options as for :func:`similar_connectivity`."""
    if same or ratio:
        rows = reduce(DataFrame.unionAll, [similar_connectivity(g, x, same=same, ratio=ratio, **how) for x in ids])
    else:
        rows = similar_many(g, g.spark.createDataFrame([(x,) for x in ids], "root_id bigint"), **how)
    return rows.groupBy("root_id").agg(F.max("score").alias("score"))


def ranked(scores: DataFrame, column: str = "score") -> DataFrame:
    return numbered(scores, (F.desc(column), F.asc("root_id")), "rank")
