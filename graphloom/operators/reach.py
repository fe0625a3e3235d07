"""Breadth-first search from many sources at once, and shortest paths by searches that meet.

Sources are bits. A node's state has a set of bits for each batch of sources: a hop joins the bits that are new at a node with
its edges and ORs what arrives at each end. Edges are bucketed by start once, and the state by node, so a hop shuffles the new
bits on their way out and, combined, on their way in, but neither edges nor what was seen. Each hop writes the state anew, with
the bits that it found and their depth, and the state before is deleted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from graphloom.model import Graph
from graphloom.storage import Buckets, delete, numbered, written

BATCH = 256  #: sources in one state row
WORD = 64  #: bits of a column


def _any(columns: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c) != 0 for c in columns])


def _set_bits(word: Column) -> Column:
    return F.filter(F.sequence(F.lit(0), F.lit(WORD - 1)), lambda b: F.call_function("shiftrightunsigned", word, b).bitwiseAND(F.lit(1)) == 1)


def _numbers(names: DataFrame) -> tuple[DataFrame, int]:
    """source, batch and bit of each source, and their number. Those of one batch are numbered here, more by a sort."""
    few = names.limit(BATCH + 1).collect()
    if len(few) <= BATCH:
        schema = StructType([*names.schema.fields, StructField("batch", IntegerType()), StructField("bit", IntegerType())])
        return names.sparkSession.createDataFrame([(r[0], 0, i) for i, r in enumerate(few)], schema), len(few)
    place = F.col("place") - 1
    bits, _ = written(numbered(names, (F.asc("source"),), "place").select("source", F.floor(place / BATCH).cast("int").alias("batch"), (place % BATCH).cast("int").alias("bit")), "sources")
    return bits, bits.count()


def distances(pairs: DataFrame, sources: DataFrame, *, up: bool = False, max_depth: int | None = None, stop_at: int | None = None, targets: DataFrame | None = None) -> DataFrame:
    """Hops from each source: source, root_id, depth, over ``pairs`` (pre_id, post_id).

    ``sources`` has source and root_id; several rows of a source start together. It ends when a hop finds nothing, at
    ``max_depth``, or when ``stop_at`` is reached by any source. ``targets`` (root_id): only rows of these nodes come, so a
    search back from all of them at once tells how far each node is from one, and no step is made that can't end there in time.
    """
    spark = pairs.sparkSession
    a, b = ("post_id", "pre_id") if up else ("pre_id", "post_id")
    starts = sources.select("source", "root_id").distinct()
    bits, n = _numbers(starts.select("source").distinct())
    words = range(max(1, -(-min(n, BATCH) // WORD)))
    new, seen = [f"n{w}" for w in words], [f"s{w}" for w in words]
    keys = ["batch", "root_id"]
    store = Buckets(spark)
    try:
        steps = pairs.select(F.col(a).alias("root_id"), F.col(b).alias("next")).where("root_id IS NOT NULL AND next IS NOT NULL").distinct()
        pruned = targets is not None and stop_at is None
        if pruned:
            ends = targets.select(F.lit(0).alias("source"), "root_id").where("root_id IS NOT NULL").distinct()
            within = distances(pairs, ends, up=not up, max_depth=None if max_depth is None else max(0, max_depth - 1))
            steps = steps.join(within.select(F.col("root_id").alias("next"), F.col("depth").alias("rest")), "next")
        # a file for each bucket, so that its order holds
        _, steps = store.put(steps.repartition(store.n, "root_id"), "root_id")
        one = lambda w: F.when(F.floor(F.col("bit") / WORD) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bit") % WORD)).otherwise(F.lit(0).cast("bigint"))
        first = starts.join(bits, "source").groupBy(*keys).agg(*[F.bit_or(one(w)).alias(new[w]) for w in words])
        history = F.array(F.struct(F.lit(0).alias("depth"), F.array(*new).alias("bits")))
        name, state = store.put(first.select(*keys, *new, *[F.col(x).alias(s) for x, s in zip(new, seen)], history.alias("found")), *keys)
        depth = 0
        while max_depth is None or depth < max_depth:
            depth += 1
            frontier = state.where(_any(new)).select(*keys, *new)
            some = steps.where(F.col("rest") <= max_depth - depth) if pruned and max_depth is not None else steps
            arrived = frontier.join(some, "root_id").groupBy("batch", F.col("next").alias("root_id")).agg(*[F.bit_or(x).alias(f"a{w}") for w, x in zip(words, new)])
            old = state.select(*keys, *seen, "found")
            zero = F.lit(0).cast("bigint")
            both = old.join(arrived, keys, "full_outer")
            fresh = [F.coalesce(f"a{w}", zero).bitwiseAND(F.bitwise_not(F.coalesce(seen[w], zero))).alias(new[w]) for w in words]
            both = both.select(*keys, *fresh, *[F.coalesce(s, zero).alias(s) for s in seen], F.coalesce("found", F.array().cast(old.schema["found"].dataType)).alias("found"))
            now = F.array(F.struct(F.lit(depth).alias("depth"), F.array(*new).alias("bits")))
            after = both.select(*keys, *new, *[F.col(s).bitwiseOR(F.col(x)).alias(s) for s, x in zip(seen, new)], F.when(_any(new), F.concat("found", now)).otherwise(F.col("found")).alias("found"))
            # what grew is counted while it is written
            grown = Observation()
            reached = _any(new) & (F.col("root_id") == stop_at) if stop_at is not None else F.lit(False)
            last, (name, state) = name, store.put(after.observe(grown, F.count_if(_any(new)).alias("rows"), F.count_if(reached).alias("reached")), *keys)
            store.drop(last)
            if not grown.get["rows"] or grown.get["reached"]:
                break
        told = state if targets is None else state.join(targets.select("root_id").distinct(), "root_id", "left_semi")
        each = told.select(*keys, F.explode("found").alias("f")).select(*keys, "f.depth", F.posexplode("f.bits").alias("w", "word")).where("word <> 0")
        each = each.select(*keys, "depth", F.explode(_set_bits(F.col("word"))).alias("b"), "w").select(*keys, "depth", (F.col("w") * WORD + F.col("b")).alias("bit"))
        out, _ = written(each.join(bits, ["batch", "bit"]).select("source", "root_id", "depth"), "distances")
    finally:
        store.close()
    return out


@dataclass
class Paths:
    """All shortest paths between two nodes: ``nodes`` (root_id, depth), their length, and the rows of both searches' frontiers."""

    nodes: DataFrame
    hops: int | None
    forward: list[int]
    backward: list[int]


def between(g: Graph, source: int, target: int, least: int = 0, max_hops: int | None = None) -> Paths:
    """Searches forward from ``source`` and backward from ``target``; the smaller frontier grows, until they meet.

    Paths of more than ``max_hops`` are none.

    They first meet in the last levels of both: a node of the new level ``f`` that is in an earlier level ``j`` of the other
    search has a neighbour before it in the level ``f - 1``, whose distance to the other end is ``j + 1`` at most, so both
    searches had that one already. So the shortest paths are ``f + b`` long, each has its f-th node among the meeting nodes, and
    the rest of them follows from there back through the levels of either search.
    """
    from graphloom.operators.graph import pairs_over

    spark = g.spark
    none = spark.createDataFrame([], "root_id bigint, depth int")
    if source == target:
        return Paths(none, None, [], [])
    out, into = (pairs_over(g, least, by_end=e) for e in (False, True))
    ways = {True: (out, "pre_id", "post_id"), False: (into, "post_id", "pre_id")}
    made: list[str] = []

    def kept(df: DataFrame) -> DataFrame:
        table, path = written(df, "level")
        made.append(path)
        return table

    def beyond(nodes: DataFrame, forward: bool) -> DataFrame:
        pairs, a, b = ways[forward]
        return pairs.join(nodes.select(F.col("root_id").alias(a)), a).select(F.col(b).alias("root_id")).distinct()

    levels = {way: [spark.createDataFrame([(x,)], "root_id bigint")] for way, x in ((True, source), (False, target))}
    sizes = {True: [1], False: [1]}
    met = None
    try:
        while met is None:
            if max_hops is not None and len(levels[True]) + len(levels[False]) - 2 >= max_hops:
                return Paths(none, None, sizes[True], sizes[False])
            way = sizes[True][-1] <= sizes[False][-1]
            seen = reduce(DataFrame.unionAll, levels[way])
            level = kept(beyond(levels[way][-1], way).join(seen, "root_id", "left_anti"))
            size = level.count()
            if not size:
                return Paths(none, None, sizes[True], sizes[False])
            levels[way].append(level)
            sizes[way].append(size)
            common = level.join(levels[not way][-1], "root_id", "left_semi")
            if not common.isEmpty():
                met = kept(common)
        f, hops = len(levels[True]) - 1, len(levels[True]) + len(levels[False]) - 2
        parts = [met.withColumn("depth", F.lit(f))]
        for way in (True, False):
            at = met
            for i in range(len(levels[way]) - 2, -1, -1):
                # back over the edges that this search came by
                at = kept(levels[way][i].join(beyond(at, not way), "root_id", "left_semi"))
                parts.append(at.withColumn("depth", F.lit(i if way else hops - i)))
        nodes, _ = written(reduce(DataFrame.unionAll, parts).select("root_id", "depth"), "paths")
        return Paths(nodes, hops, sizes[True], sizes[False])
    finally:
        for path in made:
            delete(spark, path)
