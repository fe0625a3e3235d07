"""Matches of three-node patterns.

One pass over the edges makes a table of unordered pairs with a code: for either direction whether there is an edge at all and
which edges of the pattern a row of it satisfies. An edge that must be absent is thus a code too, not a join of its own.

Where all three pairs of the pattern have an edge, matches lie on triangles. Pairs that can play no role are left out, the rest
is oriented: to the hub, between hubs to the one with more pairs, between others by id. So no node has more pairs going out than
a node that is no hub may have, or about sqrt(2 * pairs), and only hubs must be told to the pairs. Each pair then knows in which
of the six assignments of a triangle's corners to the pattern's nodes it fits at each of its three places, which is all that
travels with it. A list of neighbours in that order tells each of them those after it that fit beside it in some assignment, and
what closes is found in that neighbour's own list. Long lists are cut into slots by a hash of the neighbour; what goes to a slot
is what it may hold. Where two pairs have an edge, they join at the node that they share, and one anti join with the pair table
takes away ends that are neighbours.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.storage import written

SLOT = 512  #: neighbours in a slot of a list, about
HUB = 64  #: pairs of a node that is no hub, at most
_BACK = 8  #: bit of a code where the way back begins
_ORDERS = list(permutations("xyz"))  #: the corners of a triangle that are the pattern's nodes
_FAR, _CLOSE, _ALL = 6, 12, 63  #: bits of a pair's fits where those as the pairs xz and yz begin, and those of one place


def _roles(g: Graph, names: list[str], candidates: dict[str, DataFrame | None]) -> DataFrame | None:
    """root_id, role: a bit for each node of the pattern that a graph node can be; none if any node can be all."""
    if not any(c is not None for c in candidates.values()):
        return None
    parts = []
    for i, n in enumerate(names):
        c = candidates[n]
        ids = g.nodes.select("root_id") if c is None else c.select(F.col(n).alias("root_id"))
        parts.append(ids.select("root_id", F.lit(1 << i).alias("role")))
    return reduce(DataFrame.unionAll, parts).groupBy("root_id").agg(F.bit_or("role").alias("role"))


def pair_codes(edges: DataFrame, conditions: list[Column]) -> DataFrame:
    """u, v, code of each pair of different nodes with an edge: bit 0 for an edge from u, bit k + 1 if a row of it satisfies condition k; from bit 8 on the same for edges from v."""
    own = reduce(lambda a, b: a.bitwiseOR(b), [F.when(c, F.lit(1 << (k + 1))).otherwise(F.lit(0)) for k, c in enumerate(conditions)], F.lit(1))
    forward = F.col("pre_id") < F.col("post_id")
    rows = edges.where("pre_id <> post_id").select(F.least("pre_id", "post_id").alias("u"), F.greatest("pre_id", "post_id").alias("v"), F.when(forward, own).otherwise(F.shiftleft(own, _BACK)).alias("code"))
    return rows.groupBy("u", "v").agg(F.bit_or("code").alias("code"))


def turned(code: Column) -> Column:
    """A pair's code as seen from its other end."""
    return F.shiftleft(code.bitwiseAND(F.lit(255)), _BACK).bitwiseOR(F.shiftright(code, _BACK).bitwiseAND(F.lit(255)))


class Pattern:
    """Three node names and, by ordered pair of names, the number of the pattern's edge."""

    def __init__(self, names: list[str], edges: dict[tuple[str, str], int]):
        self.names, self.edges = names, edges

    def fits(self, s: str, t: str, code: Column) -> Column:
        """Whether a pair, seen from the graph node of ``s``, has what the pattern wants between ``s`` and ``t`` and no other edge."""
        wanted, mask = 0, 0
        for k, shift in ((self.edges.get((s, t)), 0), (self.edges.get((t, s)), _BACK)):
            mask |= 1 << shift
            if k is not None:
                wanted |= (1 | 1 << (k + 1)) << shift
                mask |= 1 << (k + 1) << shift
        return code.bitwiseAND(F.lit(mask)) == wanted

    @property
    def joined(self) -> list[tuple[str, str]]:
        a, b, c = self.names
        return [(s, t) for s, t in ((a, b), (a, c), (b, c)) if (s, t) in self.edges or (t, s) in self.edges]


def _with_roles(pairs: DataFrame, roles: DataFrame | None) -> DataFrame:
    """The pairs with the roles of both ends as ``ru`` and ``rv``; pairs with an end without any are left out."""
    if roles is None:
        return pairs.withColumns({"ru": F.lit(7), "rv": F.lit(7)})
    of = lambda end, name: roles.select(F.col("root_id").alias(end), F.col("role").alias(name))
    return pairs.join(of("u", "ru"), "u").join(of("v", "rv"), "v")


def triangles(pattern: Pattern, pairs: DataFrame) -> DataFrame:
    """Matches of a pattern whose three pairs are all joined, among ``pairs`` (u, v, code, ru, rv)."""
    names = pattern.names
    bit = {n: 1 << i for i, n in enumerate(names)}
    may = lambda role, n: role.bitwiseAND(F.lit(bit[n])) != 0
    plays = []
    for s, t in pattern.joined:
        plays += [pattern.fits(s, t, F.col("code")) & may(F.col("ru"), s) & may(F.col("rv"), t), pattern.fits(s, t, turned(F.col("code"))) & may(F.col("rv"), s) & may(F.col("ru"), t)]
    some, _ = written(pairs.where(reduce(lambda a, b: a | b, plays)), "pairs")
    hubs = some.select(F.explode(F.array("u", "v")).alias("x")).groupBy("x").agg(F.count("*").alias("d")).where(F.col("d") > min(HUB, SLOT))
    hubs, _ = written(hubs, "hubs")
    of = lambda end, name: hubs.select(F.col("x").alias(end), F.col("d").alias(name))
    ends = some.join(of("u", "hu"), "u", "left").join(of("v", "hv"), "v", "left").fillna(0, ["hu", "hv"])
    low = F.struct("hu", "u") < F.struct("hv", "v")
    pick = lambda a, b: F.when(low, a).otherwise(b)
    one_way = ends.select(
        pick(F.col("u"), F.col("v")).alias("x"), pick(F.col("v"), F.col("u")).alias("y"), pick(F.col("hu"), F.col("hv")).alias("hx"), pick(F.col("hv"), F.col("hu")).alias("h"),
        pick(F.col("code"), turned(F.col("code"))).alias("code"), pick(F.col("ru"), F.col("rv")).alias("rx"), pick(F.col("rv"), F.col("ru")).alias("ry"),
    )

    def fits(p: str, q: str) -> Column:
        """A bit for each assignment in which a pair's ends can be the corners ``p`` and ``q``."""
        bits = []
        for k, order in enumerate(_ORDERS):
            s, t = names[order.index(p)], names[order.index(q)]
            bits.append(F.when(pattern.fits(s, t, F.col("code")) & may(F.col("rx"), s) & may(F.col("ry"), t), F.lit(1 << k)).otherwise(F.lit(0)))
        return reduce(lambda a, b: a.bitwiseOR(b), bits)

    fit = fits("x", "y").bitwiseOR(F.shiftleft(fits("x", "z"), _FAR)).bitwiseOR(F.shiftleft(fits("y", "z"), _CLOSE))
    longest = F.lit((2.0 * some.count()) ** 0.5)
    # powers of two; a hub of more pairs than the longest list can have still has no longer list
    slots = lambda h: F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(F.lit(1.0), F.least(h.cast("double"), longest) / F.lit(float(SLOT)))))).cast("long")
    slot = lambda node, n: F.xxhash64(node).bitwiseAND(F.lit(2**62 - 1)) % n
    rows = one_way.select("x", slots(F.col("hx")).alias("n"), "h", "y", fit.alias("fit")).withColumn("slot", slot(F.col("y"), F.col("n")))
    # dealt first, so that lists are made where they stay
    lists = rows.repartition("x", "slot").groupBy("x", "slot").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("h", "y", "fit"))).alias("far"))
    lists, _ = written(lists, "lists")
    whole = lists.where("n = 1").select("x", "far", F.posexplode("far").alias("i", "near")).select("x", "near", F.slice("far", F.col("i") + 2, F.size("far")).alias("after"))
    cut = lists.where("n > 1")
    cut = cut.select("x", F.explode("far").alias("near")).join(cut.select("x", "far"), "x")
    cut = cut.select("x", "near", F.filter("far", lambda e: F.struct(e["h"], e["y"]) > F.struct(F.col("near.h"), F.col("near.y"))).alias("after"))
    both = whole.unionAll(cut).select("x", F.col("near.y").alias("y"), slots(F.col("near.h")).alias("n"), F.col("near.fit").bitwiseAND(F.lit(_ALL)).alias("xy"), "after")
    both = both.withColumn("after", F.filter("after", lambda e: F.shiftright(e["fit"], _FAR).bitwiseAND(F.col("xy")) != 0)).where(F.size("after") > 0)
    # what a slot of the neighbour's list may hold
    met = both.select("x", "y", "xy", "n", "after", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("slot"))
    met = met.withColumn("after", F.when(F.col("n") == 1, F.col("after")).otherwise(F.filter("after", lambda e: slot(e["y"], F.col("n")) == F.col("slot"))))
    told = lambda far, shift, ids, fits: (F.transform(far, lambda e: e["y"]).alias(ids), F.transform(far, lambda e: F.shiftright(e["fit"], shift).bitwiseAND(F.lit(_ALL)).cast("tinyint")).alias(fits))
    met = met.where(F.size("after") > 0).select("x", "y", "slot", "xy", *told("after", _FAR, "after", "xz"))
    closing = lists.select(F.col("x").alias("y"), "slot", *told("far", _CLOSE, "far", "yz"))
    # slots are small and many, whatever the graph, so they are hashed and nothing is sorted; their size as a file is no measure for a broadcast
    found = met.join(closing.hint("shuffle_hash"), ["y", "slot"]).select("x", "y", "xy", "after", "xz", "far", "yz", F.explode(F.array_intersect("after", "far")).alias("z"))
    at = lambda fits, ids: F.get(F.col(fits), (F.array_position(F.col(ids), F.col("z")) - 1).cast("int")).cast("int")
    found = found.select("x", "y", "z", F.col("xy").bitwiseAND(at("xz", "after")).bitwiseAND(at("yz", "far")).alias("fit")).where("fit <> 0")
    tries = [F.when(F.col("fit").bitwiseAND(F.lit(1 << k)) != 0, F.struct(*[F.col(c).alias(n) for n, c in zip(names, order)])) for k, order in enumerate(_ORDERS)]
    return found.select(F.explode(F.filter(F.array(*tries), lambda m: m.isNotNull())).alias("m")).select(*[F.col(f"m.{n}").alias(n) for n in names])


def wedges(pattern: Pattern, pairs: DataFrame, codes: DataFrame) -> DataFrame:
    """Matches of a pattern with two joined pairs; ``codes`` has all pairs of the graph."""
    (a, b), (c, d) = pattern.joined
    centre = ({a, b} & {c, d}).pop()
    bit = {n: 1 << i for i, n in enumerate(pattern.names)}
    both = [pairs.select("u", "v", "code", "ru", "rv"), pairs.select(F.col("v").alias("u"), F.col("u").alias("v"), turned(F.col("code")).alias("code"), F.col("rv").alias("ru"), F.col("ru").alias("rv"))]
    turns = both[0].unionAll(both[1])

    def arm(end: str) -> DataFrame:
        holds = pattern.fits(centre, end, F.col("code")) & (F.col("ru").bitwiseAND(F.lit(bit[centre])) != 0) & (F.col("rv").bitwiseAND(F.lit(bit[end])) != 0)
        return turns.where(holds).select(F.col("u").alias(centre), F.col("v").alias(end))

    p, q = [n for n in pattern.names if n != centre]
    out = arm(p).join(arm(q), centre).where(F.col(p) != F.col(q))
    near = codes.select(F.col("u").alias("low"), F.col("v").alias("high"))
    apart = out.withColumns({"low": F.least(p, q), "high": F.greatest(p, q)}).join(near, ["low", "high"], "left_anti")
    return apart.select(*pattern.names)


def three(g: Graph, names: list[str], edges: dict[tuple[str, str], Column], candidates: dict[str, DataFrame | None]) -> DataFrame:
    """A column for each node of a connected pattern of three nodes, which differ; an edge that is not in the pattern must not be there.

    ``edges`` has a condition on edge rows for each ordered pair of names; ``candidates`` the nodes that a name can stand for,
    in a column of that name, or None for all.
    """
    pattern = Pattern(names, {pair: k for k, pair in enumerate(edges)})
    codes = pair_codes(g.edges, list(edges.values()))
    if len(pattern.joined) == 2:
        codes, _ = written(codes, "codes")
    pairs = _with_roles(codes, _roles(g, names, candidates))
    return triangles(pattern, pairs) if len(pattern.joined) == 3 else wedges(pattern, pairs, codes)
