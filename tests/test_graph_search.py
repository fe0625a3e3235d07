"""Searches, patterns and similarity of many nodes against brute force on random graphs."""

import os
import random
from collections import defaultdict, deque
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from graphloom.model import Graph, degrees, with_defaults
from graphloom.operators import graph, patterns, reach, similarity
from graphloom.operators.motif import Motif
from graphloom.storage import shared_folder

REGIONS = [{"region": r, "description": r, "hemisphere": "Left", "category": "x"} for r in "LR"]


def made(spark, n, m, seed, hub=0):
    rng = random.Random(seed)
    rows = {}
    for k in range(m):
        a, b = (rng.randrange(n) if k % 3 or not hub else rng.randrange(hub)), rng.randrange(n)
        if rng.random() < 0.5:
            a, b = b, a
        rows[a, b, rng.choice("LR")] = (rng.randrange(1, 9), rng.choice("XY"))
    data = [(*k, *v) for k, v in rows.items()]
    edges = spark.createDataFrame(data, "pre_id bigint, post_id bigint, region string, weight bigint, edge_type string")
    nodes = spark.createDataFrame([(i, f"n{i}", "odd" if i % 2 else "even") for i in range(n)], "root_id bigint, name string, class string")
    g = Graph(with_defaults(nodes.join(degrees(edges), "root_id", "left")).persist(), edges.persist(), regions=REGIONS, edge_types={"X": "x", "Y": "y"}, persist=True)
    return g, data


def hops(data, start, up=False):
    out = defaultdict(set)
    for a, b, *_ in data:
        out[b if up else a].add(a if up else b)
    dist, todo = {start: 0}, deque([start])
    while todo:
        x = todo.popleft()
        for y in out[x]:
            if y not in dist:
                dist[y] = dist[x] + 1
                todo.append(y)
    return dist


@pytest.fixture(scope="module")
def sparse(spark):
    return made(spark, 700, 1100, 3)


def folders(spark):
    at = shared_folder(spark).removeprefix("file:")
    return {f for f in os.listdir(at) if f.startswith("graph-")}


@pytest.mark.parametrize("up", [False, True])
def test_many_sources_in_several_batches(spark, sparse, up):
    g, data = sparse
    before = folders(spark)
    sources = g.nodes.where("root_id % 2 = 0").select(F.col("root_id").alias("source"), "root_id")
    got = {(r["source"], r["root_id"]): r["depth"] for r in reach.distances(g.pairs, sources, up=up).collect()}
    assert got == {(s, x): d for s in range(0, 700, 2) for x, d in hops(data, s, up).items()}
    # the result is left, states and edges are deleted
    assert {f.rsplit("-", 1)[0] for f in folders(spark) - before} <= {"graph-distances", "graph-sources", "graph-numbered"}


def test_sources_of_several_nodes_depth_and_targets(spark, sparse):
    g, data = sparse
    sources = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), ("b", 3), ("c", 99999)], "source string, root_id bigint")
    got = {(r["source"], r["root_id"]): r["depth"] for r in reach.distances(g.pairs, sources, max_depth=3, targets=g.nodes.where("root_id % 3 = 0")).collect()}
    want = {}
    for name, starts in (("a", (1, 2)), ("b", (3,))):
        for s in starts:
            for x, d in hops(data, s).items():
                if d <= 3 and x % 3 == 0:
                    want[name, x] = min(d, want.get((name, x), 9))
    assert got == want
    assert reach.distances(g.pairs.limit(0), sources.limit(0)).count() == 0
    early = {r["root_id"]: r["depth"] for r in graph.distances_from(g, 1, stop_at=max(hops(data, 1), key=hops(data, 1).get)).collect()}
    assert early == hops(data, 1)


def test_searches_that_meet_find_all_shortest_paths(sparse):
    g, data = sparse
    rng = random.Random(8)
    ours = alone = 0
    for k in range(8):
        s = rng.randrange(700)
        t = rng.randrange(700) if k < 2 else rng.choice(sorted(hops(data, s)))
        there, back = hops(data, s), hops(data, t, up=True)
        want = {x: d for x, d in there.items() if x in back and t in there and d + back[x] == there[t]} if s != t else {}
        found = reach.between(g, s, t)
        rows = found.nodes.collect()
        assert {r["root_id"]: r["depth"] for r in rows} == want and len(rows) == len(want)
        if want:
            assert found.hops == there[t]
            ours += sum(found.forward + found.backward)
            # one search has all nodes that are no farther than the target in its frontiers
            alone += sum(d <= there[t] for d in there.values())
    assert 0 < ours < alone / 2


def brute_three(data, names, edges, allowed, n):
    ok, any_ = defaultdict(set), set()
    for a, b, region, weight, kind in data:
        any_.add((a, b))
        for pair, (regions, least, type_) in edges.items():
            if (not regions or region in regions) and weight >= least and (not type_ or kind == type_):
                ok[pair].add((a, b))
    near = defaultdict(set)
    for a, b in any_:
        near[a].add(b)
        near[b].add(a)
    found = set()
    for x in range(n):
        for y in near[x]:
            for z in near[x] | near[y]:
                if len({x, y, z}) == 3:
                    for order in permutations((x, y, z)):
                        at = dict(zip(names, order))
                        if all(at[m] in allowed.get(m, range(n)) for m in names) and all(((at[s], at[t]) in ok[s, t]) if (s, t) in edges else (at[s], at[t]) not in any_ for s, t in permutations(names, 2)):
                            found.add(order)
    return sorted(found)


PATTERNS = [
    {("A", "B"): ("", 0, None), ("B", "C"): ("", 0, None), ("C", "A"): ("", 0, None)},
    {("A", "B"): ("L", 0, None), ("B", "C"): ("", 3, None), ("A", "C"): ("", 0, "X")},
    {("A", "B"): ("", 2, None), ("B", "A"): ("", 0, "Y"), ("B", "C"): ("", 0, None), ("A", "C"): ("", 0, None)},
    {("A", "B"): ("", 4, None), ("B", "C"): ("R", 0, None)},
    {("B", "A"): ("", 0, None), ("C", "A"): ("", 0, "X"), ("A", "C"): ("", 5, None)},
]


@pytest.mark.parametrize("edges", PATTERNS)
@pytest.mark.parametrize("only", [False, True])
def test_three_node_patterns(spark, edges, only, monkeypatch):
    monkeypatch.setattr(patterns, "SLOT", 4)  # lists of several slots
    g, data = made(spark, 90, 900, 5, hub=3)
    m = Motif(g)
    for n in "ABC":
        m.node(n, "class == odd" if only and n == "B" else "*")
    for (s, t), (regions, least, type_) in edges.items():
        m.edge(s, t, regions or None, least, type_)
    got = sorted(tuple(r) for r in m.matches().collect())
    assert got == brute_three(data, "ABC", edges, {"B": range(1, 90, 2)} if only else {}, 90)
    assert got or only


def test_matches_with_nodes_and_edges(spark):
    edges = spark.createDataFrame([(1, 2, "L", 5, "X"), (1, 2, "R", 6, "X"), (2, 3, "L", 7, "Y"), (2, 3, "R", 1, "Y"), (4, 4, "L", 1, "X")], "pre_id bigint, post_id bigint, region string, weight bigint, edge_type string")
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(1, 9)], "root_id bigint, name string")
    g = Graph(with_defaults(nodes.join(degrees(edges), "root_id", "left")), edges, regions=REGIONS, edge_types={"X": "x", "Y": "y"})
    chain = Motif(g).node("A").node("B").node("C").edge("A", "B").edge("B", "C", least=2)
    (r,) = chain.matches(with_edges=True).collect()
    assert r["nodes"] == '[{"id":"1","name":"n1"},{"id":"2","name":"n2"},{"id":"3","name":"n3"}]'
    assert r["edges"] == '[{"from":"1","to":"2","region":"L","weight":5,"edge_type":"X"},{"from":"1","to":"2","region":"R","weight":6,"edge_type":"X"},{"from":"2","to":"3","region":"L","weight":7,"edge_type":"Y"}]'
    beside = Motif(g).node("A").node("B").node("C", "root_id << 3, 4, 5").edge("A", "B")
    assert sorted((r["A"], r["B"], r["C"]) for r in beside.matches(limit=50).collect()) == [(1, 2, 4), (1, 2, 5), (2, 3, 4), (2, 3, 5)]
    assert beside.matches(limit=1).count() == 1
    assert Motif(g).node("A", "root_id << 3, 4").matches(with_edges=True).select("A", "edges").collect()[0]["edges"] == "[]"
    assert [tuple(r) for r in Motif(g).node("A").node("B").edge("A", "B", least=0).edge("B", "A").matches().collect()] == [(4, 4)]


def test_no_list_grows_with_a_hub(spark):
    """A node with a pair to every other one has no list of its own: pairs point to it."""
    n = 400
    star = [(0, i, "L", 1, "X") for i in range(1, n)] + [(i, i % (n - 1) + 1, "L", 1, "X") for i in range(1, n)]
    edges = spark.createDataFrame(star, "pre_id bigint, post_id bigint, region string, weight bigint, edge_type string")
    g = Graph(with_defaults(spark.range(n).withColumnRenamed("id", "root_id")), edges, regions=REGIONS, edge_types={"X": "x"})
    m = Motif(g).node("A").node("B").node("C").edge("A", "B").edge("B", "C").edge("A", "C")
    assert sorted(tuple(r) for r in m.matches().collect()) == sorted((0, i, i % (n - 1) + 1) for i in range(1, n))


def test_triangles_send_no_whole_lists(spark):
    """To the far end of a pair go the neighbours that fit beside it and come after it, not all of a list."""
    rng = random.Random(8)
    rows = [(*rng.sample(range(600), 2), "L", 1, "X") for _ in range(15000)]
    edges = spark.createDataFrame(rows, "pre_id bigint, post_id bigint, region string, weight bigint, edge_type string")
    g = Graph(with_defaults(spark.range(600).withColumnRenamed("id", "root_id")), edges, regions=REGIONS, edge_types={"X": "x"})
    store = spark.sparkContext._jsc.sc().statusStore()
    no_quantiles = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0)

    def shuffled():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, no_quantiles, None)
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8KB")
    try:
        start = shuffled()
        m = Motif(g).node("A").node("B").node("C").edge("A", "B").edge("B", "C").edge("C", "A")
        got = {tuple(r) for r in m.matches().collect()}
        sent = shuffled() - start
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    there = {r[:2] for r in rows}
    out = {a: {b for x, b in there if x == a} for a in range(600)}
    one_way = lambda a, b: (a, b) in there and (b, a) not in there
    assert got == {(a, b, c) for a, b in there if one_way(a, b) for c in out[b] if one_way(b, c) and one_way(c, a)}
    assert sent < 85 * len(there)


@pytest.mark.parametrize("up,down,weighted", [(True, True, False), (True, False, True), (False, True, False), (True, True, True)])
def test_similarity_of_many_equals_one_by_one(spark, monkeypatch, up, down, weighted):
    monkeypatch.setattr(similarity, "HUB", 7)
    g, _ = made(spark, 60, 500, 9, hub=2)
    asked = [0, 1, 7, 59, 1000]
    got = sorted((r["query"], r["root_id"], round(r["score"], 9)) for r in similarity.similar_many(g, spark.createDataFrame([(x,) for x in asked + [7]], "root_id bigint"), up=up, down=down, weighted=weighted, first=5).collect())
    want = sorted((x, r["root_id"], round(r["score"], 9)) for x in asked for r in similarity.similar_connectivity(g, x, up=up, down=down, weighted=weighted, first=5).collect())
    assert got == want and len(got) >= 10
    best = {r["root_id"]: round(r["score"], 9) for r in similarity.similar_to_any(g, asked, up=up, down=down, weighted=weighted, first=5).collect()}
    assert best == {n: max(s for _, m, s in want if m == n) for n in {w[1] for w in want}}


def test_shape_scores_are_all_tasks_work(spark):
    from graphloom.sources.driver_tables import _shape_sim

    assert _shape_sim(spark, "/root/testdata/sf0.001").where("src % 20 = 0").rdd.getNumPartitions() >= 4


def test_steps_that_end_at_no_target_are_not_made(spark, monkeypatch):
    """A chain into the target and a fan that leads nowhere: the state holds no node of the fan."""
    pairs = spark.createDataFrame([(0, 1), (1, 2), (2, 3), *[(0, 100 + i) for i in range(50)]], "pre_id bigint, post_id bigint")
    sources, targets = spark.createDataFrame([(0, 0)], "source bigint, root_id bigint"), spark.createDataFrame([(3,)], "root_id bigint")
    put, seen = reach.Buckets.put, []

    def watched(self, df, *columns):
        out = put(self, df, *columns)
        if "found" in df.columns:
            seen.append({r[0] for r in out[1].select("root_id").collect()})
        return out

    monkeypatch.setattr(reach.Buckets, "put", watched)
    for depth, want in ((None, [(0, 3, 3)]), (3, [(0, 3, 3)]), (2, [])):
        assert [tuple(r) for r in reach.distances(pairs, sources, max_depth=depth, targets=targets).collect()] == want
    assert all(n < 100 for state in seen for n in state)
