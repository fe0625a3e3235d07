"""Embedding near-duplicates by a robust-pruned flat graph.

Vectors of the same direction and length are one node from the start. Nodes are dealt to clusters by k-means on a bounded
sample, each to its ``overlap`` nearest ones, and a cluster that is too large is split again in the same way. Within each of these
overlapping shards a flat graph is built: a node's nearest others and a few far ones, pruned robustly (a candidate goes if a kept
one is nearer to it than the node, by a factor), and the edges back. The lists that a node has in its shards are united.

Every node then searches its shards: greedily from the shard's medoid with a beam, then expanding all that lies within range
until nothing new does. Where it finds a node that has another shard, the search goes on there, round by round, until it meets no
new shard. Products are taken in doubles, so what is found is verified. A link is counted in one shard only and leaves its task
as a number and a label, so a dense group costs no row for each pair. Labels of shards are joined to components by
:func:`graphloom.llm.near_dup.components`. An audit compares a sample with brute force; below the wanted recall all is done
again with twice the overlap.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .near_dup import components
from .topk import usable

SIMILARITY = 0.95
OVERLAP = 3  #: shards of a node
TARGET, LIMIT = 2048, 4096  #: nodes of a shard that clusters aim at, and the most before it is split
FAN, PER_CENTRE = 256, 64  #: the most clusters of one split, and sampled nodes for each: 16,384 of a split at most, about
LEVELS = 5  #: splits of a shard within a shard; 256**5 shards are beyond any table
ROOT = 1 << 20  #: numbers of first shards start here, so that those of later levels are apart
NEAR, KEPT, FAR, DEGREE = 48, 24, 8, 64  #: candidates of a node, near ones kept, far ones, and the most edges
ALPHA = 1.2
BEAM, AT_ONCE, STEPS = 32, 4, 24  #: of the greedy search: its beam, nodes expanded at once and the most steps
EXPAND = 0.92  #: nodes of this cosine are expanded, so that links behind a gap are met
BLOCK = 128  #: queries that search together
CHUNK = 8192  #: nodes or guests that one task reads beside a shard or its centres
AUDIT, RECALL = 512, 0.9  #: nodes of the audit, and the recall that it demands

_OUT = "kind int, a long, b long, x long"
_COUNT, _LABEL, _NEXT = 0, 1, 2


def _units(batches):
    """row, vec_id, v: the unit vector as doubles, null for what takes no part."""
    for b in batches:
        lists, ok = b.column("embedding"), b.column("ok").to_numpy(zero_copy_only=False).astype(bool)
        lengths = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
        starts = np.cumsum(lengths) - lengths
        out: list[bytes | None] = [None] * b.num_rows
        for dim in np.unique(lengths[ok]):
            at = np.flatnonzero(ok & (lengths == dim))
            m = values[starts[at][:, None] + np.arange(dim)]
            largest = np.abs(m).max(axis=1)
            some = largest > 0
            m = m[some] / largest[some][:, None]
            m = m / np.sqrt((m * m).sum(axis=1))[:, None] + 0.0
            for i, v in zip(at[some].tolist(), m):
                out[i] = v.astype("<f8").tobytes()
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("vec_id"), pa.array(out, pa.binary())], names=["row", "vec_id", "v"])


def _matrix(table: pa.Table, name: str = "v") -> np.ndarray:
    column = table[name].to_pylist()
    return np.frombuffer(b"".join(column), dtype="<f8").reshape(len(column), -1)


def _sorted(table: pa.Table, by: str = "node") -> pa.Table:
    return table.sort_by(by)


# shards


def _centres(target: float):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = _sorted(table)
        v, n = _matrix(table), table["size"][0].as_py()
        k = max(2, min(FAN, int(np.ceil(n / target)), len(v)))
        rng = np.random.default_rng(7)
        c = v[np.sort(rng.choice(len(v), min(k, len(v)), replace=False))].copy()
        for _ in range(6):
            near = (v @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, v)
            norm = np.sqrt((sums * sums).sum(axis=1))
            c = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], c)
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int64()), "centres": pa.array([c.astype("<f8").tobytes()], pa.binary())})

    return run


def _assigned(overlap: int):
    def run(key, nodes: pa.Table, centres: pa.Table) -> pa.Table:
        if not nodes.num_rows or not centres.num_rows:
            return pa.table({"node": pa.array([], pa.int64()), "shard": pa.array([], pa.int64()), "sim": pa.array([], pa.float64())})
        v = _matrix(nodes)
        c = np.frombuffer(centres["centres"][0].as_py(), "<f8").reshape(-1, v.shape[1])
        s = v @ c.T
        k = min(overlap, len(c))
        best = np.argsort(-s, axis=1, kind="stable")[:, :k]
        ids = np.repeat(nodes["node"].to_numpy(), k)
        return pa.table({"node": pa.array(ids, pa.int64()), "shard": pa.array((key[0].as_py() * FAN + best).ravel(), pa.int64()), "sim": pa.array(np.take_along_axis(s, best, axis=1).ravel())})

    return run


def _place(nodes: DataFrame, overlap: int) -> DataFrame:
    """node, shards: the shards of each node, at most ``overlap``, sorted."""
    # the first shard of a node is its dimension, so that vectors meet their own kind only
    members = nodes.select("node", (F.col("dim") + ROOT).alias("shard"), F.lit(1.0).alias("sim"))
    target = TARGET / overlap
    part = (F.xxhash64("node").bitwiseAND(F.lit(2**30 - 1)) / F.lit(2.0**30)).alias("u")
    for level in range(LEVELS):
        sizes = common.written(members.groupBy("shard").agg(F.count("*").alias("size")).where(F.col("size") > LIMIT), "sizes")
        if sizes.isEmpty():
            break
        rows = members.join(sizes, "shard").join(nodes.select("node", "v"), "node")
        # later levels hold each node ``overlap`` times already
        aim = target if level == 0 else TARGET
        wanted = F.least(F.lit(FAN), F.ceil(F.col("size") / F.lit(aim))) * PER_CENTRE / F.col("size")
        sample = rows.where(part < wanted).select("shard", "size", "node", "v")
        centres = common.written(sample.groupBy("shard").applyInArrow(_centres(aim), "shard long, centres binary"), "centres")
        chunks = F.ceil(F.col("size") / F.lit(CHUNK))
        dealt = rows.select("shard", F.pmod(F.xxhash64("node", F.lit(1)), chunks).alias("chunk"), "node", "v")
        told = centres.join(sizes, "shard").select("shard", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("chunk"), "centres")
        parts = dealt.groupBy("shard", "chunk").cogroup(told.groupBy("shard", "chunk")).applyInArrow(_assigned(overlap), "node long, shard long, sim double")
        members = members.join(sizes, "shard", "left_anti").unionByName(parts)
        if level:
            best = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("sim")).alias("far"), "shard"))), 1, overlap)
            members = members.groupBy("node").agg(best.alias("m")).select("node", F.explode("m").alias("m")).select("node", "m.shard", (-F.col("m.far")).alias("sim"))
        members = common.written(members.select("node", "shard", "sim"), "members")
    return members.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("shards"))


# the graph


def _pruned(v: np.ndarray, own: np.ndarray, cand: np.ndarray, real: np.ndarray, keep: int) -> np.ndarray:
    """Which candidates of each node stay: in order of nearness, each takes away those that it is nearer to by ALPHA than the node is."""
    sims = np.einsum("id,icd->ic", v[own], v[cand])
    order = np.argsort(np.where(real, -sims, np.inf), axis=1, kind="stable")
    cand, real, sims = (np.take_along_axis(x, order, axis=1) for x in (cand, real, sims))
    between = v[cand] @ v[cand].transpose(0, 2, 1)
    alive, kept, rows = real.copy(), np.zeros_like(real), np.arange(len(own))
    for _ in range(keep):
        p = alive.argmax(axis=1)
        some = alive[rows, p]
        if not some.any():
            break
        kept[rows[some], p[some]] = True
        gone = ALPHA**2 * (1 - between[rows, p]) <= 1 - sims
        alive &= ~(gone & some[:, None])
        alive[rows, p] = False
    out = np.zeros_like(kept)
    np.put_along_axis(out, order, kept, axis=1)
    return out


def _graph(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """node, neighbours: the pruned graph of one shard."""
    table = _sorted(table)
    ids, v = table["node"].to_numpy(), _matrix(table)
    n = len(ids)
    near, far = min(NEAR, n - 1), min(4 * FAR, n - 1)
    if n < 2:
        return pa.table({"node": pa.array(ids, pa.int64()), "neighbours": pa.array([[] for _ in ids], pa.list_(pa.int64()))})
    rng = np.random.default_rng(n)
    pairs = []
    for at in range(0, n, 256):
        own = np.arange(at, min(at + 256, n))
        s = v[own] @ v.T
        s[np.arange(len(own)), own] = -np.inf
        cand = np.argpartition(-s, near - 1, axis=1)[:, :near]
        kept = _pruned(v, own, cand, np.ones_like(cand, dtype=bool), KEPT)
        i, j = np.nonzero(kept)
        pairs.append((own[i], cand[i, j]))
        cand = rng.integers(0, n, (len(own), far))
        kept = _pruned(v, own, cand, cand != own[:, None], FAR)
        i, j = np.nonzero(kept)
        pairs.append((own[i], cand[i, j]))
    src, dst = (np.concatenate([p[k] for p in pairs]) for k in (0, 1))
    both = np.unique(np.concatenate([src * n + dst, dst * n + src]))
    src, dst = both // n, both % n
    # a node with too many edges keeps its nearest, pruned, and its farthest
    order = np.lexsort((-np.einsum("id,id->i", v[src], v[dst]), src))
    src, dst = src[order], dst[order]
    degree = np.bincount(src, minlength=n)
    place = np.arange(len(src)) - (np.cumsum(degree) - degree)[src]
    stays = place < DEGREE
    crowded = np.flatnonzero(degree > DEGREE)
    for at in range(0, len(crowded), 256):
        own = crowded[at : at + 256]
        begin = (np.cumsum(degree) - degree)[own]
        slot = begin[:, None] + np.arange(DEGREE)
        kept = _pruned(v, own, dst[slot], np.ones(slot.shape, dtype=bool), DEGREE - FAR)
        stays[slot] = kept
        last = (begin + degree[own])[:, None] - 1 - np.arange(FAR)
        stays[last] = True
    src, dst = src[stays], dst[stays]
    ends = np.cumsum(np.bincount(src, minlength=n))
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids[dst], pa.int64()))
    return pa.table({"node": pa.array(ids, pa.int64()), "neighbours": lists})


# the search


class _Shard:
    def __init__(self, key: int, table: pa.Table):
        table = _sorted(table)
        self.key, self.ids, self.v = key, table["node"].to_numpy(), _matrix(table)
        self.copies = table["n"].to_numpy()
        self.shards = _padded(table["shards"].to_pylist())
        n = len(self.ids)
        lists = table["neighbours"].combine_chunks()
        lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
        src = np.repeat(np.arange(n), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        dst = self.place(lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64))
        src, dst = src[dst >= 0], dst[dst >= 0]
        degree = np.bincount(src, minlength=n)
        # padded with the node itself
        self.adj = np.repeat(np.arange(n)[:, None], max(1, degree.max(initial=0)), axis=1)
        self.adj[src, np.arange(len(src)) - (np.cumsum(degree) - degree)[src]] = dst
        self.medoid = int((self.v @ self.v.mean(axis=0)).argmax())

    def place(self, ids: np.ndarray) -> np.ndarray:
        """Places of nodes in this shard, -1 for others."""
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        return np.where(self.ids[at] == ids, at, -1)

    def reach(self, q: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Cosines of each query to the nodes that its search looks at, -2 for the rest. ``start`` is a place or -1."""
        b, n = len(q), len(self.ids)
        sims, open_ = np.full((b, n), -2.0), np.zeros((b, n), dtype=bool)

        def look(rows: np.ndarray, cols: np.ndarray) -> None:
            want = np.zeros((b, n), dtype=bool)
            want[rows, cols] = True
            new = want & (sims == -2.0)
            at = np.flatnonzero(new.any(axis=0))
            if len(at):
                products = q @ self.v[at].T
                sims[:, at] = np.where(new[:, at], products, sims[:, at])
                np.logical_or(open_, new, out=open_)

        def expand(rows: np.ndarray, cols: np.ndarray) -> None:
            open_[rows, cols] = False
            for at in range(0, len(rows), 1 << 16):
                r, c = rows[at : at + (1 << 16)], cols[at : at + (1 << 16)]
                look(np.repeat(r, self.adj.shape[1]), self.adj[c].ravel())

        look(np.arange(b), np.full(b, self.medoid))
        known = np.flatnonzero(start >= 0)
        look(known, start[known])
        beam, wide = min(BEAM, n), min(AT_ONCE, n)
        for _ in range(STEPS):
            least = np.partition(sims, n - beam, axis=1)[:, n - beam]
            waiting = np.where(open_, sims, -3.0)
            best = np.argpartition(-waiting, wide - 1, axis=1)[:, :wide]
            value = np.take_along_axis(waiting, best, axis=1)
            r, k = np.nonzero((value > -2.0) & (value >= least[:, None]))
            if not len(r):
                break
            expand(r, best[r, k])
        while True:
            r, c = np.nonzero(open_ & (sims >= EXPAND))
            if not len(r):
                return sims
            expand(r, c)


def _padded(lists: list[list[int]], width: int | None = None) -> np.ndarray:
    out = np.full((len(lists), width or max(map(len, lists), default=1) or 1), -1, dtype=np.int64)
    for i, x in enumerate(lists):
        out[i, : len(x)] = x
    return out


class _Labels:
    """Components of nodes, by number."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, r: np.ndarray, c: np.ndarray) -> None:
        a, b = self.label[r], self.label[c]
        differ = a != b
        if not differ.any():
            return
        n, up = len(self.label), {}

        def root(x: int) -> int:
            while up.get(x, x) != x:
                up[x] = up.get(up[x], up[x])
                x = up[x]
            return x

        for k in np.unique(np.maximum(a, b)[differ] * n + np.minimum(a, b)[differ]).tolist():
            x, y = root(k // n), root(k % n)
            if x != y:
                up[max(x, y)] = min(x, y)
        names = np.arange(n)
        for x in up:
            names[x] = root(x)
        self.label = names[self.label]


def _find(key: int, shard: _Shard, nodes: np.ndarray, v: np.ndarray, seen: np.ndarray, now: np.ndarray, start: np.ndarray) -> pa.Table:
    """What ``nodes`` find in the shard: their counts, labels and next shards.

    ``seen`` are a node's shards of rounds before and ``now`` those of this one: a link counts in the first shard that both share.
    """
    own = shard.place(nodes)
    # guests stand behind the members
    numbers = np.where(own >= 0, own, len(shard.ids) + np.arange(len(nodes)))
    labels = _Labels(len(shard.ids) + len(nodes))
    out: list[list[np.ndarray]] = [[], [], [], []]

    def put(kind: int, a, b, x) -> None:
        for column, values in zip(out, (np.full(len(a), kind), a, b, x)):
            column.append(np.asarray(values, dtype=np.int64))

    before = [np.where(m < 0, -9, m) for m in (seen, np.where(now < key, now, -9))]
    every = np.concatenate([seen, now], axis=1)
    for at in range(0, len(nodes), BLOCK):
        to = min(at + BLOCK, len(nodes))
        found = shard.reach(v[at:to], start[at:to]) >= SIMILARITY
        mine = own[at:to]
        found[np.flatnonzero(mine >= 0), mine[mine >= 0]] = False
        r, c = np.nonzero(found)
        if not len(r):
            continue
        counted, follow = np.ones(len(r), dtype=bool), []
        theirs = shard.shards[c]
        for k in range(theirs.shape[1]):
            s = theirs[:, k]
            known = np.zeros(len(r), dtype=bool)
            for m in before:
                counted &= ~((m[at:to][r] == s[:, None]).any(axis=1) & (s >= 0))
            known = (every[at:to][r] == s[:, None]).any(axis=1)
            new = np.flatnonzero((s >= 0) & ~known)
            if len(new):
                follow.append((r[new], s[new], c[new]))
        links = np.bincount(r[counted], weights=shard.copies[c[counted]], minlength=to - at).astype(np.int64)
        some = np.flatnonzero(links)
        put(_COUNT, nodes[at:to][some], links[some], np.zeros(len(some)))
        labels.join(numbers[at:to][r], c)
        if follow:
            r, s, c = (np.concatenate([f[k] for f in follow]) for k in range(3))
            names, which = np.unique(s, return_inverse=True)
            _, first = np.unique(r * len(names) + which, return_index=True)
            put(_NEXT, nodes[at:to][r[first]], s[first], shard.ids[c[first]])
    all_ids = np.concatenate([shard.ids, nodes])
    lowest = np.full(len(all_ids), np.iinfo(np.int64).max)
    np.minimum.at(lowest, labels.label, all_ids)
    low = lowest[labels.label]
    linked = np.bincount(labels.label, minlength=len(all_ids))[labels.label] > 1
    put(_LABEL, all_ids[linked], low[linked], np.zeros(linked.sum()))
    kind, a, b, x = (np.concatenate(c) if c else np.empty(0, np.int64) for c in out)
    return pa.table({"kind": pa.array(kind, pa.int32()), "a": pa.array(a), "b": pa.array(b), "x": pa.array(x)})


def _search(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    shard = _Shard(key[0].as_py(), table)
    return _find(shard.key, shard, shard.ids, shard.v, np.full((len(shard.ids), 1), -9), shard.shards, np.arange(len(shard.ids)))


def _visit(key, hosts: pa.Table, guests: pa.Table) -> pa.Table:
    if not hosts.num_rows or not guests.num_rows:
        return pa.table({"kind": pa.array([], pa.int32()), **{c: pa.array([], pa.int64()) for c in ("a", "b", "x")}})
    shard, guests = _Shard(key[0].as_py(), hosts), _sorted(guests)
    return _find(shard.key, shard, guests["node"].to_numpy(), _matrix(guests), _padded(guests["seen"].to_pylist()), _padded(guests["now"].to_pylist()), shard.place(guests["hint"].to_numpy()))


class Index:
    """The flat graph of some vectors: ``nodes`` (node, v, n), their ``members`` of shards, and ``adjacency`` (node, neighbours)."""

    def __init__(self, nodes: DataFrame, overlap: int = OVERLAP):
        self.nodes = nodes
        placed = nodes.join(_place(nodes, overlap), "node")
        members = common.written(placed.select("node", "v", "n", "shards", F.explode("shards").alias("shard")), "members")
        lists = members.select("shard", "node", "v").groupBy("shard").applyInArrow(_graph, "node long, neighbours array<long>")
        self.adjacency = common.written(lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("neighbours"))).alias("neighbours")), "adjacency")
        self.members = common.written(members.join(self.adjacency, "node"), "graph")

    def links(self) -> tuple[DataFrame, DataFrame]:
        """node, links (copies of linked nodes); and a, b: labels whose components are those of the links."""
        rounds = [common.written(self.members.groupBy("shard").applyInArrow(_search, _OUT), "found")]
        seen = self.members.select("node", F.col("shards").alias("seen")).dropDuplicates(["node"])
        while True:
            nexts = rounds[-1].where(F.col("kind") == _NEXT).groupBy(F.col("a").alias("node"), F.col("b").alias("shard")).agg(F.min("x").alias("hint"))
            nexts = common.written(nexts, "nexts")
            if nexts.isEmpty():
                break
            now = nexts.groupBy("node").agg(F.sort_array(F.collect_list("shard")).alias("now"))
            known = common.written(now.join(seen, "node"), "visits")
            sizes = nexts.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(CHUNK)).alias("chunks"))
            guests = nexts.join(known, "node").join(self.nodes.select("node", "v"), "node").join(sizes, "shard")
            guests = common.written(guests.select("shard", F.pmod(F.xxhash64("node"), "chunks").alias("chunk"), "node", "v", "seen", "now", "hint"), "guests")
            hosts = self.members.join(sizes, "shard").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
            met = hosts.groupBy("shard", "chunk").cogroup(guests.groupBy("shard", "chunk")).applyInArrow(_visit, _OUT)
            rounds.append(common.written(met, "found"))
            seen = known.select("node", F.array_union("seen", "now").alias("seen"))
        every = rounds[0]
        for r in rounds[1:]:
            every = every.unionAll(r)
        counts = every.where(F.col("kind") == _COUNT).groupBy(F.col("a").alias("node")).agg(F.sum("b").alias("links"))
        return common.written(counts, "links"), every.where(F.col("kind") == _LABEL).select("a", "b")


def audit(nodes: DataFrame, links: DataFrame, size: int = AUDIT) -> float:
    """Recall of the links of about ``size`` nodes, half of them linked, against brute force over all nodes."""
    spark = nodes.sparkSession
    order = F.xxhash64("node", F.lit(11))
    picked = [df.orderBy(order).limit(size // 2) for df in (nodes.join(links, "node"), nodes.join(links, "node", "left"))]
    asked = picked[0].unionAll(picked[1]).select("node", "v", F.coalesce("links", F.lit(0)).alias("links")).dropDuplicates(["node"]).collect()
    if not asked:
        return 1.0
    queries = spark.sparkContext.broadcast([(r["node"], bytes(r["v"])) for r in asked])

    def count(batches):
        by: dict[int, list] = {}
        for i, (node, v) in enumerate(queries.value):
            by.setdefault(len(v), []).append((i, node, np.frombuffer(v, "<f8")))
        total = np.zeros(len(queries.value), dtype=np.int64)
        for b in batches:
            ids, copies, vs = b.column("node").to_numpy(), b.column("n").to_numpy(), b.column("v").to_pylist()
            size = np.array([len(v) for v in vs])
            for k, group in by.items():
                at = np.flatnonzero(size == k)
                if len(at):
                    m = np.frombuffer(b"".join([vs[i] for i in at]), "<f8").reshape(len(at), -1)
                    hit = np.stack([g[2] for g in group]) @ m.T >= SIMILARITY
                    hit &= np.array([g[1] for g in group])[:, None] != ids[at]
                    total[[g[0] for g in group]] += hit @ copies[at]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "t"])

    true = {r["i"]: r["t"] for r in nodes.select("node", "n", "v").mapInArrow(count, "i long, t long").groupBy("i").agg(F.sum("t").alias("t")).collect()}
    wanted = sum(true.values())
    return sum(min(r["links"], true.get(i, 0)) for i, r in enumerate(asked)) / wanted if wanted else 1.0


def near_duplicates(vectors: DataFrame, overlap: int = OVERLAP, recall: float = RECALL) -> DataFrame:
    """Each vector with its links: vec_id, n_links, component_id, kept.

    ``vectors`` has vec_id and embedding; other columns are ignored, whatever their names. Two vectors are linked if their cosine
    is 0.95 or more; vectors that are null, empty, zero or hold a null or non-finite component are linked with nothing, and
    vectors of different dimension are not either. ``n_links`` counts linked vectors, copies included; ``component_id`` is the
    smallest vec_id that links lead to. Every row is a vector of its own, also if ids repeat; a null id comes after all others,
    so a component has none only if all its vectors have none. The graph is searched, not all pairs, so a link may be missed: the
    audit's recall of ``recall`` is demanded, else the overlap is doubled, twice at most. An empty table gives no rows.
    """
    rows = vectors.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding"), usable(F.col("embedding")).alias("ok"))
    rows = common.written(rows.mapInArrow(_units, "row long, vec_id long, v binary"), "units").withColumn("key", F.md5("v"))
    nodes = rows.where("v IS NOT NULL").groupBy("key").agg(F.min("row").alias("node"), F.min("vec_id").alias("first"), F.count("*").alias("n"), F.min("v").alias("v"))
    nodes = common.written(nodes.withColumn("dim", (F.length("v") / 8).cast("long")), "nodes")
    for more in (1, 2, 4):
        links, labels = Index(nodes.select("node", "v", "n", "dim"), overlap * more).links()
        if audit(nodes, links) >= recall:
            break
    comp = components(labels)
    known = nodes.join(links, "node", "left").join(comp, "node", "left").select("key", "n", "first", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("comp", "node").alias("comp"))
    known = common.written(known, "known")
    lowest = known.groupBy("comp").agg(F.min("first").alias("component_id"))
    told = known.join(lowest, "comp").select("key", (F.col("links") + F.col("n") - 1).alias("n_links"), "component_id")
    out = rows.select("vec_id", "key").join(told, "key", "left")
    alone = F.col("n_links").isNull()
    component = F.when(alone, F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
