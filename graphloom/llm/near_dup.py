"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding and verification.

A document is the multiset of its runs of five words (A-Z lower-cased; words as in :mod:`decontam`; a text of fewer words is
one run). Each shingle is a Poisson process with its count as the rate, whose points fall on registers at random; a register
keeps the shingle of its earliest point. Points are drawn in order, and a shingle is done once its next point comes later
than the latest of its document's registers. Two documents agree in a register with the probability Jaccard similarity.

Two documents are near-duplicates if the probability Jaccard similarity of their counts or the plain Jaccard similarity of
their sets is 0.8 or more. Either has its own bands: with all counts 1, registers agree with the plain similarity, and a
text with repeated shingles has bands of both. So a pair above the limit in one measure is met as one of that measure.

Documents with the same words are one node from the start. Nodes that agree in a band of registers are candidates, and
candidates are verified on their exact shingles. No bucket is multiplied out into rows:

* in each of two rounds a node meets one node of each of its buckets, the first in an order of that round, unless
  both are in one class already. This costs a row a member and joins nearly all that belongs together;
* a bucket of at most ``FEW`` nodes that still has several classes is then met whole;
* a larger one is dealt to blocks of ``BLOCK`` nodes, each of one large class or of nodes outside all of these: two blocks meet
  in one task, which counts common shingles by matrix products and hands on links only, no more than join the classes in it.
  Only blocks of the same large class never meet each other.

After that, every two nodes of a bucket have met or are in one class; nothing is left out by a cap or an estimate.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .decontam import small

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 26, 6  #: pairs at the least similarity share no band once in 2,700 times; pairs at half of it share one once in ten times
REGISTERS = BANDS * ROWS
FEW = 12  #: nodes of a bucket that is met whole, pair by pair
BLOCK, BLOCK_SHINGLES = 1024, 300_000  #: nodes of a block and their shingles, about
COLUMNS = 2048  #: shingles in a matrix product
CHUNK_BYTES = 1 << 19  #: of text that a task turns into arrays at a time
PAIRS_AT_ONCE = 64  #: pairs in a batch of the verification

_G, _A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x100000001B3 * 0x5851F42D4C957F2D | 1


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _A
    x = (x ^ (x >> np.uint64(27))) * _B
    return x ^ (x >> np.uint64(31))


_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_is_word = np.zeros(256, dtype=bool)
_is_word[48:58] = _is_word[97:123] = _is_word[128:] = True

_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash's base modulo 2**64, and of its inverse."""
    if len(_powers.get("up", ())) < n:
        size = max(n, CHUNK_BYTES * 2)
        base, inverse = _BASE % 2**64, pow(_BASE, -1, 2**64)
        for name, b in (("up", base), ("down", inverse)):
            out = np.full(size, b, dtype=np.uint64)
            out[0] = 1
            with np.errstate(over="ignore"):
                _powers[name] = np.multiply.accumulate(out)
    return _powers["up"], _powers["down"]


def shingles(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: doc, hash and count of each distinct shingle, ordered by doc and hash; two hashes of each text's words."""
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)
    data = _lower[data]
    bounds = np.cumsum([len(t) + 1 for t in texts])
    mask = _is_word[data]
    edges = np.diff(mask.astype(np.int8), prepend=0)
    starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    up, down = _power(len(data) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    word = _mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _G)
    doc = np.searchsorted(bounds, starts, "right")
    first = np.searchsorted(doc, np.arange(len(texts)))
    n_words = np.diff(np.append(first, len(word)))
    # words in order, for copies
    place = (np.arange(len(word)) - first[doc]).astype(np.uint64)
    sequence = np.zeros((2, len(texts)), dtype=np.uint64)
    for k, salt in enumerate((np.uint64(0x1234567), np.uint64(0xABCDEF123))):
        run = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(word + (place + salt) * _G))])
        sequence[k] = _mix(run[first + n_words] - run[first] + n_words.astype(np.uint64))
    n = len(word) - SHINGLE + 1
    if n > 0:
        whole = doc[:n] == doc[SHINGLE - 1 :]
        h = np.zeros(n, dtype=np.uint64)
        for i in range(SHINGLE):
            h = h * np.uint64(0xD6E8FEB86659FD93) + word[i : i + n]
        h, d = _mix(h[whole]), doc[:n][whole]
    else:
        h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    short = np.flatnonzero((n_words > 0) & (n_words < SHINGLE))
    if len(short):
        h, d = np.concatenate([h, sequence[0][short]]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (d[1:] != d[:-1])]) if len(h) else np.zeros(0, np.int64)
    return d[new], h[new], np.diff(np.append(new, len(h))), np.where(n_words > 0, sequence, np.uint64(0))


def registers(doc: np.ndarray, hashes: np.ndarray, weights: np.ndarray, n_docs: int, m: int = REGISTERS) -> np.ndarray:
    """ProbMinHash registers, one row a document; 0 throughout where a document has no shingle."""
    times, ids = np.full(n_docs * m, np.inf), np.zeros(n_docs * m, dtype=np.uint64)
    alive, t, k = np.arange(len(doc)), np.zeros(len(doc)), 0
    while len(alive):
        k += 1
        x = _mix(hashes[alive] + np.uint64(k * int(_G) % 2**64))
        t = t - np.log(((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53) / weights[alive]
        at = doc[alive] * m + (_mix(x + _G) % np.uint64(m)).astype(np.int64)
        better = t < times[at]
        np.minimum.at(times, at[better], t[better])
        won = better & (times[at] == t)
        ids[at[won]] = hashes[alive[won]]
        go_on = t < times.reshape(-1, m).max(axis=1)[doc[alive]]
        alive, t = alive[go_on], t[go_on]
    return ids.reshape(-1, m)


def _bands(sig: np.ndarray) -> np.ndarray:
    """The key of each band of registers."""
    sig = sig.reshape(-1, BANDS, ROWS)
    band = np.zeros(sig.shape[:2], dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _G
    for i in range(ROWS):
        band = _mix(band + sig[:, :, i])
    return band


_SIGNED = "doc_id long, ref string, node binary, size long, bands array<struct<band: int, key: long>>"


def _sign(batches):
    for b in batches:
        texts = b.column(2).to_pylist()
        for at, part in common.chunks(texts, CHUNK_BYTES):
            doc, h, n, sequence = shingles(part)
            sig = registers(doc, h, n.astype(np.float64), len(part))
            band = _bands(sig)
            # a text with repeats has bands of its shingles without their counts too, each where it is another
            repeats = np.zeros(len(part), dtype=bool)
            repeats[doc[n > 1]] = True
            of = repeats[doc]
            plain = _bands(registers((np.cumsum(repeats) - 1)[doc[of]], h[of], np.ones(of.sum()), int(repeats.sum())))
            other = np.zeros(band.shape, dtype=bool)
            other[repeats] = plain != band[repeats]
            both = np.concatenate([band, np.zeros_like(band)], axis=1)
            both[repeats, BANDS:] = plain
            used = np.concatenate([np.ones(band.shape, dtype=bool), other], axis=1)
            empty = (sequence == 0).all(axis=0)
            nodes = pa.array([x.tobytes() for x in np.ascontiguousarray(sequence.T)], pa.binary(), mask=empty)
            at_band = pa.array(np.broadcast_to(np.tile(np.arange(BANDS, dtype=np.int32), 2), used.shape)[used])
            ends = pa.array(np.concatenate([[0], used.sum(axis=1).cumsum()]), pa.int32())
            lists = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([at_band, pa.array(both[used].view(np.int64))], names=["band", "key"]))
            size = pa.array(np.bincount(doc, minlength=len(part)))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), b.column(1).slice(at, len(part)), nodes, size, lists], names=["doc_id", "ref", "node", "size", "bands"])


def _shingle_rows(batches):
    for b in batches:
        for at, part in common.chunks(b.column(1).to_pylist(), CHUNK_BYTES):
            doc, h, n, _ = shingles(part)
            cut = np.searchsorted(doc, np.arange(1, len(part)))
            hs, ns = np.split(h, cut), np.split(n, cut)
            weights = [None if (x == 1).all() else x.astype("<i4").tobytes() for x in ns]
            yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(part)), pa.array([x.tobytes() for x in hs], pa.binary()), pa.array(weights, pa.binary())], names=["node", "h", "n"])


def similarity(a: np.ndarray, x: np.ndarray, b: np.ndarray, y: np.ndarray) -> float:
    """The larger of the Jaccard similarity of two sorted sets and the probability Jaccard of their counts (they agree where no count is above 1)."""
    _, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    plain = len(i) / (len(a) + len(b) - len(i))
    if x.max() == 1 and y.max() == 1:
        return plain
    fx, fy = x.astype(np.float64), y.astype(np.float64)
    xi, yi = fx[i], fy[j]
    only_x, only_y = fx.sum() - xi.sum(), fy.sum() - yi.sum()
    total = 0.0
    ratio = xi / yi
    for r in np.unique(ratio):
        same = ratio == r
        total += (xi[same] / (only_x + r * only_y + np.maximum(xi, yi * r).sum())).sum()
    return max(plain, total)


def _verify(batches):
    for whole in batches:
        # shingles of long texts are large, so a few pairs at a time become Python objects
        for at in range(0, whole.num_rows, PAIRS_AT_ONCE):
            b = whole.slice(at, PAIRS_AT_ONCE)
            keep = []
            for i, r in enumerate(b.to_pylist()):
                ha, hb = np.frombuffer(r["ha"], np.uint64), np.frombuffer(r["hb"], np.uint64)
                if min(len(ha), len(hb)) == 0:
                    continue
                na, nb = (np.ones(len(h), np.int32) if n is None else np.frombuffer(n, "<i4") for h, n in ((ha, r["na"]), (hb, r["nb"])))
                if similarity(ha, na, hb, nb) >= SIMILARITY - 1e-9:
                    keep.append(i)
            rows = pa.array(keep, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows)], names=["a", "b"])


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) of every node of ``edges`` (a, b), by alternating large and small stars.

    Each step is written to the shared folder; hubs are spread by partial aggregation and by the skew handling of joins.
    """
    e = common.written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    while True:
        # done once every node hangs on one centre, and no centre on another
        ends = e.select("u", F.lit(1).alias("hangs"), F.lit(0).alias("centre")).unionAll(e.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("u").agg(F.sum("hangs").alias("n"), F.max("centre").alias("c")).where("n + c > 1").isEmpty():
            break
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        e = common.written(joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "stars")
    return e.groupBy("u").agg(F.min("v").alias("comp")).select(F.col("u").alias("node"), "comp").unionAll(e.select(F.col("v").alias("node"), F.col("v").alias("comp")).distinct())


def _labelled(members: DataFrame, comp: DataFrame | None) -> DataFrame:
    if comp is None:
        return members.withColumn("comp", F.col("node"))
    return members.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def _ordered(a: str, b: str) -> list:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _rough(links: DataFrame) -> DataFrame:
    """node, comp from links: the smallest node that each is linked to, followed once."""
    ends = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select("node", F.least("node", "b").alias("comp"))
    above = low.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
    return common.written(low.join(above, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp")), "rough")


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The labels ``comp`` after new links: only labels that these join are looked at."""
    a, b = comp.select(F.col("node").alias("a"), F.col("comp").alias("ca")), comp.select(F.col("node").alias("b"), F.col("comp").alias("cb"))
    ends = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    over = common.written(components(ends), "over")
    alone = over.select("node", F.col("node").alias("comp")).join(comp, "node", "left_anti")
    up = over.select(F.col("node").alias("comp"), F.col("comp").alias("higher"))
    return comp.unionAll(alone).join(up, "comp", "left").select("node", F.coalesce("higher", "comp").alias("comp"))


def _sets(used: DataFrame, n_used: int, nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """node, h, n: the shingles and counts (null: all 1) of the nodes in ``used``."""
    # a node's row is found again by its id and text; rows that repeat give the same shingles once
    text = rows.join(small(used.join(nodes.select("node", "ref"), "node"), n_used), "ref").select("node", "t")
    return common.written(text.mapInArrow(_shingle_rows, "node binary, h binary, n binary").dropDuplicates(["node"]), "sets")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("node")).unionAll(pairs.select(F.col("b").alias("node"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are similar enough on their exact shingles."""
    left = sets.select(F.col("node").alias("a"), F.col("h").alias("ha"), F.col("n").alias("na"))
    right = sets.select(F.col("node").alias("b"), F.col("h").alias("hb"), F.col("n").alias("nb"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "na", "hb", "nb")
    # a pair of long texts has hundreds of kilobytes of shingles
    with common.batches_of(pairs.sparkSession, PAIRS_AT_ONCE):
        return common.written(both.mapInArrow(_verify, "a binary, b binary"), "links")


def _first_pairs(labelled: DataFrame, seed: int) -> DataFrame:
    """Each node of ``labelled`` (band, key, node, comp) with the first node of each of its buckets, unless they are of one class."""
    first = F.min(F.struct(F.xxhash64("node", F.lit(seed)).alias("o"), "node", "comp")).alias("f")
    lead = labelled.groupBy("band", "key").agg(first, F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high")
    lead = lead.select("band", "key", F.col("f.node").alias("first"), F.col("f.comp").alias("of"))
    return labelled.join(lead, ["band", "key"]).where("comp <> of").select(*_ordered("node", "first")).distinct()


def _few_pairs(labelled: DataFrame, several: DataFrame) -> DataFrame:
    """All pairs of different classes in buckets of at most ``FEW`` nodes."""
    m = labelled.join(several.where(F.col("n") <= FEW).select("band", "key"), ["band", "key"])
    other = m.select("band", "key", F.col("node").alias("x"), F.col("comp").alias("c"))
    keys = (F.col("m.band") == F.col("o.band")) & (F.col("m.key") == F.col("o.key"))
    return m.alias("m").join(other.alias("o"), keys & (F.col("node") < F.col("x")) & (F.col("comp") != F.col("c"))).select(*_ordered("node", "x")).distinct()


def _parts(n: str, total: str):
    return F.greatest(F.ceil(F.col(n) / BLOCK), F.ceil(F.col(total) / BLOCK_SHINGLES))


def _dealt(labelled: DataFrame, several: DataFrame, sizes: DataFrame) -> DataFrame:
    """Nodes of larger buckets in blocks: band, key, block, node, comp. A block is of one large class (``whole``) or of none."""
    m = labelled.join(several.where(F.col("n") > FEW).select("band", "key"), ["band", "key"]).join(sizes, "node")
    of = m.groupBy("band", "key", "comp").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    of = of.withColumn("whole", F.when(F.col("n") >= BLOCK // 2, F.col("comp")))
    pool = of.groupBy("band", "key", "whole").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    part = pool.select("band", "key", F.col("whole").alias("w"), _parts("n", "total").alias("parts"))
    of = of.alias("f").join(part.alias("p"), (F.col("f.band") == F.col("p.band")) & (F.col("f.key") == F.col("p.key")) & F.col("whole").eqNullSafe(F.col("w")))
    of = of.select("f.band", "f.key", "comp", "whole", "parts")
    block = F.xxhash64(F.coalesce("whole", F.lit(b"")), F.pmod(F.xxhash64("node"), "parts"))
    return m.join(of, ["band", "key", "comp"]).select("band", "key", block.alias("block"), "whole", "node", "comp")


def _pack_block(table: pa.Table) -> pa.Table:
    """One row of a block's nodes, comps (16 bytes each), numbers of shingles, shingles and counts."""
    cols = {c: table.column(c).to_pylist() for c in ("node", "comp", "h", "n")}
    lengths = np.array([len(h) // 8 for h in cols["h"]], dtype="<i4")
    counts = b"".join(np.ones(k, "<i4").tobytes() if n is None else n for k, n in zip(lengths.tolist(), cols["n"]))
    one = lambda x: pa.array([x], pa.binary())
    return pa.table({"band": table.column("band").slice(0, 1), "key": table.column("key").slice(0, 1), "block": table.column("block").slice(0, 1), "nodes": one(b"".join(cols["node"])), "comps": one(b"".join(cols["comp"])), "lengths": one(lengths.tobytes()), "h": one(b"".join(cols["h"])), "n": one(counts)})


class _Block:
    def __init__(self, row: dict):
        self.nodes = [row["nodes"][i : i + 16] for i in range(0, len(row["nodes"]), 16)]
        self.comps = [row["comps"][i : i + 16] for i in range(0, len(row["comps"]), 16)]
        self.size = np.frombuffer(row["lengths"], "<i4").astype(np.int64)
        self.h, self.n = np.frombuffer(row["h"], np.uint64), np.frombuffer(row["n"], "<i4").astype(np.float64)
        self.at = np.r_[0, np.cumsum(self.size)]
        self.of = np.repeat(np.arange(len(self.size)), self.size)
        self.total = np.bincount(self.of, weights=self.n, minlength=len(self.size))
        self.plain = bool((self.n == 1).all())

    def one(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        s = slice(self.at[i], self.at[i + 1])
        return self.h[s], self.n[s]


def _possible(a: _Block, b: _Block) -> np.ndarray:
    """Which pairs of two blocks can be similar enough: exact for plain similarity, an upper bound for counts."""
    shared = np.intersect1d(a.h, b.h)
    same, x, y = (np.zeros((len(a.nodes), len(b.nodes))) for _ in range(3))
    weighted = not (a.plain and b.plain)
    for i in range(0, len(shared), COLUMNS):
        columns = shared[i : i + COLUMNS]
        sides = []
        for s in (a, b):
            at = np.minimum(np.searchsorted(columns, s.h), len(columns) - 1)
            hit = np.flatnonzero(columns[at] == s.h)
            ones, mass = np.zeros((2, len(s.nodes), len(columns)), dtype=np.float32)
            ones[s.of[hit], at[hit]] = 1
            mass[s.of[hit], at[hit]] = s.n[hit] / s.total[s.of[hit]]
            sides.append((ones, mass))
        same += sides[0][0] @ sides[1][0].T
        if weighted:
            x += sides[0][1] @ sides[1][0].T
            y += sides[0][0] @ sides[1][1].T
    with np.errstate(divide="ignore", invalid="ignore"):
        fine = same / (a.size[:, None] + b.size[None, :] - same) >= SIMILARITY - 1e-9
        # a pair whose common shingles are X of the mass of one and Y of the other has 1 / (1 / X + 1 / Y - 1) at most
        return fine | (1 / (1 / x + 1 / y - 1) >= SIMILARITY - 1e-4) if weighted else fine


def _meet(table: pa.Table) -> pa.Table:
    """Links that join the classes of two blocks, or of one with itself."""
    blocks = [_Block(r) for r in table.to_pylist()]
    a, b = blocks[0], blocks[-1]
    top: dict[bytes, bytes] = {}

    def find(c):
        while top.setdefault(c, c) != c:
            c = top[c]
        return c

    links = ([], [])
    for i, j in zip(*map(np.ndarray.tolist, np.nonzero(_possible(a, b)))):
        c, d = find(a.comps[i]), find(b.comps[j])
        if c != d and similarity(*a.one(i), *b.one(j)) >= SIMILARITY - 1e-9:
            top[max(c, d)] = min(c, d)
            links[0].append(min(a.nodes[i], b.nodes[j]))
            links[1].append(max(a.nodes[i], b.nodes[j]))
    return pa.table({"a": pa.array(links[0], pa.binary()), "b": pa.array(links[1], pa.binary())})


def _block_links(dealt: DataFrame, sets: DataFrame) -> DataFrame:
    """Links of different classes between all blocks of a bucket, but those of one large class."""
    schema = "band int, key long, block long, nodes binary, comps binary, lengths binary, h binary, n binary"
    whole = dealt.select("band", "key", "block", "node", "comp").join(sets, "node")
    packed = common.written(whole.groupBy("band", "key", "block").applyInArrow(_pack_block, schema), "blocks")
    kinds = dealt.select("band", "key", "block", "whole").distinct()
    side = lambda s: kinds.select("band", "key", F.col("block").alias(f"block_{s}"), F.col("whole").alias(f"whole_{s}"))
    # blocks meet once, those of no large class themselves too; a block is sent to each pair that it is in
    pairs = side("a").join(side("b"), ["band", "key"]).where("block_a <= block_b AND coalesce(whole_a <> whole_b, true)").select("band", "key", "block_a", "block_b")
    sent = pairs.select("*", F.explode(F.array_distinct(F.array("block_a", "block_b"))).alias("block"))
    met = packed.join(sent, ["band", "key", "block"]).groupBy("band", "key", "block_a", "block_b").applyInArrow(_meet, "a binary, b binary")
    return common.written(met, "block-links")


def links(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The signed rows (doc_id, ref, node, size, bands), verified links (a, b) that join all classes, and the components of the nodes in them."""
    rows = docs.select("doc_id", "text").select(F.col("doc_id").cast("long"), common.row_key(F.col("doc_id"), F.col("text")).alias("ref"), F.encode(F.coalesce("text", F.lit("")), "utf-8").alias("t"))
    signed = common.written(rows.mapInArrow(_sign, _SIGNED), "signed")
    nodes = common.written(signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min(F.struct("ref", "size", "bands")).alias("x")).select("node", "x.ref", "x.size", "x.bands"), "nodes")
    members = nodes.select("node", F.inline("bands"))
    members = common.written(members.join(members.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1").select("band", "key"), ["band", "key"]), "members")
    tried = None

    def new(pairs: DataFrame) -> DataFrame | None:
        """The links among pairs that have not met."""
        nonlocal tried
        pairs = common.written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        n_pairs = pairs.count()
        tried = pairs if tried is None else tried.unionAll(pairs)
        return _verified(pairs, _sets(_ends(pairs), 2 * n_pairs, nodes, rows)) if n_pairs else None

    def both(x: DataFrame | None, y: DataFrame | None) -> DataFrame | None:
        return x.unionAll(y) if x is not None and y is not None else x if y is None else y

    first = new(_first_pairs(_labelled(members, None), 0))
    # labels that are right as far as they go will do for the second round
    found = both(first, new(_first_pairs(_labelled(members, None if first is None else _rough(first)), 1)))
    comp = None if found is None else common.written(components(found), "comp")
    labelled = common.written(_labelled(members, comp), "labelled")
    several = labelled.groupBy("band", "key").agg(F.count("*").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high AND n > 2")
    several = common.written(several.select("band", "key", "n"), "several")
    late = new(_few_pairs(labelled, several))
    if not several.where(F.col("n") > FEW).isEmpty():
        dealt = common.written(_dealt(labelled, several, nodes.select("node", "size")), "dealt")
        used = dealt.select("node").distinct()
        late = both(late, _block_links(dealt, _sets(used, used.count(), nodes, rows)))
    if late is not None and not late.isEmpty():
        found = both(found, late)
        comp = common.written(components(late) if comp is None else _joined(comp, late), "comp")
    return signed, found if found is not None else members.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0), comp


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, class_id (the smallest doc_id of its class) and n_class (rows of the class).

    Documents are linked at a similarity of 0.8 or more of their five-word shingles; classes are what links connect.
    Documents without words (null and empty texts too) are each a class of their own, as are documents that resemble none.
    Repeated rows belong to one class; a class without any id has a null class_id. Other columns are ignored.
    """
    signed, _, comp = links(docs)
    rows = signed.select("doc_id", "node")
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    nodes = _labelled(nodes, comp)
    classes = nodes.groupBy("comp").agg(F.min("first").alias("class_id"), F.sum("n").alias("n_class"))
    of = nodes.select("node", "comp").join(classes, "comp").select("node", "class_id", "n_class")
    out = rows.where(F.col("node").isNotNull()).join(of, "node").select("doc_id", "class_id", "n_class")
    return out.unionAll(rows.where(F.col("node").isNull()).select("doc_id", F.col("doc_id").alias("class_id"), F.lit(1).cast("long")))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each near-duplicate class: that of the smallest (doc_id, hash of id and text).

    Rows with that document's id and text stay once. Documents without words are kept as they are, but repeated ones once.
    """
    signed, _, comp = links(docs)
    one = F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "ref"))
    nodes = signed.where(F.col("node").isNotNull()).groupBy("node").agg(one.alias("first"))
    kept = _labelled(nodes, comp).groupBy("comp").agg(F.min("first").alias("first")).select("first.ref")
    kept = common.written(kept.unionAll(signed.where(F.col("node").isNull()).select("ref")).distinct(), "kept")
    # a name that no column has
    (mark,) = common.free_names(docs.columns, 1)
    marked = docs.withColumn(mark, common.row_key(F.col("doc_id"), F.col("text")))
    # of the keys that stay and those that go, the fewer meet the texts, which then need no shuffle as long as these are few
    gone = common.written(signed.select("ref").distinct().join(kept, "ref", "left_anti"), "gone")
    n_kept, n_gone = kept.count(), gone.count()
    fewer, n, how = (gone, n_gone, "left_anti") if n_gone <= n_kept else (kept, n_kept, "left_semi")
    stay = marked.join(small(fewer.withColumnRenamed("ref", mark), n), mark, how)
    # only rows that share id and text meet here
    twice = common.written(signed.groupBy("ref").agg(F.count("*").alias("n")).where("n > 1").select(F.col("ref").alias(mark)), "twice")
    n_twice = twice.count()
    if not n_twice:
        return stay.select(*map(common.quoted, docs.columns))
    once = stay.join(small(twice, n_twice), mark, "left_anti")
    again = stay.join(small(twice, n_twice), mark, "left_semi").dropDuplicates([mark])
    return once.unionByName(again).select(*map(common.quoted, docs.columns))
