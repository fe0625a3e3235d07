"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into blocks of nearly equal length. Against a block whose longest vector is ``M``, a query ``q`` with a
known lower bound ``theta`` of its k-th best product can only gain from vectors whose cosine to ``q`` is at least
``theta / (|q| M)``. By that local threshold each query and block choose one way to prune:

* the whole block is skipped if ``|q| M < theta``;
* *length*: only the vectors with ``|q| |p| >= theta``, a prefix of the block, are multiplied;
* *coordinate*: for the query's largest coordinates, the threshold bounds where a vector's own unit coordinate may lie;
  vectors in all those ranges are the candidates.

Candidates are then verified by exact integer products. Queries come in tiles and candidates in lanes, both of bounded size,
so a task holds one tile and one lane, however many rows there are. A tile and a lane are shipped to each other only if the
lane's longest vector is long enough for some query of the tile, which their summaries tell. Rows are told apart by a key of
their own, so an id that repeats stands for as many vectors.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

BLOCK = 2048  #: vectors in a block
LANE = 8  #: blocks of candidates that one task reads
TILE = 4096  #: queries that one task reads
FOCUS = 3  #: coordinates that coordinate pruning looks at

_BLOCK_SCHEMA = "dim int, block long, longest double, n int, rows binary, ids binary, vals binary"
_HIT_SCHEMA = "row long, query_id long, vec_id long, score long"


def usable(embedding: Column) -> Column:
    """Not null, not empty, and every component a finite number."""
    x = lambda v: v.cast("double")
    return F.coalesce(
        (F.size(embedding) > 0) & F.forall(embedding, lambda v: F.coalesce(~F.isnan(x(v)) & (F.abs(x(v)) < float("inf")), F.lit(False))),
        F.lit(False),
    )


def quantised(embedding: Column, scale: int = 256) -> Column:
    """floor(scale * x) of every component, as long."""
    return F.transform(embedding, lambda v: F.floor(v.cast("double") * F.lit(float(scale))))


def _blocks(vectors: DataFrame, size: int, partitions: int) -> DataFrame:
    """Pack vectors(row, vec_id, v) into blocks of like length, the longest first."""

    def pack(batches):
        def flush(dim, rows, ids, vals, k):
            m = np.asarray(vals, dtype=np.int64)
            small = next(t for t in ("<i2", "<i4", "<i8") if np.array_equal(m.astype(t), m))
            norm = np.sqrt((m.astype(np.float64) ** 2).sum(axis=1))
            order = np.argsort(-norm, kind="stable")
            part = pa.array([k])
            return pa.RecordBatch.from_arrays(
                [pa.array([dim], pa.int32()), part.cast(pa.int64()), pa.array([float(norm.max())]), pa.array([len(ids)], pa.int32()),
                 *[pa.array([np.asarray(x, dtype=np.int64)[order].tobytes()], pa.binary()) for x in (rows, ids)], pa.array([m[order].astype(small).tobytes()], pa.binary())],
                names=["dim", "block", "longest", "n", "rows", "ids", "vals"],
            )

        from pyspark import TaskContext

        part, k, dim, rows, ids, vals = TaskContext.get().partitionId(), 0, -1, [], [], []
        for b in batches:
            for r, i, v in zip(*[c.to_pylist() for c in b.columns]):
                if ids and (len(v) != dim or len(ids) >= size):
                    yield flush(dim, rows, ids, vals, (part << 32) + k)
                    k, rows, ids, vals = k + 1, [], [], []
                dim = len(v)
                rows.append(r)
                ids.append(i)
                vals.append(v)
        if ids:
            yield flush(dim, rows, ids, vals, (part << 32) + k)

    norm = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return (
        vectors.withColumns({"d": F.size("v"), "l": -norm, "h": F.xxhash64("row")})
        .repartitionByRange(partitions, "d", "l", "h")
        .sortWithinPartitions("d", "l", "vec_id", "row")
        .select("row", "vec_id", "v")
        .mapInArrow(pack, _BLOCK_SCHEMA)
    )


def _dealt(blocks: DataFrame, name: str, n: int) -> DataFrame:
    """``blocks`` in ``n`` groups of neighbours in length, however many partitions they were packed in."""
    part = F.shiftright("block", 32)
    packed = blocks.agg(F.max(part)).first()[0] + 1
    return blocks.withColumn(name, F.floor(part * F.lit(n) / F.lit(packed)).cast("int"))


def _load(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, ids and vectors of a block; these are in the smallest type that they fit."""
    rows, ids = (np.frombuffer(row[c], dtype=np.int64) for c in ("rows", "ids"))
    vals = np.frombuffer(row["vals"], dtype=f"<i{len(row['vals']) // (row['n'] * row['dim'])}")
    return rows, ids, vals.astype(np.int64).reshape(len(ids), -1)


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact a @ b.T of int64 rows, in float64 where that is exact; a product beyond 64 bits becomes the nearest number of 64 bits."""
    most = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    bound = most(a) * most(b) * a.shape[1]
    if bound < 2.0**53:
        return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if bound < 2.0**62:
        return np.einsum("ij,kj->ik", a, b)
    # whole numbers of any size; scores keep clear of the one number that has no negative
    return np.clip(a.astype(object) @ b.astype(object).T, 1 - 2**63, 2**63 - 1).astype(np.int64)


class _Best:
    """The k best (score, id) pairs of each query of a tile, ties to the smaller id."""

    def __init__(self, n: int, k: int, theta: np.ndarray):
        self.k, self.found, self.theta = k, [(np.empty(0, np.int64), np.empty(0, np.int64))] * n, theta

    def add(self, i: int, score: np.ndarray, ids: np.ndarray) -> None:
        keep = score >= self.theta[i]
        if not keep.any():
            return
        s, v = np.concatenate([self.found[i][0], score[keep]]), np.concatenate([self.found[i][1], ids[keep]])
        order = np.lexsort((v, -s))[: self.k]
        self.found[i] = s[order], v[order]
        if len(order) == self.k:
            self.theta[i] = max(self.theta[i], float(s[order[-1]]))


def _search(keys: np.ndarray, q: np.ndarray, theta: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> _Best:
    best = _Best(len(keys), k, theta)
    qn = np.sqrt((q.astype(np.float64) ** 2).sum(axis=1))
    unit_q = q / np.where(qn > 0, qn, 1)[:, None]
    focus = np.argsort(-np.abs(unit_q), axis=1)[:, :FOCUS]
    slack = 1e-9
    for rows, ids, p in blocks:
        pn = np.sqrt((p.astype(np.float64) ** 2).sum(axis=1))
        longest = pn.max()
        open_ = np.flatnonzero((qn * longest) * (1 + slack) + slack >= best.theta)
        if not len(open_):
            continue
        # shorter vectors have a larger unit coordinate for the same product, so the ranges below hold for all of the block
        unit_p = p / np.where(pn > 0, pn, 1)[:, None]
        ranked = np.argsort(unit_p, axis=0)
        values = np.take_along_axis(unit_p, ranked, axis=0)
        by_length = []
        for i in open_:
            local = best.theta[i] / max(qn[i] * longest, 1e-300)
            if not 0 < local <= 1:
                by_length.append(i)
                continue
            hit = None
            f = focus[i]
            spread = np.sqrt(np.maximum(0.0, (1 - unit_q[i, f] ** 2) * (1 - local**2)))
            low = np.where(-unit_q[i, f] >= local, -1.0, unit_q[i, f] * local - spread) - slack
            high = np.where(unit_q[i, f] >= local, 1.0, unit_q[i, f] * local + spread) + slack
            ends = [(np.searchsorted(values[:, c], lo, "left"), np.searchsorted(values[:, c], hi, "right")) for c, lo, hi in zip(f, low, high)]
            c = min(range(len(f)), key=lambda j: ends[j][1] - ends[j][0])
            if ends[c][1] - ends[c][0] > len(ids) // 4:
                by_length.append(i)
                continue
            hit = ranked[ends[c][0] : ends[c][1], f[c]]
            for j in range(len(f)):
                if j != c:
                    hit = hit[(unit_p[hit, f[j]] >= low[j]) & (unit_p[hit, f[j]] <= high[j])]
            hit = hit[rows[hit] != keys[i]]
            if len(hit):
                best.add(i, _products(q[i : i + 1], p[hit])[0], ids[hit])
        if by_length:
            need = np.array([best.theta[i] / max(qn[i], 1e-300) for i in by_length])
            upto = int(np.searchsorted(-pn, -(need.min() * (1 - slack) - slack), "right")) if np.isfinite(need).all() else len(ids)
            s = _products(q[by_length], p[:upto])
            for row, i in zip(s, by_length):
                ok = (row >= best.theta[i]) & (rows[:upto] != keys[i])
                best.add(i, row[ok], ids[:upto][ok])
    return best


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """Each query's ``k`` highest integer inner products among all other vectors: query_id, rank, vec_id, score.

    ``vectors`` has vec_id and embedding; other columns are ignored. ``queries`` is a condition on it. Ties go to the smaller
    vec_id. Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without a vec_id.
    Vectors are compared with those of their own dimension only. Every row is a vector of its own, also if ids repeat: a
    query row that repeats an id has ranks of its own, and candidates are all rows but itself. A table without usable rows
    gives no rows. Components and scores beyond 64 bits become the nearest number of 64 bits.
    """
    spark = vectors.sparkSession
    usable_rows = vectors.where(usable(F.col("embedding")) & F.col("vec_id").isNotNull())
    v = usable_rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), quantised(F.col("embedding"), scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("asks"))
    v = common.written(v, "vectors")  # from here on the keys stay as they are
    n, asked = v.agg(F.count("*"), F.count_if("asks")).first()
    if not n or not asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    n_blocks, n_tiles = math.ceil(n / BLOCK), math.ceil(asked / TILE)
    parts = max(1, math.ceil(n_blocks / LANE))
    lanes = _dealt(common.written(_blocks(v.select("row", "vec_id", "v"), BLOCK, parts), "lanes"), "lane", parts)
    tiles = _dealt(common.written(_blocks(v.where("asks").select("row", "vec_id", "v"), TILE // 4, n_tiles), "tiles"), "tile", n_tiles)

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], [], []]
        blocks = sorted(right.to_pylist(), key=lambda r: -r["longest"])
        for row in left.to_pylist():
            keys, qids, q = _load(row)
            theta = np.frombuffer(row["theta"], dtype=np.float64).copy() if row["theta"] is not None else np.full(len(qids), -np.inf)
            best = _search(keys, q, theta, [_load(b) for b in blocks if b["dim"] == row["dim"]], k)
            for r, i, (s, c) in zip(keys.tolist(), qids.tolist(), best.found):
                for column, values in zip(out, ([r] * len(s), [i] * len(s), c.tolist(), s.tolist())):
                    column += values
        return pa.table(dict(zip(("row", "query_id", "vec_id", "score"), map(lambda x: pa.array(x, pa.int64()), out))))

    def against(q: DataFrame, c: DataFrame, pairs: DataFrame) -> DataFrame:
        """The hits of the pairs (tile, lane)."""
        pairs = common.written(pairs, "met")
        q, c = q.join(pairs, "tile"), c.join(pairs.select("lane", F.col("tile").alias("with")), "lane").withColumnRenamed("with", "tile")
        return q.groupBy("tile", "lane").cogroup(c.groupBy("tile", "lane")).applyInArrow(run, _HIT_SCHEMA)

    # seeds: the k-th best product within the lane of the longest vectors is a lower bound everywhere
    of_tile = tiles.select("tile", "dim").distinct()
    of_lane = lanes.groupBy("lane", "dim").agg(F.max("longest").alias("longest"))
    leading = of_lane.groupBy("dim").agg(F.min("lane").alias("lane"))
    seed = against(tiles.withColumn("theta", F.lit(None).cast("binary")), lanes, of_tile.join(leading, "dim").select("tile", "lane").distinct())
    kth = seed.groupBy("row").agg(F.count("*").alias("c"), F.min("score").alias("kth")).where(F.col("c") >= k).select("row", "kth")
    flat = tiles.mapInArrow(_members, "tile int, block long, at int, row long, norm double").join(kth, "row", "left")
    theta = F.coalesce(F.col("kth").cast("double"), F.lit(float("-inf")))
    # the shortest vector that can still matter to any query of the block
    need = F.min(F.when(F.col("norm") > 0, theta / F.col("norm")).otherwise(F.lit(float("-inf")))).alias("need")
    bounds = flat.groupBy("tile", "block").agg(F.sort_array(F.collect_list(F.struct("at", theta.alias("t")))).alias("s"), need)
    bounds = common.written(bounds.mapInArrow(_thetas, "tile int, block long, theta binary, need double"), "bounds")
    wanted = tiles.select("tile", "block", "dim").join(bounds.select("tile", "block", "need"), ["tile", "block"]).groupBy("tile", "dim").agg(F.min("need").alias("need"))
    pairs = wanted.join(of_lane, "dim").where(F.col("longest") * (1 + 1e-9) + 1e-9 >= F.col("need")).select("tile", "lane").distinct()
    hits = against(tiles.join(bounds.drop("need"), ["tile", "block"]), lanes, pairs)
    by = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    return hits.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")


def _members(batches):
    for b in batches:
        for r in b.to_pylist():
            rows, _, v = _load(r)
            n, norm = len(rows), np.sqrt((v.astype(np.float64) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_pydict({"tile": pa.array([r["tile"]] * n, pa.int32()), "block": pa.array([r["block"]] * n, pa.int64()), "at": pa.array(np.arange(n), pa.int32()), "row": pa.array(rows), "norm": pa.array(norm)})


def _thetas(batches):
    for b in batches:
        rows = b.to_pylist()
        yield pa.RecordBatch.from_pydict({
            "tile": pa.array([r["tile"] for r in rows], pa.int32()),
            "block": pa.array([r["block"] for r in rows], pa.int64()),
            "theta": pa.array([np.array([x["t"] for x in r["s"]], dtype=np.float64).tobytes() for r in rows], pa.binary()),
            "need": pa.array([r["need"] for r in rows], pa.float64()),
        })
