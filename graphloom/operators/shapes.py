"""Scores of vectors by their cosine, as products of blocks.

Vectors are dealt evenly and packed into blocks; blocks of targets meet blocks of sources in a Cartesian product, a task for
each two parts, so neither side is ever in one place. A block product in single precision tells the score of nearly all
pairs; where its error could change a score, the pair is computed in double precision, summed in the order of the components
as the SQL does. The functions that run in tasks need numpy and Arrow only, not this package.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 1 << 20  #: bytes of the components of a block
PART = 16 << 20  #: bytes of the components of a part, on average
CELLS = 1 << 20  #: pairs that are looked at in one step

_BLOCK_SCHEMA = "dim int, ids binary, vals binary"
_SCORE_SCHEMA = "src bigint, dst bigint, score int"


def _packer(kind: str, limit: int):
    """Packs rows of (id, v) into blocks of vectors of one dimension; a vector without a finite, positive length has no cosine and is left out."""

    def pack(batches):
        def block(ids, m):
            return pa.RecordBatch.from_arrays([pa.array([m.shape[1]], pa.int32()), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary())], names=["dim", "ids", "vals"])

        waiting = {}
        for b in batches:
            sizes = b.column(1).value_lengths().to_numpy()
            for d in np.unique(sizes).tolist():
                own = b.filter(pa.array(sizes == d))
                ids, m = own.column(0).to_numpy(), own.column(1).flatten().to_numpy().reshape(-1, d)
                with np.errstate(all="ignore"):
                    squares = (m.astype(np.float64) ** 2).sum(axis=1)
                fit = np.isfinite(squares) & (squares > 0)
                before = waiting.pop(d, (ids[:0], m[:0]))
                ids, m, step = np.concatenate([before[0], ids[fit]]), np.concatenate([before[1], m[fit]]), max(1, limit // (d * np.dtype(kind).itemsize))
                full = len(ids) // step * step
                for at in range(0, full, step):
                    yield block(ids[at : at + step], m[at : at + step])
                if full < len(ids):
                    waiting[d] = ids[full:], m[full:]
        for ids, m in waiting.values():
            yield block(ids, m)

    return pack


def _meeter(kind: str, least: int, cells: int):
    """Scores of all pairs of two blocks, for those of at least ``least``."""

    def dots(a, b):
        total = np.zeros(len(a))
        for x, y in zip(a.T, b.T):
            total += x.astype(np.float64) * y.astype(np.float64)
        return total

    def met(src, q, dst, v):
        qn, vn = np.sqrt(dots(q, q)), np.sqrt(dots(v, v))
        # twice what rounding to single precision can change of ten times a cosine; lengths near the ends of double precision tell nothing
        slack = 10 * (q.shape[1] + 8) * 2.0**-23 if min(qn.min(), vn.min()) > 1e-100 and max(qn.max(), vn.max()) < 1e100 else np.inf
        uq, uv = (q / qn[:, None]).astype(np.float32), (v / vn[:, None]).astype(np.float32).T
        step = max(1, cells // len(v))
        for at in range(0, len(q), step):
            s = (uq[at : at + step] @ uv).ravel()
            hit = np.flatnonzero(s >= (least - slack) / 10)
            i, j = np.divmod(hit, len(v))
            i += at
            tenths = 10 * s[hit].astype(np.float64) + 1e-9
            score = np.floor(tenths - slack)
            near = np.flatnonzero(score != np.floor(tenths + slack))
            a, b = i[near], j[near]
            score[near] = np.floor(10 * dots(q[a], v[b]) / (qn[a] * vn[b]) + 1e-9)
            a, b = src[i], dst[j]
            keep = (score >= least) & (score < np.inf) & (a != b)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep]), pa.array(score[keep].astype(np.int32))], names=["src", "dst", "score"])

    def meet(batches):
        for b in batches:
            for d, ids, vals, src_d, src_ids, src_vals in zip(*b.columns):
                if d == src_d:
                    dst, src = (np.frombuffer(x.as_buffer(), np.int64) for x in (ids, src_ids))
                    v, q = (np.frombuffer(x.as_buffer(), kind).reshape(-1, d.as_py()) for x in (vals, src_vals))
                    with np.errstate(all="ignore"):
                        yield from met(src, q, dst, v)

    return meet


def scores(vectors: DataFrame, sources: Column | None = None, least: int = 2) -> DataFrame:
    """src, dst and score of all pairs of different ids: floor(10 * cosine), for those of at least ``least``.

    ``vectors`` has vec_id and embedding; ``sources`` is a condition on ``src`` that sources meet, all rows if it isn't given.
    Vectors meet those of their own dimension only; vectors that are null, empty, zero or hold a null or non-finite component
    meet none. The number of parts follows from the sizes, which are asked for at once.
    """
    spark, single = vectors.sparkSession, dict(vectors.dtypes)["embedding"] == "array<float>"
    kind, width = ("<f4", 4) if single else ("<f8", 8)
    whole = F.coalesce((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull()), F.lit(False))
    v = vectors.select(F.col("vec_id").cast("bigint").alias("src"), F.col("embedding").cast("array<float>" if single else "array<double>").alias("v")).where(whole & F.col("src").isNotNull())
    asks = F.lit(True) if sources is None else sources
    sizes = v.agg(*[F.coalesce(F.sum(F.when(c, F.size("v"))), F.lit(0)) for c in (F.lit(True), asks)]).first()
    n, n_asked = (max(1, math.ceil(s * width / PART)) for s in sizes)
    n = max(n, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pack = _packer(kind, BLOCK)
    # sources are dealt again as blocks, or every part of the targets would pack them anew
    asked = v.where(asks).repartition(n_asked).mapInArrow(pack, _BLOCK_SCHEMA).repartition(n_asked).toDF("src_dim", "src_ids", "src_vals")
    others = v.repartition(n).mapInArrow(pack, _BLOCK_SCHEMA)
    return others.crossJoin(asked.hint("shuffle_replicate_nl")).mapInArrow(_meeter(kind, least, CELLS), _SCORE_SCHEMA)
