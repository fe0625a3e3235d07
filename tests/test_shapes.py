"""Shape scores against all pairs, one by one."""

import math
import time

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from graphloom.operators import shapes
from graphloom.sources.driver_tables import _shape_sim



def test_shape_scores_of_many_vectors_are_products_of_blocks(spark, tmp_path):
    """80 million pairs take seconds; pair by pair, as column expressions, they took minutes."""
    m = np.random.default_rng(4).standard_normal((40_000, 64)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": np.arange(len(m)), "embedding": pa.FixedSizeListArray.from_arrays(m.ravel(), 64).cast(pa.list_(pa.float32()))}), tmp_path / "embeddings.parquet")
    start = time.monotonic()
    got = _shape_sim(spark, str(tmp_path), sources=F.expr("src % 20 = 0")).groupBy("score").count().collect()
    assert time.monotonic() - start < 90
    u = m / np.linalg.norm(m.astype(np.float64), axis=1)[:, None]
    want = np.zeros(11, dtype=np.int64)
    for at in range(0, len(m), 2000):
        want += np.bincount(np.clip(np.floor(10 * (u[at : at + 2000 : 20] @ u.T) + 1e-9), 0, 10).astype(int).ravel(), minlength=11)
    assert {r["score"]: r["count"] for r in got} == {k: n - (2000 if k == 10 else 0) for k, n in enumerate(want.tolist()) if k >= 2 and n - (2000 if k == 10 else 0)}


@pytest.mark.parametrize("kind", ["float", "double"])
def test_shape_scores_are_exact_at_their_steps(spark, kind):
    """Cosines that single precision can't tell from a step, and vectors without a cosine."""
    near = [s / 10 + e for s in range(2, 10) for e in (-1e-7, -1e-9, 0.0, 1e-9)]
    rows = [(0, [1.0, 0.0])] + [(i, [c, math.sqrt(1 - c * c)]) for i, c in enumerate(near, 1)] + [(40, [3e30, 0.0]), (41, [4e-30, 3e-30]), (42, [1.0, 1.0, 1.0]), (43, [2.0, 2.0, 1.0]), (42, [0.0, 0.0, 5.0])]
    odd = [(50, None), (51, []), (52, [0.0, 0.0]), (53, [float("nan"), 1.0]), (54, [float("inf"), 1.0]), (55, [None, 1.0]), (None, [1.0, 0.0])]
    if kind == "double":
        rows += [(60, [3e140, 4e140]), (61, [1e-130, 0.0])]
    df = spark.createDataFrame(rows + odd, f"vec_id bigint, embedding array<{kind}>")
    own = [(i, [float(np.float32(x)) for x in v] if kind == "float" else v) for i, v in rows]
    dot = lambda a, b: sum((x * y for x, y in zip(a, b)), 0.0)
    score = lambda a, b: math.floor(10 * dot(a, b) / (math.sqrt(dot(a, a)) * math.sqrt(dot(b, b))) + 1e-9)
    want = sorted((i, j, score(a, b)) for i, a in own for j, b in own if i != j and len(a) == len(b) and score(a, b) >= 2)
    assert sorted(map(tuple, shapes.scores(df).collect())) == want and len(want) > 500
    assert sorted(map(tuple, shapes.scores(df, F.col("src") == 42, least=5).collect())) == [w for w in want if w[0] == 42 and w[2] >= 5]
