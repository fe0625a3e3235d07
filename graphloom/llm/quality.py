"""Quality classifier by compression: how much smaller a text gets with a dictionary of good text than with one of bad text.

Two zstandard dictionaries are built from labelled text, one for each label, of equal size. A text is compressed with either,
and the difference of the two sizes over their sum says which kind of text it resembles. How well it compresses at all, and
how the dictionaries compare with none, are kept beside it, since a text that repeats itself needs neither dictionary. A
logistic calibration turns these into a score.

Only the dictionaries and the calibration are fitted, on a bounded sample of labelled rows (``FIT_ROWS`` for each label) that
follows from the ids' hashes, on whole texts. Every text is scored whole. The calibrated difference alone is a score of its own
beside it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from . import common
from .common import quoted

FIT_ROWS = 3000  #: labelled rows of each label that the classifier is fitted on, at most
PIECE_BYTES = 1024  #: of the pieces that a text is cut up into for its dictionary
DICT_BYTES = 110_000  #: of either dictionary
LEVEL = 3
PIECE = 1 << 14  #: long texts are compressed in pieces of this many bytes, so that a dictionary helps everywhere alike


def _size(c: zstandard.ZstdCompressor, text: bytes) -> int:
    return sum(len(c.compress(text[i : i + PIECE])) for i in range(0, len(text), PIECE))


class _Model:
    """Picklable: the dictionaries' bytes and the calibration's weights; compressors are made in each process."""

    def __init__(self, good: bytes, bad: bytes, weights: np.ndarray | None = None, plain: np.ndarray | None = None):
        self.good, self.bad, self.weights, self.plain = good, bad, weights, plain

    def compressors(self) -> list[zstandard.ZstdCompressor]:
        options = {"level": LEVEL, "write_checksum": False, "write_content_size": False, "write_dict_id": False}
        own = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_AUTO), **options) if d else zstandard.ZstdCompressor(**options) for d in (self.good, self.bad)]
        return [*own, zstandard.ZstdCompressor(**options)]

    def features(self, texts: list[bytes]) -> np.ndarray:
        cs = self.compressors()
        sizes = np.array([[_size(c, t) for c in cs] + [len(t)] for t in texts], dtype=np.float64).reshape(-1, 4)
        good, bad, none, raw = sizes.T
        pieces = np.ceil(raw / PIECE) * 6  # frame headers
        good, bad, none = (np.maximum(x - pieces, 1.0) for x in (good, bad, none))
        difference = (bad - good) / (bad + good)
        ratio = np.log((none + 8) / (raw + 8))
        long_ = np.log1p(raw)
        return np.stack([np.ones_like(raw), difference, difference * np.abs(difference), ratio, ratio**2, np.log((np.minimum(good, bad) + 8) / (none + 8)), long_ / 10, difference * long_ / 10, (long_ / 10) ** 2, ratio * long_ / 10], axis=1)

    def both(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The scores by all features, and by the difference alone."""
        x = self.features(texts)
        return tuple(1 / (1 + np.exp(-np.clip(x[:, : len(w)] @ w, -30, 30))) for w in (self.weights, self.plain))

    def score(self, texts: list[bytes]) -> np.ndarray:
        return self.both(texts)[0]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.02) -> np.ndarray:
    """Newton's method; both labels weigh as often as they occur."""
    w, scale = np.zeros(x.shape[1]), np.maximum(x.std(axis=0), 1e-9)
    scale[0] = 1
    z, penalty = x / scale, ridge * np.r_[0.0, np.ones(x.shape[1] - 1)]
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty + 1e-9), z.T @ (y - p) - penalty * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w / scale


def _pieces(text: bytes) -> list[bytes]:
    return [text[i : i + PIECE_BYTES] for i in range(0, len(text), PIECE_BYTES)]


def _dictionary(samples: list[bytes]) -> bytes:
    data = b"".join(samples)
    if len(samples) < 8 or len(data) <= DICT_BYTES:
        return data[-DICT_BYTES:]  # all of the text fits
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, len(data) // 3)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return data[-DICT_BYTES:]


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column) -> _Model:
    """A classifier from a bounded, repeatable sample of the labelled rows of ``docs`` for which ``may_learn`` holds.

    Half of the sample makes the dictionaries, the other half the calibration, so that the calibration sees texts that the
    dictionaries haven't. Without labelled rows of both kinds every score is the share of label 1 (0.5 without any).
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & may_learn).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").cast("int").alias("q"), F.min("quality").alias("p")).where("q = p")
    counts = {r["q"]: r["count"] for r in known.groupBy("q").count().collect()}
    order = [F.xxhash64(F.col("doc_id"), F.lit(7)), F.col("doc_id")]
    # the sample is drawn from the labels alone, so that at most 2 * FIT_ROWS ids meet the documents
    ids = [known.where(F.col("q") == q).orderBy(*order).limit(FIT_ROWS) for q in (0, 1)]
    rows = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", common.text_key(F.col("text")).alias("k")).join(F.broadcast(ids[0].union(ids[1]).select("doc_id", "q")), "doc_id")
    # an id may have many rows, so keys are cut to the bound before texts are fetched
    keys = common.written(rows.select("doc_id", "k").distinct().orderBy(*order, "k").limit(2 * FIT_ROWS), "sample-keys")
    sample = common.written(rows.join(F.broadcast(keys), ["doc_id", "k"]).dropDuplicates(["doc_id", "k"]).select("q", "doc_id", "k", F.encode("text", "utf-8").alias("t")), "sample")
    learns = F.pmod(F.xxhash64("doc_id", "k", F.lit(8)), F.lit(2))

    def cut(batches):
        for b in batches:
            some = [_pieces(t) for t in b.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(some, pa.list_(pa.binary()))], names=["q", "doc_id", "k", "pieces"])

    taught = sorted(sample.where(learns == 0).mapInArrow(cut, "q int, doc_id long, k long, pieces array<binary>").collect(), key=lambda r: (r["doc_id"], r["k"]))
    good, bad = ([bytes(p) for r in taught if r["q"] == q for p in r["pieces"]] for q in (1, 0))
    model = _Model(_dictionary(good), _dictionary(bad))

    def measure(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(list(model.features(b.column(3).to_pylist())), pa.list_(pa.float64()))], names=["q", "doc_id", "k", "x"])

    measured = sorted(sample.where(learns == 1).mapInArrow(measure, "q int, doc_id long, k long, x array<double>").collect(), key=lambda r: (r["doc_id"], r["k"]))
    y = np.array([r["q"] for r in measured], dtype=np.float64)
    if not (good and bad and 0 < y.sum() < len(y)):
        n = [sum(r["q"] == q for r in [*taught, *measured]) for q in (0, 1)]
        share = (n[1] + 1) / (sum(n) + 2)
        return _Model(b"", b"", np.r_[np.log(share / (1 - share)), np.zeros(9)], np.r_[np.log(share / (1 - share)), np.zeros(2)])
    # each class is sampled to its own bound, so the calibration is told how often they occur
    n0, n1 = counts[0], counts[1]
    x = np.array([r["x"] for r in measured])
    model.weights, model.plain = _logistic(x, y), _logistic(x[:, :3], y)
    for w in (model.weights, model.plain):
        w[0] += np.log(n1 / n0) - np.log(max(1, y.sum()) / max(1, (1 - y).sum()))
    return model


def kept(docs: DataFrame, model: _Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose chance of label 1 is ``least`` or more. Null texts count as empty."""
    (name,) = common.free_names(docs.columns, 1)
    out = scores(docs, model, docs.columns, name)
    return out.where(F.col(name) >= least).drop(name)


def scores(docs: DataFrame, model: _Model, keep: list[str], name: str = "score", plain: str | None = None) -> DataFrame:
    """``keep`` columns of every row and ``name`` (double): the chance of label 1; ``plain``: a column for that by the difference alone. Null texts count as empty."""
    # by place, so that any name will do
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))
    schema = StructType([*rows.schema.fields[:-1], StructField("s", DoubleType()), StructField("d", DoubleType())])

    def run(batches):
        for b in batches:
            texts = [(t or "").encode("utf-8") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *map(pa.array, model.both(texts))], names=schema.names)

    out = rows.mapInArrow(run, schema)
    return out.toDF(*keep, name, plain) if plain else out.drop("d").toDF(*keep, name)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per row: doc_id, held_out, score, predicted, difference_score (by the difference of the dictionaries alone).

    Labels are learnt only from rows whose crc32(doc_id as text) mod 3 is not 1. Only the text goes into a score. Null and
    empty texts get the score of an empty text; repeated rows get the same score; ids with contradictory labels, rows with a
    null id and other labels than 0 and 1 teach nothing; an empty table gives no rows. Other columns are ignored.
    """
    held = common.fold(F.col("doc_id"), 3) == 1
    model = fit(docs.select("doc_id", "text"), labels.select("doc_id", "quality"), ~held)
    out = scores(docs.select("doc_id", "text"), model, ["doc_id"], plain="difference_score")
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference_score")
