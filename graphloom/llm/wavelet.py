"""Token ids as wavelet matrices: one compressed file a shard that answers access, count and occurrence queries.

A shard holds the ids of consecutive documents. Its wavelet matrix has one bit-plane for each bit of an id, the highest
first; a plane lists that bit of all ids in the order that stable sorting by the planes before gives. Ranks of every
``STEP`` bits let a reader follow a position or an id through the planes without unpacking them.

File format: a Parquet data set, one row group entry for each shard, in files that follow each other in doc_id order.

=============  ======  ===================================================================================
part, shard    int     place of the shard: shards follow each other by (part, shard)
before         long    ids of the part's shards before this one
n, bits        int     ids in the shard and bit-planes
doc_ids        binary  little-endian int64; documents in order
nulls          binary  one byte a document: 1 where doc_id is null
ends           binary  little-endian int64; where each document's ids end within the shard
planes         binary  ``bits`` packed planes of ceil(n / 8) bytes, most significant bit first
ranks          binary  little-endian uint32; for each plane the set bits before every STEP-th position, then all
=============  ======  ===================================================================================
"""

from __future__ import annotations

import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .pretok import ChunkedEncoder

STEP = 512
SHARD_IDS = 1 << 20  #: a shard ends with the document that takes it to this many ids
PART_BYTES = 24 << 20  #: bytes of text in a partition, about, as long as that gives no more than
CACHE = 1_000_000  #: distinct chunks, and words, whose ids a Python worker remembers
MAX_PARTS = 20_000  #: parts; a part of any size is written shard by shard

SCHEMA = "part int, shard int, before long, n int, bits int, doc_ids binary, nulls binary, ends binary, planes binary, ranks binary"

_popcount = np.array([bin(i).count("1") for i in range(256)], dtype=np.uint32)


def build(ids: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """The packed planes and their ranks."""
    planes, ranks, seq = [], [], ids.astype(np.uint16 if bits <= 16 else np.uint32)
    for k in range(bits - 1, -1, -1):
        b = (seq & seq.dtype.type(1 << k)) != 0
        packed = np.packbits(b)
        planes.append(packed.tobytes())
        ones = np.add.reduceat(_popcount[packed], np.arange(0, len(packed), STEP // 8)) if len(packed) else np.zeros(0, np.uint32)
        ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4").tobytes())
        if k:
            seq = np.concatenate([seq[np.flatnonzero(~b)], seq[np.flatnonzero(b)]])  # far quicker than by the mask
    return b"".join(planes), b"".join(ranks)


class WaveletMatrix:
    """Reads one shard."""

    def __init__(self, n: int, bits: int, planes: bytes, ranks: bytes):
        self.n, self.bits = n, bits
        self.planes = np.frombuffer(planes, dtype=np.uint8).reshape(bits, -1)
        self.ranks = np.frombuffer(ranks, dtype="<u4").reshape(bits, -1)
        self.zeros = n - self.ranks[:, -1].astype(np.int64)

    def _rank1(self, plane: int, at: int) -> int:
        """Set bits before ``at``."""
        if at >= self.n:
            return self.n - int(self.zeros[plane])
        first = at // STEP
        row = self.planes[plane]
        whole = row[first * STEP // 8 : at // 8]
        tail = int(row[at // 8]) >> (8 - at % 8) if at % 8 else 0
        return int(self.ranks[plane, first]) + int(_popcount[whole].sum()) + tail.bit_count()

    def _bit(self, plane: int, at: int) -> int:
        return int(self.planes[plane, at // 8]) >> (7 - at % 8) & 1

    def _select(self, plane: int, bit: int, k: int) -> int:
        """Where the ``k``-th (from 0) bit of this value is."""
        before = self.ranks[plane, :-1].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * STEP - before
        first = int(np.searchsorted(before, k, "right")) - 1
        bits = np.unpackbits(self.planes[plane, first * STEP // 8 : (first + 1) * STEP // 8])[: self.n - first * STEP]
        return first * STEP + int(np.flatnonzero(bits == bit)[k - int(before[first])])

    def access(self, at: int) -> int:
        """The id at a position."""
        out = 0
        for p in range(self.bits):
            b, one = self._bit(p, at), self._rank1(p, at)
            out, at = out << 1 | b, int(self.zeros[p]) + one if b else at - one
        return out

    def _range(self, token: int, start: int, end: int) -> tuple[int, int]:
        if token >> self.bits:
            return 0, 0
        for p in range(self.bits):
            a, b = self._rank1(p, start), self._rank1(p, end)
            start, end = (int(self.zeros[p]) + a, int(self.zeros[p]) + b) if token >> (self.bits - 1 - p) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """How often an id occurs in a range of positions."""
        a, b = self._range(token, start, self.n if end is None else end)
        return b - a

    def occurrences(self, token: int, start: int = 0, end: int | None = None) -> list[int]:
        """The positions of an id in a range, ascending."""
        a, b = self._range(token, start, self.n if end is None else end)
        out = []
        for at in range(a, b):
            for p in range(self.bits - 1, -1, -1):
                bit = token >> (self.bits - 1 - p) & 1
                at = self._select(p, bit, at - int(self.zeros[p]) if bit else at)
            out.append(at)
        return sorted(out)

    def all(self) -> np.ndarray:
        """Every id in order: the planes' sorting, undone from the lowest plane up."""
        kind = np.uint16 if self.bits <= 16 else np.uint32
        seq = np.zeros(self.n, dtype=kind)
        for p in range(self.bits - 1, -1, -1):
            b = np.unpackbits(self.planes[p], count=self.n).view(np.bool_)
            out, z = np.empty_like(seq), int(self.zeros[p])
            out[np.flatnonzero(~b)] = seq[:z]
            out[np.flatnonzero(b)] = seq[z:] | kind(1 << (self.bits - 1 - p))
            seq = out
        return seq.astype("<u4")


def _byte_alphabet() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable Latin-1 ones for themselves, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Encoder:
    """Ids of whole texts with the tokenizers library, as little-endian bytes.

    Each distinct word goes to the library's model once. Texts with one of the vocabulary's special strings go to the
    library whole.
    """

    def __init__(self, path: str, pattern: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "false", "1"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        top = max(self.library.get_vocab(with_added_tokens=True).values())
        self.bits = max(1, top.bit_length())
        self.kind, self.code = (np.dtype("<u2"), "H") if self.bits <= 16 else (np.dtype("<u4"), "I")
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        model, code, alphabet = self.library.model, self.code, _byte_alphabet()
        space = alphabet[32]

        def fresh(word: str) -> bytes:
            if word.isascii() and word[1:].isalpha():
                mapped = space + word[1:] if word[0] == " " else word if word.isalpha() else word.translate(alphabet)
            else:
                mapped = word.encode("utf-8").decode("latin-1").translate(alphabet)
            return array(code, [t.id for t in model.tokenize(mapped)]).tobytes()

        self.words = ChunkedEncoder(pattern, fresh, cache=CACHE)

    def encode(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return array(self.code, self.library.encode(text, add_special_tokens=False).ids).tobytes()
        return self.words.encode(text)


def _encoder(path: str, pattern: str) -> Encoder:
    """One for each Python worker and file."""
    held = sys.__dict__.setdefault("_graphloom_encoders", {})
    if path not in held:
        held.clear()
        held[path] = Encoder(path, pattern)
    return held[path]


def write(docs: DataFrame, path: str, tokenizer: str, pattern: str, end_id: int) -> None:
    """Encode every text (null: empty), append ``end_id``, and write ids in ascending doc_id order, null ids first.

    Rows that share an id are ordered by their texts' hashes; each stays a document of its own. ``tokenizer`` is a vocabulary
    file that every executor has, ``pattern`` what cuts its words. A table without rows writes no shard.
    """

    def run(batches):
        from pyspark import TaskContext

        enc, part, shard, before = _encoder(tokenizer, pattern), TaskContext.get().partitionId(), 0, 0
        end = np.array([end_id], dtype=enc.kind).tobytes()
        ids, docs_, count = [], [], 0

        def flush():
            seq = np.frombuffer(b"".join(ids), dtype=enc.kind)
            bits = max(enc.bits, end_id.bit_length())
            planes, ranks = build(seq, bits)
            ends = np.cumsum([len(x) // enc.kind.itemsize for x in ids]).astype("<i8")
            numbers, nulls = np.array([d or 0 for d in docs_], dtype="<i8"), np.array([d is None for d in docs_], dtype=np.uint8)
            row = {"part": part, "shard": shard, "before": before, "n": len(seq), "bits": bits, "doc_ids": numbers.tobytes(), "nulls": nulls.tobytes(), "ends": ends.tobytes(), "planes": planes, "ranks": ranks}
            return pa.RecordBatch.from_pylist([row], schema=_ARROW)

        for b in batches:
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids.append(enc.encode(t or "") + end)
                docs_.append(d)
                count += len(ids[-1]) // enc.kind.itemsize
                if count >= SHARD_IDS:
                    yield flush()
                    ids, docs_, count, shard, before = [], [], 0, shard + 1, before + count
        if ids:
            yield flush()

    # the plan's own estimate, so that no pass is spent on it; text takes about twice its room in a file
    size = 2 * int(str(docs.select("doc_id", "text")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    parts = max(docs.sparkSession.sparkContext.defaultParallelism, min(MAX_PARTS, size // PART_BYTES + 1))
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("h", common.text_key(F.col("text")))
    ordered = rows.repartitionByRange(parts, F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h")
    ordered.select("doc_id", "text").mapInArrow(run, SCHEMA).write.option("compression", "zstd").parquet(path)


_ARROW = pa.schema([("part", pa.int32()), ("shard", pa.int32()), ("before", pa.int64()), ("n", pa.int32()), ("bits", pa.int32()), *[(c, pa.binary()) for c in ("doc_ids", "nulls", "ends", "planes", "ranks")]])


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a data set: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A shard knows the ids of its part before it; the parts' sizes, MAX_PARTS numbers at most, give the rest.
    """
    shards = read(spark, path)
    sums = sorted((r["part"], r["n"]) for r in shards.groupBy("part").agg(F.sum("n").alias("n")).collect())
    starts, total = [], 0
    for part, n in sums:
        starts.append((part, total))
        total += n
    starts = F.broadcast(spark.createDataFrame(starts, "part int, base long"))
    placed = shards.join(starts, "part").withColumn("first", F.col("base") + F.col("before"))

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                ids = WaveletMatrix(r["n"], r["bits"], r["planes"], r["ranks"]).all().tobytes()
                ends = np.frombuffer(r["ends"], dtype="<i8")
                begins = np.r_[0, ends[:-1]]
                crc = [zlib.crc32(ids[4 * a : 4 * z]) for a, z in zip(begins.tolist(), ends.tolist())]
                d = pa.array(np.frombuffer(r["doc_ids"], dtype="<i8"), mask=np.frombuffer(r["nulls"], dtype=np.uint8).astype(bool))
                yield pa.RecordBatch.from_arrays([d, pa.array(begins + r["first"]), pa.array(ends - begins), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return placed.select("n", "bits", "doc_ids", "nulls", "ends", "planes", "ranks", "first").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, tokens: list[int], positions: bool = False) -> DataFrame:
    """Per shard and id of ``tokens`` that occurs in it: part, shard, token, n and, if asked for, its positions."""

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                w = WaveletMatrix(r["n"], r["bits"], r["planes"], r["ranks"])
                found = [(t, n) for t in tokens if (n := w.count(t))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * len(found), pa.int32()), pa.array([r["shard"]] * len(found), pa.int32()), pa.array([t for t, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64()),
                     pa.array([w.occurrences(t) if positions else [] for t, _ in found], pa.list_(pa.int64()))],
                    names=["part", "shard", "token", "n", "positions"],
                )

    return read(spark, path).select("part", "shard", "n", "bits", "planes", "ranks").mapInArrow(run, "part int, shard int, token long, n long, positions array<long>")
