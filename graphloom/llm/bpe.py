"""Byte-level BPE by ranks: encoding and decoding.

Words (pre-tokens) are encoded by Spark higher-order functions: a fold over the ids of a word's bytes that joins the
lowest-ranked neighbours again and again, with the ranks as a literal map of pairs of ids. It costs a word some tens of
microseconds, so equal words are folded together: the distinct words of the whole corpus are counted, and those used most,
``DICTIONARY`` at most, are folded once and sent to every executor. They are most of all words in use.

Documents are then cut into words. A word that is a piece of the vocabulary is that piece, and one of the dictionary is
looked up. The others are nearly all rare, so that sending each of them to one place and its ids back would cost more
than it saves; they get their ids where they stand, by the same merges in Python, or, with ``everywhere``, by the same fold:
then the other words of a document travel beside it as a column, which the fold turns into ids in the same task. Both
give the same ids; ``everywhere`` costs about twice the CPU time. Words of more than ``FOLD_BYTES`` bytes are always merged
with a heap in Python, as the fold's work grows with the square of a word's length. Decoding concatenates the pieces.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import pickle
import struct
import sys
import uuid
from array import array

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common
from .common import quoted
from .pretok import ChunkedEncoder, cutter

DICTIONARY = 200_000  #: words encoded ahead of the documents, at most
FOLD_BYTES = 512  #: of a word that is folded
WORDS_AT_ONCE = 512  #: words of the dictionary that are folded beside one copy of the constant, about
CHUNK_CHARS = 1 << 20  #: of documents whose words are folded beside one copy of the constant, about
CACHE = 150_000  #: chunks of text whose ids a Python worker remembers
BUCKETS = 1 << 16  #: a map is searched entry by entry, so the pairs are dealt to this many small ones
SPREAD = 8191
NONE = 1 << 40  #: above any rank
MARK = b"\xff\xff\xff\xff"  #: an id that stands before the number of a word still to be folded


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 piece and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def pair_map(ranks: dict[bytes, int]) -> list[dict[int, int]]:
    """What each pair of ids joins to, dealt to small maps: the constant that the fold looks pairs up in."""
    maps: list[dict[int, int]] = [{} for _ in range(BUCKETS)]
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            left, right = ranks.get(piece[:i]), ranks.get(piece[i:])
            if left is not None and right is not None:
                maps[(left * SPREAD + right) % BUCKETS][(left << 32) + right] = rank
    return maps


def _constant(spark, ranks: dict[bytes, int]) -> DataFrame:
    """One row with the rank map and the ids of the 256 bytes; it is sent once, and not written out in every plan that mentions it."""
    return spark.createDataFrame([(0, pair_map(ranks), [ranks[bytes([i])] for i in range(256)])], "const int, pairs array<map<bigint,bigint>>, bytes array<bigint>")


def fold_words(rows: DataFrame, words: str, constant: DataFrame, nested: bool = False) -> DataFrame:
    """``rows`` with the array column ``words`` of words, each an array of bytes (``nested``: arrays of words), replaced by ``folded``: their ids.

    A row brings many words, as the constant is beside it. It has the bytes of one vocabulary, so it is broadcast.
    """
    others = [c for c in rows.columns if c != words]
    both = rows.withColumn("const", F.lit(0)).join(F.broadcast(constant), "const")
    each = lambda some: F.transform(some, lambda w: fold_merges(w, F.col("pairs"), F.col("bytes")))
    return both.select(*others, (F.transform(words, each) if nested else each(F.col(words))).alias("folded"))


def bytes_of(word: Column) -> Column:
    """A word's UTF-8 bytes as numbers."""
    return F.transform(F.split(F.decode(F.encode(word, "utf-8"), "ISO-8859-1"), ""), lambda c: F.ascii(c).cast("smallint"))


def fold_merges(word: Column, pairs: Column, byte_ids: Column) -> Column:
    """The ids of one word by ranked merges folded over its bytes (of a word that is no piece as a whole)."""
    none = F.lit(NONE)

    def joined(left: Column, right: Column) -> Column:
        at = ((left * F.lit(SPREAD) + right) % F.lit(BUCKETS)).cast("int")
        return F.coalesce(F.try_element_at(F.get(pairs, at), left * F.lit(1 << 32) + right), none)

    ids = F.transform(word, lambda b: F.get(byte_ids, b))
    pairs_of = F.zip_with(ids, F.slice(ids, F.lit(2), F.size(word)), lambda a, b: joined(a, b))
    state = lambda ids, low, new, at: F.struct(ids.alias("ids"), low.alias("low"), new.cast("bigint").alias("new"), at.cast("int").alias("at"))
    start = state(ids, pairs_of, none, F.lit(0))

    def step(s: Column, _: Column) -> Column:
        # each merge takes two steps, since an expression that stands at several places is computed at each:
        # one finds the lowest pair and its place (at -1 there is none any more), one joins it
        ids, low, new, at = (s[c] for c in ("ids", "low", "new", "at"))
        least = F.array_min(low)
        found = state(ids, low, least, F.when(least < none, F.array_position(low, least)).otherwise(F.lit(-1)))
        before = F.when(at > 1, F.array(joined(F.get(ids, at - 2), new))).otherwise(F.array().cast("array<bigint>"))
        merged = state(
            F.concat(F.slice(ids, F.lit(1), at - 1), F.array(new), F.slice(ids, at + 2, F.size(ids))),
            F.concat(F.slice(low, F.lit(1), F.greatest(at - 2, F.lit(0))), before, F.array(joined(new, F.get(ids, at + 1))), F.slice(low, at + 2, F.size(low))),
            none, F.lit(0),
        )
        return F.when(at < 0, s).when(at == 0, found).otherwise(merged)

    steps = F.sequence(F.lit(1), 2 * F.greatest(F.size(word), F.lit(1)) - 1)
    return F.aggregate(steps, start, step, lambda s: F.transform(s["ids"], lambda i: i.cast("int")))


def word_uses(docs: DataFrame, pattern: str) -> DataFrame:
    """word, uses: the distinct words of all of ``docs``, counted over whole texts, of up to ``FOLD_BYTES`` bytes."""
    chunks = docs.select(F.explode(F.split("text", " ")).alias("c")).groupBy("c").agg(F.count("*").alias("n"))
    # white space as Unicode has it, as for the library
    words = chunks.select(F.explode(F.regexp_extract_all(F.concat(F.lit(" "), "c"), F.lit(f"((?U){pattern})"), F.lit(1))).alias("word"), "n")
    return words.where(F.octet_length("word") <= FOLD_BYTES).groupBy("word").agg(F.sum("n").alias("uses"))


def frequent_words(docs: DataFrame, pattern: str, n: int = DICTIONARY) -> DataFrame:
    """Words used most in all of ``docs``: of the uses that ``n`` words at most have or exceed. Words used once are left out."""
    words = common.written(word_uses(docs, pattern).where("uses > 1"), "uses")
    # counts in steps of an eighth or less, so that few rows come back
    step = F.floor(F.log2("uses") * 8)
    least, total = None, 0
    for r in words.groupBy(step.alias("step")).agg(F.count("*").alias("n"), F.min("uses").alias("least")).orderBy(F.desc("step")).collect():
        total += r["n"]
        if total > n:
            break
        least = r["least"]
    return words.where(F.col("uses") >= least if least is not None else F.lit(False))


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same fold in Python; long pieces keep their pairs in a heap."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= 64:
        parts, get, none = [piece[i : i + 1] for i in range(n)], ranks.get, 1 << 30
        pairs = [get(piece[i : i + 2], none) for i in range(n - 1)]
        # a join changes the pairs on either side of it only
        while pairs and (low := min(pairs)) != none:
            i = pairs.index(low)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i < len(pairs):
                pairs[i] = get(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = get(parts[i - 1] + parts[i], none)
        return [ranks[p] for p in parts]
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    after = lambda i: ends[i] if ends[i] < n else -1
    heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, j, end = heapq.heappop(heap)
        if not (alive[i] and ends[i] == j and alive[j] and ends[j] == end):
            continue
        alive[j], ends[i] = False, end
        if end < n:
            before[end] = i
        for a in (before[i], i):
            b = after(a) if a >= 0 else -1
            if a >= 0 and b >= 0 and (r := ranks.get(piece[a : ends[b]])) is not None:
                heapq.heappush(heap, (r, a, b, ends[b]))
    return [ranks[piece[i : ends[i]]] for i in range(n) if alive[i]]


class _Words(ChunkedEncoder):
    """Ids as little-endian uint32 of words. With ``mark``, words that are not known here are marked and collected instead of merged."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, dictionary: dict[str, bytes], mark: bool = False):
        ready, cut = dict(dictionary), cutter(pattern).findall
        for piece, rank in ranks.items():
            try:
                word = piece.decode("utf-8")
            except UnicodeDecodeError:
                continue  # part of a character: no word
            if cut(word) == [word]:
                ready[word] = struct.pack("<I", rank)
        super().__init__(pattern, self._fresh, ready, CACHE, MARK if mark else None)
        self.ranks, self.fresh_words = ranks, {}

    def _fresh(self, word: str) -> bytes:
        b = word.encode("utf-8")
        if self.mark is None or len(b) > FOLD_BYTES:
            return array("I", merge(b, self.ranks)).tobytes()
        return MARK + struct.pack("<I", self.fresh_words.setdefault(word, len(self.fresh_words)))

    def marked(self, text: str) -> tuple[bytes, list[str]]:
        """The ids of a text with marks, and the words that these stand for."""
        self.fresh_words = {}
        return self.encode(text), list(self.fresh_words)


def _filled(marked: bytes, folded: list[np.ndarray]) -> bytes:
    """``marked`` with the ids of its fresh words."""
    if not folded:
        return marked
    ids = np.frombuffer(marked, "<u4")
    at = np.flatnonzero(ids == 0xFFFFFFFF)
    out, begin = [], 0
    for i in at.tolist():
        out += [ids[begin:i], folded[ids[i + 1]]]
        begin = i + 2
    return np.concatenate([*out, ids[begin:]]).astype("<u4", copy=False).tobytes()


def _held(kind: str, key: object, make):
    """One object of a kind for each Python worker, made anew for another key."""
    store = sys.__dict__.setdefault("_graphloom_bpe", {})
    if store.get(kind, (None, None))[0] != key:
        store.pop(kind, None)  # the old one goes before the new one is made
        store[kind] = (key, make())
    return store[kind][1]


def _shared_dictionary(docs: DataFrame, constant: DataFrame, pattern: str, n: int) -> tuple[Broadcast, str]:
    """word -> ids as little-endian uint32, for the words used most in ``docs``."""
    spark = docs.sparkSession
    words = frequent_words(docs, pattern, n).select("word", F.pmod(F.xxhash64("word"), F.lit(max(1, n // WORDS_AT_ONCE))).alias("part"))
    folded = fold_words(words.groupBy("part").agg(F.collect_list("word").alias("w")).withColumn("words", F.transform("w", bytes_of)), "words", constant).select("w", "folded").toArrow()
    made = {}
    for batch in folded.to_batches():
        for ws, ids in zip(batch.column(0).to_pylist(), _lists(batch.column(1))):
            made.update((w, i.astype("<u4").tobytes()) for w, i in zip(ws, ids))
    # as bytes, so that a worker keeps no second copy
    return spark.sparkContext.broadcast(pickle.dumps(made)), uuid.uuid4().hex


def _joined(ids: bytes, pieces: dict[int, bytes]) -> bytes:
    return b"".join(map(pieces.__getitem__, memoryview(ids).cast("I")))


def _lists(column: pa.Array) -> list[list[np.ndarray]]:
    """Rows of an array<array<int>> column, each list of ids as an array."""
    inner = column.flatten()
    ids, ends = inner.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.r_[0, inner.value_lengths().to_numpy(zero_copy_only=False)]).tolist()
    out, at = [], 0
    for n in column.value_lengths().to_pylist():
        out.append([ids[ends[k] : ends[k + 1]] for k in range(at, at + n)])
        at += n
    return out


def _row(names: list[str], arrays: list[pa.Array]) -> pa.RecordBatch:
    """One row that holds each of ``arrays`` as a list."""
    return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a) for a in arrays], names=names)


def _byte_lists(words: list[list[str]]) -> pa.Array:
    """For each document the bytes of each of its words, as numbers."""
    encoded = [w.encode("utf-8") for some in words for w in some]
    ends = lambda sizes: pa.array(np.cumsum([0, *sizes]), pa.int32())
    each = pa.ListArray.from_arrays(ends(map(len, encoded)), pa.array(np.frombuffer(b"".join(encoded), np.uint8).astype(np.int16)))
    return pa.ListArray.from_arrays(ends(map(len, words)), each)


def _encoded(docs: DataFrame, keep: list[str], ranks_path: str, pattern: str, dictionary: int, everywhere: bool, finish, schema: str) -> DataFrame:
    """``finish(columns, ids)`` -> arrays by ``schema``, of the ``keep`` columns and the ids of each document's text."""
    spark = docs.sparkSession
    constant = _constant(spark, load_ranks(ranks_path))
    held, made = _shared_dictionary(docs, constant, pattern, dictionary)
    rows = docs.select(*[F.col(quoted(c)).alias(f"c{i}") for i, c in enumerate(keep)], F.col("text").alias("t"))
    own = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    schema = schema.replace("*", ", ".join(own))
    columns = rows.columns[:-1]
    out = [x.split()[0] for x in schema.split(", ")]
    words = lambda: _held("words", (ranks_path, made, everywhere), lambda: _Words(load_ranks(ranks_path), pattern, pickle.loads(held.value), everywhere))

    def merged(batches):
        w = words()
        for b in batches:
            ids = [w.encode(t or "") for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(finish(b.columns[:-1], ids), names=out)

    if not everywhere:
        return rows.mapInArrow(merged, schema)
    names = [*columns, "marked", "fresh"]

    def cut(batches):
        w = words()
        for b in batches:
            for at, part in common.chunks([t or "" for t in b.column(b.num_columns - 1).to_pylist()], CHUNK_CHARS):
                done = [w.marked(t) for t in part]
                yield _row(names, [*[c.slice(at, len(part)) for c in b.columns[:-1]], pa.array([m for m, _ in done], pa.binary()), _byte_lists([f for _, f in done])])

    def fill(batches):
        for b in batches:
            ids = list(map(_filled, b.column(b.num_columns - 2).to_pylist(), _lists(b.column(b.num_columns - 1))))
            yield pa.RecordBatch.from_arrays(finish(b.columns[:-2], ids), names=out)

    # a row has the documents of a chunk, as the constant is beside it; then they part
    lists = ", ".join([*[f"{f.name} array<{f.dataType.simpleString()}>" for f in rows.schema.fields[:-1]], "marked array<binary>, fresh array<array<array<smallint>>>"])
    folded = fold_words(rows.mapInArrow(cut, lists), "fresh", constant, nested=True)
    return folded.select(F.inline(F.arrays_zip(*[F.col(c) for c in [*names[:-1], "folded"]]))).mapInArrow(fill, schema)


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: list[str] | None = None, dictionary: int = DICTIONARY, everywhere: bool = False) -> DataFrame:
    """``keep`` columns (doc_id) of every row, and ``ids``: little-endian uint32 ids of its whole text (null: of an empty one).

    ``ranks_path`` is a file that every executor has. Rows may repeat, ids be null, and texts be of any length; no row gives
    no row. Other columns are ignored.
    """
    keep = keep or ["doc_id"]
    finish = lambda columns, ids: [*columns, pa.array(ids, pa.binary())]
    return _encoded(docs, keep, ranks_path, pattern, dictionary, everywhere, finish, "*, ids binary").toDF(*keep, "ids")


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``encoded`` with ``decoded``: the binary pieces of its ids, concatenated. Null ids give null; an unknown id is an error."""
    names, at = encoded.columns, encoded.columns.index("ids")
    rows = encoded.toDF(*[f"c{i}" for i in range(len(names))])  # by place, so that any name will do
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields], "decoded binary"])

    def run(batches):
        pieces = _held("pieces", ranks_path, lambda: {i: p for p, i in load_ranks(ranks_path).items()})
        for b in batches:
            out = [None if x is None else _joined(x, pieces) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.binary())], names=[*b.schema.names, "decoded"])

    return rows.mapInArrow(run, schema).toDF(*names, "decoded")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str, dictionary: int = DICTIONARY, everywhere: bool = False) -> DataFrame:
    """Per row: doc_id, n_tokens, ids_sha256 and decoded_sha256.

    The same steps as :func:`encode` and :func:`decode`, text by text, so that ids and bytes need not leave the task. A null
    text is an empty one, which has no token; rows may repeat, ids be null, and texts and words be of any length. Every row
    gives one row. Other columns are ignored, whatever their names.
    """

    def digests(columns, ids):
        pieces = _held("pieces", ranks_path, lambda: {i: p for p, i in load_ranks(ranks_path).items()})
        sha = pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string())
        back = pa.array([hashlib.sha256(_joined(x, pieces)).hexdigest() for x in ids], pa.string())
        return [*columns, pa.array([len(x) // 4 for x in ids], pa.int64()), sha, back]

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return _encoded(rows, ["doc_id"], ranks_path, pattern, dictionary, everywhere, digests, "*, n_tokens long, ids_sha256 string, decoded_sha256 string").toDF(*names)
