"""Edit-aware token counts: a segment tree of pre-tokens for each document.

The leaves of a document's tree are runs of pre-tokens with their widths (characters) and token counts; inner nodes hold
the sums of what is below. An edit finds its place by the sums of widths, cuts the text anew from the last boundary that
the pattern cannot see the edit from, goes on until a new boundary falls on an old one in the unchanged rest, counts only
the pre-tokens in between, and updates the sums on the paths above them. The pattern looks ahead two characters at most
and never back, which is what the boundary context rests on.
"""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bpe
from .pretok import CUT_AT_SPACES, ChunkedEncoder, cutter

RUN = 64  #: pre-tokens in a leaf of a new tree; a leaf that grows past FULL has its tree rebuilt
FULL = 512
LOOK_AHEAD = 2
CACHE = 500_000  #: distinct chunks, and pre-tokens, whose widths and counts a Python worker remembers

_SHAPE = struct.Struct("<ii")

STATE = "doc_id long, text string, runs binary, widths binary, counts binary, n_tokens long"
EDITS = "array<struct<offset:int,deleted:int,inserted:string>>"


class Counter:
    """Widths and token counts of pre-tokens by a rank file; the first ``CACHE`` of them are remembered."""

    def __init__(self, ranks_path: str, pattern: str):
        self.ranks, self.cut, self.made = bpe.load_ranks(ranks_path), cutter(pattern), {}
        self.words = ChunkedEncoder(pattern, self._shape, cache=CACHE)
        self.chunked = pattern in CUT_AT_SPACES

    def _shape(self, piece: str) -> bytes:
        """Width and token count as two numbers; few of them differ."""
        shape = len(piece), len(bpe.merge(piece.encode("utf-8"), self.ranks))
        return self.made.setdefault(shape, _SHAPE.pack(*shape))

    def _shapes(self, pieces: list[str]) -> bytes:
        return b"".join(map(self.words.word, pieces))

    def counts(self, pieces: list[str]) -> list[int]:
        return np.frombuffer(self._shapes(pieces), "<i4")[1::2].tolist()

    def whole(self, text: str) -> tuple[list[int], list[int]]:
        """Widths and token counts of a text's pre-tokens, in order."""
        shapes = np.frombuffer(self.words.encode(text) if self.chunked else self._shapes(self.cut.findall(text)), "<i4")
        return shapes[::2].tolist(), shapes[1::2].tolist()


class SegmentTree:
    """Pre-tokens of one text; ``n_tokens`` is the root's sum."""

    def __init__(self, text: str, counter: Counter, runs: list[tuple[list[int], list[int]]] | None = None):
        self.text, self.counter, self.recounted = text, counter, 0
        if runs is None:
            runs = self._runs(*counter.whole(text))
        self._build(runs)

    @staticmethod
    def _runs(widths: list[int], counts: list[int]) -> list[tuple[list[int], list[int]]]:
        return [(widths[i : i + RUN], counts[i : i + RUN]) for i in range(0, len(widths), RUN)] or [([], [])]

    def _build(self, runs: list[tuple[list[int], list[int]]]) -> None:
        self.runs = runs
        self.leaves = 1 << (len(runs) - 1).bit_length()
        pad = [0] * (self.leaves - len(runs))
        self.sums = []
        for k in (0, 1):
            level = [sum(r[k]) for r in runs] + pad
            levels = [level]
            while len(level) > 1:
                level = [a + b for a, b in zip(level[::2], level[1::2])]
                levels.append(level)
            self.sums.append([0, *(x for lv in reversed(levels) for x in lv)])

    @property
    def n_tokens(self) -> int:
        return self.sums[1][1]

    @property
    def n_pieces(self) -> int:
        return sum(len(w) for w, _ in self.runs)

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds a character (the last leaf beyond the end) and where it starts."""
        node, start, widths = 1, 0, self.sums[0]
        while node < self.leaves:
            node *= 2
            if at - start >= widths[node] and (node + 1 - self.leaves < len(self.runs) or node + 1 < self.leaves) and widths[node + 1]:
                start += widths[node]
                node += 1
        return node - self.leaves, start

    def _update(self, leaf: int) -> None:
        for k in (0, 1):
            sums, node = self.sums[k], leaf + self.leaves
            sums[node] = sum(self.runs[leaf][k])
            while node > 1:
                node //= 2
                sums[node] = sums[2 * node] + sums[2 * node + 1]

    def edit(self, offset: int, deleted: int, inserted: str) -> None:
        """Replace ``deleted`` characters at ``offset`` (both held to the text) by ``inserted``."""
        offset = min(max(offset, 0), len(self.text))
        deleted = min(max(deleted, 0), len(self.text) - offset)
        new = self.text[:offset] + inserted + self.text[offset + deleted :]
        shift = len(inserted) - deleted
        # the first pre-token that may see the edit
        leaf, start = self._find(max(0, offset - LOOK_AHEAD))
        i = 0
        if leaf and start + LOOK_AHEAD > offset:
            leaf -= 1
            start -= self.sums[0][leaf + self.leaves]
        for w in self.runs[leaf][0]:
            if start + w + LOOK_AHEAD > offset:
                break
            start, i = start + w, i + 1
        # cut anew until a boundary falls on an old one behind the edit
        last, j, old = leaf, i, start
        pieces, end = [], start
        matches = self.counter.cut.finditer(new, start)
        while True:
            while old < max(offset + deleted, end - shift) or (old == start and end > start and old + shift < end):
                while last < len(self.runs) and j >= len(self.runs[last][0]):
                    last, j = last + 1, 0
                if last >= len(self.runs):
                    break
                old, j = old + self.runs[last][0][j], j + 1
            if end >= offset + len(inserted) and old >= offset + deleted and old + shift == end:
                break
            m = next(matches, None)
            if m is None:
                break
            pieces.append(m.group())
            end = m.end()
        if end >= len(new):  # all that is left of the old text is replaced
            last, j = len(self.runs) - 1, len(self.runs[-1][0])
        self.text = new
        self.recounted += len(pieces)
        counts, widths = self.counter.counts(pieces), list(map(len, pieces))
        first = self.runs[leaf]
        if last == leaf:
            self.runs[leaf] = (first[0][:i] + widths + first[0][j:], first[1][:i] + counts + first[1][j:])
        else:
            self.runs[leaf] = (first[0][:i] + widths, first[1][:i] + counts)
            for k in range(leaf + 1, min(last, len(self.runs))):
                self.runs[k] = ([], [])
                self._update(k)
            if last < len(self.runs):
                self.runs[last] = (self.runs[last][0][j:], self.runs[last][1][j:])
                self._update(last)
        if len(self.runs[leaf][0]) > FULL:
            self._build(self._runs([w for r in self.runs for w in r[0]], [c for r in self.runs for c in r[1]]))
        else:
            self._update(leaf)

    def columns(self) -> tuple[str, bytes, bytes, bytes, int]:
        flat = lambda k: np.fromiter((x for r in self.runs for x in r[k]), dtype="<i4").tobytes()
        return self.text, np.array([len(r[0]) for r in self.runs], dtype="<i4").tobytes(), flat(0), flat(1), self.n_tokens

    @classmethod
    def load(cls, counter: Counter, text: str, runs: bytes, widths: bytes, counts: bytes) -> SegmentTree:
        w, c = np.frombuffer(widths, dtype="<i4").tolist(), np.frombuffer(counts, dtype="<i4").tolist()
        ends = np.cumsum(np.frombuffer(runs, dtype="<i4")).tolist()
        return cls(text, counter, [(w[a:z], c[a:z]) for a, z in zip([0, *ends], ends)])


def _counter(ranks_path: str, pattern: str) -> Counter:
    store = sys.__dict__.setdefault("_graphloom_counters", {})
    if (ranks_path, pattern) not in store:
        store.clear()
        store[ranks_path, pattern] = Counter(ranks_path, pattern)
    return store[ranks_path, pattern]


def _batches(rows: Iterable[tuple], schema: pa.Schema, size: int = 256):
    held = []
    for r in rows:
        held.append(r)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


_STATE = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("runs", pa.binary()), ("widths", pa.binary()), ("counts", pa.binary()), ("n_tokens", pa.int64())])


def _apply(tree: SegmentTree, edits: list[dict] | None) -> None:
    for e in edits or []:
        if e is not None:
            tree.edit(e["offset"] or 0, e["deleted"] or 0, e["inserted"] or "")


def build(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """The tree of every whole text (null: empty): doc_id, text, runs, widths, counts, n_tokens.

    Repeated rows and null ids each keep a tree of their own; an empty table gives none. Other columns are ignored.
    """

    def run(batches):
        counter = _counter(ranks_path, pattern)
        yield from _batches(((d, *SegmentTree(t or "", counter).columns()) for b in batches for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())), _STATE)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, STATE)


def edit(state: DataFrame, edits: Column, ranks_path: str, pattern: str) -> DataFrame:
    """Apply each row's own ``edits`` (``EDITS``, in order): the new state with n_tokens_before, recounted and n_pieces.

    Null edits, or none, leave a tree as it is; null parts of an edit count as 0 or the empty text; offsets and lengths are
    held to the text.
    """
    schema = pa.schema([*_STATE, ("n_tokens_before", pa.int64()), ("recounted", pa.int64()), ("n_pieces", pa.int64())])

    def run(batches):
        counter = _counter(ranks_path, pattern)

        def rows():
            for b in batches:
                for r in b.to_pylist():
                    tree = SegmentTree.load(counter, r["text"], r["runs"], r["widths"], r["counts"])
                    _apply(tree, r["edits"])
                    yield r["doc_id"], *tree.columns(), r["n_tokens"], tree.recounted, tree.n_pieces

        yield from _batches(rows(), schema)

    return state.select("doc_id", "text", "runs", "widths", "counts", "n_tokens", edits.cast(EDITS).alias("edits")).mapInArrow(run, STATE + ", n_tokens_before long, recounted long, n_pieces long")


def apply_log(state: DataFrame, log: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Apply a table of edits (doc_id, seq, offset, deleted, inserted) in order of ``seq``.

    Trees and edits are brought together and sorted by document, and a task streams through them with one document at a time,
    so a document may have any number of edits. Edits of unknown documents do nothing; ties of seq go by the other columns.
    Rows that share a doc_id are each edited; rows without one stay as they are.
    """
    n = F.lit(None)
    a = state.select("doc_id", F.lit(0).alias("kind"), n.cast("long").alias("seq"), n.cast("int").alias("offset"), n.cast("int").alias("deleted"), n.cast("string").alias("inserted"), "text", "runs", "widths", "counts", "n_tokens")
    e = log.select(F.col("doc_id").cast("long"), F.lit(1), F.col("seq").cast("long"), F.col("offset").cast("int"), F.col("deleted").cast("int"), "inserted", n.cast("string"), n.cast("binary"), n.cast("binary"), n.cast("binary"), n.cast("long"))
    schema = pa.schema([*_STATE, ("recounted", pa.int64())])

    def run(batches):
        counter = _counter(ranks_path, pattern)

        def rows():
            key, trees = None, []
            for b in batches:
                for r in b.to_pylist():
                    if r["kind"] == 0:
                        if key is None or r["doc_id"] != key:
                            yield from ((key, *t.columns(), t.recounted) for t in trees)
                            key, trees = r["doc_id"], []
                        trees.append(SegmentTree.load(counter, r["text"], r["runs"], r["widths"], r["counts"]))
                    elif key is not None and r["doc_id"] == key:
                        for t in trees:
                            t.edit(r["offset"] or 0, r["deleted"] or 0, r["inserted"] or "")
            yield from ((key, *t.columns(), t.recounted) for t in trees)

        yield from _batches(rows(), schema)

    # rows without an id wait for nothing, so they are spread
    return a.unionAll(e).repartition(F.coalesce("doc_id", F.xxhash64("text"))).sortWithinPartitions("doc_id", "kind", "seq", "offset", "deleted", "inserted").mapInArrow(run, STATE + ", recounted long")


def sample_edits(doc_id: Column, text: Column) -> Column:
    """Three edits that follow from a row: one at the start, one anywhere, one at the end."""
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    n = F.length(F.coalesce(text, F.lit("")))
    one = lambda at, deleted, inserted: F.struct(at.cast("int").alias("offset"), deleted.cast("int").alias("deleted"), inserted.alias("inserted"))
    words = F.array(*map(F.lit, ["", " ", "an edited phrase ", "\n\n", "x", "'s"]))
    return F.array(one(F.lit(0), h % 3, F.get(words, (h % 6).cast("int"))), one(h % (n + 1), h % 29, F.get(words, (F.shiftright(h, 3) % 6).cast("int"))), one(n, F.lit(0), F.lit(" end.")))


def edited_counts(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per row: doc_id, n_pieces, n_tokens_before, n_tokens and recounted, after :func:`sample_edits`.

    As :func:`edit` after :func:`build`, but no state is kept, so a tree is edited in the task that built it.
    """
    names = ["doc_id", "n_pieces", "n_tokens_before", "n_tokens", "recounted"]
    schema = pa.schema([(n, pa.int64()) for n in names])

    def run(batches):
        counter = _counter(ranks_path, pattern)

        def rows():
            for b in batches:
                for doc_id, text, edits in zip(*[c.to_pylist() for c in b.columns]):
                    tree = SegmentTree(text or "", counter)
                    before = tree.n_tokens
                    _apply(tree, edits)
                    yield doc_id, tree.n_pieces, before, tree.n_tokens, tree.recounted

        yield from _batches(rows(), schema)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.select("doc_id", "text", sample_edits(F.col("doc_id"), F.col("text")).cast(EDITS).alias("edits")).mapInArrow(run, ", ".join(f"{n} long" for n in names))
