"""Phrase collocations by count tries.

A task reads texts into shards of bounded size and builds, for each language of a shard, a trie of its word runs up to a depth,
with a count at every node. A trie is cut by prefix range (ranges of a hash of the first two words, so that they are even
however often a word is used; the more text a language has, the more ranges) into blocks that are serialised in word order.
Blocks of a range are merged many ways at a time: runs that are sorted already are joined by a merge sort. While there are more
shards than one merge takes, a merge also cuts its result into finer ranges, so a block holds about as much at every level and
no task reads more than ``WAYS`` blocks, however hot a prefix is.

Parts of a phrase are at least as frequent as the phrase, so nodes below the least count are dropped after the last merge.
Left parts of a phrase are the nodes on the walk down to it. Right parts are found by suffix links: the link of a phrase is the
phrase without its first word, and the links of that give the shorter right parts.
"""

from __future__ import annotations

from collections import defaultdict
from functools import reduce
from itertools import count as counter

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

SHARD_WORDS = 2_000_000  #: words of a shard
RANGE_BYTES = 10 << 20  #: text of a language for each range
RUN_BYTES = 4 << 20  #: of text that is split at a time
WAYS = 256  #: blocks that one merge takes, and the most ranges that a merge or build cuts its trie into
BREAKS = ".,;:!?\n\x0b\x0c\r"  #: characters that end a piece (fixed values)

_fold = np.arange(256, dtype=np.uint8)
_fold[65:91] += 32
_fold[9] = 32
_fold[[ord(c) for c in BREAKS]] = 10
FOLD = _fold.tobytes()

_BLOCK_SCHEMA = "lang string, range long, shard long, payload binary"


def _planes(x: np.ndarray, dtype: str) -> bytes:
    """The numbers' first bytes, then their second ones, and so on: high ones are mostly zeros, which compress away."""
    return np.ascontiguousarray(x.astype(dtype).view(np.uint8).reshape(len(x), np.dtype(dtype).itemsize).T).tobytes()


def _from_planes(data: bytes, dtype: str) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


class Trie:
    """Levels of nodes in word order. ``keys[d]`` is (parent, word) of the nodes of depth d+1 as two arrays, ``counts[d]`` their counts.

    ``words`` are sorted, so numbers order nodes as words do. Nodes of depth 1 stand apart from deeper ones, which hang on pairs
    of words: level 1 has both words of a pair.
    """

    def __init__(self, words: list[bytes], keys: list[tuple[np.ndarray, np.ndarray]], counts: list[np.ndarray]):
        self.words, self.keys, self.counts = words, keys, counts

    @property
    def nodes(self) -> int:
        return sum(map(len, self.counts))

    @classmethod
    def of(cls, ids: np.ndarray, names: list[bytes], depth: int) -> Trie:
        """From word numbers in text order, 0 at each break; ``names[i]`` is the word of number i+1."""
        order = sorted(range(len(names)), key=names.__getitem__)
        place = np.empty(len(names) + 1, dtype=np.int64)
        place[0] = -1
        place[np.array(order, dtype=np.int64) + 1] = np.arange(len(names))
        at = place[ids]
        real = at >= 0
        keys, counts = [(np.full(len(names), -1), np.arange(len(names)))], [np.bincount(at[real], minlength=len(names))]
        run, node = real, at  # of each place: whether a run of this depth starts there, and its node
        for d in range(1, depth):
            run = run[:-1] & real[d:]
            start = np.flatnonzero(run)
            both = node[start] * len(names) + at[d:][start]
            unique, inverse, n = np.unique(both, return_inverse=True, return_counts=True)
            keys.append((unique // max(1, len(names)), unique % max(1, len(names))))
            counts.append(n)
            node = np.full(len(run), -1)
            node[start] = inverse
        return cls([names[i] for i in order], keys, counts)

    @classmethod
    def merged(cls, tries: list[Trie]) -> Trie:
        """The sum of tries. Their words and nodes are sorted runs, which a stable sort merges."""
        words = sorted({w for t in tries for w in t.words})
        number = {w: i for i, w in enumerate(words)}
        maps = [np.fromiter(map(number.__getitem__, t.words), np.int64, len(t.words)) for t in tries]
        keys, counts, parents = [], [], None
        for d in range(len(tries[0].keys)):
            both = []
            for i, t in enumerate(tries):
                parent, word = t.keys[d]
                up = np.full(len(word), 0) if d == 0 else maps[i][parent] if d == 1 else parents[i][parent]
                both.append(up * len(words) + maps[i][word])
            n = np.concatenate([t.counts[d] for t in tries])
            all_ = np.concatenate(both)
            order = np.argsort(all_, kind="stable")
            run = all_[order]
            first = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.empty(0, np.int64)
            unique = run[first]
            keys.append((unique // max(1, len(words)) if d else np.full(len(unique), -1), unique % max(1, len(words))))
            counts.append(np.add.reduceat(n[order], first) if len(first) else np.empty(0, np.int64))
            parents = [np.searchsorted(unique, x) for x in both]
        return cls(words, keys, counts)

    def cut(self, level: int, ways: int) -> list[Trie | None]:
        """Parts by the level's bits of the prefix hash: nodes of depth 1 by their word, deeper ones by the pair they hang on."""
        h = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, len(self.words))

        def slot(x: np.ndarray) -> np.ndarray:
            # bits of their own for each of the levels
            x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            return ((x >> np.uint64(48 - 12 * level)) % np.uint64(4096) % np.uint64(ways)).astype(np.int64)

        slots = [slot(h[self.keys[0][1]])]
        for d in range(1, len(self.keys)):
            parent, word = self.keys[d]
            slots.append(slot(h[parent] * np.uint64(3) + h[word]) if d == 1 else slots[-1][parent])
        out: list[Trie | None] = []
        for k in range(ways):
            mine = [np.flatnonzero(s == k) for s in slots]
            if not sum(map(len, mine)):
                out.append(None)
                continue
            used = np.unique(np.concatenate([self.keys[d][1][m] for d, m in enumerate(mine)] + [self.keys[1][0][mine[1]] if len(mine) > 1 else np.empty(0, np.int64)]))
            keys = []
            for d, m in enumerate(mine):
                parent, word = self.keys[d][0][m], np.searchsorted(used, self.keys[d][1][m])
                keys.append((parent if d == 0 else np.searchsorted(used, parent) if d == 1 else np.searchsorted(mine[d - 1], parent), word))
            out.append(Trie([self.words[i] for i in used.tolist()], keys, [self.counts[d][m] for d, m in enumerate(mine)]))
        return out

    def dump(self) -> bytes:
        """Words, then the nodes of each level in order: children of each parent, words and counts."""
        text = b"\n".join(self.words)
        head = [len(text), len(self.words), len(self.keys), *map(len, self.counts)]
        parts = [np.array(head, "<i8").tobytes(), text]
        for (parent, word), n in zip(self.keys, self.counts):
            # parents ascend, so their steps are small
            parts += [_planes(np.diff(parent, prepend=0), "<i4"), _planes(word, "<i4"), _planes(n, "<i8")]
        return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))

    @classmethod
    def load(cls, payload: bytes) -> Trie:
        data = zstandard.ZstdDecompressor().decompress(payload)
        size, n_words, depth = np.frombuffer(data, "<i8", 3).tolist()
        lengths = np.frombuffer(data, "<i8", depth, 24).tolist()
        at = 24 + 8 * depth
        words = data[at : at + size].split(b"\n") if n_words else []
        at += size
        keys, counts = [], []
        for n in lengths:
            step, word, c = (_from_planes(data[at + k * n : at + (k + np.dtype(t).itemsize) * n], t) for t, k in (("<i4", 0), ("<i4", 4), ("<i8", 8)))
            keys.append((np.cumsum(step, dtype=np.int64), word.astype(np.int64)))
            counts.append(c)
            at += 16 * n
        return cls(words, keys, counts)


def _blocks(trie: Trie, lang: str, range_: int, shard: int, level: int, ways: int) -> pa.RecordBatch:
    parts = trie.cut(level, ways) if ways > 1 else [trie]
    rows = [(lang, range_ * WAYS + k, shard, t.dump()) for k, t in enumerate(parts) if t is not None]
    return pa.RecordBatch.from_pylist([dict(zip(_ARROW.names, r)) for r in rows], schema=_ARROW)


_ARROW = pa.schema([("lang", pa.string()), ("range", pa.int64()), ("shard", pa.int64()), ("payload", pa.binary())])


def _build(depth: int):
    def run(batches):
        from pyspark import TaskContext

        task, seq = TaskContext.get().partitionId() << 24, counter()
        held: dict[str, list[np.ndarray]] = defaultdict(list)
        names: dict[str, defaultdict] = {}
        ways: dict[str, int] = {}
        n = 0

        def read(lang: str, texts: list[bytes]) -> int:
            if lang not in names:
                names[lang] = defaultdict(counter(1).__next__, {b"\n": 0})
            words = b"\n".join(texts).translate(FOLD).replace(b"\n", b" \n ").split(b" ")
            ids = np.fromiter(map(names[lang].__getitem__, filter(None, words)), np.int32)
            held[lang] += [ids, np.zeros(1, np.int32)]
            return len(ids)

        def flush():
            for lang in list(held):
                ids = np.concatenate(held.pop(lang))
                known = names.pop(lang)
                known.pop(b"\n")
                if ids.any():
                    yield _blocks(Trie.of(ids, list(known), depth), lang, 0, task + next(seq), 0, ways[lang])

        for b in batches:
            by: dict[str, list[bytes]] = defaultdict(list)
            ways.update(zip(b.column("lang").to_pylist(), b.column("ways").to_pylist()))
            for lang, t in zip(b.column("lang").to_pylist(), b.column("text").cast(pa.binary()).to_pylist()):
                by[lang].append(t)
            for lang, texts in by.items():
                for _, part in common.chunks(texts, RUN_BYTES):
                    n += read(lang, part)
                    if n >= SHARD_WORDS:
                        yield from flush()
                        n = 0
        yield from flush()

    return run


def _loaded(table: pa.Table) -> Trie:
    return Trie.merged([Trie.load(p) for p in table["payload"].to_pylist()])


def _merge(level: int):
    """Merges the blocks of a group and cuts the result anew."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lang, range_, shard = (k.as_py() for k in key)
        return pa.Table.from_batches([_blocks(_loaded(table), lang, range_, shard, level, WAYS)])

    return run


def _nodes(least: int):
    """Merges the last blocks of a range: its nodes of ``least`` and more, and the sum of its words as a node of depth 0."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        trie = _loaded(table)
        depths, phrases, paths = [0], [b""], [[int(trie.counts[0].sum())]]
        kept, spelt, walks = np.empty(0, np.int64), [], []
        for d, ((parent, word), n) in enumerate(zip(trie.keys, trie.counts)):
            keep = np.flatnonzero(n >= least)
            # the walk down: the parent of a kept node is kept too, being at least as frequent
            up = parent[keep].tolist() if d < 2 else np.searchsorted(kept, parent[keep]).tolist()
            last = [trie.words[w] for w in word[keep].tolist()]
            if d < 2:
                now = last if d == 0 else [trie.words[p] + b" " + w for p, w in zip(up, last)]
                ways = [[c] for c in n[keep].tolist()]
            else:
                now = [spelt[p] + b" " + w for p, w in zip(up, last)]
                ways = [[*walks[p], c] for p, c in zip(up, n[keep].tolist())]
            kept, spelt, walks = keep, now, ways
            depths += [d + 1] * len(now)
            phrases += now
            paths += ways
        return pa.table({"lang": pa.array([key[0].as_py()] * len(depths), pa.string()), "depth": pa.array(depths, pa.int32()), "phrase": pa.array(phrases, pa.binary()).cast(pa.string()), "path": pa.array(paths, pa.list_(pa.int64()))})

    return run


def frequent(docs: DataFrame, depth: int, least: int) -> DataFrame:
    """Word runs of up to ``depth`` words that occur ``least`` times or more: lang, depth, phrase, path.

    ``path`` has the counts on the walk down to a phrase, from its first two words (its own count for a single word). Rows of
    depth 0 sum up to the words of a language.
    """
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")).where("text <> ''")
    sizes = rows.groupBy("lang").agg(F.least(F.lit(WAYS), F.ceil(F.sum(F.octet_length("text")) / F.lit(RANGE_BYTES))).cast("int").alias("ways"))
    blocks = common.written(rows.join(common.written(sizes, "sizes"), "lang").select("lang", "ways", "text").mapInArrow(_build(depth), _BLOCK_SCHEMA), "tries")
    shards = blocks.groupBy("lang").agg(F.countDistinct("shard").alias("n")).agg(F.max("n")).first()[0] or 0
    level = 1
    while shards > WAYS:
        groups = -(-shards // WAYS)
        # numbers of shards are hashed at first only: later ones are dense
        dealt = blocks.withColumn("shard", F.pmod(F.xxhash64("shard") if level == 1 else F.col("shard"), F.lit(groups)))
        blocks = common.written(dealt.groupBy("lang", "range", "shard").applyInArrow(_merge(level), _BLOCK_SCHEMA), "tries")
        shards, level = groups, level + 1
    nodes = blocks.groupBy("lang", "range").applyInArrow(_nodes(least), "lang string, depth int, phrase string, path array<long>")
    return common.written(nodes, "nodes")


def candidates(nodes: DataFrame, depth: int) -> DataFrame:
    """lang, depth, phrase, path (counts of its first 1, 2, .. words) and links (of its last words, the longest first; itself included)."""
    single = nodes.where("depth = 1").select("lang", F.col("phrase").alias("first"), F.col("path")[0].alias("f1"))
    known = [nodes.where("depth = 1").select("lang", "depth", "phrase", "path", F.col("path").alias("links"))]
    for d in range(2, depth + 1):
        rest = known[-1].select("lang", F.col("phrase").alias("rest"), F.col("links").alias("rest_links"))
        at = nodes.where(F.col("depth") == d).withColumns({"first": F.substring_index("phrase", " ", 1), "rest": F.expr("substring(phrase, instr(phrase, ' ') + 1)")})
        joined = at.join(rest, ["lang", "rest"]).join(single, ["lang", "first"])
        own = F.element_at("path", -1)
        known.append(common.written(joined.select("lang", "depth", "phrase", F.concat(F.array("f1"), "path").alias("path"), F.concat(F.array(own), "rest_links").alias("links")), f"links{d}"))
    return reduce(DataFrame.unionAll, known[1:])


def collocations(docs: DataFrame, least: int = 10, words: int = 3, top: int = 2000, cover: int = 50, scale: int = 1_000_000) -> DataFrame:
    """The strongest phrases of two to ``words`` words of each language: lang, rank, phrase, a, l, r, n, score.

    Words are split at blanks and tabs within pieces, which end at punctuation and line ends; A-Z is lower-cased. ``a`` counts
    a phrase (``least`` at least), ``l`` and ``r`` the parts of its weakest cut (the first of equal ones), ``n`` all words of the
    language, and ``score`` is floor(scale * a * a / (l * r)), computed exactly. A phrase is left out if a longer candidate
    holds it and has at least ``cover`` percent of its count. The first ``top`` of each language come, by score, count and
    phrase. A null language is ``und``, a null text empty; documents that repeat count as often as they come. Other columns are
    ignored.
    """
    nodes = frequent(docs, words, least)
    totals = nodes.where("depth = 0").groupBy("lang").agg(F.sum(F.col("path")[0]).alias("words"))
    every = common.written(candidates(nodes, words).withColumn("a", F.element_at("path", -1)), "candidates")
    # what longer candidates hold: their runs of fewer words
    shorter = [
        every.where(F.col("depth") == m).select("lang", "a", F.split("phrase", " ").alias("w")).select("lang", F.col("a").alias("longer"), F.explode(F.array(*[F.array_join(F.slice("w", i + 1, k), " ") for i in range(m - k + 1)])).alias("phrase"))
        for m in range(3, words + 1)
        for k in range(2, m)
    ]
    kept = every
    if shorter:
        most = reduce(DataFrame.unionAll, shorter).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))
        covered = most.join(every.select("lang", "phrase", "a"), ["lang", "phrase"]).where(F.col("longer") * 100 >= F.col("a") * cover)
        kept = every.join(covered.select("lang", "phrase"), ["lang", "phrase"], "left_anti")
    # a * a <= l * r, so the quotient is at most the scale; a product of more than 38 digits is an error, never a wrong score
    cuts = F.transform(F.sequence(F.lit(1), F.col("depth") - 1), lambda k: F.struct(k.alias("k"), F.element_at("path", k).alias("l"), F.element_at("links", k + 1).alias("r")))
    scored = kept.select("lang", "phrase", "a", F.explode(cuts).alias("c")).select("lang", "phrase", "a", "c.k", "c.l", "c.r")
    scored = scored.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(16,0)) * CAST(a AS DECIMAL(16,0)) * CAST({scale} AS DECIMAL(10,0))) div (CAST(l AS DECIMAL(18,0)) * CAST(r AS DECIMAL(18,0)))"))
    worst = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    flat = worst.select("lang", "phrase", "a", F.col("c.l").alias("l"), F.col("c.r").alias("r"), F.col("c.score").alias("score"))
    by = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each slice first, so that no task ranks a whole language
    slices = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = flat.withColumn("slice", F.pmod(F.xxhash64("phrase"), F.lit(slices)))
    part = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "slice").orderBy(*by))).where(F.col("rank") <= top)
    best = part.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*by)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("words").alias("n"), "score")
