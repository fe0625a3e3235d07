"""Fill-in-middle by succinct rank and select.

A run of texts is one byte string with two packed bit vectors over it: one marks the last byte of each unit (a line with its
newline), one the first byte of each code point. Each has a directory of the bits set before every block, so ``rank`` reads one
directory entry and one block, and ``select`` searches the directory and then one block. The bits of a text count its units;
select on two ranks gives the bytes where it is cut; rank of the second vector at the cuts gives the code points of each part.

Cuts and forms come from a hash of ``seed:doc_id``, so they don't depend on how rows are dealt, and a task that is run again
gives the same rows. Nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK = 64  #: bytes of packed bits to a directory entry
RUN_BYTES = 4 << 20  #: of text that share a bit vector; a longer text has one of its own


@dataclass(frozen=True)
class Markers:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


class Bits:
    """A packed bit vector with a directory of bits set before each block."""

    def __init__(self, mask: np.ndarray):
        size = BLOCK * 8
        packed = np.packbits(mask, bitorder="little")
        self.words = np.zeros(-(-(len(packed) + 1) // BLOCK) * BLOCK, dtype=np.uint8)
        self.words[: len(packed)] = packed
        self.n, self.size = len(mask), size
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).reshape(-1, BLOCK).sum(axis=1, dtype=np.int64))])

    @property
    def total(self) -> int:
        return int(self.before[-1])

    def _within(self, block: np.ndarray) -> np.ndarray:
        """Bits set up to and with each byte of the blocks."""
        return np.cumsum(np.bitwise_count(self.words.reshape(-1, BLOCK)[block]), axis=1, dtype=np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Bits set before each place ``at`` (0 to n)."""
        block, byte, bit = at // self.size, at % self.size // 8, at % 8
        counts = np.concatenate([np.zeros((len(at), 1), np.int64), self._within(block)], axis=1)
        last = self.words[block * BLOCK + byte] & ((1 << bit) - 1).astype(np.uint8)
        return self.before[block] + counts[np.arange(len(at)), byte] + np.bitwise_count(last)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Places of the k-th set bits (k from 1)."""
        block = np.searchsorted(self.before, k, side="left") - 1
        left = k - self.before[block]
        counts = self._within(block)
        byte = (counts < left[:, None]).sum(axis=1)
        left = left - np.where(byte > 0, counts[np.arange(len(k)), np.maximum(byte - 1, 0)], 0)
        bits = np.unpackbits(self.words[block * BLOCK + byte][:, None], axis=1, bitorder="little")
        bit = (np.cumsum(bits, axis=1) < left[:, None]).sum(axis=1)
        return block * self.size + byte * 8 + bit


def cut(texts: list[bytes], h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each text: its units, the bytes where prefix and middle end (a row of two), and code points of these parts (a row of two)."""
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - np.array([len(t) for t in texts], dtype=np.int64)
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    last = data == 10
    last[ends[ends > starts] - 1] = True
    units, points = Bits(last), Bits((data & 0xC0) != 0x80)
    base = units.rank(starts)
    n = units.rank(ends) - base
    ranks = np.sort(np.stack([h1 % (n + 1), h2 % (n + 1)], axis=1), axis=1)
    cuts = np.repeat(starts[:, None], 2, axis=1)
    some = ranks > 0
    if some.any():
        cuts[some] = units.select((ranks + base[:, None])[some]) + 1
    at = points.rank(np.concatenate([starts, cuts[:, 0], cuts[:, 1]])).reshape(3, -1)
    return n, cuts - starts[:, None], np.stack([at[1] - at[0], at[2] - at[1]], axis=1)


_SCHEMA = "doc_id {id}, text string, n long, form string, prefix_chars long, middle_chars long, output string"


def _fill(markers: Markers):
    p, s, m = (x.encode() for x in (markers.prefix, markers.suffix, markers.middle))

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary()).to_pylist()
            forms = b.column("form").to_pylist()
            h1, h2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2"))
            for at, part in common.chunks(texts, RUN_BYTES):
                to = at + len(part)
                n, cuts, chars = cut(part, h1[at:to], h2[at:to])
                out = []
                for t, form, (i, j) in zip(part, forms[at:to], cuts.tolist()):
                    if form == "psm":
                        t = b"".join((p, t[:i], s, t[j:], m, t[i:j]))
                    elif form == "spm":
                        t = b"".join((s, t[j:], p, t[:i], m, t[i:j]))
                    out.append(t)
                form = b.column("form").slice(at, len(part))
                plain = np.array([f == "plain" for f in forms[at:to]])
                counts = [pa.array(chars[:, k], pa.int64(), mask=plain) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").slice(at, len(part)), b.column("text").slice(at, len(part)), pa.array(n, pa.int64()), form, *counts, pa.array(out, pa.binary()).cast(pa.string())],
                    names=["doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    return run


def fill_in_middle(docs: DataFrame, seed: str = "7", percent: int = 100, spm_percent: int = 50, markers: Markers = Markers()) -> DataFrame:
    """Each document with its middle moved to the end: doc_id, text, n (lines), form, prefix_chars, middle_chars, output.

    ``percent`` of the documents are cut, by a hash; of these ``spm_percent`` have form spm (suffix, prefix, middle), the others
    psm. The rest are plain, as are empty texts and texts that hold a marker; their counts of code points are null. A null text
    is an empty one. A null doc_id hashes as the empty text; rows that repeat an id are cut by the same numbers. Other columns
    are ignored, whatever their names.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = lambda k: F.conv(F.substring("own_digest", 1 + 8 * k, 8), 16, 10).cast("long")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("own_digest"))
    plain = (F.col("text") == "") | (group(2) % 100 >= percent)
    for marker in (markers.prefix, markers.suffix, markers.middle):
        plain = plain | F.contains("text", F.lit(marker))
    form = F.when(plain, "plain").when(group(3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("doc_id", "text", form.alias("form"), group(0).alias("h1"), group(1).alias("h2"))
    return rows.mapInArrow(_fill(markers), _SCHEMA.format(id=docs.schema["doc_id"].dataType.simpleString()))


def restored(output: Column, form: Column, markers: Markers = Markers()) -> Column:
    """The text of an output: markers stand in it once each, since texts that hold one stay plain."""
    p, s, m = markers.prefix, markers.suffix, markers.middle
    middle = F.substring_index(output, m, -1)
    head = F.substring_index(output, m, 1)
    psm = F.concat(F.substring_index(F.substring_index(head, s, 1), p, -1), middle, F.substring_index(head, s, -1))
    spm = F.concat(F.substring_index(head, p, -1), middle, F.substring_index(F.substring_index(head, p, 1), s, -1))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digests(filled: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256 and restored_sha256 of what :func:`fill_in_middle` returns."""
    back = restored(F.col("output"), F.col("form"))
    return filled.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"))
