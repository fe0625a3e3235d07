"""Benchmark decontamination with a distributed positional inverted index, in DataFrame operations only.

The index holds one posting (term, document, position) for every occurrence of a benchmark term in the corpus, and for each
document a posting of the empty term at the position after its last word, which gives its length. A window of test words
is looked up from its rarest terms: their posting lists, each shifted by the term's offset in the window, are intersected,
and what is left is confirmed at the window's other offsets by the same kind of shifted lookup. Only rare terms' lists are
ever matched against windows, so frequent words cost nothing beyond their postings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from . import common

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  #: what stands between words; splitting is several times quicker than extracting
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BROADCAST_ROWS = 200_000  #: a side of short rows is broadcast up to this many rows, counted first; beyond it the join shuffles
FIRST = 3  #: rarest terms of a window whose lists are intersected before the rest is confirmed

_DOC = ["doc_id", "h"]


def words(text: Column) -> Column:
    """A-Z lower-cased, then runs of digits, letters and non-ASCII characters; none for null."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), lambda w: w != "")


def small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


class PositionalIndex:
    """Postings of a vocabulary's terms over a corpus.

    ``postings``: term_id, doc_id, h (64 bits of the text, so that documents that share an id stay apart), pos.
    ``lengths``: one row per input row with doc_id, h and n_words.
    """

    def __init__(self, docs: DataFrame, terms: DataFrame):
        """``terms``: term, distinct and not null. Rows of ``docs`` need doc_id and text; repeated rows are kept in ``lengths``."""
        self.terms = common.written(
            terms.where("term <> ''").distinct().select("term", F.xxhash64("term").alias("term_id")).union(docs.sparkSession.sql("SELECT '' AS term, 0L AS term_id")), "terms"
        )
        self.n_terms = self.terms.count()
        # the hash is a column before the words are unrolled; beside posexplode it would be computed for each word
        rows = docs.select("doc_id", common.text_key(F.col("text")).alias("h"), F.concat(words(F.col("text")), F.array(F.lit(""))).alias("w"))
        each = rows.select("doc_id", "h", F.posexplode("w").alias("pos", "term"))
        found = each.join(small(self.terms, self.n_terms), "term").select("term_id", "doc_id", "h", "pos")
        self.table = common.written(found, "postings")
        self.postings = self.table.where("term_id <> 0")
        self.lengths = self.table.where("term_id = 0").select("doc_id", "h", F.col("pos").cast("long").alias("n_words"))

    def phrases(self, windows: DataFrame) -> DataFrame:
        """Where whole windows occur: window_id, doc_id, h, start. ``windows``: window_id, terms (array of words, none null)."""
        spark = windows.sparkSession
        counts = self.postings.groupBy("term_id").agg(F.count("*").alias("cf"))
        slots = windows.select("window_id", F.posexplode("terms").alias("at", "term")).join(self.terms, "term").join(counts, "term_id", "left")
        slots = slots.withColumn("cf", F.coalesce("cf", F.lit(0)))
        # a window with a term that the corpus lacks occurs nowhere
        alive = slots.groupBy("window_id").agg(F.min("cf").alias("least"), F.count("*").alias("n")).join(windows.select("window_id", F.size("terms").alias("size")), "window_id")
        alive = alive.where("least > 0 AND n = size").select("window_id", "size")
        ranked = slots.join(alive, "window_id").withColumn("k", F.row_number().over(Window.partitionBy("window_id").orderBy("cf", "at")))
        slots = common.written(ranked.select("window_id", "at", "term_id", "size", "k", "cf"), "slots")
        n = slots.count()
        if not n:
            return spark.createDataFrame([], "window_id long, doc_id long, h long, start int")
        shifted = self.postings.join(small(slots.where(F.col("k") <= FIRST).select("window_id", "at", "k", "term_id", F.least("size", F.lit(FIRST)).alias("need")), n), "term_id")
        shifted = shifted.select("window_id", "need", "doc_id", "h", (F.col("pos") - F.col("at")).alias("start"), "k").where("start >= 0")
        # each list at most once: rows of a repeated document bring their postings again
        bits = shifted.groupBy("window_id", "need", "doc_id", "h", "start").agg(F.bit_or(F.expr("shiftleft(1L, k - 1)")).alias("b"))
        left = common.written(bits.where(F.bit_count("b") == F.col("need")).select("window_id", "doc_id", "h", "start"), "phrases")
        rest = slots.where(F.col("k") > FIRST)
        more = left.join(small(rest.select("window_id", "at", "term_id"), n), "window_id")
        expected = more.select("doc_id", "h", (F.col("start") + F.col("at")).alias("pos"), "term_id")
        held = left.select(*_DOC).distinct()
        held = common.written(held, "held")
        near = self.postings.join(small(held.select(F.col("doc_id").alias("d"), F.col("h").alias("g")), held.count()), common.same(F.col("doc_id"), F.col("d")) & (F.col("h") == F.col("g")), "left_semi")
        near = near.join(small(rest.select("term_id").distinct(), n), "term_id", "left_semi").select(*_DOC, "pos", "term_id")
        null_safe = lambda a, b: common.same(a["doc_id"], b["doc_id"]) & (a["h"] == b["h"]) & (a["pos"] == b["pos"]) & (a["term_id"] == b["term_id"])
        e, p = expected.distinct().alias("e"), near.alias("p")
        lacking = e.join(p, null_safe({c: F.col(f"e.{c}") for c in ("doc_id", "h", "pos", "term_id")}, {c: F.col(f"p.{c}") for c in ("doc_id", "h", "pos", "term_id")}), "left_anti")
        # a candidate with a term missing at any of its other offsets goes
        gone = more.withColumn("pos", F.col("start") + F.col("at")).alias("m").join(
            lacking.alias("x"), common.same(F.col("m.doc_id"), F.col("x.doc_id")) & (F.col("m.h") == F.col("x.h")) & (F.col("m.pos") == F.col("x.pos")) & (F.col("m.term_id") == F.col("x.term_id")), "left_semi"
        ).select("window_id", "doc_id", "h", "start").distinct()
        l, g = left.alias("l"), gone.alias("g")
        return l.join(g, (F.col("l.window_id") == F.col("g.window_id")) & common.same(F.col("l.doc_id"), F.col("g.doc_id")) & (F.col("l.h") == F.col("g.h")) & (F.col("l.start") == F.col("g.start")), "left_anti")

    def near(self, pairs: DataFrame, within: int) -> DataFrame:
        """Proximity: pair_id, doc_id, h, pos, other where the terms ``a`` and ``b`` of a pair stand at most ``within`` words apart.

        Postings are matched by document and position cell, so a frequent pair's lists are never multiplied out.
        """
        ids = self.terms.withColumnsRenamed({"term": "t", "term_id": "i"})
        p = pairs.join(ids.select(F.col("t").alias("a"), F.col("i").alias("ia")), "a").join(ids.select(F.col("t").alias("b"), F.col("i").alias("ib")), "b")
        cell = F.floor(F.col("pos") / F.lit(within))
        a = self.postings.join(p.select("pair_id", F.col("ia").alias("term_id"), "ib"), "term_id").select("pair_id", *_DOC, "pos", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
        b = self.postings.join(p.select("pair_id", F.col("ib").alias("term_id")), "term_id").select("pair_id", *_DOC, F.col("pos").alias("other"), cell.alias("cell"))
        a, b = a.alias("a"), b.alias("b")
        on = (F.col("a.pair_id") == F.col("b.pair_id")) & common.same(F.col("a.doc_id"), F.col("b.doc_id")) & (F.col("a.h") == F.col("b.h")) & (F.col("a.cell") == F.col("b.cell"))
        hit = a.join(b, on).where((F.abs(F.col("pos") - F.col("other")) <= within) & (F.col("pos") != F.col("other")))
        return hit.select("a.pair_id", "a.doc_id", "a.h", "pos", "other").distinct()


def item_windows(benchmark: DataFrame, n: int = 10) -> tuple[DataFrame, DataFrame]:
    """Distinct windows of ``n`` consecutive item words (an item of fewer, but not none, is one): windows(window_id, terms) and owners(window_id, item_id)."""
    w = benchmark.select("item_id", words(F.col("text")).alias("w")).where(F.size("w") > 0)
    each = w.select("item_id", "w", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - (n - 1)))).alias("i")).select("item_id", F.slice("w", F.col("i"), n).alias("terms"))
    each = common.written(each.select("item_id", "terms", F.xxhash64("terms").alias("window_id")).distinct(), "windows")
    return each.select("window_id", "terms").dropDuplicates(["window_id"]), each.select("window_id", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word is hit if it lies in any occurrence of an item window. ``n_items`` counts the distinct item ids with
    occurring windows and ``items_sha256`` is the hash of those ids as sorted strings, joined by commas. Null texts have no
    words. Items without an id mark words as hit but are not counted among the items. Every input row gives one row, also
    if rows or ids repeat or the id is null; an empty benchmark leaves every document clean. Other columns are ignored.
    """
    benchmark = benchmark.select("item_id", "text")
    windows, owners = item_windows(benchmark, n)
    terms = windows.select(F.explode("terms").alias("term")).distinct()
    index = PositionalIndex(docs.select("doc_id", "text"), terms)
    found = common.written(index.phrases(windows).join(windows.select("window_id", F.size("terms").alias("size")), "window_id"), "found")
    hit = found.select(*_DOC, F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("pos")).distinct().groupBy(*_DOC).agg(F.count("*").alias("n_hit"))
    items = found.select("window_id", *_DOC).distinct().join(owners, "window_id").where(F.col("item_id").isNotNull()).select(*_DOC, "item_id").distinct()
    items = items.groupBy(*_DOC).agg(F.count("*").alias("n_items"), F.array_join(F.sort_array(F.collect_list(F.col("item_id").cast("string"))), ",").alias("ids"))
    d, x = index.lengths.alias("d"), hit.alias("x")
    i = items.alias("i")
    on = lambda a, b: common.same(F.col(f"{a}.doc_id"), F.col(f"{b}.doc_id")) & (F.col(f"{a}.h") == F.col(f"{b}.h"))
    out = d.join(x, on("d", "x"), "left").join(i, on("d", "i"), "left")
    n_hit = F.coalesce(F.col("x.n_hit"), F.lit(0).cast("long"))
    return out.select(
        F.col("d.doc_id"), F.col("d.n_words"), n_hit.alias("n_hit"), F.coalesce(F.col("i.n_items"), F.lit(0).cast("long")).alias("n_items"),
        F.sha2(F.coalesce(F.col("i.ids"), F.lit("")), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, n: int = 10) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, that hold no window of the benchmark.

    Null and empty texts hold none. Rows that repeat stay or go together; so do rows without an id that have the same text.
    """
    windows, _ = item_windows(benchmark.select("item_id", "text"), n)
    index = PositionalIndex(docs.select("doc_id", "text"), windows.select(F.explode("terms").alias("term")).distinct())
    d, h = common.free_names(docs.columns, 2)
    hit = common.written(index.phrases(windows).select(F.col("doc_id").alias(d), F.col("h").alias(h)).distinct(), "contaminated")
    on = common.same(F.col("doc_id"), F.col(d)) & (common.text_key(F.col("text")) == F.col(h))
    return docs.join(small(hit, hit.count()), on, "left_anti")
