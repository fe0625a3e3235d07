"""An inverted index of labels and attribute values, kept with a graph's tables.

Five Parquet tables, each partitioned by a hash of its key's first character and sorted by the key, so that a look-up reads one
partition and in it the row groups whose range holds the key:

* ``tokens``: token_lc, token, root_id of labels and their tokens;
* ``values``: value_lc, root_id of whole attribute values;
* ``grams``: the three characters at every place of every distinct label, with the label's number and the place;
* ``deletions``: what is left of the first characters of a word after taking away up to two, with the word;
* ``label_nodes`` and ``words``: the nodes of each label number, and the distinct words.

A part of a label is found by its grams at their distances, without reading any label. Two words within two edits share a
deletion of their first eight characters: what is left of either in a longest alignment is a common subsequence with at most two
characters missing of each. So the nearest word is exact if it is that near; beyond, all words are compared.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.model import Graph
from graphloom.operators import text as text_ops
from graphloom.storage import delete, written

HEADS = 64  #: partitions of a table
GRAM = 3  #: characters of a gram
PREFIX, EDITS = 8, 2  #: first characters of a word that deletions are taken of, and how many are taken
ROW_GROUP = 4 << 20  #: bytes of a row group, so that little more than the key's rows is read

#: How a gram or word may be compared: as it is and in lower case, or only one of these.
BOTH, LOWER, ORIGINAL = "both", "lower", "original"


def _head(key: Column) -> Column:
    """The partition of a key. Of a literal it is a literal too, so that it prunes."""
    return F.pmod(F.crc32(F.substring(F.lower(key), 1, 1).cast("binary")), F.lit(HEADS)).cast("int")


def _write(df: DataFrame, key: str, path: str, *more: str) -> None:
    """``more``: columns that part the rows of one key, so that a frequent key is several tasks' work."""
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = df.withColumn("head", _head(F.col(key))).repartitionByRange(n, "head", key, *more).sortWithinPartitions("head", key)
    rows.write.option("parquet.block.size", ROW_GROUP).partitionBy("head").parquet(path)


def _folds(df: DataFrame, column: str) -> DataFrame:
    """Each text as it is and in lower case, as one row where these are equal: text and fold."""
    lower, same = F.lower(column), F.lower(column) == F.col(column)
    forms = F.when(same, F.array(F.struct(F.col(column).alias("text"), F.lit(BOTH).alias("fold")))).otherwise(
        F.array(F.struct(F.col(column).alias("text"), F.lit(ORIGINAL).alias("fold")), F.struct(lower.alias("text"), F.lit(LOWER).alias("fold")))
    )
    return df.withColumn("form", F.explode(forms)).select(*[c for c in df.columns if c != column], "form.text", "form.fold")


def _deletions(word: Column) -> Column:
    """What is left of a word's first characters after taking away up to two."""
    start = F.substring(word, 1, PREFIX)
    without = lambda s, i: F.concat(s.substr(F.lit(1), i), s.substr(i + 2, F.length(s)))
    places = lambda s: F.when(F.length(s) > 0, F.sequence(F.lit(0), F.length(s) - 1)).otherwise(F.array().cast("array<int>"))
    once = F.transform(places(start), lambda i: without(start, i))
    twice = F.flatten(F.transform(once, lambda s: F.transform(places(s), lambda i: without(s, i))))
    return F.array_distinct(F.concat(F.array(start), once, twice))


def deletions_text(word: str) -> list[str]:
    start = word[:PREFIX]
    return sorted({"".join(c for i, c in enumerate(start) if i not in gone) for k in range(EDITS + 1) for gone in combinations(range(len(start)), min(k, len(start)))})


def build(g: Graph, path: str) -> None:
    """Writes the index of a graph's labels and values to a new folder."""
    spark = g.spark
    found = text_ops.token_table(Graph(g.nodes, g.edges))
    _write(found.select("token_lc", "token", "root_id"), "token_lc", f"{path}/tokens", "root_id")
    _write(text_ops.value_table(g), "value_lc", f"{path}/values", "root_id")
    # numbers of labels are kept by writing them once
    named, at = written(g.labels.select("label").distinct().select(F.monotonically_increasing_id().alias("label_id"), "label"), "labels")
    owners = g.labels.distinct().join(named, "label").select("label_id", "root_id")
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    owners.repartitionByRange(n, "label_id", "root_id").sortWithinPartitions("label_id").write.option("parquet.block.size", ROW_GROUP).parquet(f"{path}/label_nodes")
    padded = F.concat("text", F.lit("\0" * (GRAM - 1)))
    grams = _folds(named, "label").select("label_id", "fold", F.posexplode(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substr(padded, i, F.lit(GRAM)))).alias("pos", "gram"))
    _write(grams.select("gram", "label_id", "pos", "fold"), "gram", f"{path}/grams")
    words = _folds(spark.read.parquet(f"{path}/tokens").select("token").distinct(), "token").groupBy("text").agg(F.collect_set("fold").alias("folds"))
    # a word is in lower case in one label and the lower case of a word of another
    kind = F.when(F.array_contains("folds", BOTH) | (F.size("folds") > 1), BOTH).otherwise(F.col("folds")[0])
    words = words.select(F.col("text").alias("word"), kind.alias("fold"))
    _write(words, "word", f"{path}/words")
    _write(words.select(F.explode(_deletions(F.col("word"))).alias("deletion"), "word", "fold"), "deletion", f"{path}/deletions", "word")
    delete(spark, at)


class TextIndex:
    """An index that :func:`build` wrote."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}")

    def _at(self, name: str, key: str) -> DataFrame:
        """The partition of a table that holds ``key`` and all that begins with it."""
        t = self.table(name)
        return t.where(F.col("head") == _head(F.lit(key))) if key else t

    def tokens(self, term: str, case_sensitive: bool = False, prefix: bool = False) -> DataFrame:
        """root_id of the nodes with a token, or with one that begins so."""
        column = F.col("token" if case_sensitive else "token_lc")
        t = term if case_sensitive else term.lower()
        return self._at("tokens", t).where(column.startswith(t) if prefix else column == t).select("root_id")

    def values(self, term: str) -> DataFrame:
        return self._at("values", term.lower()).where(F.col("value_lc") == term.lower()).select("root_id")

    def labels_with(self, part: str, case_sensitive: bool = False) -> DataFrame:
        """label_id of the labels that hold ``part``: the grams that cover it, at their distances from one start."""
        t = part if case_sensitive else part.lower()
        folds = [BOTH, ORIGINAL if case_sensitive else LOWER]
        if len(t) <= GRAM:
            hit = self._at("grams", t).where(F.col("gram").startswith(t) & F.col("fold").isin(*folds))
            return hit.select("label_id").distinct()
        places = sorted({*range(0, len(t) - GRAM + 1, GRAM), len(t) - GRAM})
        by: dict[str, list[int]] = {}
        for p in places:
            by.setdefault(t[p : p + GRAM], []).append(p)
        heads = [_head(F.lit(x)) for x in by]
        rows = self.table("grams").where(F.col("head").isin(*heads) & F.col("gram").isin(*by) & F.col("fold").isin(*folds))
        offsets = F.create_map(*[x for gram, at in by.items() for x in (F.lit(gram), F.array(*map(F.lit, at)))])
        starts = rows.select("label_id", "pos", F.explode(offsets[F.col("gram")]).alias("off")).select("label_id", (F.col("pos") - F.col("off")).alias("start"))
        return starts.groupBy("label_id", "start").agg(F.count("*").alias("n")).where(F.col("n") == len(places)).select("label_id").distinct()

    def lookup(self, term: str, case_sensitive: bool = False, word_match: bool = False) -> DataFrame:
        """As :func:`graphloom.operators.text.lookup`: root_id and its best tier."""
        tier = lambda df, k: df.select("root_id", F.lit(k).alias("tier"))
        found = tier(self.tokens(term, case_sensitive), 1).unionAll(tier(self.values(term), 2))
        if not word_match:
            within = self.table("label_nodes").join(self.labels_with(term, case_sensitive), "label_id")
            found = found.unionAll(tier(self.tokens(term, case_sensitive, prefix=True), 3)).unionAll(tier(within, 4))
        return found.groupBy("root_id").agg(F.min("tier").alias("tier"))

    def nearest(self, term: str, case_sensitive: bool = False) -> DataFrame:
        """token and distance of the word nearest to a term that is no stop word; ties alphabetical."""
        t = term if case_sensitive else term.lower()
        folds = [BOTH, ORIGINAL if case_sensitive else LOWER]
        best = lambda words: words.where(F.col("fold").isin(*folds) & ~F.lower("word").isin(*text_ops.STOP_WORDS)).select(F.col("word").alias("token")).distinct().withColumn("distance", F.levenshtein("token", F.lit(t))).orderBy("distance", "token").limit(1)
        keys = deletions_text(t)
        near = best(self.table("deletions").where(F.col("head").isin(*[_head(F.lit(k)) for k in keys]) & F.col("deletion").isin(*keys)))
        first = near.first()
        if first is not None and first["distance"] <= EDITS:
            return self.spark.createDataFrame([tuple(first)], near.schema)
        return best(self.table("words"))
