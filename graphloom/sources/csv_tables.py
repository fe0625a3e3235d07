"""The nine CSV sources of a snapshot, and CSV and JSON sinks."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from graphloom.model import Graph

#: Columns of each source (fixed values of the file formats); all are read as text and decoded by :mod:`graphloom.operators.ingest`.
SCHEMAS = {
    "neurons": "root_id string, group string, nt_type string, nt_type_score string, da_avg string, ser_avg string, gaba_avg string, glut_avg string, ach_avg string, oct_avg string",
    "classification": "root_id string, flow string, super_class string, class string, sub_class string, hemilineage string, side string, nerve string",
    "cell_types": "root_id string, primary_type string, additional_types string",
    "cell_stats": "root_id string, length_nm string, area_nm string, size_nm string",
    "labels": "root_id string, label string, user_id string, position string, supervoxel_id string, label_id string, date_created string, user_name string, user_affiliation string",
    "connections": "pre_root_id string, post_root_id string, neuropil string, syn_count string, nt_type string",
    "connectivity_tags": "root_id string, connectivity_tag string",
    "coordinates": "root_id string, position string, supervoxel_id string",
    "nblast": "root_id string, scores string",
}
OPTIONAL = ("cell_stats", "nblast", "coordinates", "connectivity_tags")
EXPORT_LIMIT = 100_000


class TooLarge(ValueError):
    """A result with more rows than an export takes."""


def read_csv(spark: SparkSession, path: str, schema: str, rows: int | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV file or folder, plain or gzip, with a header. A gzip file is one task to read, so it is dealt out anew."""
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    if path.endswith(".gz"):
        df = df.repartition(spark.sparkContext.defaultParallelism)
    df = df.select(*columns) if columns else df
    return df.limit(rows) if rows is not None else df


def read_sources(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All sources of a folder; an optional one that is missing is empty, with its columns."""
    out = {}
    for name, schema in SCHEMAS.items():
        found = None
        for ending in (".csv", ".csv.gz"):
            try:
                found = read_csv(spark, f"{folder}/{name}{ending}", schema)
                found.schema  # noqa: B018 - the path is looked up here
                break
            except AnalysisException:
                found = None
        if found is None and name not in OPTIONAL:
            raise FileNotFoundError(f"{folder}/{name}.csv[.gz]")
        out[name] = found if found is not None else spark.createDataFrame([], schema)
    return out


#: Columns that :func:`read_with_facts` adds: a row that doesn't fit the columns as it stands, and its file's path and date.
FACTS = ("own_corrupt", "own_file", "own_modified")


def read_with_facts(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The sources as :func:`read_sources` has them, with ``FACTS``: a row with too many or too few cells is kept, and known."""
    out = {}
    for name, schema in SCHEMAS.items():
        found = None
        for ending in (".csv", ".csv.gz"):
            try:
                # with pruned columns the reader would not look at whole rows
                reader = spark.read.schema(f"{schema}, own_corrupt string").option("columnNameOfCorruptRecord", "own_corrupt").option("columnPruning", False)
                found = reader.option("header", True).option("quote", '"').option("escape", '"').csv(f"{folder}/{name}{ending}")
                found = found.withColumns({"own_file": F.col("_metadata.file_path"), "own_modified": F.col("_metadata.file_modification_time")})
                break
            except AnalysisException:
                found = None
        if found is None and name not in OPTIONAL:
            raise FileNotFoundError(f"{folder}/{name}.csv[.gz]")
        out[name] = found if found is not None else spark.createDataFrame([], f"{schema}, own_corrupt string, own_file string, own_modified timestamp")
    return out


def file_facts(sources: dict[str, DataFrame]) -> DataFrame:
    """The files of sources that were read with their facts: source, file, modified, rows."""
    each = [df.groupBy(F.lit(name).alias("source"), F.col("own_file").alias("file"), F.col("own_modified").alias("modified")).agg(F.count("*").alias("rows")) for name, df in sources.items()]
    return reduce(DataFrame.unionAll, each)


def write_csv(df: DataFrame, path: str, compress: bool = False) -> None:
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path, compression="gzip" if compress else "none")


SEARCH_COLUMNS = ("root_id", "name", "label", "nt_type", "flow", "super_class", "class", "sub_class", "cell_type", "hemilineage", "nerve", "side", "length_nm", "area_nm", "size_nm")


def as_text(name: str, kind: str):
    """A value as a cell: commas become semicolons, arrays are listed in brackets with quotes."""
    c = F.col(f"`{name}`")
    if kind.startswith("array"):
        c = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.concat(F.lit("'"), x.cast("string"), F.lit("'"))), ", "), F.lit("]"))
    return F.translate(F.coalesce(c.cast("string"), F.lit("")), ",", ";").alias(name)


def search_export(nodes: DataFrame) -> DataFrame:
    """The fifteen columns of a result's export."""
    kinds = dict(nodes.dtypes)
    return nodes.select(*[as_text(c, kinds[c]) for c in SEARCH_COLUMNS])


def id_list(ranked: DataFrame) -> DataFrame:
    """The ids of a result (root_id, rank) that is no larger than an export takes, comma-joined in order: one row."""
    return guarded(ranked).agg(F.expr("listagg(CAST(root_id AS STRING), ',') WITHIN GROUP (ORDER BY rank)").alias("ids"))


def guarded(df: DataFrame, limit: int = EXPORT_LIMIT) -> DataFrame:
    """``df``, unless it has more rows than an export takes; counts no further than needed."""
    if df.limit(limit + 1).count() > limit:
        raise TooLarge(f"more than {limit:,} rows; narrow the query.")
    return df


#: Columns of an exported edge table (fixed values).
EDGE_COLUMNS = ("From", "To", "Neuropil", "Synapses", "Neuro Transmitter")


def edge_export(edges: DataFrame) -> DataFrame:
    """Edges under the headings of their export, for :func:`write_csv`; of any number, in as many files as there are partitions."""
    return edges.select("pre_id", "post_id", "region", "weight", "edge_type").toDF(*EDGE_COLUMNS)


def edge_json_rows(edges: DataFrame) -> DataFrame:
    """One JSON object a row, for edges of any number: ``write.text`` makes files of JSON lines."""
    return edges.select(F.to_json(F.struct(F.col("pre_id").alias("from"), F.col("post_id").alias("to"), F.col("region").alias("neuropil"), F.col("weight").alias("synapses"), F.col("edge_type").alias("nt_type"))).alias("edge"))


def edges_as_json(g: Graph, edges: DataFrame, meta: dict | None = None) -> DataFrame:
    """One row: nodes and edges of a guarded edge table as JSON arrays, and ``meta`` if given; ids as text, empty attributes left out."""
    edges = guarded(edges)
    ends = edges.select(F.explode(F.array("pre_id", "post_id")).alias("root_id")).distinct()
    some = lambda c: F.when(F.col(f"`{c}`") != "", F.col(f"`{c}`")).alias(c)
    nodes = g.nodes.join(ends, "root_id", "left_semi").select(F.struct(F.col("root_id").cast("string").alias("root_id"), some("name"), some("nt_type"), some("class")).alias("n"))
    rows = edges.select(F.struct(F.col("pre_id").cast("string").alias("from"), F.col("post_id").cast("string").alias("to"), "region", "weight", "edge_type").alias("e"))
    both = [nodes.select(F.lit(1).alias("k"), "n", F.lit(None).alias("e")), rows.select(F.lit(1).alias("k"), F.lit(None).alias("n"), "e")]
    one = both[0].unionAll(both[1]).groupBy("k").agg(F.to_json(F.sort_array(F.collect_list("n"))).alias("nodes"), F.to_json(F.sort_array(F.collect_list("e"))).alias("edges")).drop("k")
    return one.withColumn("meta", F.lit(json.dumps(meta))) if meta else one
