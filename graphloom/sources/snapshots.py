"""Versions of a graph as Parquet tables, committed by a manifest.

``{path}/data/{commit}/`` has the tables of one commit and is never written again. ``{path}/manifests/{version}.json`` names a
version's commit with each table's schema, row count and checksum; it is put in place by one rename, after all tables are
written and counted, so a version is there as a whole or not at all. Readers take the folder from the manifest once and stay
with it while newer commits of that version are made. A folder without a manifest is one that :func:`write` filled in place.

Edges are laid out twice, by start and by end, both sorted by that node, so that the edges at a node are read from a few row
groups of either.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.model import ATTRIBUTES, SPARK_TYPE, Graph
from graphloom.sources import text_index

EDGES = "pre_id bigint, post_id bigint, region string, weight bigint, edge_type string"
LOG = "label_id bigint, root_id bigint, label string, user_id bigint, user_name string, user_affiliation string, date_created string"
SHAPES = "src bigint, dst bigint, score int"
REGIONS = "region string, description string, hemisphere string, category string"
TYPES = "code string, name string"
ROW_GROUP = 4 << 20  #: bytes of a row group of edges


class UnknownSnapshot(KeyError):
    pass


class BrokenSnapshot(ValueError):
    """Tables that aren't what their manifest says."""


def write(g: Graph, path: str) -> None:
    """A single version in place, without a manifest. Edges are laid out by region, which queries filter on, and sorted by id within."""
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.sortWithinPartitions("pre_id").write.mode("overwrite").partitionBy("region").parquet(f"{path}/edges")
    g.pairs.write.mode("overwrite").parquet(f"{path}/pairs")
    if g.label_log is not None:
        g.label_log.write.mode("overwrite").parquet(f"{path}/label_log")
    if (shapes := g.shapes()) is not None:
        shapes.write.mode("overwrite").parquet(f"{path}/shape_sim")
    g.region_table.coalesce(1).write.mode("overwrite").parquet(f"{path}/regions")
    g.spark.createDataFrame(list(g.edge_types.items()), TYPES).coalesce(1).write.mode("overwrite").parquet(f"{path}/edge_types")


def _checked(nodes: DataFrame, path: str) -> DataFrame:
    have, want = dict(nodes.dtypes), {a.name: SPARK_TYPE[a.kind] for a in ATTRIBUTES}
    wrong = {n: (t, have.get(n)) for n, t in want.items() if have.get(n) != t}
    if wrong:
        raise ValueError(f"snapshot {path} has other columns than expected (wanted, found): {wrong}")
    return nodes


def read(spark: SparkSession, path: str) -> Graph:
    """A snapshot of :func:`write`; an error if the node table lacks an attribute or has one of another type."""
    nodes = _checked(spark.read.parquet(f"{path}/nodes"), path)
    g = Graph(nodes, spark.read.parquet(f"{path}/edges").select("pre_id", "post_id", "region", "weight", "edge_type"))
    g.__dict__["pairs"] = spark.read.parquet(f"{path}/pairs")
    g.regions = [r.asDict() for r in spark.read.schema(REGIONS).parquet(f"{path}/regions").collect()]
    g.edge_types = {r["code"]: r["name"] for r in spark.read.schema(TYPES).parquet(f"{path}/edge_types").collect()}
    for name in ("label_log", "shape_sim"):
        try:
            setattr(g, name, spark.read.parquet(f"{path}/{name}"))
        except Exception as e:  # noqa: BLE001
            if "PATH_NOT_FOUND" not in str(e):
                raise
    return g


# commits


@dataclass(frozen=True)
class Files:
    """The file system of a path, through Spark."""

    spark: SparkSession
    path: str

    def _at(self, name: str):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), at

    def put(self, name: str, text: str) -> None:
        """A whole file at once: written beside its place and renamed."""
        fs, at = self._at(f"{name}.{uuid.uuid4().hex}.part")
        out = fs.create(at, False)
        out.write(bytearray(text.encode()))
        out.close()
        # one rename that replaces: a reader finds the file of before or the new one
        jvm, gateway = self.spark.sparkContext._jvm, self.spark.sparkContext._gateway
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        how = gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(at, self._at(name)[1], how)

    def names(self, folder: str) -> list[str]:
        fs, at = self._at(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def text(self, name: str) -> str:
        return "".join(r[0] for r in self.spark.read.option("wholetext", True).text(f"{self.path}/{name}").collect())

    def delete(self, name: str) -> None:
        fs, at = self._at(name)
        fs.delete(at, True)


def checksum(df: DataFrame) -> dict:
    """Rows and an order-free checksum of a table: the sum of its rows' hashes, modulo 2**64, as text."""
    total = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)"))
    r = df.agg(F.count("*").alias("rows"), total.alias("sum")).first()
    return {"rows": r["rows"], "sum": str(int(r["sum"] or 0) % 2**64)}


def _tables(g: Graph) -> dict[str, DataFrame]:
    out = {"nodes": g.nodes, "edges": g.edges.select("pre_id", "post_id", "region", "weight", "edge_type"), "pairs": g.pairs}
    out |= {n: t for n, t in (("label_log", g.label_log), ("shape_sim", g.shapes())) if t is not None}
    return out | {"regions": g.region_table.coalesce(1), "edge_types": g.spark.createDataFrame(list(g.edge_types.items()), TYPES).coalesce(1)}


def _laid_out(spark: SparkSession, df: DataFrame, key: str, path: str) -> None:
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    df.repartitionByRange(n, key).sortWithinPartitions(key).write.option("parquet.block.size", ROW_GROUP).parquet(path)


def commit(g: Graph, path: str, version: str, with_text: bool = True, edge_layouts: tuple[str, ...] = ("pre_id", "post_id")) -> dict:
    """Writes a graph as ``version`` under ``path`` and returns its manifest. Readers see it once all of it is there."""
    spark, files = g.spark, Files(g.spark, path)
    folder = f"data/{version}-{uuid.uuid4().hex}"
    manifest: dict = {"version": version, "folder": folder, "tables": {}, "text_index": with_text}
    tables = _tables(g)
    for name, df in tables.items():
        if name in ("edges", "pairs"):
            for key in edge_layouts:
                _laid_out(spark, df, key, f"{path}/{folder}/{name}/by_{key}")
            at = f"{name}/by_{edge_layouts[0]}"
        else:
            at = name
            df.write.parquet(f"{path}/{folder}/{at}")
        back = spark.read.schema(df.schema).parquet(f"{path}/{folder}/{at}")
        manifest["tables"][name] = {"at": at, "schema": json.loads(df.schema.json()), **checksum(back)}
    manifest["edge_layouts"] = list(edge_layouts)
    if with_text:
        text_index.build(g, f"{path}/{folder}/text_index")
    files.put(f"manifests/{version}.json", json.dumps(manifest))
    return manifest


def versions(spark: SparkSession, path: str) -> list[str]:
    """The committed versions."""
    return [n.removesuffix(".json") for n in Files(spark, path).names("manifests") if n.endswith(".json")]


def checkout(spark: SparkSession, path: str, version: str, verify: bool = False) -> Graph:
    """The graph of a committed version, held to the commit that its manifest names now.

    Schemas come from the manifest, and files must have them. ``verify`` also counts and hashes all rows.
    """
    if version not in versions(spark, path):
        raise UnknownSnapshot(f"no snapshot {version!r}; there are {', '.join(versions(spark, path)) or 'none'}.")
    manifest = json.loads(Files(spark, path).text(f"manifests/{version}.json"))
    base = f"{path}/{manifest['folder']}"
    tables = {}
    for name, t in manifest["tables"].items():
        schema = StructType.fromJson(t["schema"])
        found = {c.lower(): k for c, k in spark.read.parquet(f"{base}/{t['at']}").dtypes}
        wrong = {c: (k, found.get(c.lower())) for c, k in ((f.name, f.dataType.simpleString()) for f in schema) if found.get(c.lower()) != k}
        if wrong:
            raise BrokenSnapshot(f"{name} of {version} has other columns than its manifest (wanted, found): {wrong}")
        tables[name] = spark.read.schema(schema).parquet(f"{base}/{t['at']}")
        if verify and (now := checksum(tables[name])) != {k: t[k] for k in now}:
            raise BrokenSnapshot(f"{name} of {version} has {now}, its manifest {t['rows']} rows of sum {t['sum']}")
    g = Graph(_checked(tables["nodes"], base), tables["edges"], tables.get("label_log"), tables.get("shape_sim"))
    g.__dict__["pairs"] = tables["pairs"]
    g.regions = [r.asDict() for r in tables["regions"].collect()]
    g.edge_types = {r["code"]: r["name"] for r in tables["edge_types"].collect()}
    if "post_id" in manifest["edge_layouts"]:
        by_end = {n: spark.read.schema(tables[n].schema).parquet(f"{base}/{n}/by_post_id") for n in ("edges", "pairs")}
        g.edges_by_post, g.pairs_by_post = by_end["edges"], by_end["pairs"]
    if manifest["text_index"]:
        g.text_index = text_index.TextIndex(spark, f"{base}/text_index")
    return g


def sweep(spark: SparkSession, path: str) -> list[str]:
    """Deletes the folders that no manifest names: of commits that were broken off or replaced. Returns their names.

    To be run while no commit is under way and no reader holds a replaced one.
    """
    files = Files(spark, path)
    named = {json.loads(files.text(f"manifests/{v}.json"))["folder"] for v in versions(spark, path)}
    lost = [n for n in files.names("data") if f"data/{n}" not in named]
    for n in lost:
        files.delete(f"data/{n}")
    return lost


class Catalogue:
    """Snapshots by version, read when first asked for. Folders with manifests are checked out, others read in place."""

    def __init__(self, spark: SparkSession, folders: dict[str, str], default: str | None = None):
        self.spark, self.folders, self.default, self._read = spark, folders, default or max(folders), {}

    @classmethod
    def of(cls, spark: SparkSession, path: str, default: str | None = None) -> Catalogue:
        """All committed versions under ``path``."""
        return cls(spark, {v: f"{path}#{v}" for v in versions(spark, path)}, default)

    def get(self, version: str | None = None) -> Graph:
        version = version or self.default
        if version not in self.folders:
            raise UnknownSnapshot(f"no snapshot {version!r}; there are {', '.join(sorted(self.folders))}.")
        if version not in self._read:
            path, mark, name = self.folders[version].rpartition("#")
            self._read[version] = checkout(self.spark, path, name) if mark else read(self.spark, self.folders[version])
        return self._read[version]

    def all(self) -> dict[str, Graph]:
        return {v: self.get(v) for v in self.folders}
