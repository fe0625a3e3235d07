"""The folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder will do for one machine only, so a cluster is an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if sc.getCheckpointDir() is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            import tempfile

            sc.setCheckpointDir(tempfile.mkdtemp(prefix="graphloom-"))
        folder = sc.getCheckpointDir()
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


_made: dict[str, SparkSession] = {}


def delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder or file wherever Spark can reach it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _made.pop(path, None)


@atexit.register
def release() -> None:
    """Deletes what :func:`scratch` named and nobody deleted; runs by itself when Python ends."""
    while _made:
        path, spark = _made.popitem()
        try:
            delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; its owner clears the folder
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    path = f"{shared_folder(spark)}/graph-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``df`` as a Parquet table in the shared folder, and its path for :func:`delete`."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Buckets:
    """Tables in the shared folder, bucketed into as many buckets as a shuffle has partitions, so that joins on these columns move the other side only."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.made: dict[str, str] = {}

    def put(self, df: DataFrame, *columns: str) -> tuple[str, DataFrame]:
        """The table's name, for :meth:`drop`, and the table."""
        name, path = f"graph_{uuid.uuid4().hex}", scratch(self.spark, "bucketed")
        df.write.bucketBy(self.n, *columns).sortBy(*columns).option("path", path).saveAsTable(name)
        self.made[name] = path
        return name, self.spark.table(name)

    def drop(self, name: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.made.pop(name))

    def close(self) -> None:
        for name in list(self.made):
            self.drop(name)


def numbered(df: DataFrame, order: tuple[Column, ...], name: str) -> DataFrame:
    """``df`` with each row's place in ``order`` (from 1), which tells all rows apart.

    A range-partitioned sort is written once; a row's place in its partition is told by its id there, and the partitions before it
    by their sizes, so there is one shuffle and no task for all.
    """
    n = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts, _ = written(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("own_id", F.monotonically_increasing_id()), "numbered")
    part, within = F.shiftright("own_id", 33), F.col("own_id").bitwiseAND(F.lit(2**33 - 1))
    sizes = parts.groupBy(part.alias("own_part")).agg(F.count("*").alias("own_n"))
    # as many rows as there are partitions
    before = sizes.select("own_part", (F.sum("own_n").over(Window.orderBy("own_part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own_n")).alias("own_before"))
    placed = parts.withColumn("own_part", part).join(F.broadcast(before), "own_part").withColumn(name, F.col("own_before") + within + 1)
    return placed.drop("own_part", "own_before", "own_id")
