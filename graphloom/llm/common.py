"""What the operators of this subpackage share: row keys, hold-out folds and shared storage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.storage import shared_folder

_made: dict[str, SparkSession] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application, as ``--py-files`` would, and set the session's batches to 1,000 rows."""
    sc = spark.sparkContext
    # texts are long, so a batch of Spark's usual 10,000 rows is too much for a worker; another setting of the user's stays
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    if sc.applicationId not in _shipped:
        package = Path(__file__).resolve().parent.parent
        base = Path(tempfile.mkdtemp(prefix="graphloom-py-")) / package.name
        sc.addPyFile(shutil.make_archive(str(base), "zip", package.parent, package.name))
        _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session; where it is unset, one of our own on a single machine, else an error."""
    return shared_folder(spark)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def release() -> None:
    """Delete the tables that :func:`written` made; runs by itself when Python ends."""
    while _made:
        path, spark = _made.popitem()
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session has ended; its owner clears the folder
            return


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, deleted by :func:`release`."""
    path = f"{shared_dir(spark)}/graphloom-{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage and outlives executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df_or_path: str, spark: SparkSession) -> None:
    """Delete one scratch table early, once nothing reads it any more."""
    if _made.pop(df_or_path, None) is not None:
        _delete(spark, df_or_path)


def fold(doc_id: Column, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def text_key(text: Column) -> Column:
    """64 bits of a text; beside doc_id it tells rows that share an id apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits of a row's id and text, as text: what repeats as a whole has one key, and nothing else."""
    return F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.when(text.isNull(), "-").otherwise(":"), F.coalesce(text, F.lit(""))).cast("binary"))


def free_names(columns: list[str], n: int) -> list[str]:
    """``n`` column names that are not among ``columns``, whatever their case."""
    taken, out, k = {c.lower() for c in columns}, [], 0
    while len(out) < n:
        if f"own_{k}" not in taken:
            out.append(f"own_{k}")
        k += 1
    return out


def same(a: Column, b: Column) -> Column:
    """Equality that holds for two nulls."""
    return a.eqNullSafe(b)


def quoted(column: str) -> str:
    """A column name as an expression, whatever is in it."""
    return f"`{column.replace('`', '``')}`"


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows, for actions inside: for steps whose single rows may be large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def chunks(texts: list, limit: int):
    """(place, texts) of runs of at most ``limit`` bytes; a longer text is a run of its own."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= limit):
            size += len(texts[end])
            end += 1
        yield at, texts[at:end]
        at = end
