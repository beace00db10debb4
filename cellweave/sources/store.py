"""Intermediate tables in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; a temporary one only in local mode where none is set (tests)."""
    held = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not held:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        import tempfile

        held = tempfile.mkdtemp(prefix="cellweave-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", held)
    return held


#: Whether Spark drops a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, compression: str | None = None) -> DataFrame:
    """df written as Parquet in the shared folder and read again: no lineage, no partitioning.

    The shuffle files of the write are dropped when it ends; nothing reads them again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/cellweave-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=compression)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _file_system(spark, path)
    return fs.exists(at)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none where it isn't there."""
    at, fs = _file_system(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(at)) if fs.exists(at) else []


def drop(spark: SparkSession, path: str) -> None:
    at, fs = _file_system(spark, path)
    fs.delete(at, True)


def read_text(spark: SparkSession, path: str) -> str:
    at, _ = _file_system(spark, path)
    return spark.read.text(str(at.toString()), wholetext=True).first()[0]


def write_once(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file that isn't there yet, whole or not at all: a hidden file is renamed, which fails where the name is taken."""
    jvm, (at, fs) = spark._jvm, _file_system(spark, path)
    fresh, _ = _file_system(spark, f"{path.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(fresh, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    rename = spark._sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    rename[0] = getattr(jvm.org.apache.hadoop.fs.Options.Rename, "NONE")
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(fresh, at, rename)
    except Exception:
        fs.delete(fresh, False)
        raise


def promote(spark: SparkSession, fresh: str, target: str) -> None:
    """Puts a finished folder in the place of another by renames: the old one is kept beside it until the new one stands, and comes back if that fails."""
    new, fs = _file_system(spark, fresh)
    old, _ = _file_system(spark, target)
    backup, _ = _file_system(spark, f"{target.rstrip('/')}.old-{uuid.uuid4().hex}")
    if not fs.exists(new):
        raise ValueError(f"there is no {fresh}")
    fs.mkdirs(old.getParent())
    kept = fs.exists(old)
    if kept and not fs.rename(old, backup):
        raise OSError(f"{target} can't be moved")
    if not fs.rename(new, old):
        if kept:
            fs.rename(backup, old)
        raise OSError(f"{fresh} can't be moved to {target}")
    if kept:
        fs.delete(backup, True)


def replace_table(df: DataFrame, target: str) -> None:
    """Writes df beside a table that it may be made of, and then takes the table's place."""
    fresh = f"{target.rstrip('/')}.new-{uuid.uuid4().hex}"
    df.write.parquet(fresh)
    promote(df.sparkSession, fresh, target)
