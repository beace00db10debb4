"""Installed items: folders named by id, and where they lie."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.text import digits_only


def installed(spark: SparkSession, root: str) -> DataFrame:
    """(id, mtime) of the folders below root that are named by an id and no links, listed through Spark's file systems."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    rows = [(s.getPath().getName(), s.getModificationTime() // 1000) for s in fs.listStatus(path) if s.isDirectory() and not s.isSymlink()]
    return spark.createDataFrame(rows, "id string, mtime long").filter(digits_only(F.col("id")))


def common_ancestor(files: DataFrame, path: str = "path", item: str = "item_id") -> DataFrame:
    """(ancestor, files): the folder above its item's folder that most files have, ties by name."""
    at = F.expr(f"instr({path}, concat('/', {item}, '/'))")
    a = files.withColumn("ancestor", F.when(at > 0, F.expr(f"substring({path}, 1, instr({path}, concat('/', {item}, '/')) - 1)"))).filter("ancestor IS NOT NULL")
    return a.groupBy("ancestor").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "ancestor").limit(1)
