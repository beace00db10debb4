"""The catalog as a stream: pages arrive as files, each micro-batch is merged once.

State lives in versioned Parquet folders: a batch writes its whole new state under its
number and then one small marker, so that a batch that is repeated after a failure
writes the same again, and readers see complete states only.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.operators.catalog import OVERLAP, upserted

ITEMS = "id string, title string, updated long, size_bytes long, downloaded long, retry_after long, tag_checked long"
PAGES = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("updated", T.LongType()), T.StructField("size_bytes", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("cursor", T.StringType())])


class State:
    """Versions of a table and of a few values in a folder, read and written through Spark."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def version(self) -> int:
        """Number of the last whole version, -1 for none."""
        if not self.fs.exists(self._path("done")):
            return -1
        return max((int(s.getPath().getName()) for s in self.fs.listStatus(self._path("done"))), default=-1)

    def items(self, version: int | None = None) -> DataFrame:
        v = self.version() if version is None else version
        return self.spark.read.schema(ITEMS).parquet(f"{self.path}/items/{v}") if v >= 0 else self.spark.createDataFrame([], ITEMS)

    def values(self, version: int | None = None) -> dict:
        v = self.version() if version is None else version
        return json.loads(self.spark.read.text(f"{self.path}/values/{v}").first()[0]) if v >= 0 else {}

    def write(self, version: int, items: DataFrame, values: dict) -> None:
        items.write.mode("overwrite").parquet(f"{self.path}/items/{version}")
        self.spark.createDataFrame([(json.dumps(values, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.path}/values/{version}")
        self.fs.mkdirs(self._path("done"))
        self.fs.create(self._path(f"done/{version}"), True).close()


class RepeatedCursor(ValueError):
    """A page came with a cursor that was followed before."""


def merge_batch(state: State, batch: DataFrame, number: int, started: int) -> None:
    """One micro-batch: merged items and the cursor in one version.

    A cursor that comes again is refused before anything is written.  The time mark moves
    to the start of the pass only when the pass ends (a page without cursor).
    """
    last = state.version()
    if number <= last:
        return  # done before a restart
    values = state.values(last)
    cursors = [r["cursor"] for r in batch.select("cursor").distinct().collect()]  # one a page
    seen = set(values.get("seen", []))
    if again := seen.intersection(c for c in cursors if c):
        raise RepeatedCursor(sorted(again)[0])
    done = None in cursors
    values = {**values, "seen": [] if done else sorted(seen | {c for c in cursors if c}), "started": values.get("started") or started}
    if done:
        values = {**values, "mark": values["started"], "started": None}
    state.write(number, upserted(state.items(last), batch.drop("cursor")), values)


def cutoff(values: dict) -> int:
    """From where the next pass reads."""
    return max(0, values.get("mark", 0) - OVERLAP)


def run(spark: SparkSession, pages: str, state_path: str, checkpoint: str, started: int, page_files: int = 1):
    """Starts the stream over a folder of JSON pages; ends when all are merged."""
    state = State(spark, state_path)
    source = spark.readStream.schema(PAGES).option("maxFilesPerTrigger", page_files).json(pages)
    return source.writeStream.foreachBatch(lambda df, n: merge_batch(state, df, n, started)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "7 days", width: str = "1 hour") -> DataFrame:
    """Events by type and window; on a stream, later rows than the watermark are dropped."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "7 days") -> DataFrame:
    e = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
