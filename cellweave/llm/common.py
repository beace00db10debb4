"""Helpers shared by the corpus operators.

Text columns are read whole; a null text counts as empty.  Arrow batches are cut
by bytes, so one batch of very long texts never sits in a Python worker at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.sources.store import checkpoint_dir, stored

__all__ = ["checkpoint_dir", "chunked", "components", "cut", "documents", "map_groups", "map_texts", "meet", "packed", "pieces", "placed_labels", "slices", "stored", "text_of"]

#: Bytes of text that one step of a Python operator holds at a time (a single longer text is one step).
SLICE_BYTES = 4 << 20


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch so that each part has about `limit` bytes of text."""
    sizes = pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(np.nan_to_num(sizes).tolist()):
        if held and held + n > limit:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if len(sizes) > start:
        yield batch.slice(start)


def map_texts(df: DataFrame, fn: Callable[[list[str]], dict[str, pa.Array]], fields: str, text: str = "__text") -> DataFrame:
    """Adds the columns that fn makes from each slice of texts and drops the text.

    df holds a string column named by `text`; its other columns pass through, but one
    that has the name of a new column (in any case) is replaced by it.
    fn must be picklable and gives one pa.Array for each name of the schema `fields`.
    """
    new = T.StructType.fromDDL(fields)
    taken = {n.lower() for n in new.names} | {text.lower()}
    keep = [c for c in df.columns if c.lower() not in taken]
    schema = T.StructType([*(df.schema[c] for c in keep), *new.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                made = fn(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in keep] + [made[n] for n in new.names], names=schema.names)

    return df.select(*[F.col(f"`{c}`") for c in [*keep, text]]).mapInArrow(run, schema)


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """df as one column, the struct __row of all its columns, and further ones: no name of df's can clash with an operator's."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"), *[c.alias(name) for name, c in more.items()])


def placed_labels(spark: SparkSession, n: int) -> list[int]:
    """n whole numbers, the i-th of which hash partitioning over n partitions sends to partition i."""
    found: dict[int, int] = {}
    at, step = 0, 16 * n + 64
    while len(found) < n:
        got = spark.range(at, at + step, 1, 1).select(F.col("id").cast("int").alias("x")).groupBy(F.pmod(F.hash("x"), F.lit(n)).alias("p")).agg(F.min("x").alias("x")).collect()
        for r in got:
            found.setdefault(r["p"], r["x"])
        at += step
    return [found[i] for i in range(n)]


def map_groups(df: DataFrame, key: str, order: list[str], fn: Callable[[pa.Table], pa.Table | None], schema: str, partitions: int | None = None) -> DataFrame:
    """fn over each group of rows with one value of `key` (a long), rows sorted by `order`.

    Groups of a partition are read as they come; only one is held at a time.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        made: list[pa.Table] = []
        rows = 0
        last = None

        def close():
            got = fn(pa.Table.from_batches(held))
            held.clear()
            return got

        for batch in batches:
            if not batch.num_rows:
                continue
            k = batch.column(key).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(k[1:] != k[:-1]) + 1).tolist(), len(k)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if held and k[a] != last and (got := close()) is not None:
                    made.append(got)
                    rows += got.num_rows
                last = k[a]
                held.append(batch.slice(a, b - a))
            if rows > 5000:
                yield from pa.concat_tables(made).to_batches()
                made, rows = [], 0
        if held and (got := close()) is not None:
            made.append(got)
        if made:
            yield from pa.concat_tables(made).to_batches()

    return df.repartition(n, key).sortWithinPartitions(key, *order).mapInArrow(run, schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, label): connected components of edges (a, b), labelled by their least node.

    Each round takes the least label of a node's neighbours, then that of its label;
    rounds are written to the shared folder and end when no label changes.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.col("label").alias("was"), F.least("label", "near").alias("label"))
        via = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        step = stored(step.join(via, "label", "left").select("node", "was", F.least("label", F.coalesce("further", "label")).alias("label")))
        labels = step.select("node", "label")
        if not step.filter("was <> label").limit(1).count():
            return labels


#: Bytes of text that share a dictionary of their words (a longer text is a chunk of its own).
CHUNK_BYTES = 32 << 20


def chunked(df: DataFrame, text: str = "__text", limit: int = CHUNK_BYTES) -> DataFrame:
    """df, stored, with __chunk: rows that were read one after another, about `limit` bytes of text at a time.

    Later jobs read the stored rows, so that a row has one chunk in all of them, whatever was run again.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("__chunk", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, held = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for part in slices(batch, text):
                held += part.column(text).nbytes
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(part.num_rows, chunk, np.int64))], names=schema.names)
                if held >= limit:
                    chunk, held = chunk + 1, 0

    return stored(df.mapInArrow(run, schema), compression="zstd")


def pieces(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, int, pa.RecordBatch]]:
    """(first of its group, side, rows) of batches sorted by keys and __side: runs of rows with one key and side."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in keys:
            codes = batch.column(c).dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        side = batch.column("__side").to_numpy()
        cuts = np.flatnonzero(new[1:] | (side[1:] != side[:-1])) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            key = tuple(batch.column(c)[a].as_py() for c in keys)
            yield key != last, int(side[a]), batch.slice(a, b - a)
            last = key


def meet(rows: DataFrame, entries: DataFrame | None, keys: list[str], order: list[str], fn: Callable, schema: str | T.StructType) -> DataFrame:
    """fn over the groups of rows that share keys, each after the entries that have them too.

    fn is called once a partition with `pieces`: side 0 are entries, in a column e, side 1 rows,
    in a column d (both structs of all columns); rows of a group are sorted by `order`, columns of rows.
    A group is never held: fn keeps what it needs of it.
    """
    struct = lambda df: F.struct(*[F.col(f"`{c}`") for c in df.columns])
    kind = T.StructType(rows.schema.fields)
    d = rows.select(*keys, F.lit(1).alias("__side"), struct(rows).alias("d"))
    if entries is None:
        d = d.withColumn("e", F.lit(None).cast("struct<none: int>"))
    else:
        e = entries.select(*keys, F.lit(0).alias("__side"), F.lit(None).cast(kind).alias("d"), struct(entries).alias("e"))
        d = e.union(d.withColumn("e", F.lit(None).cast(T.StructType(entries.schema.fields))))
    d = d.repartition(*keys).sortWithinPartitions(*keys, "__side", *[F.col(f"d.`{c}`") for c in order])
    return d.mapInArrow(lambda batches: fn(pieces(batches, keys)), schema)
