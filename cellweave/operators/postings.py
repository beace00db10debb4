"""The inverted index: samples, document frequencies, cutoffs and maintenance.

Features are rows (doc_id, channel, hash, cnt) with channels g (geometry), w
(winnowing), l (logic) and m (controllers); postings are the sampled ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.hashing import hash60

#: Least sample by channel, most of an adaptive one, and the share that it grows to.
SAMPLE = {"g": 512, "w": 512, "l": 128, "m": 128}
MOST, SHARE = 4096, 0.10
ADAPTIVE = ("g", "w")


def sample_size(channel: Column, n: Column) -> Column:
    fixed = F.element_at(F.create_map(*[F.lit(x) for kv in SAMPLE.items() for x in kv]), channel)
    grown = F.least(F.lit(MOST), F.greatest(fixed, F.ceil(n * F.lit(SHARE)).cast("int")))
    return F.when(channel.isin(*ADAPTIVE), grown).otherwise(fixed)


class Sample:
    """sample_size of a channel for whole bags in memory."""

    def __init__(self, channel: str):
        self.channel = channel

    def __call__(self, n: int) -> int:
        least = SAMPLE[self.channel]
        return min(MOST, max(least, math.ceil(n * SHARE))) if self.channel in ADAPTIVE else least


def bottom_k(features: DataFrame, rank: Column | None = None) -> DataFrame:
    """Postings (doc_id, channel, hash): of each document and channel the hashes of least rank.

    The rank is a function of the hash alone, so that documents that share hashes tend
    to keep the same ones.
    """
    part = Window.partitionBy("doc_id", "channel")
    d = features.select("doc_id", "channel", "hash").distinct().withColumn("r", hash60(F.col("hash")) if rank is None else rank)
    d = d.withColumn("n", F.count("*").over(part)).withColumn("k", F.row_number().over(part.orderBy("r", "hash")))
    return d.filter(F.col("k") <= sample_size(F.col("channel"), F.col("n"))).select("doc_id", "channel", "hash")


def bottom_k_of_bags(bags: DataFrame, channel: str) -> DataFrame:
    """The same postings of whole bags (doc_id, bag) of one channel: each document is sampled where it lies."""
    hashes = F.transform("bag", lambda f: f["hash"])
    d = bags.select("doc_id", hashes.alias("hashes"))
    k = sample_size(F.lit(channel), F.size("hashes"))
    ranked = F.array_sort(F.transform("hashes", lambda h: F.struct(hash60(h).alias("r"), h.alias("hash"))))
    kept = F.when(F.size("hashes") <= k, F.col("hashes")).otherwise(F.transform(F.slice(ranked, F.lit(1), F.greatest(k, F.lit(0))), lambda f: f["hash"]))
    return d.select("doc_id", F.lit(channel).alias("channel"), F.explode_outer(kept).alias("hash")).filter("hash IS NOT NULL")


def document_frequency(postings: DataFrame, cap: int | None = None) -> DataFrame:
    n = F.count("*")
    return postings.groupBy("channel", "hash").agg((n if cap is None else F.least(n, F.lit(cap + 1))).alias("df"))


def frequency_cutoff(n: Column | int) -> Column:
    """Postings of more documents say little: max(32, min(2000, ceil(2 % of n)))."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(32), F.least(F.lit(2000), F.ceil(n * F.lit(0.02)).cast("int")))


def rare_limit(n: Column | int) -> Column:
    n = F.lit(n) if isinstance(n, int) else n
    return F.greatest(F.lit(2), F.floor(n / 100)).cast("long")


def idf(n: Column, df: Column, clamped: bool = True) -> Column:
    """1 + ln((n + 1) / (df + 1)), the logarithm not below 0 if clamped."""
    x = F.log((n + 1) / (df + 1))
    return 1 + (F.greatest(F.lit(0.0), x) if clamped else x)


def changed_files(listed: DataFrame, manifest: DataFrame, version: int) -> DataFrame:
    """listed (item_id, path, mtime, size) with action: skip if the manifest has the file alike at this version, else index or new."""
    m = manifest.select("item_id", "path", F.col("mtime").alias("m"), F.col("size").alias("s"), F.col("version").alias("v"))
    same = (F.col("m") == F.col("mtime")) & (F.col("s") == F.col("size")) & (F.col("v") == version)
    return listed.join(m, ["item_id", "path"], "left").withColumn("action", F.when(F.col("v").isNull(), "new").when(F.coalesce(same, F.lit(False)), "skip").otherwise("index")).drop("m", "s", "v")


def stale_paths(manifest: DataFrame, listed: DataFrame, failed: DataFrame) -> DataFrame:
    """Manifest rows of seen items without failures whose path is listed no more; local items stay."""
    seen = listed.select("item_id").distinct().join(failed.select("item_id").distinct(), "item_id", "left_anti")
    return manifest.filter("item_id <> 'local'").join(seen, "item_id", "left_semi").join(listed.select("item_id", "path"), ["item_id", "path"], "left_anti")


def replaced(rows: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """rows without those of fresh keys, and fresh: delete and insert on immutable files."""
    return rows.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh)


def to_upgrade(manifest: DataFrame, indexed: DataFrame, version: int) -> DataFrame:
    """Manifest rows that the index lacks or holds in an older version."""
    i = indexed.select("item_id", "path", F.col("version").alias("v"))
    return manifest.join(i, ["item_id", "path"], "left").filter(F.col("v").isNull() | (F.col("v") < version)).drop("v")
