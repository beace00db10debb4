"""Gates, lookups and rules around an index: what is let in, what is reported, and how work is paced."""

from __future__ import annotations

import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.sources.store import stored

#: Components that a file must have at least, and hours (in seconds) that a looked-up text, an empty one and an error are kept.
LEAST_COMPONENTS = 3
KEPT = {"found": 24 * 3600, "empty": 3600, "error": 120}
#: Entries of the cache, new files and seconds after which a scan is run again, items of a page.
CACHE_SIZE, RESCAN_FILES, RESCAN_SECONDS, PAGE = 256, 500, 30, 500


# -- indexing


def evidence_errors(counts: DataFrame) -> DataFrame:
    """(doc_id, error) of files (doc_id, components, features, other) with too little to compare: the rows of the error table."""
    none = F.col("other") == 0
    error = F.when(none & (F.col("components") < LEAST_COMPONENTS), F.lit("too few components")).when(none & (F.col("features") == 0), F.lit("no features"))
    return counts.select("doc_id", error.alias("error")).filter("error IS NOT NULL")


def merged_flags(flags: DataFrame, new: DataFrame, key: str = "item_id", flag: str = "had_error") -> DataFrame:
    """Flags after new ones: one that was set stays set."""
    return flags.select(key, flag).unionByName(new.select(key, flag)).groupBy(key).agg(F.max(flag).alias(flag))


def composite_page(rows: DataFrame, item: str, path: str, limit: int = PAGE) -> DataFrame:
    """The next rows after (item, path), in that order: a filter that reaches the scan and a top-n, no offset."""
    after = (F.col("item_id") > item) | (F.col("item_id") == item) & (F.col("path") > path)
    return rows.filter(after).orderBy("item_id", "path").limit(limit)


def packed_json(row: Column) -> Column:
    """Canonical JSON of a struct (fields in its order, nulls left out) in a zlib stream."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else zlib.compress(x.encode(), 6))

    return F.pandas_udf(run, "binary")(F.to_json(row))


def unpacked_json(data: Column, schema: str) -> Column:
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else zlib.decompress(x).decode())

    return F.from_json(F.pandas_udf(run, "string")(data), schema)


# -- retrieval and reports


def budgeted_terms(terms: DataFrame, budget: int, key: str = "query_id") -> DataFrame:
    """A query's terms (query_id, channel, hash, df), rare ones first, as far as their postings fit the budget.

    Plus tier, the first of 32, 128 and 512 that isn't under df (0 beyond): frequencies are known, so no term is probed.
    """
    upto = F.sum("df").over(Window.partitionBy(key).orderBy("df", "channel", "hash").rowsBetween(Window.unboundedPreceding, 0))
    tier = F.when(F.col("df") <= 32, 32).when(F.col("df") <= 128, 128).when(F.col("df") <= 512, 512).otherwise(0)
    return terms.withColumn("upto", upto).filter(F.col("upto") <= budget).withColumn("tier", tier).drop("upto")


def small_exact(pairs: DataFrame, same: DataFrame, components: DataFrame) -> DataFrame:
    """pairs (query_id, doc_id, ...) plus small_exact: equal bags (same) and equal numbers of components (id, components; ids that aren't there have as many as each other)."""
    n = lambda name, out: components.select(F.col("id").alias(name), F.col("components").alias(out))
    d = pairs.join(same.select("query_id", "doc_id", F.lit(True).alias("__same")), ["query_id", "doc_id"], "left").join(n("query_id", "__q"), "query_id", "left").join(n("doc_id", "__d"), "doc_id", "left")
    return d.withColumn("small_exact", F.coalesce("__same", F.lit(False)) & F.col("__q").eqNullSafe(F.col("__d"))).drop("__same", "__q", "__d")


def titled(matches: DataFrame, items: DataFrame) -> DataFrame:
    """matches (item_id, ...) with the item's title, null if it isn't known, and listed: a known numbered item."""
    known = items.select(F.col("id").alias("item_id"), "title", F.lit(True).alias("__known"))
    d = matches.join(known, "item_id", "left")
    return d.withColumn("listed", F.coalesce("__known", F.lit(False)) & F.col("item_id").rlike("^[0-9]+$")).drop("__known")


def located(ranked: DataFrame, files: DataFrame, k: int) -> DataFrame:
    """The first k ranked files of each query with their paths: paths are looked up after the cut, never for every posting."""
    return ranked.filter(F.col("rank") <= k).join(files.select(F.col("file_id"), "item_id", "path"), "file_id")


def searched_files(manifest: DataFrame, version: int, older: bool) -> DataFrame:
    """One row: the files that a scan covers, those of this version only unless older forms can be searched too."""
    return manifest.agg((F.count("*") if older else F.count_if(F.col("version") == version)).alias("searched_files"))


def with_shared_kinds(pairs: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """pairs (a, b) whose sides (a, kind) and (b, kind) have a kind in common; others need no alignment."""
    both = pairs.join(left.select("a", "kind").distinct(), "a").join(right.select("b", "kind").distinct(), ["b", "kind"])
    return pairs.join(both.select("a", "b").distinct(), ["a", "b"], "left_semi")


def linear_place(points: DataFrame, group: list[str]) -> DataFrame:
    """points (x, y, z) plus place: row-major number within the box of their group, one sortable integer (a decimal, so that no box is too large)."""
    box = points.groupBy(*group).agg(*[F.min(a).alias(f"low_{a}") for a in "xyz"], *[(F.max(a) - F.min(a) + 1).alias(f"span_{a}") for a in "yz"])
    at = {a: (F.col(a) - F.col(f"low_{a}")).cast("decimal(38,0)") for a in "xyz"}
    place = (at["x"] * F.col("span_y") + at["y"]) * F.col("span_z") + at["z"]
    return points.join(box, group).withColumn("place", place.cast("decimal(38,0)")).drop(*[f"low_{a}" for a in "xyz"], "span_y", "span_z")


def valid_match(prefix: str) -> Column:
    """Whether a reported row (item_id, title, url, confidence, shares in percent, counts) may be shown."""
    c = F.col
    share = lambda v: v.isNotNull() & v.between(0.0, 100.0)
    ok = c("item_id").isNotNull() & F.char_length("item_id").between(1, 256) & c("confidence").isin("low", "medium", "high")
    for v in ("query_pct", "doc_pct", "combined"):
        ok &= share(c(v))
    ok &= (c("shared") >= 0) & (c("rare") >= 0)
    url = c("url").isNull() | (c("url") == F.when(c("item_id").rlike("^[0-9]+$"), F.concat(F.lit(prefix), "item_id")))
    return F.coalesce(ok & F.coalesce(url, F.lit(False)), F.lit(False))


# -- pacing


def fresh_entries(cache: DataFrame, now: int, size: int = CACHE_SIZE) -> DataFrame:
    """Entries (key, kind, stored, used) that are still good at `now`, the `size` last used ones; kinds have lives of their own."""
    life = F.element_at(F.create_map(*[F.lit(x) for kv in KEPT.items() for x in kv]), F.col("kind"))
    live = cache.withColumn("expires", F.col("stored") + life).filter(F.col("expires") > now)
    return live.orderBy(F.desc("used"), "key").limit(size)


def workers_after(results: Column, workers: int) -> Column:
    """Workers after chunks (array<boolean>: whether asked to slow down): halved by each such chunk, one more after two others in a row."""
    state = lambda n, calm: F.struct(n.cast("int").alias("n"), calm.cast("int").alias("calm"))

    def step(s, limited):
        more = (s["calm"] >= 1) & (s["n"] < workers)
        return F.when(limited, state(F.greatest(F.lit(1), F.floor(s["n"] / 2)), F.lit(0))).when(more, state(s["n"] + 1, F.lit(0))).otherwise(state(s["n"], s["calm"] + 1))

    return F.aggregate(results, state(F.lit(workers), F.lit(0)), step, lambda s: s["n"])


def rescan_due(done: Column, seen: Column, now: Column, last: Column) -> Column:
    return (done - seen >= RESCAN_FILES) & (now - last >= RESCAN_SECONDS)


def seconds_left(done: Column, total: Column, elapsed: Column) -> Column:
    """Estimate of the seconds that are left: known after two seconds and some progress."""
    return F.when((elapsed >= 2) & (done > 0) & (total >= done), (total - done) * elapsed / done)


def with_rank(rows: DataFrame, *order: Column) -> DataFrame:
    """rows plus place, their number in a total order: rows are dealt by range, ranked inside a partition, and partitions' counts added up."""
    # written once: ranges are sampled, and a second run of the plan could deal rows otherwise
    d = stored(rows.repartitionByRange(*order).withColumn("__p", F.spark_partition_id()))
    inside = d.withColumn("__i", F.row_number().over(Window.partitionBy("__p").orderBy(*order)))
    counts = inside.groupBy("__p").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))  # a row for each partition
    return inside.join(F.broadcast(before.drop("__n")), "__p").withColumn("place", (F.col("__before") + F.col("__i")).cast("int")).drop("__p", "__i", "__before")
