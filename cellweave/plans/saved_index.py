"""An index of XML files on disk that grows by segments and is seen by snapshots.

A segment holds what one batch of files adds: their manifest rows, features, postings and
bands, errors, and tombstones, the paths whose rows in earlier segments are dead.  It
holds frequencies too, as signed counts: what its postings add and what its tombstones take
away, so that the frequency of a term is a sum over segments and no posting is counted
again.  Rows lie in folders by a hash of their path; a tombstone's counts are taken from its
own buckets only.

A snapshot is a small file that lists the segments of a version, and comes into being by one
rename that fails where the number is taken.  Readers take the segments of one snapshot and keep to
them.  Whatever a writer leaves behind when it is stopped is in no snapshot; it is dropped
by `vacuum`.  `compact` writes all that lives as one segment.

Files are read in batches of BATCH paths, each one a segment and a snapshot: an update or
upgrade that was stopped goes on after its last batch, and scans work on what there is,
files of several versions among them.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.operators import gates, postings, sketch
from cellweave.plans import scan as plan
from cellweave.sources import store, xml_source
from cellweave.sources.store import stored

#: Of the features' definition: files indexed in another version are indexed again.
VERSION = 1
#: Folders that a segment's rows are dealt to, and files of a batch (their paths go through the driver).
BUCKETS, BATCH = 64, 20_000
TABLES = {
    "manifest": "item_id string, path string, mtime timestamp, size long, version int",
    "errors": "item_id string, doc_id string, error string",
    "dead": "path string",
    "features": "doc_id string, hash string, cnt long, x long, y long, z long, channel string",
    "postings": "doc_id string, channel string, hash string",
    "bands": "doc_id string, band int, bucket string",
    "df": "channel string, hash string, df long",
    "counts": "bucket string, df long",
}
#: The column of a table that names the file; counts have none.
PATH = {"manifest": "path", "errors": "doc_id", "dead": "path", "features": "doc_id", "postings": "doc_id", "bands": "doc_id"}
COUNTED = {"df": ["channel", "hash"], "counts": ["bucket"]}


@dataclass
class Snapshot:
    """The segments of one version of an index, oldest first."""

    out: str
    number: int = 0
    segments: list[str] = field(default_factory=list)


def _snapshots(out: str) -> str:
    return f"{out.rstrip('/')}/snapshots"


def latest(spark: SparkSession, out: str) -> Snapshot:
    """The newest snapshot; an index of the older layout, six tables side by side, is taken over first."""
    names = [n for n in store.listed(spark, _snapshots(out)) if re.fullmatch(r"\d{12}\.json", n)]
    if not names:
        return migrated(spark, out) if store.exists(spark, f"{out.rstrip('/')}/manifest") else Snapshot(out)
    held = json.loads(store.read_text(spark, f"{_snapshots(out)}/{max(names)}"))
    return Snapshot(out, held["number"], held["segments"])


def commit(spark: SparkSession, seen: Snapshot, segments: list[str]) -> Snapshot:
    """The snapshot after `seen`; fails where another writer has made it."""
    after = Snapshot(seen.out, seen.number + 1, segments)
    store.write_once(spark, f"{_snapshots(seen.out)}/{after.number:012d}.json", json.dumps({"number": after.number, "segments": segments}))
    return after


def _typed(df: DataFrame, name: str) -> DataFrame:
    return df.select(*[F.col(n).cast(t).alias(n) for n, t in (f.strip().split(" ") for f in TABLES[name].split(","))])


def rows(spark: SparkSession, snapshot: Snapshot, name: str) -> DataFrame:
    """All rows of a table's segments, with seg and part, dead ones too."""
    schema = f"{TABLES[name]}, seg string, part int"
    base = f"{snapshot.out.rstrip('/')}/data/{name}"
    paths = [f"{base}/seg={s}" for s in snapshot.segments]
    return spark.read.schema(schema).option("basePath", base).parquet(*paths) if paths else spark.createDataFrame([], schema)


def live(spark: SparkSession, snapshot: Snapshot, name: str, parts: list[int] | None = None) -> DataFrame:
    """Rows that no later tombstone names, of some buckets or all; of errors, a file's latest."""
    d = rows(spark, snapshot, name)
    if parts is not None:
        d = d.filter(F.col("part").isin(parts))
    dead = rows(spark, snapshot, "dead").groupBy(F.col("path").alias("__path")).agg(F.max("seg").alias("__dead"))
    d = d.join(dead, (F.col(PATH[name]) == F.col("__path")) & (F.col("seg") < F.col("__dead")), "left_anti")
    if name == "errors":
        d = d.groupBy("doc_id").agg(F.max_by(F.struct("item_id", "error"), "seg").alias("e")).select("e.item_id", "doc_id", "e.error")
    return _typed(d, name)


def summed(spark: SparkSession, snapshot: Snapshot, name: str) -> DataFrame:
    return rows(spark, snapshot, name).groupBy(*COUNTED[name]).agg(F.sum("df").alias("df")).filter("df > 0")


def table(spark: SparkSession, out: str, name: str) -> DataFrame:
    """A table of the newest snapshot, empty where there is none yet."""
    s = latest(spark, out)
    return summed(spark, s, name) if name in COUNTED else live(spark, s, name)


def _part(path: str):
    return F.pmod(F.xxhash64(path), F.lit(BUCKETS)).cast("int")


def write_segment(spark: SparkSession, seen: Snapshot, made: dict[str, DataFrame]) -> str:
    """Writes a segment's tables; it is seen once a snapshot lists it."""
    segment = f"{seen.number + 1:012d}-{uuid.uuid4().hex[:12]}"
    for name in TABLES:
        d = _typed(made[name], name) if name in made else spark.createDataFrame([], TABLES[name])
        d = d.withColumn("part", _part(PATH[name]) if name in PATH else F.lit(0))  # counts are never read by path
        d.write.partitionBy("part").parquet(f"{seen.out.rstrip('/')}/data/{name}/seg={segment}")
    return segment


def xml_features(rows: DataFrame) -> DataFrame:
    """All channels of parsed XML files (doc_id, hash, cnt, x, y, z, channel)."""
    logic, micro = xml_source.semantic_features(rows)
    kinds = rows.filter("kind = 'placed'").groupBy("doc_id", F.col("type").alias("hash")).agg(F.count("*").alias("cnt")).withColumns(dict.fromkeys("xyz", F.lit(None).cast("long")))
    out = plan.channel_features(xml_source.cells(rows))
    for channel, df in (("l", logic), ("m", micro), ("t", kinds)):
        out = out.unionByName(df.withColumn("channel", F.lit(channel)))
    return out


def indexed(features: DataFrame) -> dict[str, DataFrame]:
    """What a scan reads of features: features, postings, bands."""
    posted = stored(_typed(postings.bottom_k(features.filter("channel <> 't'")), "postings"))
    tokens = features.filter("channel IN ('g', 'w')").select("doc_id", F.concat_ws(":", "channel", "hash").alias("token"))
    return {"features": features, "postings": posted, "bands": stored(_typed(sketch.bands(sketch.signatures(tokens)), "bands"))}


def counts_of(posted: DataFrame, banded: DataFrame, sign: int = 1) -> dict[str, DataFrame]:
    n = (F.count("*") * sign).alias("df")
    return {"df": posted.groupBy("channel", "hash").agg(n), "counts": banded.groupBy("bucket").agg(n)}


def replaced(spark: SparkSession, seen: Snapshot, fresh: dict[str, DataFrame], dead: DataFrame) -> Snapshot:
    """Commits a segment of fresh tables and tombstones (path): only the buckets of dead paths are read, to take their counts away."""
    dead = stored(dead.select("path").distinct())
    parts = [r[0] for r in dead.select(_part("path")).distinct().collect()]  # at most BUCKETS
    taken = {}
    for name in ("postings", "bands") if parts else ():
        taken[name] = live(spark, seen, name, parts).join(dead.withColumnRenamed("path", "doc_id"), "doc_id", "left_semi")
    made = dict(fresh) | {"dead": dead}
    plus = counts_of(fresh["postings"], fresh["bands"]) if "postings" in fresh else {}
    minus = counts_of(taken["postings"], taken["bands"], -1) if taken else {}
    for name, keys in COUNTED.items():
        both = [x[name] for x in (plus, minus) if x]
        if both:
            d = both[0] if len(both) == 1 else both[0].unionByName(both[1])
            made[name] = d.groupBy(*keys).agg(F.sum("df").alias("df")).filter("df <> 0")
    return commit(spark, seen, [*seen.segments, write_segment(spark, seen, made)])


def _pages(files: DataFrame, batch: int):
    """Rows of files (item_id, path, ...) in batches, in the order of item and path; each is a top-n after the one before."""
    item = path = ""
    while page := gates.composite_page(files, item, path, batch).collect():
        yield page
        item, path = page[-1]["item_id"], page[-1]["path"]


def _escaped(path: str) -> str:
    """A path as a pattern that matches it alone."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)


def add_files(spark: SparkSession, seen: Snapshot, page: list, version: int) -> tuple[Snapshot, int]:
    """The snapshot with a batch of files read and put in the place of what was known of them, and how many failed.

    Only these files are read.  A file that can't be read keeps its older rows and has a row in the error table.
    """
    batch = stored(spark.createDataFrame([(r["item_id"], r["path"], r["mtime"], r["size"]) for r in page], "item_id string, path string, mtime timestamp, size long"))
    files = spark.read.format("binaryFile").load([_escaped(r["path"]) for r in page]).select("path", "content")
    parsed = stored(xml_source.parse_rows(files.filter(xml_source.sniffed(F.col("content").cast("string")))))
    fresh = stored(_typed(xml_features(parsed), "features"))
    n = parsed.groupBy("doc_id").agg(F.max("error").alias("error"), F.count_if(F.col("kind") == "cell").alias("components"))
    has = fresh.groupBy("doc_id").agg(F.count_if(F.col("channel").isin("g", "w")).alias("features"), F.count_if(F.col("channel").isin("l", "m")).alias("other"))
    read = stored(n.join(has, "doc_id", "left").fillna(0, ["features", "other"]))
    failed = stored(read.filter("error IS NOT NULL").select("doc_id", "error").union(gates.evidence_errors(read.filter("error IS NULL"))))
    good = stored(read.select(F.col("doc_id").alias("path")).join(failed.select(F.col("doc_id").alias("path")), "path", "left_anti"))
    made = indexed(fresh.join(good.withColumnRenamed("path", "doc_id"), "doc_id", "left_semi"))
    made["manifest"] = batch.join(good, "path", "left_semi").withColumn("version", F.lit(version))
    made["errors"] = batch.select("item_id", F.col("path").alias("doc_id")).join(failed, "doc_id")
    return replaced(spark, seen, made, good), failed.count()


def update(spark: SparkSession, folder: str, out: str, version: int = VERSION, batch: int = BATCH) -> dict[str, int]:
    """Brings the index in `out` up to date with the XML files below folder; counts of new, changed, skipped, removed and failed files.

    The folder is listed without reading a file; each batch of new and changed files is read by its paths and committed.
    """
    seen = latest(spark, out)
    manifest = stored(live(spark, seen, "manifest"))
    actions = stored(postings.changed_files(xml_source.scan(spark, folder).drop("content"), manifest, version))
    failed = 0
    for page in _pages(actions.filter("action <> 'skip'"), batch):
        seen, bad = add_files(spark, seen, page, version)
        failed += bad
    errors = live(spark, seen, "errors").select("item_id").distinct()
    gone = stored(postings.stale_paths(manifest, actions, errors).select("path"))
    removed = gone.count()
    if removed:
        seen = replaced(spark, seen, {}, gone)
    counts = {r["action"]: r["count"] for r in actions.groupBy("action").count().collect()}
    return {"new": counts.get("new", 0), "changed": counts.get("index", 0), "skipped": counts.get("skip", 0), "removed": removed, "failed": failed}


def upgrade(spark: SparkSession, out: str, version: int = VERSION, batch: int = 500, most: int = 0) -> dict[str, int]:
    """Reads the files of older versions again, by the paths that the index has, at most `most` of them if that isn't 0.

    Each batch is committed; one that was stopped is done again and nothing else is.  Files that are no more stay as they are, and are searched.
    """
    seen = latest(spark, out)
    older = stored(live(spark, seen, "manifest").filter(F.col("version") < version))
    done = {"examined": 0, "upgraded": 0, "missing_files": 0, "errors": 0}
    for page in _pages(older, min(batch, most) if most else batch):
        there = [r for r in page if store.exists(spark, r["path"])]  # a batch of them
        if most:
            there = there[: most - done["upgraded"] - done["errors"]]
        done["examined"] += len(page)
        done["missing_files"] += len(page) - len(there)
        if there:
            seen, bad = add_files(spark, seen, there, version)
            done["upgraded"] += len(there) - bad
            done["errors"] += bad
        if most and done["upgraded"] + done["errors"] >= most:
            break
    return done | {"remaining_legacy_files": live(spark, seen, "manifest").filter(F.col("version") < version).count()}


def migrated(spark: SparkSession, out: str) -> Snapshot:
    """The older layout as a first segment, one snapshot for all its tables; its files are of version 0, so that an upgrade reads them again."""
    old = lambda name: spark.read.schema(TABLES[name]).parquet(f"{out.rstrip('/')}/{name}")
    made = {name: old(name) for name in ("manifest", "errors", "features", "postings", "bands")}
    made["manifest"] = made["manifest"].withColumn("version", F.lit(0))
    made |= counts_of(made["postings"], made["bands"])
    seen = Snapshot(out)
    return commit(spark, seen, [write_segment(spark, seen, made)])


def compact(spark: SparkSession, out: str) -> Snapshot:
    """All that lives, as one segment; older snapshots can be read until `vacuum`."""
    seen = latest(spark, out)
    made = {name: live(spark, seen, name) for name in ("manifest", "errors", "features", "postings", "bands")} | {name: summed(spark, seen, name) for name in COUNTED}
    return commit(spark, seen, [write_segment(spark, seen, made)])


def vacuum(spark: SparkSession, out: str) -> int:
    """Drops older snapshots and the segments that the newest doesn't list (no writer may be at work); how many segments went."""
    seen = latest(spark, out)
    for name in store.listed(spark, _snapshots(out)):
        if name != f"{seen.number:012d}.json":
            store.drop(spark, f"{_snapshots(out)}/{name}")
    gone = set()
    for name in TABLES:
        base = f"{out.rstrip('/')}/data/{name}"
        for folder in store.listed(spark, base):
            if folder.startswith("seg=") and folder[4:] not in seen.segments:
                store.drop(spark, f"{base}/{folder}")
                gone.add(folder)
    return len(gone)


def load(spark: SparkSession, out: str) -> plan.Index:
    """The newest snapshot as scans take it; nothing is built, and later commits don't show in it."""
    s = latest(spark, out)
    files = live(spark, s, "manifest").count()
    return plan.Index(live(spark, s, "features"), live(spark, s, "postings"), rows(spark, s, "df").select("channel", "hash", "df"), live(spark, s, "bands"), files, rows(spark, s, "counts").select("bucket", "df"))


def report(spark: SparkSession, matches: DataFrame, out: str, items: DataFrame | None = None) -> DataFrame:
    """matches with the file's item and path, looked up after the cut, and the item's title."""
    d = gates.located(matches.withColumnRenamed("doc_id", "file_id"), table(spark, out, "manifest").withColumn("file_id", F.col("path")), 1 << 30)
    return d if items is None else gates.titled(d, items)


def status(spark: SparkSession, out: str, version: int = VERSION) -> DataFrame:
    """One row: files, those of this version, items, errors."""
    s = latest(spark, out)
    a = live(spark, s, "manifest").agg(F.count("*").alias("files"), F.count_if(F.col("version") == version).alias("current"), F.count_distinct("item_id").alias("items"))
    return a.crossJoin(live(spark, s, "errors").agg(F.count("*").alias("errors")))  # one row each
