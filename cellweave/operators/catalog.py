"""The item catalog: upserts, tag predicates, queues, pages and schedules.

items (id STRING, title, updated BIGINT, size_bytes BIGINT, downloaded BIGINT, retry_after BIGINT, tag_checked BIGINT),
item_tags (item_id, tag, tag_key).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.text import digits_only, positive

DAY = 86_400
#: Seconds of overlap between passes, between refreshes, between full passes; and of how long tags count as known.
OVERLAP, REFRESH, RESCAN, TAGS_KNOWN = 7 * DAY, 6 * 3600, 30 * DAY, 7 * DAY


def latest(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """The last row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*[c.desc() for c in order]))).filter("__n = 1").drop("__n")


def upserted(items: DataFrame, batch: DataFrame) -> DataFrame:
    """items merged with a batch (id, title, updated, size_bytes, seq).

    Within the batch, the last known title and size and the greatest time of an id count.
    A known title or size is not lost to an unknown one, times only grow, and a newer time
    means that tags must be looked up again.
    """
    b = batch.groupBy("id").agg(F.max_by("title", F.when(F.col("title").isNotNull(), F.col("seq"))).alias("b_title"), F.max(F.coalesce("updated", F.lit(0))).alias("b_updated"), F.max_by("size_bytes", F.when(F.col("size_bytes").isNotNull(), F.col("seq"))).alias("b_size"))
    d = items.join(b, "id", "full_outer")
    newer = F.col("b_updated") > F.coalesce("updated", F.lit(0))
    return d.select("id", F.coalesce("b_title", "title").alias("title"), F.greatest(F.coalesce("updated", F.lit(0)), F.coalesce("b_updated", F.lit(0))).cast("long").alias("updated"), F.coalesce("b_size", "size_bytes").cast("long").alias("size_bytes"), F.coalesce("downloaded", F.lit(0)).cast("long").alias("downloaded"), F.coalesce("retry_after", F.lit(0)).cast("long").alias("retry_after"), F.when(newer, 0).otherwise(F.coalesce("tag_checked", F.lit(0))).cast("long").alias("tag_checked"))


def normalised_tags(rows: DataFrame, id_col: str = "item_id", tags: str = "tags") -> DataFrame:
    """(item_id, tag, tag_key): trimmed tags, the first spelling of each."""
    t = rows.select(F.col(id_col).alias("item_id"), F.posexplode(tags).alias("n", "raw")).select("item_id", "n", F.trim("raw").alias("tag")).filter("tag <> ''").withColumn("tag_key", F.lower("tag"))
    return t.groupBy("item_id", "tag_key").agg(F.min_by("tag", "n").alias("tag")).select("item_id", "tag", "tag_key")


def replaced_tags(tags: DataFrame, rows: DataFrame) -> DataFrame:
    """Tags after rows (item_id, tags): those of items whose row has tags are replaced, null leaves them."""
    told = rows.filter(F.col("tags").isNotNull())
    return tags.join(told.select("item_id").distinct(), "item_id", "left_anti").unionByName(normalised_tags(told))


def check_filters(required: list[str], excluded: list[str]) -> None:
    if both := {t.casefold() for t in required} & {t.casefold() for t in excluded}:
        raise ValueError(f"tags both required and excluded: {sorted(both)}")


def with_tags(items: DataFrame, tags: DataFrame, required: list[str] = (), excluded: list[str] = (), match_all: bool = True, now: int | None = None) -> DataFrame:
    """Items with all (or any) of the required tags and none of the excluded ones.

    With `now`, only items whose tags were looked up in the last week can pass: unknown
    tags are not absent ones.
    """
    check_filters(list(required), list(excluded))
    d = items
    if (required or excluded) and now is not None:
        d = d.filter(F.col("tag_checked") >= now - TAGS_KNOWN)
    if required:
        keys = sorted({t.casefold() for t in required})
        hit = tags.filter(F.col("tag_key").isin(keys)).groupBy("item_id").agg(F.count_distinct("tag_key").alias("n"))
        hit = hit.filter(F.col("n") == len(keys)) if match_all else hit
        d = d.join(hit.select(F.col("item_id").alias("id")), "id", "left_semi")
    if excluded:
        out = tags.filter(F.col("tag_key").isin(sorted({t.casefold() for t in excluded}))).select(F.col("item_id").alias("id")).distinct()
        d = d.join(out, "id", "left_anti")
    return d


def row_matches(tags: Column, required: list[str], excluded: list[str], match_all: bool = True) -> Column:
    """The same on an array of tags in the row; null passes."""
    keys = F.transform(tags, lambda t: F.lower(F.trim(t)))
    arr = lambda xs: F.array(*[F.lit(x.casefold()) for x in xs])
    ok = F.lit(True)
    if required:
        ok &= F.size(F.array_except(arr(required), keys)) == 0 if match_all else F.arrays_overlap(keys, arr(required))
    if excluded:
        ok &= ~F.arrays_overlap(keys, arr(excluded))
    return tags.isNull() | ok


def tag_histogram(tags: DataFrame) -> DataFrame:
    return tags.groupBy("tag_key").agg(F.min("tag").alias("tag"), F.count("*").alias("items"))


def pending(now: int, force: bool = False) -> Column:
    """What is to be fetched: numbered items whose wait is over and that are not there or out of date."""
    due = F.col("retry_after") <= now
    return digits_only(F.col("id")) & (F.lit(True) if force else due & ((F.col("downloaded") == 0) | (F.col("updated") > F.col("downloaded"))))


def queue(items: DataFrame, now: int, limit: int | None = None, attempted: DataFrame | None = None) -> DataFrame:
    """Pending items, smallest first, unknown sizes last; ids tried in this run are left out."""
    d = items.filter(pending(now))
    if attempted is not None:
        d = d.join(attempted.select("id"), "id", "left_anti")
    d = d.orderBy(F.col("size_bytes").asc_nulls_last(), "id")
    return d if limit is None else d.limit(limit)


def batches(ranked: DataFrame, size: int, workers: int) -> DataFrame:
    """ranked (place from 1) plus batch: batches of min(size, max(1, n / workers)); n is one row, sent to all tasks."""
    n = ranked.agg(F.count("*").alias("__n"))
    batch = F.floor((F.col("place") - 1) / F.least(F.lit(size), F.greatest(F.lit(1), F.floor(F.col("__n") / workers)))).cast("int")
    return ranked.crossJoin(F.broadcast(n)).withColumn("batch", batch).drop("__n")


def page(items: DataFrame, after: str = "", limit: int = 100) -> DataFrame:
    """Keyset page of numbered ids, in the order of text."""
    if not 1 <= limit <= 1000:
        raise ValueError("limit is from 1 to 1000")
    return items.filter(digits_only(F.col("id")) & (F.col("id") > after)).orderBy("id").limit(limit)


def adopted(items: DataFrame, folders: DataFrame, now: int) -> DataFrame:
    """items after a look at the installed folders (id, mtime): unknown ones are added, an up-to-date folder counts as downloaded, others don't."""
    f = folders.groupBy("id").agg(F.max(F.greatest(F.lit(1), F.least(F.col("mtime"), F.lit(now)))).alias("mtime"))
    d = items.join(f, "id", "full_outer")
    current = F.col("mtime").isNotNull() & (F.coalesce("updated", F.lit(0)) <= F.col("mtime"))
    return d.select("id", "title", F.coalesce("updated", F.lit(0)).cast("long").alias("updated"), "size_bytes", F.when(current, F.greatest(F.coalesce("downloaded", F.lit(0)), F.col("mtime"))).otherwise(0).cast("long").alias("downloaded"))


def installed_states(items: DataFrame, folders: DataFrame, indexed: DataFrame) -> DataFrame:
    """(id, state): unknown, stale, absent or unindexed, by item and folder."""
    i, f = items.select("id", "updated"), folders.select("id", "mtime")
    both = f.join(i, "id")
    s = lambda d, state: d.select("id", F.lit(state).alias("state"))
    return s(f.join(i, "id", "left_anti"), "unknown").union(s(both.filter("updated > mtime"), "stale")).union(s(i.join(f, "id", "left_anti"), "absent")).union(s(both.filter("updated <= mtime").join(indexed.select("id").distinct(), "id", "left_anti"), "unindexed"))


def after_failure(items: DataFrame, failed: DataFrame, now: int) -> DataFrame:
    """items with the wait of those that failed (id, attempts)."""
    from cellweave.functions.text import backoff_seconds

    return items.join(failed.select("id", "attempts"), "id", "left").withColumn("retry_after", F.when(F.col("attempts").isNotNull(), now + backoff_seconds(F.col("attempts"))).otherwise(F.col("retry_after")).cast("long")).drop("attempts")


def recheck_tags(now: int) -> Column:
    """Whose tags are to be looked up: never checked and not tried for a day, or checked over a week ago."""
    return digits_only(F.col("id")) & ((F.col("tag_checked") == 0) & (F.col("tag_tried") <= now - DAY) | (F.col("tag_checked") > 0) & (F.col("tag_checked") < now - TAGS_KNOWN))


def recheck_sizes(now: int) -> Column:
    return digits_only(F.col("id")) & F.col("size_bytes").isNull() & (F.col("size_checked") <= now - DAY)


def valid_detail(result: Column, item_id: Column, app: Column, wanted: str) -> Column:
    """Whether a looked-up row counts."""
    return (result == 1) & item_id.isNotNull() & (app.isNull() | (app.cast("string") == wanted))


def within_overlap(rows: DataFrame, started: int, time: str = "updated") -> DataFrame:
    """Rows that an incremental pass still takes: not older than the pass before it began, less the overlap; ties stay."""
    return rows.filter(F.col(time) >= max(0, started - OVERLAP))


def pass_ends(pages: DataFrame, cutoff: int) -> DataFrame:
    """(page, ends): a page ends a pass if all its times are known and any is before the cutoff."""
    return pages.groupBy("page").agg((F.bool_and(F.col("updated").isNotNull()) & F.coalesce(F.min("updated") < cutoff, F.lit(False))).alias("ends"))


def pass_mode(now: int, restart: bool, full_done: int | None, full_incomplete: bool, refresh_done: int | None) -> str:
    """What the next catalog pass is: full, refresh, or skip."""
    if restart or full_incomplete or not full_done or now - full_done >= RESCAN:
        return "full"
    return "skip" if refresh_done and now - refresh_done < REFRESH else "refresh"


def coverage(items: DataFrame, files: DataFrame, version: int) -> DataFrame:
    """One row of counts: known, sized, tagged, downloaded items; files, current ones, distinct items of files."""
    a = items.agg(F.count("*").alias("known"), F.count("size_bytes").alias("sized"), F.count_if(F.col("tag_checked") > 0).alias("tagged"), F.count_if(F.col("downloaded") > 0).alias("downloaded"))
    b = files.agg(F.count("*").alias("files"), F.count_if(F.col("version") == version).alias("current"), F.count_distinct("item_id").alias("file_items"))
    return a.crossJoin(b)  # one row each


def typed_items(rows: DataFrame) -> DataFrame:
    """Rows of a page as batch rows: ids as text, sizes above 0, times not below 0."""
    return rows.select(F.col("id").cast("string").alias("id"), "title", F.greatest(F.coalesce(F.col("updated").try_cast("long"), F.lit(0)), F.lit(0)).alias("updated"), positive(F.col("size_bytes")).alias("size_bytes"), "seq")
