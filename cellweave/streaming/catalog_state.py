"""The catalog as keyed state: items, passes and pacing by transformWithState.

Each item, each pass over the catalog and each request loop has its own state in the
state store, so that a batch's work is its page's rows, whatever the catalog holds.  Items
change as the table's upsert changes them; what comes out are the items that changed.
A pass keeps its cursors one entry each, and forgets them when it ends.  The pace of
requests is set by timers: the next page after a minute, the next pass after six hours,
a retry after an error's wait.  A restart goes on from the checkpoint and repeats nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cellweave.operators.catalog import OVERLAP, REFRESH, RESCAN

#: Seconds to the next page, and after an error.
PAGE_WAIT, ERROR_WAIT = 60, 15 * 60
ITEM = "title string, updated long, size_bytes long, downloaded long, retry_after long, tag_checked long"
CHANGED = f"id string, {ITEM}, batch_rows int"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def with_store(spark: SparkSession) -> None:
    """State of this session's streams is kept in RocksDB, which keyed state needs."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _known(value):
    return None if value is None or value != value else value


class Items(StatefulProcessor):
    """Rows of pages (id, title, updated, size_bytes, seq) merged into their item; one row out for an item that changed."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.item = handle.getValueState("item", ITEM)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = tuple(self.item.get()) if self.item.exists() else None
        title, updated, size, downloaded, retry, checked = held or (None, 0, None, 0, 0, 0)
        n = 0
        last_title, last_size = (-1, title), (-1, size)
        newest = 0
        for part in rows:
            n += len(part)
            for t, u, s, seq in zip(part["title"], part["updated"], part["size_bytes"], part["seq"], strict=True):
                if _known(t) is not None:
                    last_title = max(last_title, (int(seq), t), key=lambda x: x[0])
                if _known(s) is not None:
                    last_size = max(last_size, (int(seq), int(s)), key=lambda x: x[0])
                newest = max(newest, int(_known(u) or 0))
        now = (last_title[1], max(updated, newest), last_size[1], downloaded, retry, 0 if newest > updated else checked)
        if now != held:
            self.item.update(now)
            yield pd.DataFrame([(key[0], *now, n)], columns=["id", "title", "updated", "size_bytes", "downloaded", "retry_after", "tag_checked", "batch_rows"]).astype({"size_bytes": "Int64"})

    def close(self) -> None:
        pass


def changed_items(pages: DataFrame) -> DataFrame:
    """A stream of the items that a stream of page rows (id, title, updated, size_bytes, seq) changes."""
    with_store(pages.sparkSession)
    return pages.groupBy("id").transformWithStateInPandas(statefulProcessor=Items(), outputStructType=CHANGED, outputMode="Update", timeMode="None")


def current(changes: DataFrame) -> DataFrame:
    """Items as they are, of all changes (id, ..., batch) that were written: the last of each."""
    names = [f.split(" ")[0] for f in ITEM.split(", ")]
    return changes.groupBy("id").agg(F.max_by(F.struct(*names), "batch").alias("i")).select("id", "i.*")


PASS = "scope string, page long, cursor string, mark long, started long, cutoff long, done boolean, error string"


class Passes(StatefulProcessor):
    """Pages of a scope (page, asked, cursor, oldest, all_timed, at) in their order; one row out for each: where the scope stands.

    A cursor that was followed in this pass is an error, and changes nothing.  A pass ends with a page that has no
    further cursor, or whose times are all known and reach behind the cutoff; then its start becomes the mark.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.followed = handle.getMapState("followed", "cursor string", "page long")
        self.stand = handle.getValueState("stand", "mark long, started long, cutoff long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mark, started, cutoff = tuple(self.stand.get()) if self.stand.exists() else (0, 0, 0)
        out = []
        for r in pd.concat(list(rows)).sort_values("page").itertuples():
            if not started:
                started, cutoff = int(r.at), max(0, mark - OVERLAP)
            following = _known(r.cursor)
            error, done = None, False
            if following is not None and (following == r.asked or self.followed.containsKey((following,))):
                error = f"cursor {following!r} came again"
            else:
                self.followed.updateValue((r.asked,), (int(r.page),))
                behind = bool(cutoff) and bool(r.all_timed) and _known(r.oldest) is not None and int(r.oldest) < cutoff
                done = following is None or behind
            out.append((key[0], int(r.page), following, started if done else mark, started, cutoff, done, error))
            if done:
                mark, started, cutoff = started, 0, 0
                self.followed.clear()
        self.stand.update((mark, started, cutoff))
        yield pd.DataFrame(out, columns=["scope", "page", "cursor", "mark", "started", "cutoff", "done", "error"])

    def close(self) -> None:
        pass


def pass_states(pages: DataFrame) -> DataFrame:
    """A stream of where scopes stand after each page: pages (scope, page, asked, cursor, oldest, all_timed, at)."""
    with_store(pages.sparkSession)
    return pages.groupBy("scope").transformWithStateInPandas(statefulProcessor=Passes(), outputStructType=PASS, outputMode="Update", timeMode="None")


PACED = "scope string, at timestamp, mode string"


class Pace(StatefulProcessor):
    """Outcomes of a scope's requests (at, full, done, failed) set a timer; when it fires, a request goes out: full, refresh or page.

    An outcome takes the place of what was planned for later than it; what was due before it still goes out.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.planned = handle.getMapState("planned", "at long", "mode string")
        self.stand = handle.getValueState("stand", "mode string, full_done long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        mode, full_done = tuple(self.stand.get()) if self.stand.exists() else ("full", 0)
        last = pd.concat(list(rows)).sort_values("at").iloc[-1]
        at = int(last["at"].timestamp())
        if last["failed"]:
            wait = ERROR_WAIT  # what was asked for is asked for again
        elif not last["done"]:
            wait, mode = PAGE_WAIT, "page"
        else:
            full_done = at if last["full"] else full_done
            # a full pass is followed by a look at what changed meanwhile
            wait = PAGE_WAIT if last["full"] else REFRESH
            mode = "full" if not full_done or at + wait - full_done >= RESCAN else "refresh"
        self.stand.update((mode, full_done))
        for timer in list(self.handle.listTimers()):
            if timer > at * 1000:
                self.handle.deleteTimer(timer)
                self.planned.removeKey((timer,))
        self.planned.updateValue(((at + wait) * 1000,), (mode,))
        self.handle.registerTimer((at + wait) * 1000)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        timer = expiredTimerInfo.getExpiryTimeInMs()
        mode = self.planned.getValue((timer,))[0]
        self.planned.removeKey((timer,))
        yield pd.DataFrame([(key[0], pd.Timestamp(timer, unit="ms"), mode)], columns=["scope", "at", "mode"])

    def close(self) -> None:
        pass


def requests(outcomes: DataFrame, late: str = "0 seconds") -> DataFrame:
    """A stream of requests (scope, at, mode) that are due, from outcomes (scope, at, full, done, failed); time is that of `at`."""
    with_store(outcomes.sparkSession)
    return outcomes.withWatermark("at", late).groupBy("scope").transformWithStateInPandas(statefulProcessor=Pace(), outputStructType=PACED, outputMode="Update", timeMode="EventTime")


def follow(spark: SparkSession, pages: DataFrame, out: str, checkpoint: str):
    """Writes the items that a stream of page rows changes below `out`, a folder for each batch; ends when all there is was read.

    A batch that is repeated after a failure writes its own folder again.
    """

    def write(df: DataFrame, number: int) -> None:
        df.drop("batch_rows").write.mode("overwrite").parquet(f"{out.rstrip('/')}/batch={number}")

    return changed_items(pages).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def items(spark: SparkSession, out: str) -> DataFrame:
    return current(spark.read.schema(f"id string, {ITEM}, batch long").parquet(out))
