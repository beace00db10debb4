"""The catalog as keyed state, over streams of files."""

import datetime as dt
import json
import os

import pytest

from cellweave.operators import catalog
from cellweave.streaming import catalog_state as cs

ROW = "id string, title string, updated long, size_bytes long, seq long"


@pytest.fixture
def put(tmp_path):
    def write(folder, number, rows):
        (tmp_path / folder).mkdir(exist_ok=True)
        path = tmp_path / folder / f"{number:04d}.json"
        path.write_text("\n".join(map(json.dumps, rows)))
        os.utime(path, (1_700_000_000 + number,) * 2)  # files are read in the order of their times

    return write


def stream(spark, tmp_path, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / folder))


def test_items_by_key(spark, tmp_path, put):
    """State gives what the table's upsert gives; a batch puts out its own items only; a restart repeats nothing."""
    rows = [
        [{"id": "1", "title": "a", "updated": 10, "size_bytes": 5, "seq": 0}, {"id": "2", "title": "b", "updated": 20, "seq": 1}],
        [{"id": "1", "updated": 30, "seq": 2}, {"id": "1", "title": "late", "updated": 5, "seq": 3}, {"id": "3", "size_bytes": 7, "seq": 4}],
        [{"id": "2", "title": "b", "updated": 20, "seq": 5}],
    ]
    args = (str(tmp_path / "out"), str(tmp_path / "ck"))
    for k, page in enumerate(rows[:2]):
        put("pages", k, page)
    cs.follow(spark, stream(spark, tmp_path, "pages", ROW), *args).awaitTermination()
    put("pages", 2, rows[2])
    q = cs.follow(spark, stream(spark, tmp_path, "pages", ROW), *args)
    q.awaitTermination()
    assert sum(p["numInputRows"] for p in q.recentProgress) == 1  # earlier pages aren't read again
    got = sorted(map(tuple, cs.items(spark, args[0]).collect()))
    want = spark.createDataFrame([], f"id string, {cs.ITEM}")
    for page in rows:
        want = catalog.upserted(want, spark.createDataFrame([tuple(r.get(c) for c in ("id", "title", "updated", "size_bytes", "seq")) for r in page], ROW))
    assert got == sorted(map(tuple, want.collect()))
    batches = spark.read.parquet(args[0]).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in batches) == [2, 2]  # the last page changed nothing


def test_passes(spark, tmp_path, put):
    """Marks move when a pass ends, by its last page or by its times; a cursor that comes again is told and changes nothing."""
    page = lambda n, asked, cursor, at, oldest=None, timed=False: {"scope": "s", "page": n, "asked": asked, "cursor": cursor, "oldest": oldest, "all_timed": timed, "at": at}
    day = 86_400
    seen = [page(0, "*", "c1", 100 * day), page(1, "c1", "*", 101 * day), page(2, "c1", "c2", 102 * day), page(3, "c2", None, 103 * day)]
    seen += [page(4, "*", "c1", 200 * day, 150 * day, True), page(5, "c1", "c2", 201 * day, 92 * day, True)]
    for k, p in enumerate(seen):
        put("passes", k, [p])
    d = stream(spark, tmp_path, "passes", "scope string, page long, asked string, cursor string, oldest long, all_timed boolean, at long")
    q = cs.pass_states(d).writeStream.outputMode("update").format("memory").queryName("passes").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.page, r.mark, r.done, r.error) for r in spark.table("passes").orderBy("page").collect()]
    assert got == [(0, 0, False, None), (1, 0, False, "cursor '*' came again"), (2, 0, False, None), (3, 100 * day, True, None), (4, 100 * day, False, None), (5, 200 * day, True, None)]


def test_pace(spark, tmp_path, put):
    """The next page after a minute, an error's wait, six hours between passes, and a full pass once a month."""
    start = dt.datetime(2024, 1, 1)
    at = lambda s: (start + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S")
    row = lambda s, **k: {"scope": "s", "at": at(s), "full": False, "done": False, "failed": False} | k
    hour = 3600
    clock = lambda s: row(s, scope="clock")
    told = [row(0), clock(65), row(70, failed=True), clock(1000), row(1010), clock(1100), row(1105, full=True, done=True), clock(1200), row(1205, done=True), clock(1205 + 6 * hour + 1)]
    told += [row(31 * 24 * hour, done=True), clock(32 * 24 * hour), row(32 * 24 * hour + 5), row(32 * 24 * hour + 6, done=True, full=True), clock(33 * 24 * hour), clock(34 * 24 * hour)]
    for k, r in enumerate(told):
        put("outcomes", k, [r])
    d = stream(spark, tmp_path, "outcomes", "scope string, at timestamp, full boolean, done boolean, failed boolean")
    q = cs.requests(d).writeStream.outputMode("update").format("memory").queryName("requests").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = [(int((r["at"] - start).total_seconds()), r["mode"]) for r in spark.table("requests").filter("scope = 's'").orderBy("at").collect()]
    end = 32 * 24 * hour
    # the page that was planned after end + 5 was overtaken by the outcome after it
    assert got == [(60, "page"), (970, "page"), (1070, "page"), (1165, "refresh"), (1205 + 6 * hour, "refresh"), (31 * 24 * hour + 6 * hour, "full"), (end + 66, "refresh")]
