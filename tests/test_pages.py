"""The page source: filters that reach the reader, partitions, offsets of one size, cycles; and pages by Spark's own readers."""

import json

import pytest
from pyspark.sql import functions as F

from cellweave.sources import pages as ps


def put(folder, cursor, rows, following):
    (folder / f"{cursor}.json").write_text(json.dumps({"response": {"result": 1, "publishedfiledetails": rows, "next_cursor": following}}))


def item(i):
    tags = {0: [{"tag": "Air"}, {"tag": "Fast"}], 1: [{"tag": "air"}], 2: None}[i % 3]
    return {"publishedfileid": str(i), "title": f"t{i}", "time_updated": 1000 + i, "file_size": i % 5, "consumer_app_id": 7 + i % 2, **({} if tags is None else {"tags": tags})}


@pytest.fixture
def chain(tmp_path):
    n = 130
    for k in range(n):
        put(tmp_path, "start" if k == 0 else f"c{k}", [item(2 * k), item(2 * k + 1), {"result": 9, "publishedfileid": "x"}], None if k == n - 1 else f"c{k + 1}")
    return tmp_path


def test_filters_reach_the_reader(spark, chain, capsys):
    ps.register(spark)
    d = spark.read.format("pages").option("path", str(chain)).load()
    assert d.count() == 260 and d.rdd.getNumPartitions() == 3
    got = ps.tagged(d, ["AIR"], ["fast"]).filter((F.col("updated") >= 1100) & (F.col("app") == "8"))
    want = [i for i in range(100, 260) if i % 3 == 1 and i % 2 == 1]
    assert sorted(int(r.id) for r in got.collect()) == want
    got.explain("formatted")
    plan = capsys.readouterr().out
    assert all(x in plan for x in ("StringContains(tag_text,|air|)", "Not(StringContains(tag_text,|fast|))", "GreaterThanOrEqual(updated,1100)", "EqualTo(app,8)"))
    assert ") Filter" not in plan and "* Filter" not in plan  # the reader has applied them
    assert {r.id for r in d.filter("title LIKE '%5' AND id IN ('5', '6', '15')").collect()} == {"5", "15"}
    assert d.filter(F.length("title") == 2).count() == 10  # one that the reader can't apply


def test_an_offset_of_one_size(spark, chain):
    ps.register(spark)
    out = spark.readStream.format("pages").option("path", str(chain)).load().writeStream.format("memory").queryName("paged").option("checkpointLocation", str(chain / "ck")).start()
    out.processAllAvailable()
    sizes = [len(p["sources"][0]["endOffset"] if isinstance(p["sources"][0]["endOffset"], str) else json.dumps(p["sources"][0]["endOffset"])) for p in out.recentProgress if p["sources"][0]["endOffset"]]
    out.stop()
    assert spark.table("paged").select("id").distinct().count() == 260 == spark.table("paged").count()
    assert max(sizes) < 200


@pytest.mark.parametrize(("lead", "loop"), [(0, 1), (3, 5), (20, 2)])
def test_cycles_are_found(tmp_path, lead, loop):
    names = ["start", *[f"c{k}" for k in range(1, lead + loop)]]
    for k, name in enumerate(names):
        put(tmp_path, name, [], names[k + 1] if k + 1 < len(names) else names[lead])
    s = ps.PagesStream({"path": str(tmp_path)})
    with pytest.raises(ValueError, match="came again"):
        for _ in range(10):
            s.latestOffset()


def test_pages_by_sparks_readers(spark, chain):
    ps.register(spark)
    cols = ["id", "title", "updated", "size_bytes", "app", "tags"]
    key = lambda d: sorted(map(str, d.select(cols).collect()))
    want = key(spark.read.format("pages").option("path", str(chain)).load())
    log = ps.logged(spark.read, str(chain))
    assert key(log) == want and log.filter("asked = 'c5'").first()["cursor"] == "c6"
    q = ps.logged(spark.readStream, str(chain)).writeStream.format("memory").queryName("logged_pages").option("checkpointLocation", str(chain / "ck2")).start()
    q.processAllAvailable()
    q.stop()
    assert key(spark.table("logged_pages")) == want
