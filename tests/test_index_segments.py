"""The index by segments and snapshots: small changes, stops between any two writes, batches that go on, mixed versions; and budgets of a scan."""

import os
import random

import pytest
from pyspark.sql import functions as F
from test_xml_and_streams import vehicle

from cellweave.operators import search
from cellweave.plans import saved_index as si
from cellweave.plans import scan as plan
from cellweave.sources import store
from cellweave.sources import xml_source as xs

LIVE = ("manifest", "errors", "features", "postings", "bands", "df", "counts")


def content(spark, out, skip=()):
    drop = {"manifest": "version"} if "version" in skip else {}
    return {n: sorted(map(str, si.table(spark, out, n).drop(drop.get(n, "")).collect())) for n in LIVE}


def put(root, name, cells):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_bytes(vehicle(cells) if isinstance(cells, list) else cells)


def some(seed, n=30):
    r = random.Random(seed)
    return [(x, y, f"k{r.randint(0, 9)}") for x in range(6) for y in range(n // 6)]


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "items"
    for i in range(5):
        put(root, f"{i + 10}/a[{i}].xml", some(i))  # names that are patterns, too
    return root


def test_a_change_writes_its_own_rows(spark, tree, tmp_path):
    out = str(tmp_path / "index")
    si.update(spark, str(tree), out)
    index = si.load(spark, out)
    pinned = si.latest(spark, out)
    before = sorted(map(str, si.live(spark, pinned, "postings").collect()))
    # of an unchanged file nothing is read: other bytes of one length and time go unnoticed
    quiet = tree / "13/a[3].xml"
    was = quiet.stat()
    quiet.write_bytes(quiet.read_bytes().replace(b"k1", b"k2"))
    os.utime(quiet, ns=(was.st_atime_ns, was.st_mtime_ns))
    put(tree, "11/a[1].xml", some(77, 36))
    (tree / "12/a[2].xml").unlink()
    put(tree, "12/b.xml", some(78))
    got = si.update(spark, str(tree), out)
    assert got == {"new": 1, "changed": 1, "skipped": 3, "removed": 1, "failed": 0}
    s = si.latest(spark, out)
    added = si.rows(spark, s, "postings").filter(F.col("seg") > max(pinned.segments)).select("doc_id").distinct().collect()
    assert sorted(r[0].rsplit("/", 1)[1] for r in added) == ["a[1].xml", "b.xml"]
    assert sorted(map(str, si.live(spark, pinned, "postings").collect())) == before  # a reader keeps its snapshot
    assert sorted(map(str, index.postings.collect())) == before and index.files == 5
    put(tree, "13/a[3].xml", some(3))
    os.utime(quiet, ns=(was.st_atime_ns, was.st_mtime_ns))
    fresh = str(tmp_path / "fresh")
    si.update(spark, str(tree), fresh)
    assert content(spark, out) == content(spark, fresh)
    assert len(si.compact(spark, out).segments) == 1
    assert content(spark, out) == content(spark, fresh)
    assert si.vacuum(spark, out) == len(s.segments) and content(spark, out) == content(spark, fresh)


def test_stops_leave_the_old_index(spark, tree, tmp_path, monkeypatch):
    """A stop before any write of a segment or snapshot; what was written is in no snapshot, and the next update does all of it."""
    out = str(tmp_path / "index")
    si.update(spark, str(tree), out)
    old = content(spark, out)
    put(tree, "11/a[1].xml", some(5, 36))
    real, once = si._typed, store.write_once
    for stop in ("features", "dead", "counts", "snapshot"):
        made = []

        def typed(df, name):
            made.append(name)  # noqa: B023
            if name == stop and "manifest" in made:  # noqa: B023
                raise RuntimeError("stopped")
            return real(df, name)

        def refuse(*a):
            raise RuntimeError("stopped")

        monkeypatch.setattr(*(store, "write_once", refuse) if stop == "snapshot" else (si, "_typed", typed))
        with pytest.raises(RuntimeError):
            si.update(spark, str(tree), out)
        monkeypatch.setattr(si, "_typed", real)
        monkeypatch.setattr(store, "write_once", once)
        assert content(spark, out) == old
    assert si.update(spark, str(tree), out)["changed"] == 1
    assert si.vacuum(spark, out) > 0
    fresh = str(tmp_path / "fresh")
    si.update(spark, str(tree), fresh)
    assert content(spark, out) == content(spark, fresh)
    seen = si.latest(spark, out)
    with pytest.raises(Exception, match="exist"):
        si.commit(spark, si.Snapshot(out, seen.number - 1), [])


def test_batches_go_on(spark, tree, tmp_path, monkeypatch):
    out = str(tmp_path / "index")
    real, calls = si.add_files, []

    def stops(*a):
        calls.append(len(a[2]))
        if len(calls) == 2:
            raise RuntimeError("stopped")
        return real(*a)

    monkeypatch.setattr(si, "add_files", stops)
    with pytest.raises(RuntimeError):
        si.update(spark, str(tree), out, batch=2)
    assert si.table(spark, out, "manifest").count() == 2
    assert si.update(spark, str(tree), out, batch=2) == {"new": 3, "changed": 0, "skipped": 2, "removed": 0, "failed": 0}
    assert calls == [2, 2, 2, 1]
    # an upgrade: one file is gone, one can't be read any more, and it was stopped half-way
    (tree / "10/a[0].xml").unlink()
    put(tree, "11/a[1].xml", b"<vehicle><bodies>")
    calls[:] = []
    with pytest.raises(RuntimeError):
        si.upgrade(spark, out, version=2, batch=2)
    m = si.table(spark, out, "manifest")
    assert m.count() == 5 and m.filter("version = 2").count() == 0
    calls[:] = [0, 0]
    assert si.upgrade(spark, out, version=2, batch=2, most=1)["errors"] == 1
    got = si.upgrade(spark, out, version=2, batch=2, most=3)
    assert got == {"examined": 4, "upgraded": 2, "missing_files": 1, "errors": 1, "remaining_legacy_files": 3}
    # both versions are searched, and the file that is no more
    q = si.xml_features(xs.parse_rows(spark.createDataFrame([("q", bytearray(vehicle(some(0))))], "path string, content binary"))).withColumnRenamed("doc_id", "query_id")
    assert plan.scan(si.load(spark, out), q).first()["doc_id"].endswith("10/a[0].xml")


def test_the_older_layout_is_taken_over(spark, tree, tmp_path):
    new, old = str(tmp_path / "new"), str(tmp_path / "old")
    si.update(spark, str(tree), new)
    for name in ("manifest", "errors", "features", "postings", "df", "bands"):
        si.table(spark, new, name).write.parquet(f"{old}/{name}")
    assert content(spark, old, ["version"]) == content(spark, new, ["version"])
    assert {r["version"] for r in si.table(spark, old, "manifest").collect()} == {0}
    assert si.upgrade(spark, old)["remaining_legacy_files"] == 0
    assert content(spark, old) == content(spark, new)


def walk(terms, buckets, n, most, total):
    """A query's probes one at a time."""
    cutoff = max(32, min(2000, -(-n * 2 // 100)))
    probes = sum(min(b, cutoff + 1) for b in buckets)
    left, chosen = sorted(terms), []
    for level in sorted({min(cutoff, x) for x in (32, 128, 512, cutoff)}):
        later = []
        for place, channel, h, df in left:
            budget = most - probes
            if budget < 2:
                break
            limit = min(level + 1, budget)
            seen = min(df, limit)
            probes += seen
            if seen < limit:
                chosen.append((df, channel, h))
            else:
                later.append((place, channel, h, df))
        left = later
    out, used = [], 0
    for df, channel, h in sorted(chosen):
        if df > total - probes - used:
            break
        used += df
        out.append((channel, h, df))
    return sorted(out)


@pytest.mark.parametrize("n", [100, 9_000, 200_000])
def test_budgets_of_a_query(spark, n):
    r = random.Random(n)
    terms, buckets, want = [], [], {}
    for q in range(25):
        own = [(i, r.choice("gwlm"), f"h{i}", r.choice([1, 2, 31, 32, 33, 128, 129, 500, 512, 513, 1999, 2001, 5000])) for i in range(r.randint(0, 60))]
        full = [r.randint(1, 3000) for _ in range(r.randint(0, 16))]
        terms += [(q, *t) for t in own]
        buckets += [(q, b) for b in full]
        want[q] = walk(own, full, n, 6000, 9000)
    got = {q: [] for q in want}
    d = search.probed(spark.createDataFrame(terms, "query_id int, place int, channel string, hash string, df long"), spark.createDataFrame(buckets, "query_id int, df long"), n, 6000, 9000)
    for x in d.collect():
        got[x.query_id].append((x.channel, x.hash, x.df))
    assert {q: sorted(v) for q, v in got.items()} == want
    assert any(want.values())


def test_a_query_of_controllers_only(spark):
    """Two rare controllers are enough where a query has no geometry, and not where it has some that isn't shared."""
    row = lambda i, c, h: (i, h, 1, 0, 0, 0, c)
    rows = [row("a", "m", "m1"), row("a", "m", "m2"), *[row("a", "g", f"g{i}") for i in range(6)], row("b", "g", "other")]
    schema = "{} string, hash string, cnt long, x long, y long, z long, channel string"
    index = plan.build(spark.createDataFrame(rows, schema.format("doc_id")), 2)
    q = [row("bare", "m", "m1"), row("bare", "m", "m2"), row("solid", "m", "m1"), row("solid", "m", "m2"), row("solid", "g", "mine")]
    got = {r.query_id: (r.confidence, r.status) for r in plan.scan(index, spark.createDataFrame(q, schema.format("query_id"))).collect()}
    assert got == {"bare": ("medium", "possible shared controller"), "solid": ("low", "no strong match in indexed set")}


def test_older_forms_in_one_scan(spark):
    """Files of an older form are found by the older rule; one that the newer form finds isn't compared twice."""
    row = lambda i, c, h, n=0: (i, h, 1, n, 0, 0, c)
    schema = "{} string, hash string, cnt long, x long, y long, z long, channel string"
    frame = lambda rows, key: spark.createDataFrame(rows, schema.format(key))
    new = [row("both", "g", f"n{i}", i) for i in range(12)] + [row("other", "g", f"o{i}", i) for i in range(9)]
    old = [row(d, "g", f"v{i}", i) for d in ("both", "old") for i in range(12)] + [row("far", "g", f"u{i}", i) for i in range(9)]
    index = plan.build(frame(new, "doc_id"), 4)
    q, was = frame([row("q", "g", f"n{i}", i) for i in range(12)], "query_id"), frame([row("q", "g", f"v{i}", i) for i in range(10)], "query_id")
    got = [(r.doc_id, r.older, r.shared) for r in plan.scan(index, q, older=plan.Older(frame(old, "doc_id"), was)).orderBy("place").collect()]
    assert got == [("both", False, 12), ("old", True, 10)]
    assert [r.doc_id for r in plan.scan(index, q).collect()] == ["both"]


def test_text_reports(spark, tree, tmp_path, capsys):
    from cellweave.__main__ import main

    out = str(tmp_path / "index")
    main(["index", str(tree), out])
    capsys.readouterr()
    main(["--text", "status", out])
    lines = [x for x in capsys.readouterr().out.splitlines() if "\t" in x]
    assert lines == ["files\tcurrent\titems\terrors", "5\t5\t5\t0"]
    main(["compact", out])
    main(["vacuum", out])
    assert '{"dropped": 1}' in capsys.readouterr().out
