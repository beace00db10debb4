import json

import pytest

from cellweave.sources import xml_source as xs
from cellweave.streaming import catalog_stream as cs

PART = '<c d="{k}" t="1.0"><o sc="{c}"><vp x="{x}" y="{y}" z="0"/></o></c>'


def vehicle(parts, extra="", colour="1"):
    return ("<vehicle><bodies><body><components>" + "".join(PART.format(k=k, x=x, y=y, c=colour) for x, y, k in parts) + "</components></body></bodies>" + extra + "</vehicle>").encode()


PARTS = [(x, y, f"k{(x * y) % 3}") for x in range(6) for y in range(3)]


def bag(df):
    return sorted((r["hash"], r["cnt"]) for r in df.collect())


def features(spark, data):
    from cellweave.operators import grid

    rows = xs.parse_rows(spark.createDataFrame([("a", bytearray(data))], "path string, content binary"))
    return bag(grid.neighbourhood_features(xs.cells(rows))), bag(grid.winnow_features(xs.cells(rows)))


def test_looks_and_order_do_not_matter(spark):
    a = features(spark, vehicle(PARTS))
    assert a == features(spark, vehicle([(x + 9, y - 4, k) for x, y, k in PARTS[::-1]], colour="77")) and a[0] and a[1]


def test_repair():
    fixed = xs.repaired(b'<vehicle a="x>y" 00="1" value="2" value="3"><!-- <b 0="1"> --><b 0=\'1\'/></vehicle>')
    assert fixed == b'<vehicle a="x>y" sw_00="1" value="2" value__dup2="3"><!-- <b 0="1"> --><b sw_0=\'1\'/></vehicle>'
    assert xs.parsed(b'<vehicle 00="1" value="2" value="3"/>').tag == "vehicle"


@pytest.mark.parametrize("data", [b'<!DOCTYPE x><vehicle/>', b"<other/>", b"<vehicle>", b'<vehicle><!ENTITY a "b"></vehicle>'])
def test_refused(data):
    with pytest.raises(ValueError):
        xs.parsed(data)


CONTROLLER = """<c d="controller"><o><vp x="50" y="0" z="0"/><microprocessor_definition name="m"><nodes><n component_id="{a}" built_slot_index="0"><node mode="1" type="0" flags="0"/></n></nodes>
<group><components><c type="8"><object id="{a}"/></c><c type="56"><object id="{b}" script="{s}"><in1 component_id="{a}" node_index="0"/></object></c><c type="6"><object id="{c}"><in1 component_id="{b}"/></object></c></components></group></microprocessor_definition></o></c>"""
LINK = '<logic_node_links><logic_node_link type="2"><voxel_pos_0 x="0" y="0" z="0"/><voxel_pos_1 x="1" y="0" z="0"/></logic_node_link></logic_node_links>'


def semantic(spark, a=10, b=20, c=30, s="x = 1 " * 20, link=LINK):
    data = vehicle(PARTS, link).replace(b"</components></body>", CONTROLLER.format(a=a, b=b, c=c, s=s).encode() + b"</components></body>", 1)
    logic, micro = xs.semantic_features(xs.parse_rows(spark.createDataFrame([("a", bytearray(data))], "path string, content binary")))
    return bag(logic), bag(micro)


def test_controllers(spark):
    base = semantic(spark)
    assert len(base[0]) == 1 and len(base[1]) == 2
    assert base == semantic(spark, a=7, b=8, c=9)
    assert base[1] != semantic(spark, s="y = 2 " * 20)[1]
    assert base[0] != semantic(spark, link=LINK.replace('type="2"', 'type="3"'))[0]


def test_scan_and_geometry(spark, tmp_path):
    (tmp_path / "123").mkdir()
    (tmp_path / "123" / "v.xml").write_bytes(vehicle(PARTS))
    (tmp_path / "own.xml").write_bytes(b"<microcontroller/>")
    files = xs.scan(spark, str(tmp_path)).cache()
    from pyspark.sql import functions as F

    got = {r["item_id"]: r["v"] for r in files.select("item_id", xs.sniffed(F.col("content").cast("string")).alias("v")).collect()}
    assert got == {"123": True, "local": False}
    points = xs.geometry(files.filter("item_id = '123'")).collect()
    assert len(points) == len(PARTS) and points[0]["kind"] == "k0" and points[0]["category"] == "structure"
    errors = xs.parse_rows(files).filter("error IS NOT NULL").collect()
    assert len(errors) == 1


def page(folder, n, rows, cursor):
    (folder / f"{n:03d}.json").write_text("\n".join(json.dumps({"id": i, "title": t, "updated": u, "size_bytes": 1, "seq": k, "cursor": cursor}) for k, (i, t, u) in enumerate(rows)))


def test_catalog_stream(spark, tmp_path):
    pages = tmp_path / "pages"
    pages.mkdir()
    page(pages, 1, [("1", "a", 10), ("2", "b", 20)], "c1")
    args = (spark, str(pages), str(tmp_path / "state"), str(tmp_path / "ck"))
    cs.run(*args, started=10**7).awaitTermination()
    state = cs.State(spark, str(tmp_path / "state"))
    assert state.version() == 0 and state.values()["seen"] == ["c1"] and "mark" not in state.values()
    page(pages, 2, [("1", None, 30)], None)
    cs.run(*args, started=2 * 10**7).awaitTermination()
    assert state.values()["mark"] == 10**7 and cs.cutoff(state.values()) == 10**7 - cs.OVERLAP
    assert {r["id"]: (r["title"], r["updated"]) for r in state.items().collect()} == {"1": ("a", 30), "2": ("b", 20)}


def test_repeated_cursor_keeps_state(spark, tmp_path):
    state = cs.State(spark, str(tmp_path / "s"))
    row = lambda c: spark.createDataFrame([("1", "a", 10, 1, 0, c)], cs.PAGES)
    cs.merge_batch(state, row("c1"), 0, 5)
    with pytest.raises(cs.RepeatedCursor):
        cs.merge_batch(state, row("c1"), 1, 5)
    assert state.version() == 0
    cs.merge_batch(state, row("c9"), 0, 5)  # a batch that was done is not done again
    assert state.values()["seen"] == ["c1"]


def api_page(folder, name, rows, cursor):
    (folder / f"{name}.json").write_text(json.dumps({"response": {"result": 1, "publishedfiledetails": rows, "next_cursor": cursor}}))


def test_pages_source(spark, tmp_path):
    from cellweave.sources.pages import PagesSource

    spark.dataSource.register(PagesSource)
    row = {"publishedfileid": "7", "title": "t", "file_size": "12", "time_updated": 5, "tags": [{"tag": " Air "}], "result": 1}
    api_page(tmp_path, "start", [row, {"publishedfileid": None}, {**row, "publishedfileid": "8", "result": 9}], "b")
    api_page(tmp_path, "b", [{**row, "publishedfileid": "9", "file_size": "x", "tags": None}], None)
    got = {r.id: r for r in spark.read.format("pages").option("path", str(tmp_path)).load().collect()}
    assert set(got) == {"7", "9"} and got["7"].tags == ["Air"] and got["9"].size_bytes is None and got["9"].tags is None
    q = spark.readStream.format("pages").option("path", str(tmp_path)).load().writeStream.format("memory").queryName("pages_out").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("pages_out").count() == 2
    api_page(tmp_path, "b", [row], "start")
    with pytest.raises(Exception, match="came again"):
        spark.read.format("pages").option("path", str(tmp_path)).load().count()


def told(capsys):
    return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]


def test_index_is_brought_up_to_date(spark, tmp_path, capsys):
    """New, changed, skipped, removed and failed files; a scan of the saved index finds what a new one would."""
    from cellweave.__main__ import main
    from cellweave.plans import saved_index

    root, out = tmp_path / "items", str(tmp_path / "index")
    put = lambda name, data: ((root / name).parent.mkdir(parents=True, exist_ok=True), (root / name).write_bytes(data))
    big = [(x, y, f"k{(x * 7 + y) % 5}") for x in range(12) for y in range(6)]
    put("11/a.xml", vehicle(big))
    put("12/b.xml", vehicle([(x, y, "q") for x, y, _ in big[:30]]))
    put("12/c.xml", vehicle(PARTS))
    put("13/broken.xml", b"<vehicle><bodies>")
    put("13/small.xml", vehicle(PARTS[:2]))
    main(["index", str(root), out])
    assert told(capsys) == [{"new": 5, "changed": 0, "skipped": 0, "removed": 0, "failed": 2}]
    main(["errors", out])
    assert sorted(r["error"].split(":")[0] for r in told(capsys))[-1] == "too few components"
    (root / "12/c.xml").unlink()
    put("12/b.xml", vehicle([(x, y, "other") for x, y, _ in big[:33]]))
    put("14/d.xml", vehicle([(x + 3, y, k) for x, y, k in big]))
    main(["index", str(root), out])
    assert told(capsys) == [{"new": 3, "changed": 1, "skipped": 1, "removed": 1, "failed": 2}]
    main(["status", out])
    assert told(capsys) == [{"files": 3, "current": 3, "items": 3, "errors": 2}]
    fresh = str(tmp_path / "fresh")
    saved_index.update(spark, str(root), fresh)
    for name in ("features", "postings", "df", "bands", "manifest", "errors"):
        assert sorted(map(str, saved_index.table(spark, out, name).collect())) == sorted(map(str, saved_index.table(spark, fresh, name).collect()))
    main(["scan", str(root / "11/a.xml"), out, "--limit", "2"])
    assert sorted(r["item_id"] for r in told(capsys)) == ["11", "14"]
    main(["upgrade", str(root), out, "--version", "2"])
    assert told(capsys)[0]["changed"] == 3


def test_small_exact_copies_are_reported(spark):
    """Four components are under all limits, and an exact copy is a match all the same."""
    from cellweave.plans import saved_index
    from cellweave.plans import scan as plan

    small = vehicle(PARTS[:4])
    rows = xs.parse_rows(spark.createDataFrame([("a", bytearray(small)), ("b", bytearray(vehicle(PARTS)))], "path string, content binary"))
    query = saved_index.xml_features(xs.parse_rows(spark.createDataFrame([("q", bytearray(small))], "path string, content binary"))).withColumnRenamed("doc_id", "query_id")
    got = plan.scan(plan.build(saved_index.xml_features(rows), 2), query).collect()
    assert [(r.doc_id, r.small_exact, r.confidence) for r in got if r.small_exact] == [("a", True, "low")]


def test_promotion(spark, tmp_path):
    from cellweave.sources import store

    target = str(tmp_path / "t")
    store.replace_table(spark.range(3), target)
    store.replace_table(spark.read.parquet(target).union(spark.range(2)), target)
    assert spark.read.parquet(target).count() == 5 and [p.name for p in tmp_path.iterdir()] == ["t"]
    with pytest.raises(ValueError):
        store.promote(spark, str(tmp_path / "none"), target)
    assert spark.read.parquet(target).count() == 5


def test_workers_by_brute_force(spark):
    import random

    from pyspark.sql import functions as F

    from cellweave.operators import gates

    r = random.Random(5)
    rows = [[r.random() < 0.3 for _ in range(r.randint(0, 30))] for _ in range(40)]
    got = [x.w for x in spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, r array<boolean>").orderBy("i").select(gates.workers_after(F.col("r"), 8).alias("w")).collect()]
    for chunks, w in zip(rows, got, strict=True):
        n, calm = 8, 0
        for limited in chunks:
            if limited:
                n, calm = max(1, n // 2), 0
            elif calm >= 1 and n < 8:
                n, calm = n + 1, 0
            else:
                calm += 1
        assert w == n


def test_unreadable_geometry_is_told(spark):
    d = spark.createDataFrame([("good", bytearray(vehicle(PARTS))), ("bad", bytearray(vehicle(PARTS)[:-40]))], "path string, content binary")
    got = xs.geometry(d).groupBy("doc_id").agg({"x": "count", "error": "count"}).collect()
    assert sorted((r["doc_id"], r["count(x)"], r["count(error)"]) for r in got) == [("bad", 0, 1), ("good", 18, 0)]


def test_folders(spark, tmp_path):
    from cellweave.sources.folders import installed

    for name in ("12", "x1"):
        (tmp_path / name).mkdir()
    assert [r.id for r in installed(spark, str(tmp_path)).collect()] == ["12"]


def test_reports(spark):
    from pyspark.sql import functions as F

    from cellweave.operators import report

    d = spark.createDataFrame([("HTTP 429",), ("status code: 429",), ("id 4291",), ("Too many requests",)], "t string")
    assert [r[0] for r in d.select(report.asked_too_often(F.col("t"))).collect()] == [True, True, False, True]
    r = spark.createDataFrame([("f", [("g", "h")])], "file string, evidence array<struct<channel:string,fingerprint:string>>")
    assert report.redacted(r).dtypes == [("evidence", "array<struct<channel:string>>")]
    assert spark.range(1).select(report.source_label(F.lit("12"), F.lit("x"), True)).first()[0] == "Catalog (shared index)"
