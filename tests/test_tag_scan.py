"""The chunked tag scanner against the whole parse, its limits and its memory."""

import random
import tracemalloc

import pytest
from test_xml_and_streams import PARTS, vehicle

from cellweave.sources import tag_scan as ts
from cellweave.sources import xml_source as xs

ODD = (
    b"<?xml version='1.0'?><vehicle name='a > b'><!-- <c><vp x='90' y='0' z='0'/></c> --><![CDATA[<c><vp x='91' y='0' z='0'/></c>]]>"
    b"<c d='Engine&amp;Co'><o><vp x='1' y='2' z='3'/><vp x='q' y='2' z='3'/><vp x='1'/></o></c><c type=\"it's > that\"><o><vp z='-3' y='2' x='1'/></o></c><vp x='7' y='7' z='7'/>"
    b"<n:c t='deep'><c><vp x='4' y='4' z='4'/></c><vp x='5' y='5' z='5'/></n:c></vehicle>"
)


def scanned(data, size):
    tags, points, out = ts.Tags(), ts.Points(), []
    for i in range(0, len(data), size):
        out += [p for t in tags.feed(data[i : i + size]) if (p := points.of(t)) is not None]
    tags.close()
    points.close()
    return out


def test_any_cut_gives_the_same():
    want = [(i, *p[2:]) for i, p in enumerate(xs.points_of(ODD.replace(b"n:c", b"c"), "k"))]
    for size in (*range(1, 40), 1000):
        assert scanned(ODD, size) == want
    assert [p[4] for p in want] == ["engine&co", "it's > that", "", "deep"]


@pytest.mark.parametrize(
    ("data", "error"),
    [
        (b"", "empty"), (b"<html><vehicle/>", "root"), (b"text", "root"), (b"<vehicle></vehicle>", "no points"), (b"<!DOCTYPE x><vehicle/>", "DTDs"),
        (b"<vehicle><c><vp x='1' y='1' z='1'/></c><!-- ", "comment"), (b"<vehicle><![CDATA[ ]]", "character data"), (b"<vehicle><c d='<vp>", "tag without"), (b"<vehicle><c d='" + b"a" * (3 << 20), "2 MiB"),
    ],
)
def test_errors(spark, data, error):
    rows = ts.geometry(spark.createDataFrame([("k", bytearray(data))], "path string, content binary")).collect()
    assert [r.error for r in rows if r.error is not None] and error in rows[-1].error and rows[-1].doc_id == "k"


def test_against_the_whole_parse(spark):
    r = random.Random(2)
    files = [(f"f{i}", bytearray(vehicle([(r.randint(-99, 99), r.randint(-9, 9), f"k{r.randint(0, 5)}") for _ in range(r.randint(4, 400))]))) for i in range(12)]
    files += [("p", bytearray(vehicle(PARTS))), ("odd", bytearray(ODD.replace(b"n:c", b"c")))]
    d = spark.createDataFrame(files, "path string, content binary")
    cols = ["doc_id", "idx", "x", "y", "z", "kind", "category", "error"]
    want = sorted(map(str, xs.geometry(d).select(cols).collect()))
    for size in (50, ts.CHUNK):
        assert sorted(map(str, ts.geometry(d, size=size).select(cols).collect())) == want
    assert ts.geometry(d.limit(0)).count() == 0


def test_memory_is_a_chunk_and_a_tag():
    """60 MB in chunks, with a tag of a megabyte among them."""
    part = b"<c d='block' note='" + b"x" * 900 + b"'><o><vp x='1' y='2' z='3'/></o></c>" * 1
    tags, points, n = ts.Tags(), ts.Points(), 0
    tracemalloc.start()
    for data in [b"<vehicle>", b"<c d='" + b"y" * (1 << 20) + b"'/>", *([part * 64] * 970), b"</vehicle>"]:
        for tag in tags.feed(data):
            n += points.of(tag) is not None
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    tags.close()
    assert n == 64 * 970 and most < 8 << 20
