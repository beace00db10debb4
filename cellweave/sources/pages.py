"""A Spark data source for a catalog's pages: batch and stream over JSON files that stand for an API.

Each file is one page: {"response": {"result": 1, "publishedfiledetails": [...], "next_cursor": "..."}}.
A page's name is the cursor that asks for it; the first is "start.json".

Filters reach the reader: on ids, apps, times, sizes and titles, and on tags by the column
tag_text, which holds them in lower case between bars (see `tagged`); what the reader has
applied, Spark doesn't apply again.  A batch reads its pages in partitions of PAGES; only
the chain of cursors is followed first.  The stream's offset is of one size however far it is: the
next cursor and page, and one cursor remembered at page numbers that double (Brent's
search for a cycle), so that a chain that comes back to itself ends with an error.

`logged` reads a folder of pages that were fetched in any order, through Spark's own readers.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not, StringContains

SCHEMA = "page long, cursor string, id string, title string, updated long, size_bytes long, app string, tags array<string>, seq long, tag_text string"
NAMES = [f.split(" ")[0] for f in SCHEMA.split(", ")]
#: Pages of a partition, and of a batch of the stream.
PAGES = 50


def whole(value) -> int | None:
    try:
        return int(value)
    except (TypeError, ValueError):
        return None


def rows_of(page: dict, number: int) -> list[tuple]:
    """Rows of a page that have an id; sizes above 0, tags null where the row has none."""
    response = page.get("response") or {}
    cursor = response.get("next_cursor") or None
    out = []
    for k, r in enumerate(response.get("publishedfiledetails") or []):
        if not r.get("publishedfileid") or r.get("result", 1) != 1:
            continue
        size = whole(r.get("file_size"))
        tags = [str(t.get("tag", "") if isinstance(t, dict) else t).strip() for t in r["tags"]] if r.get("tags") is not None else None
        app = r.get("consumer_app_id", r.get("consumer_appid"))
        said = None if tags is None else "|" + "|".join(t.casefold() for t in tags) + "|"
        out.append((number, cursor, str(r["publishedfileid"]), r.get("title"), whole(r.get("time_updated")), size if size and size > 0 else None, None if app is None else str(app), tags, number * 10_000 + k, said))
    return out


def follow(folder: str, cursor: str, seen: set[str]) -> tuple[dict, str | None]:
    """The page that a cursor asks for, and the next cursor."""
    if cursor in seen:
        raise ValueError(f"cursor {cursor!r} came again")
    with open(os.path.join(folder, f"{cursor}.json"), encoding="utf-8") as f:
        page = json.load(f)
    return page, (page.get("response") or {}).get("next_cursor") or None


def walk(folder: str, cursor: str | None, number: int) -> Iterator[tuple[int, str]]:
    """(number, cursor) of all pages from a cursor on."""
    seen: set[str] = set()
    while cursor:
        yield number, cursor
        _, following = follow(folder, cursor, seen)
        seen.add(cursor)
        cursor, number = following, number + 1


_COMPARE = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b, StringContains: lambda a, b: b in a, IsNotNull: lambda a, b: True}
_PUSHED = {"id", "title", "updated", "size_bytes", "app", "tag_text"}


def test_of(f: Filter):
    """(column, comparison, value, whether it is negated) of a filter that the reader can apply, else None."""
    inner, negated = (f.child, True) if isinstance(f, Not) and not isinstance(f.child, IsNotNull) else (f, False)
    compare = _COMPARE.get(type(inner))
    if compare is None or len(inner.attribute) != 1 or inner.attribute[0] not in _PUSHED:
        return None
    return inner.attribute[0], type(inner), getattr(inner, "value", None), negated


class PagesSource(DataSource):
    """spark.dataSource.register(PagesSource); spark.read.format("pages").option("path", folder).load()."""

    @classmethod
    def name(cls) -> str:
        return "pages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return PagesReader(self.options)

    def streamReader(self, schema):
        return PagesStream(self.options)


class Pages(InputPartition):
    def __init__(self, pages: list[tuple[int, str]]):
        super().__init__(0)
        self.pages = pages


class PagesReader(DataSourceReader):
    """Pages in partitions."""

    def __init__(self, options):
        self.folder, self.tests = options["path"], []

    def partitions(self):
        pages = list(walk(self.folder, "start", 0))
        return [Pages(pages[i : i + PAGES]) for i in range(0, len(pages), PAGES)]

    def passes(self, row: tuple) -> bool:
        """Whether the pushed filters let a row through; a null in a compared column passes none, as in SQL."""
        for column, kind, value, negated in self.tests:
            x = row[NAMES.index(column)]
            if x is None or bool(_COMPARE[kind](x, value)) is negated:
                return False
        return True

    def read(self, partition):
        for number, cursor in partition.pages:
            page, _ = follow(self.folder, cursor, set())
            yield from filter(self.passes, rows_of(page, number))


class FilteringReader(PagesReader):
    def pushFilters(self, filters):
        for f in filters:
            test = test_of(f)
            if test is None:
                yield f
            else:
                self.tests.append(test)


class FilteredPages(PagesSource):
    """The same for sessions in which filters are pushed to Python sources."""

    def reader(self, schema):
        return FilteringReader(self.options)


class PagesStream(DataSourceStreamReader):
    """At most PAGES pages a batch; the offset is {page, next, mark, power}."""

    def __init__(self, options):
        self.folder = options["path"]
        self.at: dict | None = None

    def initialOffset(self):
        return {"page": 0, "next": "start", "mark": None, "power": 1}

    def latestOffset(self):
        at = self.at or self.initialOffset()
        for _ in range(PAGES):
            cursor = at["next"]
            if not cursor or not os.path.exists(os.path.join(self.folder, f"{cursor}.json")):
                break
            if cursor == at["mark"]:
                raise ValueError(f"cursor {cursor!r} came again")
            mark, power = (cursor, at["power"] * 2) if at["page"] + 1 == at["power"] else (at["mark"], at["power"])
            _, following = follow(self.folder, cursor, set())
            at = {"page": at["page"] + 1, "next": following, "mark": mark, "power": power}
        self.at = at
        return at

    def partitions(self, start, end):
        self.at = end  # where a restart goes on
        n = end["page"] - start["page"]
        pages, cursor = [], start["next"]
        for k in range(n):
            pages.append((start["page"] + k, cursor))
            cursor = follow(self.folder, cursor, set())[1]
        return [Pages([p]) for p in pages] or [Pages([])]

    def read(self, partition):
        for number, cursor in partition.pages:
            page, _ = follow(self.folder, cursor, set())
            yield from rows_of(page, number)

    def commit(self, end):
        pass


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, with filters pushed to it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FilteredPages)


def tagged(pages: DataFrame, required: list[str] = (), excluded: list[str] = ()) -> DataFrame:
    """Rows with all required tags and none of the excluded ones, by filters that reach the source; a row without known tags has none to pass by."""
    held = pages
    for tags, keep in ((required, True), (excluded, False)):
        for t in tags:
            hit = F.col("tag_text").contains(f"|{t.strip().casefold()}|")
            held = held.filter(hit if keep else ~hit)
    return held


_PAGE = "response struct<result: int, publishedfiledetails: array<struct<publishedfileid: string, result: int, title: string, time_updated: string, file_size: string, consumer_app_id: string, tags: array<struct<tag: string>>>>, next_cursor: string>"


def logged(reader, folder: str) -> DataFrame:
    """Rows of all pages in a folder, whatever their order, by spark.read or spark.readStream: files are listed, dealt and read as any others, through any path."""
    d = reader.schema(_PAGE).option("multiLine", "true").json(folder).select("*", F.col("_metadata.file_name").alias("file"))
    r = F.col("r")
    d = d.select("file", F.col("response.next_cursor").alias("cursor"), F.explode("response.publishedfiledetails").alias("r"))
    size = r["file_size"].try_cast("long")
    tags = F.transform(r["tags"], lambda t: F.trim(t["tag"]))
    d = d.filter(r["publishedfileid"].isNotNull() & (F.coalesce(r["result"], F.lit(1)) == 1))
    return d.select(F.regexp_replace("file", r"\.json$", "").alias("asked"), "cursor", r["publishedfileid"].alias("id"), r["title"].alias("title"), r["time_updated"].try_cast("long").alias("updated"), F.when(size > 0, size).alias("size_bytes"), r["consumer_app_id"].alias("app"), tags.alias("tags"))
