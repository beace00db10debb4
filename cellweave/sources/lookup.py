"""Details of items, looked up in batches by the tasks that hold their ids.

Ids are made distinct, dealt to partitions and asked for BATCH at a time; whatever carries
the requests (a transport) is a function of a list of ids, or a `Url` that posts them.
What may pass is asked again after a wait; what a service says of its own waits holds.
A request that fails for good gives its ids a row with the error, and so does an id
that the answer lacks or refuses: no id is lost, and an error stops no other batch.
The result is written before it is used, so that no later job asks again.
"""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.parse
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.text import digits_only
from cellweave.operators import catalog
from cellweave.sources.pages import whole
from cellweave.sources.store import stored

#: Ids of a request, tries, seconds of the first wait and the longest, answers that may pass, largest answer.
BATCH, TRIES, FIRST_WAIT, LONGEST = 50, 5, 5, 120
PASSING = (429, 500, 502, 503, 504)
FIELDS = "id string, title string, updated long, size_bytes long, app string, description string, tags array<string>, error string"
_TYPES = {"string": pa.string(), "long": pa.int64(), "array<string>": pa.list_(pa.string())}
SCHEMA = pa.schema([(f.split(" ")[0], _TYPES[f.split(" ")[1]]) for f in FIELDS.split(", ")])


class Refused(Exception):
    """A request that failed: code (None where there was no answer) and the seconds that the service asks to wait."""

    def __init__(self, code: int | None, wait: int = 0):
        super().__init__(f"HTTP {code}" if code else "no answer")
        self.code, self.wait = code, wait


class Url:
    """Posts ids as a form and gives the rows of the answer."""

    def __init__(self, url: str, timeout: float = 30.0):
        self.url, self.timeout = url, timeout

    def __call__(self, ids: list[str]) -> list[dict]:
        form = {"itemcount": len(ids), **{f"publishedfileids[{n}]": i for n, i in enumerate(ids)}}
        request = urllib.request.Request(self.url, data=urllib.parse.urlencode(form).encode(), headers={"Content-Type": "application/x-www-form-urlencoded"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                held = json.loads(answer.read().decode("utf-8", "replace"))
        except urllib.error.HTTPError as e:
            told = e.headers.get("Retry-After", "")
            raise Refused(e.code, int(told) if told.isdigit() else 0) from e
        except (urllib.error.URLError, TimeoutError) as e:
            raise Refused(None) from e
        return (held.get("response") or {}).get("publishedfiledetails") or []


def asked(transport: Callable[[list[str]], list[dict]], ids: list[str], sleep: Callable[[float], None] = time.sleep, delay: float = 0.0) -> list[dict]:
    """The answer of a request, after as many tries as it takes and may."""
    for n in range(TRIES):
        try:
            out = transport(ids)
        except Refused as e:
            if n == TRIES - 1 or e.code is not None and e.code not in PASSING:
                raise
            sleep(min(LONGEST, max(delay, FIRST_WAIT * 2**n, e.wait)))
        else:
            if delay:
                sleep(delay)
            return out
    raise AssertionError


def rows_of(ids: list[str], answer: list[dict], app: str | None) -> list[dict]:
    """A row for each id that was asked for, in their order; of several rows for one, the first good one."""
    found: dict[str, dict] = {}
    why: dict[str, str] = {}
    for r in answer:
        key = str(r.get("publishedfileid") or "") if isinstance(r, dict) else ""
        if not key or key in found:
            continue
        own = r.get("consumer_app_id", r.get("consumer_appid"))
        if str(r.get("result", 1)) != "1":
            why.setdefault(key, f"result {r['result']}")
        elif app is not None and own is not None and str(own) != app:
            why.setdefault(key, f"of app {own}")
        else:
            size, tags = whole(r.get("file_size")), r.get("tags")
            held = [str(t.get("tag", "") if isinstance(t, dict) else t).strip() for t in tags] if tags is not None else None
            found[key] = {"title": r.get("title"), "updated": whole(r.get("time_updated")), "size_bytes": size if size and size > 0 else None, "app": None if own is None else str(own), "description": r.get("description") or r.get("short_description"), "tags": held}
    return [{"id": i, **(found.get(i) or {"error": why.get(i, "not in the answer")})} for i in ids]


def details(ids: DataFrame, transport: Callable[[list[str]], list[dict]], app: str | None = None, id_col: str = "id", partitions: int = 4, delay: float = 0.0, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """FIELDS for each different numbered id, stored; error is null for one that was found.

    `partitions` is how many requests are under way at a time; a partition has one request at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[str] = []

        def ask(some: list[str]) -> pa.RecordBatch:
            try:
                rows = rows_of(some, asked(transport, some, sleep, delay), app)
            except Refused as e:
                rows = [{"id": i, "error": str(e)} for i in some]
            return pa.RecordBatch.from_pylist([{n: r.get(n) for n in SCHEMA.names} for r in rows], SCHEMA)

        for batch in batches:
            waiting += batch.column(0).to_pylist()
            while len(waiting) >= BATCH:
                yield ask(waiting[:BATCH])
                waiting = waiting[BATCH:]
        if waiting:
            yield ask(waiting)

    i = F.col(id_col).cast("string")
    different = ids.filter(digits_only(i)).select(i.alias("id")).distinct().repartition(partitions, "id").sortWithinPartitions("id")
    return stored(different.mapInArrow(run, FIELDS))


def due(items: DataFrame, now: int, what: str = "tags", force: bool = False) -> DataFrame:
    """Items whose tags (or sizes) are to be looked up: never or long ago, and not tried in the last day."""
    if force:
        return items.filter(digits_only(F.col("id")))
    return items.filter(catalog.recheck_tags(now) if what == "tags" else catalog.recheck_sizes(now)).filter(digits_only(F.col("id")))


def merged(items: DataFrame, found: DataFrame, now: int) -> DataFrame:
    """items after a lookup (its rows `found`): known details are merged, and what was asked for counts as tried.

    Tags count as looked up now only for an id that was found with them; one that wasn't found has tags of unknown age.
    """
    rows = found.filter("error IS NULL").select("id", "title", "updated", "size_bytes", F.lit(0).alias("seq"))
    told = found.select("id", F.lit(now).cast("long").alias("tried"), (F.col("error").isNull() & F.col("tags").isNotNull()).alias("tagged"))
    d = catalog.upserted(items, rows).join(told, "id", "left")
    return d.withColumn("tag_checked", F.when(F.col("tagged"), F.col("tried")).when(F.col("tried").isNotNull(), F.lit(0)).otherwise(F.col("tag_checked"))).drop("tagged")
