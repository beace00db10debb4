"""Command line: python -m cellweave COMMAND ...

index FOLDER OUT      brings an index up to date with the XML files below a folder
upgrade FOLDER OUT    the same, and files of older versions anew
backfill OUT          files of older versions anew by the paths that the index has, in batches that a stopped run goes on after
compact OUT           an index as one segment; vacuum OUT drops what its newest snapshot doesn't list
scan FILE OUT         matches of a file, as lines of JSON
status OUT            counts of an index; errors OUT its error table
tags ITEMS            tags of a catalog; page ITEMS numbered items after an id
queue ITEMS           what is to be fetched, smallest first; sizes ITEMS whose size is to be looked up
rank ITEMS            numbers of all items by size

Tables are Parquet folders; reports are lines of JSON, or with --text before the command lines of text: a header,
then values between tabs.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions import text
from cellweave.operators import catalog, gates
from cellweave.plans import saved_index
from cellweave.plans import scan as plan
from cellweave.session import session
from cellweave.sources import xml_source

COMMANDS = {"index": ("folder", "out"), "upgrade": ("folder", "out"), "backfill": ("out",), "compact": ("out",), "vacuum": ("out",), "scan": ("file", "out"), "status": ("out",), "errors": ("out",), "tags": ("items",), "page": ("items",), "queue": ("items",), "sizes": ("items",), "rank": ("items",)}


def say(df: DataFrame, as_text: bool = False) -> None:
    if as_text:
        print("\t".join(df.columns))
        df = df.select(F.concat_ws("\t", *[F.coalesce(text.scrub(F.col(f"`{c}`").cast("string")), F.lit("-")) for c in df.columns]))
    for line in (r[0] for r in df.toLocalIterator()) if as_text else df.toJSON().toLocalIterator():
        print(line)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="cellweave")
    p.add_argument("--text", action="store_true")
    c = p.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        s = c.add_parser(name)
        for a in args:
            s.add_argument(a)
    for name, limit in (("scan", 5), ("page", 100), ("queue", 100)):
        c.choices[name].add_argument("--limit", type=int, default=limit)
    c.choices["scan"].add_argument("--items", help="catalog for titles")
    c.choices["tags"].add_argument("--like", default="")
    c.choices["page"].add_argument("--after", default="")
    for name in ("upgrade", "backfill"):
        c.choices[name].add_argument("--version", type=int, default=saved_index.VERSION)
    c.choices["backfill"].add_argument("--max-files", type=int, default=0)
    for name in ("queue", "sizes"):
        c.choices[name].add_argument("--now", type=int, default=None)
    a = p.parse_args(argv)
    spark = session()
    tell = lambda df: say(df, a.text)
    if a.command in ("index", "upgrade"):
        print(json.dumps(saved_index.update(spark, a.folder, a.out, getattr(a, "version", saved_index.VERSION))))
    elif a.command == "backfill":
        print(json.dumps(saved_index.upgrade(spark, a.out, a.version, most=a.max_files)))
    elif a.command == "compact":
        print(json.dumps({"snapshot": saved_index.compact(spark, a.out).number}))
    elif a.command == "vacuum":
        print(json.dumps({"dropped": saved_index.vacuum(spark, a.out)}))
    elif a.command == "scan":
        rows = xml_source.parse_rows(spark.read.format("binaryFile").load(a.file))
        found = plan.scan(saved_index.load(spark, a.out), saved_index.xml_features(rows).withColumnRenamed("doc_id", "query_id"), a.limit)
        tell(saved_index.report(spark, found, a.out, spark.read.parquet(a.items) if a.items else None))
    elif a.command == "status":
        tell(saved_index.status(spark, a.out))
    elif a.command == "errors":
        tell(saved_index.table(spark, a.out, "errors"))
    else:
        items = spark.read.parquet(a.items)
        now = getattr(a, "now", None) or int(time.time())
        if a.command == "tags":
            tell(catalog.tag_histogram(items).filter(F.lower("tag").contains(a.like.lower())).orderBy(F.desc("items"), "tag_key"))
        elif a.command == "page":
            tell(catalog.page(items, a.after, a.limit))
        elif a.command == "queue":
            tell(catalog.queue(items, now, a.limit))
        elif a.command == "sizes":
            tell(items.filter(catalog.recheck_sizes(now)))
        else:
            tell(gates.with_rank(items, F.col("size_bytes").asc_nulls_last(), F.col("id")).orderBy("place"))


if __name__ == "__main__":
    main()
