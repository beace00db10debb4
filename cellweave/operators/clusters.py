"""Clusters of points on a grid, as connected components that no task holds whole.

Points hang together over steps of at most 2 on an axis and 3 in all.  Each group of points is cut
into tiles; a tile, with the points around it, is labelled by union and find in sorted
arrays.  A point that two tiles saw joins their labels, and labels, of which there are few,
are joined by pointer jumping over written tables.  A group in one tile needs no join.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.sources.store import stored

#: Farthest step on an axis, and in all; edge of a tile (a tile holds at most its cube of points).
REACH, FAR, TILE = 2, 3, 32
#: Points that a worker labels at a time, of whole tiles.
HELD = 50_000
AXES = ("x", "y", "z")


def steps() -> list[tuple[int, int, int]]:
    """One of each two opposite steps."""
    r = range(-REACH, REACH + 1)
    return [s for s in ((a, b, c) for a in r for b in r for c in r) if 0 < sum(map(abs, s)) <= FAR and s > (0, 0, 0)]


def united(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least number in each one's component, for edges a - b over 0..n-1: labels pass over edges and are halved until nothing changes."""
    label = np.arange(n)
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)
        np.minimum.at(label, label[b], least)
        while not np.array_equal(up := label[label], label):
            label = up
        open_ = label[a] != label[b]
        a, b = a[open_], b[open_]
    return label


def labelled(tile: np.ndarray, places: list[np.ndarray]) -> np.ndarray:
    """The row that stands for each row's component; tile numbers rows of a tile alike, places are within it and its margin."""
    edge = TILE + 2 * REACH
    wide = edge + 2 * REACH  # a step beyond the margin must not come out on another row
    key = ((tile * wide + places[2] + REACH) * wide + places[1] + REACH) * wide + places[0] + REACH
    order = np.argsort(key, kind="stable")
    key = key[order]
    a, b = [], []
    for dx, dy, dz in steps():
        want = key + (dz * wide + dy) * wide + dx
        at = np.minimum(np.searchsorted(key, want), len(key) - 1)
        found = np.flatnonzero(key[at] == want)
        a.append(found)
        b.append(at[found])
    least = united(len(key), np.concatenate(a), np.concatenate(b))
    out = np.empty(len(key), np.int64)
    out[order] = order[least]
    return out


def tile_labels(points: DataFrame, group: list[str]) -> DataFrame:
    """points (group, x, y, z; each once) in every tile that sees them: at (their place), home (whether it is their own tile), and label, a point of their component in that tile."""
    d = points
    for a in AXES:
        near = [F.floor((F.col(a) + s * REACH) / TILE).cast("long") for s in (-1, 1)]
        d = d.withColumn(f"t{a}", F.explode(F.array_distinct(F.array(*near))))
    part = [*group, "tx", "ty", "tz"]
    kinds = dict(points.dtypes)
    fields = ", ".join(f"`{c}` {kinds[c]}" for c in group)
    at = "struct<x: bigint, y: bigint, z: bigint>"

    def done(table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        new = np.zeros(table.num_rows, bool)
        for c in part:
            codes = table.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            new[1:] |= codes[1:] != codes[:-1]
        tiles = [table.column(f"t{a}").to_numpy() for a in AXES]
        places = [table.column(a).to_numpy() for a in AXES]
        local = [x - TILE * t + REACH for x, t in zip(places, tiles, strict=True)]
        label = labelled(np.cumsum(new), local)
        home = np.logical_and.reduce([(x >= REACH) & (x < TILE + REACH) for x in local])
        struct = lambda rows: pa.StructArray.from_arrays([pa.array(x[rows]) for x in places], names=list(AXES))
        tile = pa.StructArray.from_arrays([pa.array(t) for t in tiles], names=list(AXES))
        cols = {c: table.column(c).combine_chunks() for c in group} | {"tile": tile, "at": struct(slice(None)), "home": pa.array(home), "label": struct(label)}
        yield from pa.table(cols).to_batches()

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows, last = 0, None
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                piece = batch.slice(i, 1000)
                # a full load ends where a tile ends
                if rows >= HELD:
                    keys = list(zip(*(piece.column(c).to_pylist() for c in part), strict=True))
                    cut = next((k for k, key in enumerate(keys) if key != last), None)
                    if cut is not None:
                        held.append(piece.slice(0, cut))
                        yield from done(pa.Table.from_batches(held))
                        held, rows, piece = [], 0, piece.slice(cut)
                held.append(piece)
                rows += piece.num_rows
                if piece.num_rows:
                    last = tuple(piece.column(c)[piece.num_rows - 1].as_py() for c in part)
        if rows:
            yield from done(pa.Table.from_batches(held))

    dealt = d.select(*part, *AXES).repartition(*part).sortWithinPartitions(*part)
    return dealt.mapInArrow(run, f"{fields}, tile {at}, at {at}, home boolean, label {at}")


def joined(edges: DataFrame, group: list[str]) -> DataFrame:
    """(group, node, root): components of edges (group, a, b) by pointer jumping, each named by its least node."""
    both = stored(edges.select(*group, "a", "b").union(edges.select(*group, F.col("b").alias("a"), F.col("a").alias("b"))).filter("a <> b").distinct())
    roots = stored(both.groupBy(*group, F.col("a").alias("node")).agg(F.least(F.min("b"), F.col("node")).alias("root")))
    while True:
        near = both.join(roots.withColumnRenamed("node", "b"), [*group, "b"]).groupBy(*group, F.col("a").alias("node")).agg(F.min("root").alias("near"))
        step = roots.join(near, [*group, "node"]).select(*group, "node", F.col("root").alias("was"), F.least("root", "near").alias("root"))
        jump = roots.select(*group, F.col("node").alias("root"), F.col("root").alias("further"))
        step = stored(step.join(jump, [*group, "root"], "left").select(*group, "node", "was", F.least("root", F.coalesce("further", "root")).alias("root")))
        roots = step.drop("was")
        if step.filter("was <> root").isEmpty():
            return roots


def largest(points: DataFrame, group: list[str]) -> DataFrame:
    """(group, cluster): the most points (group, x, y, z) of a group that hang together; a point that comes twice counts once.

    Null places hang together with none and are left out; a null group is a group.
    """
    whole = F.struct(*[F.col(a).cast("long").alias(a) for a in AXES])
    packed = points.select(F.struct(*[F.col(f"`{c}`") for c in group]).alias("g"), whole.alias("p")).filter("p.x IS NOT NULL AND p.y IS NOT NULL AND p.z IS NOT NULL").distinct()
    # a group's key is the digest of its values, which aren't carried along
    keyed = packed.select(F.md5(F.to_json("g", {"ignoreNullFields": "false"})).alias("k"), "g", "p.*")
    labels = stored(tile_labels(keyed.select("k", *AXES), ["k"]))
    node = F.struct("tile", "label")
    here = labels.filter("home").select("k", "at", node.alias("node"))
    edges = labels.filter("NOT home").select("k", "at", node.alias("b")).join(here.withColumnRenamed("node", "a"), ["k", "at"]).select("k", "a", "b")
    sizes = stored(here.groupBy("k", "node").agg(F.count("*").alias("n")))
    edges = stored(edges.distinct())
    if not edges.isEmpty():
        sizes = sizes.join(joined(edges, ["k"]), ["k", "node"], "left").groupBy("k", F.coalesce("root", "node").alias("node")).agg(F.sum("n").alias("n"))
    best = sizes.groupBy("k").agg(F.max("n").cast("int").alias("cluster"))
    return keyed.select("k", "g").distinct().join(best, "k").select("g.*", "cluster")
