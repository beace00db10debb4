"""Exact reranking: containment, rarity, aligned clusters, scores, labels, evidence."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.operators import clusters
from cellweave.operators.postings import rare_limit

#: Weights of the channels in the combined score; t are the component types.
SCORE_WEIGHT = {"g": 0.55, "w": 0.20, "t": 0.10, "l": 0.07, "m": 0.08}
#: Evidence rows by channel.
EVIDENCE = {"g": 5, "w": 2, "l": 2, "m": 2}


def bag_intersection(queries: DataFrame, docs: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, channel, hash, shared): least counts; queries (query_id, channel, hash, cnt), docs (doc_id, channel, hash, cnt).

    With pairs (query_id, doc_id), only those are compared: a query's bag goes to its own candidates,
    and a hash that all documents hold meets no others.
    """
    d = docs.select("doc_id", "channel", "hash", F.col("cnt").alias("theirs"))
    q = queries.select("query_id", "channel", "hash", "cnt")
    if pairs is not None:
        q = q.join(pairs.select("query_id", "doc_id").distinct(), "query_id")
    both = q.join(d, ["channel", "hash"] if pairs is None else ["doc_id", "channel", "hash"])
    return both.select("query_id", "doc_id", "channel", "hash", F.least("cnt", "theirs").alias("shared"))


def containment(queries: DataFrame, docs: DataFrame, pairs: DataFrame | None = None, theirs: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, channel, shared, distinct_shared, query_pct, doc_pct): shares of both bags in their intersection.

    theirs: the documents' sizes (doc_id, channel, their), where docs has a part of their features only.
    """
    shared = bag_intersection(queries, docs, pairs).groupBy("query_id", "doc_id", "channel").agg(F.sum("shared").alias("shared"), F.count("*").alias("distinct_shared"))
    own = queries.groupBy("query_id", "channel").agg(F.sum("cnt").alias("own"))
    their = docs.groupBy("doc_id", "channel").agg(F.sum("cnt").alias("their")) if theirs is None else theirs
    d = shared.join(own, ["query_id", "channel"]).join(their, ["doc_id", "channel"])
    return d.select("query_id", "doc_id", "channel", "shared", "distinct_shared", (100.0 * F.col("shared") / F.col("own")).alias("query_pct"), (100.0 * F.col("shared") / F.col("their")).alias("doc_pct"))


def coverage(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, channel, query_pct): containment's share of the query alone, for which documents' sizes needn't be known."""
    shared = bag_intersection(queries, docs).groupBy("query_id", "doc_id", "channel").agg(F.sum("shared").alias("shared"))
    own = queries.groupBy("query_id", "channel").agg(F.sum("cnt").alias("own"))
    return shared.join(own, ["query_id", "channel"]).select("query_id", "doc_id", "channel", (100.0 * F.col("shared") / F.col("own")).alias("query_pct"))


def same_bags(queries: DataFrame, docs: DataFrame, channel: str = "g") -> DataFrame:
    """(query_id, doc_id): pairs whose bags of a channel are equal; compared by the digest of the sorted bag."""
    whole = lambda d, key: d.filter(F.col("channel") == channel).groupBy(key).agg(F.sha2(F.concat_ws(",", F.array_sort(F.collect_list(F.concat_ws(":", "hash", F.col("cnt").cast("string"))))), 256).alias("bag"))
    return whole(queries, "query_id").join(whole(docs, "doc_id"), "bag").select("query_id", "doc_id")


def bag_digests(bags: DataFrame) -> DataFrame:
    """(doc_id, bag): the digest that same_bags compares, of whole bags (doc_id, bag); null for no bag."""
    return bags.select("doc_id", F.sha2(F.array_join(F.transform("bag", lambda f: F.concat_ws(":", f["hash"], f["cnt"].cast("string"))), ","), 256).alias("bag"))


def rare_shared(shared: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """Shared features that few sampled postings hold; one that isn't sampled isn't rare."""
    return shared.join(df, ["channel", "hash"]).filter((F.col("df") > 0) & (F.col("df") <= rare_limit(n)))


def rare_counts(shared: DataFrame, df: DataFrame, n: int) -> DataFrame:
    return rare_shared(shared, df, n).groupBy("query_id", "doc_id", "channel").agg(F.count("*").alias("rare_distinct"), F.sum("shared").alias("rare"))


def largest_cluster_of(points: set[tuple[int, int, int]]) -> int:
    """The same of a few points in memory."""
    at = {p: i for i, p in enumerate(sorted(points))}
    edges = [(i, at[q]) for (x, y, z), i in at.items() for a, b, c in clusters.steps() if (q := (x + a, y + b, z + c)) in at]
    return int(np.bincount(clusters.united(len(at), *np.array(edges, np.int64).reshape(-1, 2).T)).max()) if at else 0


def aligned_cluster(anchors: DataFrame) -> DataFrame:
    """(query_id, doc_id, cluster): of the anchors (qx, qy, qz, dx, dy, dz) with one shift, the largest cluster on the query's side."""
    shift = [(F.col(f"d{a}") - F.col(f"q{a}")).alias(f"s{a}") for a in "xyz"]
    points = anchors.dropna().select("query_id", "doc_id", *shift, *[F.col(f"q{a}").alias(a) for a in "xyz"])
    return clusters.largest(points, ["query_id", "doc_id", "sx", "sy", "sz"]).groupBy("query_id", "doc_id").agg(F.max("cluster").alias("cluster"))


def combined_score(channels: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, doc_id, combined): weighted mean of the query's coverage over the channels that the query has."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in SCORE_WEIGHT.items() for x in kv]), F.col("channel"))
    total = queries.select("query_id", "channel").distinct().groupBy("query_id").agg(F.sum(weight).alias("total"))
    return channels.groupBy("query_id", "doc_id").agg(F.sum(F.col("query_pct") * weight).alias("s")).join(total, "query_id").select("query_id", "doc_id", (F.col("s") / F.col("total")).alias("combined"))


def wide(channels: DataFrame, rare: DataFrame, clusters: DataFrame) -> DataFrame:
    """One row for each pair with what the rules need; what a pair lacks is 0."""
    pick = lambda c, v: F.coalesce(F.max(F.when(F.col("channel") == c, F.col(v))), F.lit(0))
    a = channels.groupBy("query_id", "doc_id").agg(pick("g", "shared").alias("shared"), pick("g", "query_pct").alias("query_pct"), pick("g", "doc_pct").alias("doc_pct"), pick("w", "shared").alias("winnow"), pick("l", "shared").alias("logic"), pick("m", "shared").alias("micro"))
    b = rare.groupBy("query_id", "doc_id").agg(*[pick(c, "rare_distinct").alias(f"rare_{c}") for c in "gwlm"])
    d = a.join(b, ["query_id", "doc_id"], "left").join(clusters, ["query_id", "doc_id"], "left")
    return d.fillna(0, [f"rare_{c}" for c in "gwlm"] + ["cluster"])


def reportable(small_exact: Column | None = None) -> Column:
    """Whether a pair has enough in common in some channel (or is a small exact copy)."""
    c = F.col
    enough = (c("shared") >= 5) | (c("winnow") >= 3) | (c("logic") >= 3) | (c("micro") >= 2)
    return enough if small_exact is None else enough | small_exact


def partial() -> Column:
    c = F.col
    return (c("query_pct") >= 12) & (c("query_pct") < 65) & (c("shared") >= 20) & (c("rare_g") >= 10) & (c("cluster") >= 8) & ((c("winnow") >= 3) | (c("rare_g") >= 25))


def semantic(query_has_geometry: Column | None = None) -> Column:
    c = F.col
    other = (c("rare_l") >= 1) | (c("shared") >= 5)
    return (c("rare_m") >= 2) & (c("micro") >= 2) & (other if query_has_geometry is None else other | ~query_has_geometry)


def confidence(query_has_geometry: Column | None = None) -> Column:
    c = F.col
    high = (c("shared") >= 40) & (c("query_pct") >= 65) & (c("rare_g") >= 25)
    medium = (c("shared") >= 20) & (c("query_pct") >= 35) & (c("rare_g") >= 10) | partial() | (c("winnow") >= 8) & (c("rare_w") >= 4) & (c("shared") >= 10) | semantic(query_has_geometry)
    return F.when(high, "high").when(medium, "medium").otherwise("low")


def status(conf: Column, is_semantic: Column) -> Column:
    return F.when(conf == "high", "strong overlap").when(is_semantic, "possible shared controller").when(conf == "medium", "possible shared structure").otherwise("no strong match in indexed set")


def suspicion(conf: Column) -> Column:
    return F.when(conf == "high", "high").when(conf == "medium", "medium").otherwise("low within indexed set")


def certainty(has_match: Column, status_: Column, searched: Column, indexed: Column, micro: Column, geometry: Column, conf: Column) -> Column:
    """The label that a reader sees."""
    none = F.when((status_ == "no index") | (searched == 0) | (searched < indexed), "Uncertain").otherwise("No match found")
    found = F.when((micro > 0) & (geometry == 0), "Holds some matched microcontrollers").when(conf == "high", "High").when(conf == "medium", "Medium").when(conf == "low", "Low").otherwise("Uncertain")
    return F.when(has_match, found).otherwise(none)


def evidence(shared: DataFrame, df: DataFrame, n: int) -> DataFrame:
    """The rarest shared features of each pair and channel, at most EVIDENCE of them; unsampled ones count as rarer than none."""
    d = shared.join(df, ["channel", "hash"], "left")
    w = Window.partitionBy("query_id", "doc_id", "channel").orderBy(F.coalesce("df", F.lit(n + 1)), F.desc("shared"), "hash")
    most = F.element_at(F.create_map(*[F.lit(x) for kv in EVIDENCE.items() for x in kv]), F.col("channel"))
    return d.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)


def ordered(matches: DataFrame, limit: int | None = None) -> DataFrame:
    """Matches of each query by confidence, combined score, coverage and shared features; ties by candidate rank."""
    level = F.when(F.col("confidence") == "high", 3).when(F.col("confidence") == "medium", 2).otherwise(1)
    w = Window.partitionBy("query_id").orderBy(level.desc(), F.bround("combined", 1).desc(), F.bround("query_pct", 1).desc(), F.desc("shared"), "rank", "doc_id")
    d = matches.withColumn("place", F.row_number().over(w))
    return d if limit is None else d.filter(F.col("place") <= limit)


def candidate_rows(matches: DataFrame, most: int = 3) -> DataFrame:
    """First match of each item after the best, at most `most`, numbered from 2."""
    first = matches.withColumn("k", F.row_number().over(Window.partitionBy("query_id", "item_id").orderBy("place"))).filter("k = 1 AND place > 1").drop("k")
    best = matches.filter("place = 1").select("query_id", "item_id")
    rest = first.join(best, ["query_id", "item_id"], "left_anti")
    return rest.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place")) + 1).filter(F.col("rank") <= most + 1)
