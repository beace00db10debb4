"""Whole plans: building an index of features, and scanning it with queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.hashing import hash60
from cellweave.operators import gates, grid, postings, rank, search, sketch
from cellweave.sources.store import stored


@dataclass
class Index:
    """features (doc_id, channel, hash, cnt, x, y, z), postings, their frequencies, bands, the number of files, and the buckets' sizes.

    Frequencies and sizes may come in signed parts, which are summed for the terms that a scan asks for.
    """

    features: DataFrame
    postings: DataFrame
    df: DataFrame
    bands: DataFrame
    files: int
    counts: DataFrame
    #: Features of documents (doc_id), where features isn't written out.
    whole: Callable[[DataFrame], DataFrame] | None = None


def channel_features(cells: DataFrame, flat: bool = False, axes: tuple[str, ...] = grid.AXES) -> DataFrame:
    """Geometry and winnowing features of cells."""
    g = grid.neighbourhood_features(cells, flat=flat).withColumn("channel", F.lit("g"))
    w = grid.winnow_features(cells, axes=axes).withColumn("channel", F.lit("w"))
    return g.unionByName(w)


def text_features(docs: DataFrame) -> DataFrame:
    """Features of documents on the grid of their lines and words: runs along lines, neighbourhoods in the plane."""
    cells = grid.document_grid(docs)
    return channel_features(cells, flat=True, axes=("x",))


def build(features: DataFrame, files: int) -> Index:
    """The index, written to the shared folder: scans read it any number of times."""
    features = stored(features)
    posted = stored(postings.bottom_k(features))
    tokens = features.filter("channel IN ('g', 'w')").select("doc_id", F.concat_ws(":", "channel", "hash").alias("token"))
    banded = stored(sketch.bands(sketch.signatures(tokens)))
    return Index(features, posted, stored(postings.document_frequency(posted)), banded, files, stored(banded.groupBy("bucket").agg(F.count("*").alias("df"))))


def sought(docs: DataFrame, queries: DataFrame, files: int) -> Index:
    """What one scan of texts (doc_id, text) with known queries asks of their index: rows of the queries' terms and buckets only are written.

    Texts are read once for these, and those of candidates again for their whole bags, so that the index takes less room than the texts.
    """
    of = lambda d: grid.text_features(d.select("doc_id", "text"), {c: postings.Sample(c) for c in "gw"})
    terms = queries.select("channel", "hash", F.lit(True).alias("asked")).distinct()
    rows = of(docs).join(terms, ["channel", "hash"], "left").filter("asked AND sampled OR sig IS NOT NULL").select("doc_id", "channel", "hash", "sig")
    rows = stored(rows, "zstd")
    posted = rows.filter("hash IS NOT NULL").select("doc_id", "channel", "hash")
    buckets = stored(sketch.bands(sketch.signatures(queries.select("query_id", F.concat_ws(":", "channel", "hash").alias("token")), "query_id"), "query_id").select("bucket").distinct())
    banded = stored(sketch.bands(rows.filter("sig IS NOT NULL").select("doc_id", "sig")).join(buckets, "bucket", "left_semi").select("doc_id", "band", "bucket"), "zstd")
    features = lambda ids: of(docs.join(ids, "doc_id", "left_semi")).filter("hash IS NOT NULL").drop("sampled", "sig")
    return Index(features(docs.select("doc_id")), posted, stored(postings.document_frequency(posted)), banded, files, stored(banded.groupBy("bucket").agg(F.count("*").alias("df"))), features)


@dataclass
class Older:
    """Files that are known in an older form only, and the queries in that form: both (id, channel, hash, cnt, x, y, z)."""

    features: DataFrame
    queries: DataFrame


def scan(index: Index, queries: DataFrame, limit: int | None = 5, candidates: int = search.CANDIDATES, probe_rows: int = search.PROBE_ROWS, total_rows: int = search.TOTAL_ROWS, older: Older | None = None) -> DataFrame:
    """Ranked matches for queries (query_id, channel, hash, cnt, x, y, z).

    Candidates come from shared buckets and rare postings within each query's budgets of rows; only
    they are compared on whole bags.  One plan serves any number of queries.  Files of an older form have candidates
    by the older rule, compared in that form; a file that is a candidate in both is compared in the newer one.
    """
    queries = stored(queries)
    q = queries.withColumnRenamed("query_id", "doc_id")
    sampled = stored(search.interleaved(postings.bottom_k(q.filter("channel <> 't'")).withColumnRenamed("doc_id", "query_id"), hash60(F.col("hash"))))
    qb = stored(sketch.bands(sketch.signatures(q.filter("channel IN ('g', 'w')").select("doc_id", F.concat_ws(":", "channel", "hash").alias("token")))).select(F.col("doc_id").alias("query_id"), "bucket"))
    df = stored(search.frequencies(queries, index.df, ["channel", "hash"]))
    sizes = stored(search.frequencies(qb, index.counts, ["bucket"]))
    terms = search.probed(sampled.join(df, ["channel", "hash"]), qb.join(sizes, "bucket"), index.files, probe_rows, total_rows)
    votes = search.term_votes(terms, index.postings, index.files).union(search.bucket_votes(qb, index.bands.select("doc_id", "bucket"), index.files, sizes))
    chosen = stored(search.top_candidates(votes, candidates))
    features = index.features if index.whole is None else index.whole(chosen.select("doc_id").distinct())
    found = matched(queries, features, chosen, df, index.files)
    if older is not None:
        old = stored(older.queries)
        left = search.older_candidates(old, older.features, index.files).join(chosen.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        left = stored(left.withColumn("rank", F.col("rank") + candidates))  # after all of the newer form
        df = stored(older.features.groupBy("channel", "hash").agg(F.count_distinct("doc_id").alias("df")))
        found = found.withColumn("older", F.lit(False)).unionByName(matched(old, older.features, left, df, index.files).withColumn("older", F.lit(True)))
    return rank.ordered(found, limit)


def matched(queries: DataFrame, features: DataFrame, chosen: DataFrame, df: DataFrame, files: int) -> DataFrame:
    """Chosen pairs (query_id, doc_id, rank, votes) that have enough in common, with what they share and what that says."""
    theirs = stored(features.join(chosen.select("doc_id").distinct(), "doc_id", "left_semi"))
    shared = stored(rank.bag_intersection(queries, theirs, chosen))
    cover = stored(rank.containment(queries, theirs, chosen))
    rare = rank.rare_shared(shared, df, files)
    anchors = rare.filter("channel = 'g'").join(queries.select("query_id", "channel", "hash", *[F.col(a).alias(f"q{a}") for a in "xyz"]), ["query_id", "channel", "hash"]).join(theirs.select("doc_id", "channel", "hash", *[F.col(a).alias(f"d{a}") for a in "xyz"]), ["doc_id", "channel", "hash"])
    counts = rare.groupBy("query_id", "doc_id", "channel").agg(F.count("*").alias("rare_distinct"), F.sum("shared").alias("rare"))
    of = lambda d, key: d.filter("channel = 't'").groupBy(F.col(key).alias("id")).agg(F.sum("cnt").alias("components"))
    components = of(queries, "query_id").union(of(theirs, "doc_id")).groupBy("id").agg(F.max("components").alias("components"))
    wide = gates.small_exact(rank.wide(cover, counts, rank.aligned_cluster(anchors)), rank.same_bags(queries, theirs), components).filter(rank.reportable(F.col("small_exact")))
    # without geometry, a query's controllers need no other evidence
    shape = queries.groupBy("query_id").agg(F.max((F.col("channel") == "g").cast("int")).cast("boolean").alias("has_geometry"))
    scored = wide.join(shape, "query_id").join(rank.combined_score(cover, queries), ["query_id", "doc_id"]).join(chosen.select("query_id", "doc_id", "rank", "votes"), ["query_id", "doc_id"])
    has = F.col("has_geometry")
    return scored.withColumn("confidence", rank.confidence(has)).withColumn("partial", rank.partial()).withColumn("status", rank.status(F.col("confidence"), rank.semantic(has)))
