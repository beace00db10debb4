"""Comparing two samples of points: the shift between them, and labels for every point.

Points are rows (pair_id, idx, x, y, z, kind).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

POINT = ["pair_id", "x", "y", "z"]


def offset_votes(evidence: DataFrame) -> DataFrame:
    """(pair_id, ox, oy, oz): the shift with most distinct anchor pairs, of two distinct places at least on both sides; none on a tie.

    evidence: (pair_id, channel, qx, qy, qz, mx, my, mz).
    """
    e = evidence.filter(F.col("channel").isin("geometry", "winnowing")).dropna()
    q, m = F.struct("qx", "qy", "qz"), F.struct("mx", "my", "mz")
    g = e.groupBy("pair_id", *[(F.col(f"q{a}") - F.col(f"m{a}")).alias(f"o{a}") for a in "xyz"]).agg(F.count_distinct(q, m).alias("votes"), F.count_distinct(q).alias("qs"), F.count_distinct(m).alias("ms"))
    g = g.filter("qs >= 2 AND ms >= 2").withColumn("r", F.rank().over(Window.partitionBy("pair_id").orderBy(F.desc("votes"))))
    return g.filter("r = 1").groupBy("pair_id").agg(F.count("*").alias("n"), *[F.first(f"o{a}").alias(f"o{a}") for a in "xyz"]).filter("n = 1").drop("n")


def bounds(points: DataFrame, key: str = "pair_id") -> DataFrame:
    return points.groupBy(key).agg(F.count("*").alias("n"), *[f(a).alias(f"{f.__name__}_{a}") for a in "xyz" for f in (F.min, F.max)])


def extent_offset(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, ox, oy, oz): the shift of two samples of four points or more with equal extents, all points typed."""
    typed = lambda p: p.groupBy("pair_id").agg(F.bool_and(F.coalesce("kind", F.lit("")) != "").alias("typed")).filter("typed").drop("typed")
    a, b = bounds(left).join(typed(left), "pair_id"), bounds(right).join(typed(right), "pair_id")
    b = b.select("pair_id", *[F.col(c).alias(f"r_{c}") for c in b.columns if c != "pair_id"])
    same = F.lit(True)
    for x in "xyz":
        same &= F.col(f"max_{x}") - F.col(f"min_{x}") == F.col(f"r_max_{x}") - F.col(f"r_min_{x}")
    return a.join(b, "pair_id").filter((F.col("n") >= 4) & (F.col("r_n") >= 4) & same).select("pair_id", *[(F.col(f"min_{x}") - F.col(f"r_min_{x}")).alias(f"o{x}") for x in "xyz"])


def labels(left: DataFrame, right: DataFrame) -> DataFrame:
    """(pair_id, side, idx, label): both samples in one frame.

    Points of one place and kind are paired one to one (matched); of what is left, points
    of one place are paired one to one (changed); the rest is unmatched.  Each pass numbers
    the points of a key on both sides and joins on key and number.
    """
    d = left.withColumn("side", F.lit("input")).unionByName(right.withColumn("side", F.lit("match")))

    def paired(rows: DataFrame, key: list[str]) -> DataFrame:
        k = F.row_number().over(Window.partitionBy(*key, "side").orderBy("idx"))
        numbered = rows.withColumn("k", k)
        return numbered.withColumn("both", F.size(F.collect_set("side").over(Window.partitionBy(*key, "k"))) == 2).drop("k")

    exact = paired(d, [*POINT, "kind"])
    rest = paired(exact.filter("NOT both").drop("both"), POINT)
    label = lambda rows, hit: rows.select("pair_id", "side", "idx", F.lit(hit).alias("label"))
    return label(exact.filter("both"), "matched").union(label(rest.filter("both"), "changed")).union(label(rest.filter("NOT both"), "unmatched"))


def accepted(labelled: DataFrame, voted: DataFrame) -> DataFrame:
    """(pair_id, matched, verified): a shift that anchors voted for needs one match, one from extents four and 80 % of both sides."""
    g = labelled.groupBy("pair_id").agg(F.sum(F.when((F.col("side") == "input") & (F.col("label") == "matched"), 1).otherwise(0)).alias("matched"), F.sum((F.col("side") == "input").cast("int")).alias("n"), F.sum((F.col("side") == "match").cast("int")).alias("m"))
    v = g.join(voted.select("pair_id", F.lit(True).alias("voted")), "pair_id", "left")
    strict = (F.col("matched") >= 4) & (F.col("matched") >= F.ceil(0.8 * F.col("n"))) & (F.col("matched") >= F.ceil(0.8 * F.col("m")))
    return v.select("pair_id", "matched", ((F.col("matched") > 0) & (F.coalesce("voted", F.lit(False)) | strict)).alias("verified"))


def visible(points: DataFrame, depth: str, pixel: list[str]) -> DataFrame:
    """The front point of each pixel: greatest depth, the later one of equals."""
    cols = [c for c in points.columns if c not in pixel]
    return points.groupBy(*pixel).agg(F.max_by(F.struct(*cols), F.struct(depth, "idx")).alias("p")).select(*pixel, "p.*")


def last_at_each_place(points: DataFrame) -> DataFrame:
    """Points that a later one at their place covers go."""
    cols = [c for c in points.columns if c not in POINT]
    return points.groupBy(*POINT).agg(F.max_by(F.struct(*cols), "idx").alias("p")).select(*POINT, "p.*")
