"""Mixing sources to target weights by systematic sampling (DataFrame functions only).

Every document of a source has the same expected number of copies, target /
source_size.  These are summed in a fixed order, one random offset from [0, 1) is
added for the source, and a document is emitted once for each whole number that its
part of the sum crosses.

What a few large documents give is either there or not.  So a source's large documents
(of a size class above that of LARGE of its target) are dealt first, and the others'
expected copies are what is then left of the target by their size: the words that the
large ones miss or exceed are made up for.  The others are in the order of size, so
that their words follow what is left closely: the error telescopes over sizes.  It is
at most LARGE of the target, unless the others can't make up (none, or all of them
three times, are not enough).

The prefix sum has three levels.  A source is dealt into (size class, hash part)
cells; counts are summed over a source's classes (sixteen an octave), over a class's
cells (at most PARTS), and only inside a cell are documents ranked by a window.  A source that holds a
third of all rows, or a third of rows of one size, is spread over many tasks.

Defined cases: null text has size 0 and takes nothing; a null source is a source of
its own and comes last; rows without doc_id go to hash parts by their text and rank last in their
cell; rows of one id and size are in the order of a digest of their texts, so that reruns
emit the same ones; repeated rows are separate documents, of which it doesn't matter which is emitted; an empty table gives no rows; a source of size 0 has target 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import documents, stored

#: Weights that sources get in code-point order, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target stops at so many times its source's size.
MOST = 3
#: Share of a target from which a document is large.
LARGE = 0.05
#: Hash parts of a size class: a cell of one source and class is a task's work in ranking.
PARTS = 1024
SEED = 7


def size_of(text: Column) -> Column:
    """Words: runs of anything but ASCII white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash32(text: Column) -> Column:
    """A portable 32-bit hash (any SQL engine with md5 gives the same), never null: no filter is inferred that computes it again."""
    return F.coalesce(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long"), F.lit(0))


def tie_of(text: Column) -> Column:
    """60 bits of the text's digest, never null."""
    return F.coalesce(F.conv(F.substring(F.md5(F.coalesce(text, F.lit(""))), 1, 15), 16, 10).cast("long"), F.lit(0))


def size_class(size: Column) -> Column:
    """Sixteen classes an octave: the whole part of 16 log2(size + 1)."""
    return F.coalesce(F.floor(16 * F.log2(size.cast("double") + 1)).cast("long"), F.lit(0))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size) -> plus rank, target.  One row per source; sources, not documents, are ordered here.

    Water filling: with sources in the order of most x size / weight, a source is
    capped where the level reached by all that remain exceeds its ratio.
    """
    nulls = F.col("source").isNull()
    by_name, by_ratio = Window.orderBy(nulls, "source"), Window.orderBy("ratio", nulls, "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("source_rank") - 1) % len(weights) + 1).cast("int"))
    ranked = sizes.withColumn("source_rank", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("room", (most * F.col("source_size")).cast("long")).withColumn("ratio", F.col("room") / F.col("weight"))
    upto = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = ranked.withColumn("left", F.sum("source_size").over(whole) - F.coalesce(F.sum("room").over(upto), F.lit(0))).withColumn("heavy", F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(upto), F.lit(0.0))).withColumn("level", F.col("left") / F.col("heavy"))
    # The first source whose level stays under its ratio sets the level of all after it.
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", nulls, "source", "level"))).over(whole)
    return filled.withColumn("free", free).withColumn("target", F.when(F.col("source_size") == 0, 0.0).otherwise(F.least(F.col("room").cast("double"), F.coalesce(F.col("weight") * F.col("free.level"), F.col("room").cast("double"))))).select("source", "source_size", "source_rank", "target")


def mix(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, most: int = MOST, seed: int = SEED, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken, and df's columns in `keep` as struct `row`."""
    hashed = F.pmod(_hash32(F.coalesce(F.col("doc_id").cast("string"), F.col("tie").cast("string"))), F.lit(PARTS))
    # a source's key is never null, so that the join finds the rows dealt as the window left them
    named = [F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("null")).alias("key"), size_of(F.col(text_col)).alias("size"), tie_of(F.col(text_col)).alias("tie")]
    celled = lambda x: x.withColumn("cls", size_class(F.col("size"))).withColumn("part", hashed)
    slim = stored(celled(df.select(*named)))  # words are counted once; where rows are kept whole, once more
    cells = stored(slim.groupBy("key", "cls", "part").agg(F.count("*").alias("n"), F.sum("size").alias("words")))
    aims = targets(cells.groupBy("key").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col("key") != "null", F.substring("key", 2, 1 << 30))), weights, most)
    offset = _hash32(F.concat(F.lit(f"{seed}:"), F.col("key"))) / F.lit(4294967296.0)
    aims = aims.select(F.coalesce(F.concat(F.lit("s"), "source"), F.lit("null")).alias("key"), "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rho")).withColumn("u", offset)
    # written, so that windows over a class aren't dealt by source as the join is
    placed = stored(cells.join(aims, "key").withColumn("large", F.col("cls") > size_class(F.col("target") * LARGE)))
    # documents before a cell: those of lower classes, from a row for each class, and those of the class's cells before it
    upto = lambda w, order: F.coalesce(F.sum("n").over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    classes = placed.groupBy("key", "large", "cls").agg(F.sum("n").alias("n"))
    classes = classes.select("key", "cls", upto(Window.partitionBy("key", "large"), "cls").alias("lower"))
    starts = placed.withColumn("beside", upto(Window.partitionBy("key", "cls"), "part")).join(classes, ["key", "cls"])
    starts = stored(starts.withColumn("before", F.col("lower") + F.col("beside")).drop("lower", "beside"))

    def ranked(rows: DataFrame, cells: DataFrame) -> DataFrame:
        """rows of the cells with their copies."""
        inside = F.row_number().over(Window.partitionBy("key", "cls", "part").orderBy("size", F.col("doc_id").asc_nulls_last(), "tie"))
        m = rows.withColumn("inside", inside).join(cells.drop("n", "words").hint("merge"), ["key", "cls", "part"]).withColumn("rank", F.col("before") + F.col("inside"))
        return m.withColumn("copies", (F.floor(F.col("rank") * F.col("rho") + F.col("u")) - F.floor((F.col("rank") - 1) * F.col("rho") + F.col("u"))).cast("long"))

    large = starts.filter("large")
    took = ranked(slim.join(large.select("key", "cls", "part").hint("merge"), ["key", "cls", "part"], "left_semi"), large).groupBy("key").agg(F.sum(F.col("copies") * F.col("size")).alias("took"))
    rest = starts.filter("NOT large").groupBy("key").agg(F.sum("words").alias("rest"), F.max("target").alias("aim")).join(took, "key", "left")
    left = (F.col("aim") - F.coalesce("took", F.lit(0))) / F.col("rest")
    rest = rest.select("key", F.when(F.col("rest") > 0, F.greatest(F.lit(0.0), F.least(F.lit(float(most)), left))).otherwise(0.0).alias("rho_rest"))
    starts = stored(starts.join(rest, "key", "left").withColumn("rho", F.when(F.col("large"), F.col("rho")).otherwise(F.col("rho_rest"))).drop("rho_rest"))
    d = celled(df.select(*named, F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"))) if keep else slim
    return ranked(d, starts).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), *(["row"] if keep else []))


def mixed_documents(df: DataFrame, **options) -> DataFrame:
    """The mix itself: each document of df as often as it is emitted, with df's columns."""
    cols = tuple(df.columns)
    m = mix(df, keep=cols, **options).filter("copies > 0")
    return m.select(F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"), "row").select("row.*")


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, ('0x' || substr(md5(coalesce(text, '')), 1, 15))::BIGINT AS tie FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source IS NULL, source) AS rk FROM d GROUP BY source),
w AS (SELECT *, CASE (rk - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 3 * source_size AS room FROM s),
o AS (SELECT *, room / weight AS ratio, row_number() OVER (ORDER BY room / weight, source IS NULL, source) AS ro FROM w),
l AS (SELECT *, ((SELECT sum(source_size) FROM o) - coalesce(sum(room) OVER (ORDER BY ro ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
       / ((SELECT sum(weight) FROM o) - coalesce(sum(weight) OVER (ORDER BY ro ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM o),
f AS (SELECT level FROM l WHERE level <= ratio ORDER BY ro LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN source_size = 0 THEN 0.0 ELSE least(room::DOUBLE, coalesce(weight * (SELECT level FROM f), room::DOUBLE)) END AS target FROM l),
c AS (SELECT d.*, floor(16 * log2(size::DOUBLE + 1))::BIGINT AS cls, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, tie::VARCHAR)), 1, 8))::BIGINT % 1024 AS part FROM d),
m AS (SELECT c.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rho,
       cls > floor(16 * log2(t.target * 0.05::DOUBLE + 1))::BIGINT AS large,
       ('0x' || substr(md5('7:' || coalesce('s' || c.source, 'null')), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u
      FROM c JOIN t ON c.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, row_number() OVER (PARTITION BY source, large ORDER BY cls, part, size, doc_id NULLS LAST, tie) AS rank FROM m),
k AS (SELECT source, coalesce(sum((floor(rank * rho + u) - floor((rank - 1) * rho + u))::BIGINT * size) FILTER (large), 0)::BIGINT AS took, (sum(size) FILTER (NOT large))::BIGINT AS rest FROM r GROUP BY source),
f2 AS (SELECT r.* REPLACE (CASE WHEN large THEN rho WHEN rest > 0 THEN greatest(0.0, least(3.0::DOUBLE, (target - took) / rest)) ELSE 0.0 END AS rho) FROM r JOIN k ON r.source IS NOT DISTINCT FROM k.source)
SELECT doc_id, size, source_size, target, ((floor(rank * rho + u) - floor((rank - 1) * rho + u))::BIGINT * size)::BIGINT AS taken FROM f2
"""
