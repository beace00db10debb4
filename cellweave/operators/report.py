"""What a reader gets: tables of matches and evidence, redaction, validation, parsed tool output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellweave.functions.text import digits_only, percent_text, scrub, thousands

#: Channels in their order and as they are told.
CHANNELS = {"g": "Structure", "w": "Winnowing", "l": "Logic", "m": "Microcontrollers", "t": "Component types"}
#: Bounds of a submitted fingerprint.
MOST_KEYS, MOST_COUNT, MOST_COORDINATE = 500_000, 500_000, 10**9
#: Fixed value: how a download tool says that it is asked too often.
TOO_OFTEN = r"(?i)rate limit(?:ed)? exceeded|too many requests|\b(?:http|status|error)[ :=]*(?:code[ :=]*)?429\b"


def matched_data(channels: DataFrame) -> DataFrame:
    """(query_id, doc_id, matched): what a pair shares, channel by channel."""
    order = list(CHANNELS)
    part = F.concat(F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), F.col("channel")), F.lit(": "), thousands(F.col("shared")), F.lit(" ("), percent_text(F.col("query_pct")), F.lit(" of input)"))
    at = F.array_position(F.array(*map(F.lit, order)), F.col("channel"))
    g = channels.filter("shared > 0").groupBy("query_id", "doc_id").agg(F.array_sort(F.collect_list(F.struct(at.alias("at"), part.alias("part")))).alias("parts"))
    return g.select("query_id", "doc_id", F.concat_ws("; ", F.transform("parts", lambda p: p["part"])).alias("matched"))


def source_label(item_id: Column, source: Column, shared: bool) -> Column:
    where = "shared index" if shared else "local index"
    return F.when(item_id.isNull(), f"No matched source ({where})").when((source == "other") | ~digits_only(item_id), f"Other indexed source ({where})").otherwise(f"Catalog ({where})")


def evidence_table(evidence: DataFrame, limit: int = 80) -> DataFrame:
    """Evidence as text, its fingerprint left out."""
    at = lambda p: F.when(F.col(f"{p}x").isNotNull(), F.format_string("%d, %d, %d", *[F.col(f"{p}{a}") for a in "xyz"])).otherwise("-")
    name = F.element_at(F.create_map(*[F.lit(x) for kv in CHANNELS.items() for x in kv]), F.col("channel"))
    return evidence.select("query_id", "doc_id", scrub(name, limit).alias("channel"), "shared", at("q").alias("input_position"), at("d").alias("match_position"))


def redacted(result: DataFrame) -> DataFrame:
    """A result without file paths and fingerprints; evidence: array of structs with a field `fingerprint`."""
    return result.withColumn("evidence", F.transform("evidence", lambda e: e.dropFields("fingerprint"))).drop("file")


def fingerprint_errors(features: DataFrame) -> DataFrame:
    """(doc_id, error): why a submitted fingerprint (doc_id, channel, hash, cnt, x, y, z) is refused; none for a good one."""
    far = lambda a: F.abs(F.col(a)) > MOST_COORDINATE
    bad = F.when(~F.coalesce(F.col("channel").isin("g", "w", "l", "m", "t"), F.lit(False)), "channel").when((F.col("channel") != "t") & ~F.coalesce(F.col("hash").rlike("^[0-9a-f]{24}$"), F.lit(False)), "hash").when(~F.coalesce(F.col("cnt").between(1, MOST_COUNT), F.lit(False)), "count").when(F.coalesce(far("x") | far("y") | far("z"), F.lit(False)), "position")
    g = features.groupBy("doc_id").agg(F.count("*").alias("keys"), F.min(bad).alias("bad"), (F.count("*") - F.count_distinct("channel", "hash")).alias("repeats"))
    e = F.coalesce("bad", F.when(F.col("keys") > MOST_KEYS, "keys").when(F.col("repeats") > 0, "repeats"))
    return g.select("doc_id", e.alias("error")).filter("error IS NOT NULL")


def tool_outcomes(output: DataFrame) -> DataFrame:
    """(batch, id, ok) from the output of a download tool (batch, text)."""
    out = lambda pattern, ok: output.select("batch", F.explode(F.regexp_extract_all("text", F.lit(pattern), F.lit(1))).alias("id"), F.lit(ok).alias("ok"))
    return out(r"(?i)success\. downloaded item (\d+)", True).union(out(r"(?i)error! download item (\d+) failed", False)).distinct()


def asked_too_often(text: Column) -> Column:
    return text.rlike(TOO_OFTEN)


def kind_codes(points: DataFrame, group: list[str], kind: str, order: str) -> DataFrame:
    """points plus code: kinds of a group numbered from 0 as they first appear."""
    first = points.groupBy(*group, kind).agg(F.min(order).alias("__first"))
    codes = first.withColumn("code", F.row_number().over(Window.partitionBy(*group).orderBy("__first", kind)) - 1).drop("__first")
    return points.join(codes, [*group, kind])


def projected(points: DataFrame, view: str, yaw: float = 0.0, pitch: float = 0.0) -> DataFrame:
    """points plus (u, v, depth): orthographic from the top, side or front, or turned by yaw and pitch."""
    x, y, z = F.col("x").cast("double"), F.col("y").cast("double"), F.col("z").cast("double")
    flat = {"top": (x, z, y), "side": (z, y, x), "front": (x, y, -z)}
    if view in flat:
        u, v, depth = flat[view]
    else:
        sy, cy, sp, cp = F.sin(F.lit(yaw)), F.cos(F.lit(yaw)), F.sin(F.lit(pitch)), F.cos(F.lit(pitch))
        ahead = x * sy + z * cy
        u, v, depth = x * cy - z * sy, y * cp - ahead * sp, y * sp + ahead * cp
    return points.withColumns({"u": u, "v": v, "depth": depth})
