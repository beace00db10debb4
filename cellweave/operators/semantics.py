"""Logic links and controller graphs as rows.

links (doc_id, type, x0, y0, z0, x1, y1, z1, ord), placed (doc_id, x, y, z, kind),
nodes (doc_id, def_id, node_id, base), edges (doc_id, def_id, target, port, slot, source).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.functions.hashing import domain_digest

DOMAIN = "cells:semantics:v1\x00"


def _array(items) -> F.Column:
    return F.concat(F.lit("["), F.concat_ws(",", items), F.lit("]"))


def _quoted(c) -> F.Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def logic_features(links: DataFrame, placed: DataFrame) -> DataFrame:
    """(doc_id, hash, cnt, x, y, z): type, shift and the sorted kinds at both ends (none where nothing is placed)."""
    kinds = placed.groupBy("doc_id", "x", "y", "z").agg(_array(F.transform(F.sort_array(F.collect_list("kind")), _quoted)).alias("kinds"))
    end = lambda k: kinds.select("doc_id", *[F.col(a).alias(f"{a}{k}") for a in "xyz"], F.col("kinds").alias(f"k{k}"))
    d = links.dropna(subset=[f"{a}{k}" for a in "xyz" for k in (0, 1)])
    for k in (0, 1):
        d = d.join(end(k), ["doc_id", *[f"{a}{k}" for a in "xyz"]], "left")
    shift = _array(F.array(*[(F.col(f"{a}1") - F.col(f"{a}0")).cast("string") for a in "xyz"]))
    payload = _array(F.array(_quoted(F.coalesce("type", F.lit(""))), shift, _array(F.array(F.coalesce("k0", F.lit("[]")), F.coalesce("k1", F.lit("[]"))))))
    h = d.withColumn("hash", domain_digest(DOMAIN, "logic-link", payload))
    g = h.groupBy("doc_id", "hash").agg(F.count("*").alias("cnt"), F.min_by(F.struct("x0", "y0", "z0"), "ord").alias("at"))
    return g.select("doc_id", "hash", "cnt", F.col("at.x0").alias("x"), F.col("at.y0").alias("y"), F.col("at.z0").alias("z"))


def refined_labels(nodes: DataFrame, edges: DataFrame, rounds: int = 2) -> DataFrame:
    """nodes plus label: each round hashes a node's base with the sorted (port, slot, label) of its sources."""
    key = ["doc_id", "def_id"]
    live = edges.join(nodes.select(*key, F.col("node_id").alias("source")), [*key, "source"], "left_semi")
    now = nodes.withColumn("label", F.col("base"))
    for _ in range(rounds):
        came = live.join(now.select(*key, F.col("node_id").alias("source"), "label"), [*key, "source"])
        seen = came.groupBy(*key, F.col("target").alias("node_id")).agg(_array(F.transform(F.sort_array(F.collect_list(F.struct("port", "slot", "label"))), lambda s: _array(F.array(_quoted(s["port"]), _quoted(s["slot"]), _quoted(s["label"]))))).alias("seen"))
        joined = nodes.join(seen, [*key, "node_id"], "left")
        now = joined.withColumn("label", domain_digest(DOMAIN, "micro-refine", _array(F.array(_quoted(F.col("base")), F.coalesce("seen", F.lit("[]")))))).drop("seen")
    return now


def graph_features(labelled: DataFrame, edges: DataFrame, ports: DataFrame) -> DataFrame:
    """(doc_id, def_id, hash): the whole graph of a controller with three nodes and two edges at least.

    ports: (doc_id, def_id, slot, mode, type, flags, node_id); a port without node has no label.
    """
    key = ["doc_id", "def_id"]
    n = labelled.groupBy(*key).agg(F.count("*").alias("nodes"), _array(F.transform(F.sort_array(F.collect_list("label")), _quoted)).alias("labels"))
    live = edges.join(labelled.select(*key, F.col("node_id").alias("source")), [*key, "source"], "left_semi")
    e = live.groupBy(*key).agg(F.count("*").alias("edges"))
    p = ports.join(labelled.select(*key, "node_id", "label"), [*key, "node_id"], "left")
    p = p.groupBy(*key).agg(_array(F.transform(F.sort_array(F.collect_list(F.struct("slot", "mode", "type", "flags", F.coalesce("label", F.lit("")).alias("label")))), lambda s: _array(F.array(*[_quoted(s[c]) for c in ("slot", "mode", "type", "flags", "label")])))).alias("ports"))
    d = n.join(e, key).join(p, key, "left").filter("nodes >= 3 AND edges >= 2")
    return d.select(*key, domain_digest(DOMAIN, "micro-graph", _array(F.array("labels", F.coalesce("ports", F.lit("[]")), F.col("edges").cast("string")))).alias("hash"))


def script_features(scripts: DataFrame, least: int = 64) -> DataFrame:
    """(doc_id, def_id, hash) of scripts of `least` characters or more, line ends made alike."""
    from cellweave.functions.text import normalise_script

    return scripts.withColumn("s", normalise_script(F.col("script"))).filter(F.char_length("s") >= least).select("doc_id", "def_id", domain_digest(DOMAIN, "micro-script", _quoted(F.col("s"))).alias("hash"))
