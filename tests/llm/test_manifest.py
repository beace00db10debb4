"""The dataset manifest against a tree built level by level."""

import random
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from cellweave.llm import manifest


def h(xs):
    return sha256("".join(xs).encode()).hexdigest()


def tree(leaves):
    """Root, and for each leaf the runs on its way up."""
    ways, level = [[] for _ in leaves], list(leaves)
    at = list(range(len(leaves)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, i in enumerate(at):
            run = runs[i // 8]
            ways[k].append((i % 8, "".join(run[: i % 8] + run[i % 8 + 1 :])))
        level, at = [h(r) for r in runs], [i // 8 for i in at]
    return (level or [None])[0], ways


@pytest.mark.parametrize("subtree", [1, 2, 3])
def test_fractal_paths(subtree):
    for n in [*range(1, 80), 511, 512, 513, 1000, 4095, 4096]:
        leaves = [h([str(n), str(i)]) for i in range(n)]
        root, ways = tree(leaves)
        assert list(manifest.paths(leaves, manifest.levels_of(n), subtree)) == ways
        assert manifest.block_root(leaves, manifest.levels_of(n)) == root


def expected(rows):
    """rows: (id, group, text)."""
    said = lambda *vs: h(["-" if v is None else f"{len(str(v).encode())}:{v}" for v in vs])
    by = {}
    for i, g, t in rows:
        by.setdefault(g, []).append((i is not None, i or 0, said(i, g, t)))
    groups = sorted(by, key=lambda g: (g is not None, (g or "").encode()))
    made = {g: tree([x[2] for x in sorted(by[g])]) for g in groups}
    root, over = tree([made[g][0] for g in groups])
    out = []
    for g, last in zip(groups, over, strict=True):
        for (_, _, leaf), way in zip(sorted(by[g]), made[g][1], strict=True):
            out.append((leaf, made[g][0], root, tuple(way + last)))
    return sorted(out)


def got(df):
    leaf = manifest.leaf_of(F.col("doc_id"), F.col("lang"), F.col("text"))
    m = manifest.manifest(df, "lang", ["doc_id"], leaf)
    rows = m.select("*", manifest.folded(F.col("leaf"), F.col("proof")).alias("again"), manifest.proof_digest(F.col("proof")).alias("digest")).collect()
    for r in rows:
        assert r["again"] == r["root"] and r["digest"] == h([s["others"] for s in r["proof"]])
    return sorted((r["leaf"], r["subroot"], r["root"], tuple((s["at"], s["others"]) for s in r["proof"])) for r in rows)


SCHEMA = "doc_id long, lang string, text string, subroot int, tree string"


@pytest.mark.parametrize("n", [1, 9, 9000])
def test_manifest(spark, n):
    """A hot group of several blocks, nulls, the empty group, repeated rows, and columns named as the operator's."""
    r = random.Random(n)
    rows = [(i if i % 50 else None, r.choice(["en"] * 6 + ["ä", "", None, "zz"]), r.choice(["", None, "a", f"text {i}"])) for i in range(n)]
    rows += rows[:4] * 3 if n > 1 else []
    df = spark.createDataFrame([(*x, 7, "mine") for x in rows], SCHEMA)
    assert got(df) == expected(rows)


def test_equal_rows_and_empty(spark):
    rows = [(1, "en", "same")] * 700
    assert got(spark.createDataFrame([(*x, 7, "") for x in rows], SCHEMA)) == expected(rows)
    assert got(spark.createDataFrame([], SCHEMA)) == []


def test_tampering_shows(spark, tmp_path):
    rows = [(i, f"s{i % 3}", t, "en", 3) for i, t in enumerate(["ABC", "abc", None, "", "Zz", "ABC"] * 20)]
    spark.createDataFrame(rows, "doc_id long, source string, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    from zlib import crc32

    for r in manifest.op11_dataset_manifest(spark, str(tmp_path)).collect():
        text = rows[r["doc_id"]][2]
        changed = crc32(str(r["doc_id"]).encode()) % 3 == 0 and text is not None and text.lower() != text
        assert r["verified"] is not changed
