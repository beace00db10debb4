"""Merkle manifest of a dataset with a proof for each row, by fractal traversal.

Rows are leaves.  The leaves of a group (a language) are ordered and hashed upwards in
runs of eight; the groups' roots, ordered by group, are hashed upwards alike, to one root.

Places in a group come from a range sort: a partition's rows are numbered as they lie,
and what lies before the partition is a running sum over partitions.  A group is cut
into aligned blocks of 4096 leaves (eight to the fourth).  Over each block goes a fractal
traversal: the existing subtrees on the current leaf's path are stacked, one for each two
levels, and give its siblings; beside each but the topmost, the desired subtree, the next one
to the right, grows by one leaf a step in a treehash and is finished when it is needed.
A traversal holds a few hundred nodes, whatever the block.  Roots of blocks are leaves
of the next tree, whose proofs are made in the same way by another job, and are appended
to those of the block's leaves.

Defined cases: a null group comes first and is not the group ""; a null id comes first; rows
with one id are ordered by leaf, and equal ones have equal leaves at neighbouring places;
a group of one row has that row's leaf as its root; an empty table has no rows and no root.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import documents, meet, packed, stored

#: Children of a node, levels and leaves of a block, levels of a subtree.
ARITY, LEVELS, SUBTREE = 8, 4, 2
BLOCK = ARITY**LEVELS
STEP = "array<struct<at: int, others: string>>"
#: Leaves whose proofs go out at a time.
OUT = 1024


def h(nodes: list[str]) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


class Growing:
    """A subtree from level `low` to its root at level `top`, by treehash: leaves come one at a time; below `low`, a node goes once it is hashed."""

    def __init__(self, leaves: list[str], low: int, top: int, index: int):
        self.leaves, self.low, self.top = leaves, low, top
        self.at, self.end = index * ARITY**top, min((index + 1) * ARITY**top, len(leaves))
        self.kept: list[list[str]] = [[] for _ in range(top - low)]
        self.open: list[list[str]] = [[] for _ in range(top)]
        self.root = ""

    def put(self, level: int, node: str) -> None:
        while True:
            if level == self.top:
                self.root = node
                return
            if level >= self.low:
                self.kept[level - self.low].append(node)
            self.open[level].append(node)
            if len(self.open[level]) < ARITY:
                return
            node, self.open[level] = h(self.open[level]), []
            level += 1

    def step(self) -> None:
        """Takes the next leaf; the last one closes the runs that are short."""
        if self.at >= self.end:
            return
        self.put(0, self.leaves[self.at])
        self.at += 1
        if self.at == self.end:
            for level in range(self.top):
                if self.open[level]:
                    node, self.open[level] = h(self.open[level]), []
                    self.put(level + 1, node)

    def whole(self) -> Growing:
        while self.at < self.end:
            self.step()
        return self


def levels_of(size: int) -> int:
    """Levels above the leaves of a block, in a tree of `size` leaves: all of a block, or up to the root of a smaller tree."""
    n = 0
    while n < LEVELS and size > 1:
        size, n = -(-size // ARITY), n + 1
    return n


def block_root(leaves: list[str], tall: int) -> str:
    return Growing(leaves, tall, tall, 0).whole().root if tall else leaves[0]


def paths(leaves: list[str], tall: int, subtree: int = SUBTREE) -> Iterator[list[tuple[int, str]]]:
    """For each leaf in turn, from the bottom up, its place in its run and the others of the run."""
    bands = [(low, min(low + subtree, tall)) for low in range(0, tall, subtree)]
    existing = [Growing(leaves, low, top, 0).whole() for low, top in bands]
    desired = [Growing(leaves, low, top, 1) for low, top in bands[:-1]]
    steps: list[tuple[int, str]] = [(0, "")] * tall
    for k in range(len(leaves)):
        for b, (low, top) in enumerate(bands[:-1]):
            if k and k % ARITY**top == 0:
                existing[b] = desired[b]
                desired[b] = Growing(leaves, low, top, k // ARITY**top + 1)
        for level in range(tall):
            if k % ARITY**level:
                break  # from here on the path is the last leaf's
            low, top = bands[level // subtree]
            node = k // ARITY**level
            at = node % ARITY
            nodes = existing[level // subtree].kept[level - low]
            first = node - at - k // ARITY**top * ARITY ** (top - level)
            run = nodes[first : first + ARITY]
            steps[level] = (at, "".join(run[:at] + run[at + 1 :]))
        yield list(steps)
        for d in desired:
            d.step()


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """nodes (tree, hash, ...) with pos, the place in their tree by `order` and hash, and size, the tree's leaves; stored.

    Rows that are equal in all are told apart by a number from their stored order, so that many of them still go to many partitions.
    """
    nodes = stored(nodes)
    by = ["tree", *order, "hash", "__nth"]
    ranged = nodes.withColumn("__nth", F.monotonically_increasing_id()).repartitionByRange(*by).sortWithinPartitions(*by).drop("__nth")
    ranged = stored(ranged.withColumn("__at", F.monotonically_increasing_id())).withColumn("__part", F.shiftright("__at", 33))
    counts = ranged.groupBy("tree", "__part").agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
    tree = Window.partitionBy("tree")
    before = F.coalesce(F.sum("__n").over(tree.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("tree", "__part", "__first", before.alias("__before"), F.sum("__n").over(tree).alias("size"))
    return stored(ranged.join(starts, ["tree", "__part"]).withColumn("pos", F.col("__before") + F.col("__at") - F.col("__first")).drop("__part", "__at", "__first", "__before"))


def in_blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / BLOCK).cast("long"))


def _blocks(stream) -> Iterator[tuple[dict | None, pa.RecordBatch]]:
    """(entry, rows) of each block, whose rows are at most BLOCK."""
    entry, held = None, []
    for new, side, piece in stream:
        if new:
            if held:
                yield entry, pa.Table.from_batches(held).combine_chunks()
            entry, held = None, []
        if side:
            held.append(pa.RecordBatch.from_struct_array(piece.column("d")))
        else:
            entry = piece.column("e")[0].as_py()
    if held:
        yield entry, pa.Table.from_batches(held).combine_chunks()


def _roots(stream):
    for _, t in _blocks(stream):
        size = t.column("size")[0].as_py()
        yield pa.RecordBatch.from_pydict({"tree": [t.column("tree")[0].as_py()], "block": [t.column("block")[0].as_py()], "size": [size], "hash": [block_root(t.column("hash").to_pylist(), levels_of(size))]})


def _steps(keep: list[str], more: list[str], schema: pa.Schema | None = None):
    """Emits the columns `keep` of rows, `more` of their block's entry, and steps: the block's and then the entry's."""

    def run(stream):
        for entry, t in _blocks(stream):
            upper = [(s["at"], s["others"]) for s in (entry or {}).get("steps") or []]
            leaves = t.column("hash").to_pylist()
            made: list[list[tuple[int, str]]] = []
            start = 0

            def out():
                n = len(made)  # noqa: B023
                flat = [s for steps in made for s in steps]  # noqa: B023
                ends = [0]
                for steps in made:  # noqa: B023
                    ends.append(ends[-1] + len(steps))
                values = pa.StructArray.from_arrays([pa.array([a for a, _ in flat], pa.int32()), pa.array([o for _, o in flat], pa.string())], names=["at", "others"])
                cols = {c: t.column(c).slice(start, n).combine_chunks() for c in keep}  # noqa: B023
                cols |= {c: pa.array([(entry or {}).get(c)] * n, pa.string()) for c in more}  # noqa: B023
                cols["steps"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values)
                return pa.RecordBatch.from_pydict(cols)

            for steps in paths(leaves, levels_of(t.column("size")[0].as_py())):
                made.append(steps + upper)
                if len(made) == OUT:
                    yield out()
                    start += len(made)
                    made = []
            if made:
                yield out()

    return run


KEYS = ["tree", "block"]


def climb(nodes: DataFrame) -> tuple[DataFrame | None, DataFrame]:
    """Of placed nodes (tree, pos, size, hash): (tree, block, steps), the proofs of their blocks' roots (None where each tree is one block), and (tree, hash), the trees' roots."""
    dealt = in_blocks(nodes).select("tree", "block", "pos", "size", "hash")
    roots = stored(meet(dealt, None, KEYS, ["pos"], _roots, "tree string, block long, size long, hash string"))
    if not roots.filter(F.col("size") > BLOCK).limit(1).count():
        return None, roots.select("tree", "hash")
    above = roots.select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / BLOCK).cast("long").alias("size"), "hash")
    return proofs(above), climb(above)[1]


def proofs(nodes: DataFrame) -> DataFrame:
    """(tree, block, steps) for placed nodes whose pos is the block's number."""
    upper, _ = climb(nodes)
    steps = meet(in_blocks(nodes).select("tree", "block", "pos", "size", "hash"), upper, KEYS, ["pos"], _steps(["tree", "pos"], []), f"tree string, pos long, steps {STEP}")
    return stored(steps.select("tree", F.col("pos").alias("block"), "steps"))


def manifest(df: DataFrame, group: str, order: list[str], leaf: Column) -> DataFrame:
    """(__row, leaf, subroot, root, proof): the row as a struct of all its columns, its leaf, its group's root, the root of all, and the proof.

    A proof is an array of (at, others): from the bottom up, the place among the run's nodes and the other
    nodes' digests in their order; the steps to subroot are followed by those to root.
    """
    tree = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit(""))  # null first, and not ""
    keys = {f"__o{i}": F.col(f"`{c}`") for i, c in enumerate(order)}
    nodes = placed(packed(df, tree=tree, hash=leaf, **keys), list(keys))
    upper, subroots = climb(nodes)
    subroots = stored(subroots.withColumnRenamed("hash", "subroot"))
    groups = placed(subroots.select(F.lit("").alias("tree"), F.col("subroot").alias("hash"), F.col("tree").alias("of")), ["of"])
    over, top = climb(groups)
    last = meet(in_blocks(groups), over, KEYS, ["pos"], _steps(["of", "hash"], []), f"of string, hash string, steps {STEP}")
    last = stored(last.crossJoin(F.broadcast(top.select(F.col("hash").alias("root")))).select(F.col("of").alias("tree"), F.col("hash").alias("subroot"), "root", F.col("steps").alias("last")))  # top is one row
    blocks = in_blocks(nodes)
    entries = blocks.select(*KEYS).distinct() if upper is None else upper
    entries = entries.join(last, "tree").select(*KEYS, F.concat("steps", "last").alias("steps") if upper is not None else F.col("last").alias("steps"), "subroot", "root")
    kinds = T.StructType([blocks.schema["__row"], blocks.schema["hash"], T.StructField("subroot", T.StringType()), T.StructField("root", T.StringType()), T.StructField("steps", T._parse_datatype_string(STEP))])
    return meet(blocks.select(*KEYS, "pos", "size", "hash", "__row"), entries, KEYS, ["pos"], _steps(["__row", "hash"], ["subroot", "root"]), kinds).withColumnsRenamed({"hash": "leaf", "steps": "proof"})


def leaf_of(*values: Column) -> Column:
    """Digest of values: '-' for null, else the number of UTF-8 bytes, ':' and the value."""
    said = [F.coalesce(F.concat(F.octet_length(v.cast("string")).cast("string"), F.lit(":"), v.cast("string")), F.lit("-")) for v in values]
    return F.sha2(F.concat(*said), 256)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""

    def up(node: Column, step: Column) -> Column:
        cut = step["at"] * 64
        return F.sha2(F.concat(F.substr(step["others"], F.lit(1), cut), node, F.substr(step["others"], cut + 1)), 256)

    return F.aggregate(proof, leaf, up)


def proof_digest(proof: Column) -> Column:
    return F.sha2(F.array_join(F.transform(proof, lambda s: s["others"]), ""), 256)


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def op11_dataset_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "lang", "n_chars", "text")
    head = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.lit(False))
    # digests are made where the texts are read; no text is shuffled
    rows = docs.select("doc_id", "lang", leaf_of(*head, F.col("text")).alias("own"), F.when(tampered, leaf_of(*head, F.translate("text", UPPER, LOWER))).alias("other"))
    m = manifest(rows, "lang", ["doc_id"], F.col("own"))
    m = m.select("__row.doc_id", "leaf", "subroot", "root", proof_digest(F.col("proof")).alias("proof_sha256"), folded(F.coalesce("__row.other", "leaf"), F.col("proof")).alias("folded_root"))
    return m.withColumn("verified", F.col("folded_root") == F.col("root"))


def crc32_sql(text: str) -> str:
    """SQL for the CRC-32 of ASCII text, bit by bit."""
    bits = f"flatten(list_transform(string_split({text}, ''), lambda c: list_transform(range(8), lambda k: (ascii(c) >> k) & 1)))"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {bits}::BIGINT[]), lambda s, b: xor(s >> 1, (xor(s, b) & 1) * 3988292384)), 4294967295)"


def _oracle(levels: int = 7) -> str:
    """SQL for trees of at most eight to the power of `levels` leaves a language."""
    said = lambda text: " || ".join(f"coalesce(strlen({v}::VARCHAR)::VARCHAR || ':' || {v}::VARCHAR, '-')" for v in ("doc_id", "source", "lang", "n_chars", text))
    out = [f"a0 AS (SELECT doc_id, lang, sha256({said('text')}) AS h, sha256({said(f'translate(text, {chr(39)}{UPPER}{chr(39)}, {chr(39)}{LOWER}{chr(39)})')}) AS o FROM documents)"]
    out.append("a1 AS (SELECT *, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS p FROM a0)")
    out.append("n0 AS (SELECT tree, p AS i, h FROM a1)")

    def up(name: str, first: str):
        for k in range(levels):
            here, above = f"{name}{k}", f"{name}{k + 1}"
            out.append(f"{above} AS (SELECT tree, i // 8 AS i, CASE WHEN max(c) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM (SELECT *, count(*) OVER (PARTITION BY tree) AS c FROM {here}) GROUP BY tree, i // 8)")

    up("n", "n0")
    out.append(f"m0 AS (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS i, tree AS of, h FROM n{levels})")
    up("m", "m0")
    # others and place of a node, where its level has several nodes
    steps, joins, proof = [], [], []
    for name, i in (("n", "a1.p"), ("m", "m0.i")):
        for k in range(levels):
            s = f"{name}s{k}"
            out.append(
                f"{s} AS (SELECT a.tree, a.i, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i < a.i), '') AS l, coalesce(string_agg(b.h, '' ORDER BY b.i) FILTER (b.i > a.i), '') AS r FROM {name}{k} a JOIN {name}{k} b ON a.tree = b.tree AND a.i // 8 = b.i // 8 JOIN (SELECT tree FROM {name}{k} GROUP BY tree HAVING count(*) > 1) t ON t.tree = a.tree GROUP BY a.tree, a.i)"
            )
            joins.append(f"LEFT JOIN {s} ON {s}.tree = {'a1.tree' if name == 'n' else chr(39) * 2} AND {s}.i = {i} // {8**k}")
            steps.append(s)
            proof.append(f"coalesce({s}.l || {s}.r, '')")
    out.append(f"f0 AS (SELECT a1.doc_id, a1.h AS leaf, n{levels}.h AS subroot, m{levels}.h AS root, sha256({' || '.join(proof)}) AS proof_sha256, CASE WHEN doc_id IS NOT NULL AND {crc32_sql("a1.doc_id::VARCHAR")} % 3 = 0 THEN a1.o ELSE a1.h END AS x0, {', '.join(f'{s}.l AS l{j}, {s}.r AS r{j}' for j, s in enumerate(steps))} FROM a1 JOIN n{levels} ON n{levels}.tree = a1.tree JOIN m0 ON m0.of = a1.tree CROSS JOIN m{levels} {' '.join(joins)})")
    for j in range(len(steps)):
        out.append(f"f{j + 1} AS (SELECT * EXCLUDE (x{j}), CASE WHEN l{j} IS NULL THEN x{j} ELSE sha256(l{j} || x{j} || r{j}) END AS x{j + 1} FROM f{j})")
    j = len(steps)
    return f"WITH {', '.join(out)} SELECT doc_id, leaf, subroot, root, proof_sha256, x{j} AS folded_root, x{j} = root AS verified FROM f{j}"


ORACLE = _oracle()
