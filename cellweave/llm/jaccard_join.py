"""N-gram Jaccard join by chosen paths.

A document is the set of its five-word shingles; texts with one set are copies, and
one set stands for them.  A set is embedded by minhashes, each a token of the set
sampled alike in all sets.  In each run a path starts at one sampled token: sets that
share it meet in a bucket.  A bucket of more than LIMIT sets is split on further
sampled tokens (at the first two splits a set goes on with two of them), until it is
small or a split leaves it about as large as it was, that is, its sets are alike.
Buckets are compared by brute force, in blocks of BLOCK sets that different tasks
compare.  Pairs that the minhashes don't rule out are then compared on their whole
shingle sets, in blocks of BLOCK_BYTES at most.

A pair at similarity 0.8 meets in a run with probability 0.8 (in a bucket that is split
once 0.77, twice 0.74).  Each link is known with the number of runs that it is found
in; from the links that one run and two runs found, the number of links that none
found is estimated (Chao's estimator), and all is done again with twice as many runs
until the estimated recall is TARGET or more.

Links are counted, not listed: a pair is counted in the first bucket that both are
in.  Out of a bucket come each set's number of links and the edges of a tree over
each linked part, at most one for a set; classes are the connected components.

Defined cases: words are runs without ASCII white space, in lower case; a text of one
to four words is one shingle; a text without words has no shingles, no links and a
class of its own; ids are of any type that can be ordered; a row without id has no id
to lend to its class, which is known by its least other id (null without any); repeated
rows are copies; different texts under one id are documents of their own; an empty
table gives no rows; other columns, whatever their names, pass through one_of_each.
"""

from __future__ import annotations

import logging
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import components, documents, map_groups, packed, slices, stored, text_of

WORDS, FOUR_FIFTHS = 5, (4, 5)
#: Runs to begin with and at most; estimated recall that ends them.
RUNS, MOST_RUNS, TARGET = 6, 48, 0.999
#: Sets of a bucket that isn't split; sets and bytes of shingles of a block.
LIMIT, BLOCK, BLOCK_BYTES = 400, 400, 4 << 20
#: Splits at most (a bucket that is still large then is compared in blocks); leaf buckets of a set in a run: after choices a and b it is in slot 2a + b.
LEVELS, SLOTS = 8, 4
#: Minhashes that splits beyond the second choose from.
DEEP = 22
#: Share of agreeing minhashes under which a pair is not compared further: at 0.8 a pair has fewer with probability 1e-11 (64 minhashes, binomial).
AGREE = 0.44
#: Bytes of text whose shingles a worker holds at a time; bytes of a word from which it is hashed by itself.
SLICE, LONG = 1 << 20, 1 << 16

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def size_of(runs: int) -> int:
    """Minhashes for so many runs: one for a run's start, two and four for its first splits, and DEEP for all others."""
    return 7 * runs + DEEP


@lru_cache(8)
def _multipliers(size: int) -> np.ndarray:
    return np.random.default_rng(20240607).integers(1, 2**63, size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


@lru_cache(2)
def _word_powers(base: int) -> np.ndarray:
    return _powers(base, SLICE + LONG + 1)


def word_hashes(x: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word, a part of x at a time."""
    out = np.empty(len(starts), np.uint64)
    part = starts // SLICE
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(starts)]]) if len(starts) else np.zeros(1, np.int64)
    up, down = _word_powers(_P), _word_powers(_PINV)
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        s, e = starts[a:b], np.minimum(ends[a:b], starts[a:b] + LONG)
        low = int(s[0])
        n = int(e[-1]) - low
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((x[low : low + n].astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
        out[a:b] = _mix((sums[e - low] - sums[s - low]) * down[s - low])
    for i in np.flatnonzero(ends - starts > LONG).tolist():
        out[i] = xxhash.xxh3_64_intdigest(x[starts[i] : ends[i]].tobytes())
    return out


def shingle_sets(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw = [t.lower().encode() for t in texts]
    joined = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
    space = _SPACE[joined]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    w = word_hashes(joined, starts, ends)
    bounds = np.cumsum([0, *(len(r) + 1 for r in raw)])
    first = np.searchsorted(starts, bounds)
    g = np.zeros(max(0, len(w) - words + 1), np.uint64)
    for k in range(words):
        g = _mix(g + w[k : len(w) - words + 1 + k] * np.uint64(2 * k + 3)) if len(g) else g
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= words:
            out.append(np.unique(g[a : b - words + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for k in range(a, b):
                h = _mix(h + w[k : k + 1] * np.uint64(5))
            out.append(h)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def signature(s: np.ndarray, size: int) -> np.ndarray:
    best = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    by = _multipliers(size)[None, :]
    for at in range(0, len(s), 2048):
        np.minimum(best, (s[at : at + 2048, None] * by).min(0), out=best)
    return (best >> np.uint64(32)).astype(np.uint32)


def set_id(s: np.ndarray, handle: int) -> bytes:
    """Digest of the set; of the row's handle if it is empty."""
    return xxhash.xxh3_128_digest(s.tobytes() if len(s) else b"none%d" % handle)


def described(docs: DataFrame, size: int) -> DataFrame:
    """docs: key, handle, __text -> key, handle, sid (digest of the set), n (its size), sig."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                sets = shingle_sets(part.column("__text").to_pylist())
                sids = [set_id(s, h) for s, h in zip(sets, part.column("handle").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("handle"), pa.array(sids, pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array([signature(s, size).tobytes() for s in sets], pa.binary())], names=["key", "handle", "sid", "n", "sig"])

    return docs.mapInArrow(run, f"key {dict(docs.dtypes)['key']}, handle long, sid binary, n long, sig binary")


def coordinate(runs: int, run, level: int, slot):
    """The minhash that a path goes on with; none is used twice on a path, and none by two runs at the first levels."""
    if level == 0:
        return run
    if level == 1:
        return runs + 2 * run + slot // 2
    if level == 2:
        return 3 * runs + 4 * run + slot
    return 7 * runs + (run * SLOTS + slot + 5 * level) % DEEP


def _signatures(table: pa.Table | pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("sig").to_pylist()), "<u4").reshape(table.num_rows, -1)


def children(sets: DataFrame, level: int, runs: int) -> DataFrame:
    """sets: sid, sig and, beyond level 0, run, slot, bucket, parent -> rows of the next buckets (sid, run, slot, bucket, parent)."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = _signatures(batch)
            n = len(sig)
            ways = runs if level == 0 else 2 if level < 3 else 1
            at, way = np.repeat(np.arange(n), ways), np.tile(np.arange(ways), n)
            if level == 0:
                which, slots, came, parent = way, np.zeros(n * ways, np.int64), np.zeros(n * ways, np.uint64), np.zeros(n * ways, np.int64)
            else:
                col = lambda c: np.repeat(batch.column(c).to_numpy(), ways).astype(np.int64)
                which, slots, parent, came = col("run"), col("slot"), col("parent"), col("bucket").view(np.uint64)
                slots = slots + (2 * way if level == 1 else way)
            c = coordinate(runs, which, level, slots)
            bucket = _mix(_mix(came + c.astype(np.uint64) * np.uint64(0x1F123BB5) + np.uint64(level + 1)) ^ (sig[at, c].astype(np.uint64) * _M1)).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("sid").take(pa.array(at)), pa.array(which, pa.int32()), pa.array(slots, pa.int32()), pa.array(bucket, pa.int64()), pa.array(parent, pa.int64())], names=["sid", "run", "slot", "bucket", "parent"])

    return sets.mapInArrow(run, "sid binary, run int, slot int, bucket long, parent long")


def leaf_buckets(sets: DataFrame, limit: int, runs: int) -> DataFrame:
    """(sid, slot, bucket, size): the buckets of two sets or more in which each set is compared; slots number runs and choices."""
    leaves = None
    rows = children(sets.select("sid", "sig"), 0, runs)
    for level in range(LEVELS):
        rows = stored(rows)
        sizes = stored(rows.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"))
        met = rows.join(sizes, "bucket")
        whole = (F.col("size") <= limit) | ((F.col("parent") > 0) & (2 * F.col("size") > F.col("parent")))
        last = level == LEVELS - 1 or not sizes.filter(F.col("size") > limit).limit(1).count()
        leaf = (met if last else met.filter(whole)).select("sid", (F.col("run") * SLOTS + F.col("slot")).alias("slot"), "bucket", "size")
        leaves = leaf if leaves is None else leaves.union(leaf)
        if last:
            break
        on = met.filter(~whole).select("sid", "run", "slot", "bucket", F.col("size").alias("parent"))
        rows = children(on.join(sets.select("sid", "sig"), "sid"), level + 1, runs)
    return leaves


def _dealt(rows: DataFrame, gid: str, blocks) -> DataFrame:
    """Rows of groups dealt to smaller ones so that each pair that a group compares is compared in exactly one.

    rows: sid, side and the group.  A group on one side (0) of several blocks becomes one for each two blocks
    (side 1 against 2) and one for each block with itself (side 0); in a group of two sides, a block of one side
    meets each of the other.
    """
    d = rows.withColumn("blocks", blocks.cast("int")).withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    first = F.when(F.col("side") == 0, F.least("own", "other")).when(F.col("side") == 1, F.col("own")).otherwise(F.col("other"))
    second = F.when(F.col("side") == 0, F.greatest("own", "other")).when(F.col("side") == 1, F.col("other")).otherwise(F.col("own"))
    side = F.when((F.col("side") != 0) | (F.col("own") == F.col("other")), F.col("side")).when(F.col("own") < F.col("other"), 1).otherwise(2)
    dealt = F.when(F.col("blocks") == 1, F.col(gid)).otherwise(F.xxhash64(gid, first, second))
    return d.withColumn("gid", dealt).withColumn("side", side.cast("int")).drop("blocks", "own", "other")


def blocked(leaves: DataFrame, block: int) -> DataFrame:
    """Leaf buckets as groups (gid) of at most about two blocks."""
    return _dealt(leaves.withColumn("side", F.lit(0)), "bucket", F.ceil(F.col("size") / block)).drop("size")


def weighed(found: DataFrame, sizes: DataFrame, block_bytes: int) -> DataFrame:
    """Candidates of groups with their sets' sizes; groups of more than block_bytes of shingles a side are dealt again."""
    d = found.join(sizes.select("sid", "n"), "sid")
    heavy = stored(d.groupBy("gid").agg(F.ceil(8 * F.sum("n") / block_bytes).alias("parts")).filter("parts > 1"))
    d = d.join(heavy, "gid", "left").withColumnRenamed("gid", "was")
    return _dealt(d, "was", F.coalesce("parts", F.lit(1))).drop("was", "parts", "n")


def _pairs(side: np.ndarray, first: np.ndarray):
    """For each set of a group, those after it that it is to be compared with."""
    n = len(side)
    for i in range(n - 1):
        j = np.arange(i + 1, n)
        if side[i] or side[-1]:  # two blocks: only across
            j = j[side[j] != side[i]]
        if len(j):
            yield i, j


def _uncounted(slots: np.ndarray, slot: int, i: int, j: np.ndarray) -> np.ndarray:
    """Those of j that share no earlier bucket with i."""
    if not slot or not len(j):
        return j
    mine = slots[i, :slot]
    return j[~((slots[j, :slot] == mine) & (mine != 0)).any(1)]


def _slot_matrix(table: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(table.column("slots").to_pylist()), ">i8").reshape(table.num_rows, -1).astype(np.int64)


def _runs_of(slots: np.ndarray, i: int, j: np.ndarray) -> np.ndarray:
    """In how many runs i and each of j share a bucket."""
    both = (slots[j] == slots[i]) & (slots[i] != 0)
    return both.reshape(len(j), -1, SLOTS).any(2).sum(1)


def _distinct(table: pa.Table) -> pa.Table:
    """One row for each set and side (repeated rows of one id bring a set twice)."""
    seen, keep = set(), []
    for i, x in enumerate(zip(table.column("sid").to_pylist(), table.column("side").to_pylist(), strict=True)):
        if x not in seen:
            seen.add(x)
            keep.append(i)
    return table if len(keep) == table.num_rows else table.take(keep)


def candidates(table: pa.Table) -> pa.Table | None:
    """The rows of a group with a partner that the minhashes don't rule out."""
    if table.num_rows < 2:
        return None
    sig = _signatures(table)
    least = AGREE * sig.shape[1]
    n, side, slot = table.column("n").to_numpy(), table.column("side").to_numpy(), int(table.column("slot")[0].as_py())
    slots, hit = _slot_matrix(table), np.zeros(len(n), bool)
    for i, j in _pairs(side, n):
        j = j[(5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))]
        if len(j):
            j = _uncounted(slots, slot, i, j[(sig[j] == sig[i]).sum(1) >= least])
            if len(j):
                hit[i] = True
                hit[j] = True
    return table.select(["gid", "sid", "slot", "side", "slots"]).filter(pa.array(hit)) if hit.any() else None


def intersections(sets: list[np.ndarray]):
    """A function (i, j) -> sizes of the intersections of set i with sets j, on bits of the shingles that two sets or more hold."""
    flat = np.concatenate(sets)
    values, where, counts = np.unique(flat, return_inverse=True, return_counts=True)
    number = np.cumsum(counts > 1) - 1
    width = int((counts > 1).sum())
    of = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    common = counts[where] > 1
    words = max(1, -(-width // 64))
    bits = np.zeros((len(sets), words), np.uint64)
    col = number[where[common]]
    np.bitwise_or.at(bits, (of[common], col // 64), np.uint64(1) << (col % 64).astype(np.uint64))
    return lambda i, j: np.bitwise_count(bits[j] & bits[i]).sum(1, dtype=np.int64)


def verified(table: pa.Table) -> pa.Table | None:
    """Links of a group: each linked set's number of linked documents, and its parent in a tree over its linked part.

    pairs, once, twice: the pairs of sets that this set and later ones form, and those of them that one run or two runs found.
    """
    table = _distinct(table)
    if table.num_rows < 2:
        return None
    sets = [np.frombuffer(x, "<u8") for x in table.column("shingles").to_pylist()]
    n, side, slot = np.array(list(map(len, sets))), table.column("side").to_numpy(), int(table.column("slot")[0].as_py())
    copies, slots, inter = table.column("copies").to_numpy(), _slot_matrix(table), intersections(sets)
    links, root, seen = np.zeros(len(n), np.int64), list(range(len(n))), np.zeros((3, len(n)), np.int64)

    def top(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j in _pairs(side, n):
        j = _uncounted(slots, slot, i, j[(5 * np.minimum(n[j], n[i]) >= 4 * np.maximum(n[j], n[i]))])
        if not len(j):
            continue
        both = inter(i, j)
        j = j[FOUR_FIFTHS[1] * both >= FOUR_FIFTHS[0] * (n[i] + n[j] - both)]
        if len(j):
            links[i] += copies[j].sum()
            links[j] += copies[i]
            times = _runs_of(slots, i, j)
            seen[:, i] = len(j), (times == 1).sum(), (times == 2).sum()
            mine = top(i)
            for x in j.tolist():
                if (other := top(x)) != mine:
                    root[other] = mine
    linked = np.flatnonzero(links)
    if not len(linked):
        return None
    sids = table.column("sid").to_pylist()
    parts: dict[int, list[int]] = {}
    for i in linked.tolist():
        parts.setdefault(top(i), []).append(i)
    parent = np.zeros(len(n), np.int64)  # its place in the group
    for members in parts.values():  # a tree in which a node has at most 32 children, the least set on top
        members.sort(key=sids.__getitem__)
        for k, i in enumerate(members):
            parent[i] = members[(k - 1) // 32 if k else 0]
    sid = table.column("sid")
    return pa.table({"sid": sid.take(pa.array(linked)), "parent": sid.take(pa.array(parent[linked])), "links": pa.array(links[linked])} | {c: pa.array(seen[k][linked]) for k, c in enumerate(("pairs", "once", "twice"))})


def estimated_recall(pairs: int, once: int, twice: int, runs: int) -> float:
    """Share of links found, from the numbers of all found and of those that one and two of the runs found."""
    if not pairs:
        return 1.0
    missed = (runs - 1) / runs * (once * once / (2 * twice) if twice else once * (once - 1) / 2)
    return pairs / (pairs + missed)


def _shingled(docs: DataFrame) -> DataFrame:
    """docs: handle, __text -> sid, shingles."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                sets = shingle_sets(part.column("__text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array([set_id(s, h) for s, h in zip(sets, part.column("handle").to_pylist(), strict=True)], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["sid", "shingles"])

    return docs.mapInArrow(run, "sid binary, shingles binary")


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """key, __text and a handle, by which a row's text is found again."""
    d = df.select(F.col(id_col).alias("key"), text_of(text_col).alias("__text"))
    return d.withColumn("handle", F.xxhash64("key", "__text"))


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: key (its id), copy_of (least id of its copies), class_id (least id of its class), n_links (documents at 0.8 or more)."""
    return _classes(df, id_col, text_col, **options)[0].select("key", "copy_of", "class_id", "n_links")


def _links(docs: DataFrame, sets: DataFrame, limit: int, block: int, block_bytes: int, runs: int) -> DataFrame:
    """(sid, parent, links, pairs, once, twice) of all groups."""
    leaves = stored(leaf_buckets(sets.filter("n > 0"), limit, runs))
    # a set's leaf buckets by slot, as bytes
    in_slot = lambda m: F.concat(*[F.unhex(F.lpad(F.hex(F.coalesce(m[i], F.lit(0))), 16, "0")) for i in range(runs * SLOTS)])
    of = leaves.groupBy("sid").agg(F.map_from_entries(F.collect_set(F.struct("slot", "bucket"))).alias("m")).select("sid", in_slot(F.col("m")).alias("slots"))
    known = sets.join(of, "sid").select("sid", "n", "sig", "slots")
    groups = blocked(leaves, block).join(known, "sid")
    found = stored(map_groups(groups, "gid", [], candidates, "gid long, sid binary, slot int, side int, slots binary"))
    needed = stored(found.select("sid").distinct().join(sets.select("sid", "handle", "copies"), "sid"))
    # texts are dealt by handle at every size: a broadcast would stop being possible as the corpus grows
    shingles = stored(_shingled(docs.select("handle", "__text").join(needed.select("handle").distinct().hint("merge"), "handle", "left_semi")).join(needed.select("sid", "copies"), "sid"))
    full = weighed(found, sets, block_bytes).join(shingles, "sid")
    return stored(map_groups(full, "gid", [], verified, "sid binary, parent binary, links long, pairs long, once long, twice long"))


def _classes(df: DataFrame, id_col: str, text_col: str, limit: int = LIMIT, block: int = BLOCK, block_bytes: int = BLOCK_BYTES, runs: int = RUNS, target: float = TARGET) -> tuple[DataFrame, float]:
    """near_classes with the digests of the document's set (sid) and of its class's least one (class_sid), and the estimated recall."""
    docs = _keyed(df, id_col, text_col)
    while True:
        rows = stored(described(docs, size_of(runs)))
        sets = stored(rows.groupBy("sid").agg(F.min("key").alias("rep"), F.min("handle").alias("handle"), F.count("*").alias("copies"), F.min("n").alias("n"), F.min("sig").alias("sig")))
        links = _links(docs, sets, limit, block, block_bytes, runs)
        seen = links.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("pairs", "once", "twice")]).first()
        recall = estimated_recall(*seen, runs)
        logging.getLogger(__name__).info("%d runs: %d links between sets, estimated recall %.5f", runs, seen[0], recall)
        if recall >= target or 2 * runs > MOST_RUNS:
            break
        runs *= 2
    labels = components(links.select(F.col("sid").alias("a"), F.col("parent").alias("b")))
    counted = links.groupBy("sid").agg(F.sum("links").alias("links"))
    named = sets.select("sid", "rep", "copies").join(counted, "sid", "left").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("label", F.coalesce("label", "sid"))
    named = stored(named)
    least = named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "sid")).alias("least"))
    classes = stored(named.join(least, "label").select("sid", F.col("rep").alias("copy_of"), F.col("least.rep").alias("class_id"), F.col("least.sid").alias("class_sid"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return rows.select("key", "sid").join(classes, "sid").select("key", "sid", "copy_of", "class_id", "class_sid", "n_links"), recall


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """df with one document of each class, that with the least id and then the least digest of its set; df's columns.

    Where an id is null or repeated, rows are told apart by their texts, and of equal ids and sets the least row stays.
    """
    classes = stored(_classes(df, id_col, text_col, **options)[0])
    gone = classes.filter("NOT (key <=> class_id AND sid = class_sid)").select(F.col("key").alias("__key"), F.col("sid").alias("__sid")).distinct()
    d = packed(df, __key=F.col(id_col), __text=text_of(text_col))
    if not classes.groupBy("key").count().filter("count > 1 OR key IS NULL").limit(1).count():
        return d.drop("__text").join(gone.select("__key").hint("merge"), "__key", "left_anti").select("__row.*")
    d = _with_sid(d.withColumn("handle", F.xxhash64("__key", "__text"))).join(gone.withColumnRenamed("__key", "__k").withColumnRenamed("__sid", "__s").hint("merge"), F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__sid") == F.col("__s")), "left_anti")
    return d.groupBy("__key", "__sid").agg(F.min_by("__row", F.to_json("__row")).alias("__row")).select("__row.*")


def _with_sid(df: DataFrame) -> DataFrame:
    """df (__row, __key, handle, __text) with __sid, the digest of its set, for the text."""
    schema = df.select("__row", "__key").schema.add("__sid", "binary")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                sids = [set_id(s, h) for s, h in zip(shingle_sets(part.column("__text").to_pylist()), part.column("handle").to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("__row"), part.column("__key"), pa.array(sids, pa.binary())], names=["__row", "__key", "__sid"])

    return df.mapInArrow(run, schema)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(documents(spark, sf_dir)).select(F.col("key").alias("doc_id"), "class_id", "copy_of", "n_links")
