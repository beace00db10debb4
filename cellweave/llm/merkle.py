"""Document fingerprints: Merkle trees over sections, paragraphs and their pieces.

Paragraphs are lines, sections end at blank lines, and a paragraph is cut into pieces
where its own characters say so, so that an edit changes the pieces it touches and no
others.  A piece's hash is over its characters, white space too, and a node's over its
children's in order.  The root is over the sections and the digest of the whole text.
The fingerprint is the tree: root, and each section's and paragraph's hash before what
it holds.  Equal roots mean equal texts; from differing roots the comparison goes down
into the branches that differ and into no others.

Defined cases: null text is empty and has an empty tree; ids are of any type that can
be ordered; documents are in descending order of ids, rows of one id and rows without
one (last) by a hash of their text; the last one's next is the first; a table of one
row is its own next; an empty table gives no rows; all lengths are treated alike.
"""

from __future__ import annotations

from collections import Counter
from hashlib import sha256
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents, map_texts, placed_labels, slices, text_of
from cellweave.llm.jaccard_join import _P, _PINV, _mix, _powers

#: A piece ends where a hash of three characters is a multiple of CUT, and after MOST characters.
CUT, MOST = 8, 32
#: Hexadecimal digits of a piece, of a section or paragraph, and of the root.
LEAF, INNER, ROOT = 8, 16, 32
#: Characters whose trees are made at once; ids sampled for each range.
SLICE, SAMPLE = 1 << 19, 100

_held: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    if base not in _held or len(_held[base]) < n:
        _held[base] = _powers(base, max(n, 1 << 20))
    return _held[base][:n]


def _rolled(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each range of values, whatever stands before it."""
    n = len(values)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * _powers_of(_P, n), out=sums[1:])
    return _mix((sums[ends] - sums[starts]) * _powers_of(_PINV, n + 1)[starts] + (ends - starts).astype(np.uint64))


class Tree:
    """root: digits; sections: (hash, paragraphs), paragraphs: (hash, pieces), pieces: 32 bits each."""

    __slots__ = ("root", "sections", "leaves")

    def __init__(self, root: str, sections: list[tuple[str, list[tuple[str, bytes]]]]):
        self.root, self.sections = root, sections
        self.leaves = sum(len(p[1]) for s in sections for p in s[1]) // 4

    def __str__(self) -> str:
        return self.root + ":" + "/".join(s + "," + ";".join(p + "=" + x.hex() for p, x in ps) for s, ps in self.sections)


def parse(print_: str) -> Tree:
    root, _, rest = print_.partition(":")
    return Tree(root, [(s[:INNER], [(p[:INNER], bytes.fromhex(p[INNER + 1 :])) for p in s[INNER + 1 :].split(";")]) for s in rest.split("/")] if rest else [])


def trees(texts: list[str]) -> list[Tree]:
    """The trees of some texts."""
    c = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    digests = [xxhash.xxh3_128_digest(t.encode()) for t in texts]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths)
    n = len(c)
    if not n:
        return [Tree(d.hex(), []) for d in digests]
    before = np.concatenate([[0], c[:-1]]).astype(np.uint64)
    further = np.concatenate([[0, 0], c[:-2]])[:n].astype(np.uint64)
    starts = (ends - lengths)[lengths > 0]  # nothing stands before a text
    before[starts] = further[starts] = 0
    further[(starts + 1)[lengths[lengths > 0] > 1]] = 0
    cut = _mix(c * np.uint64(0x9E3779B1) + before * np.uint64(0x85EBCA77) + further * np.uint64(0xC2B2AE3D)) % np.uint64(CUT) == 0
    line = c == 10
    stop = line.copy()
    stop[ends[lengths > 0] - 1] = True
    last = cut | stop
    # no piece is longer than MOST
    at = np.flatnonzero(last)
    size = np.diff(at, prepend=-1)
    for p, k in zip(at[size > MOST].tolist(), size[size > MOST].tolist(), strict=True):
        last[np.arange(p - k + MOST, p, MOST)] = True
    end = np.flatnonzero(last) + 1
    begin = np.concatenate([[0], end[:-1]])
    leaf = _rolled(c, begin, end)
    # lines, and whether they are blank
    line_end = np.flatnonzero(stop) + 1
    line_begin = np.concatenate([[0], line_end[:-1]])
    inked = np.concatenate([[0], np.cumsum((c > 32) & (c != 160) & (c != 0x3000))])
    blank = inked[line_end] == inked[line_begin]
    first_leaf = np.searchsorted(begin, line_begin)
    leaf_end = np.concatenate([first_leaf[1:], [len(leaf)]])
    paragraph = _rolled(leaf, first_leaf, leaf_end)
    # a section begins with a text, and with a line that isn't blank after one that is
    of = np.searchsorted(ends, line_begin, side="right")
    opens = np.concatenate([[True], (of[1:] != of[:-1]) | (blank[:-1] & ~blank[1:])])
    first_line = np.flatnonzero(opens)
    end_line = np.concatenate([first_line[1:], [len(line_begin)]])
    section = _rolled(paragraph, first_line, end_line)
    shown, lines = leaf.astype(">u4").tobytes(), ["%016x" % x for x in paragraph.tolist()]
    a, b = (first_leaf * 4).tolist(), (leaf_end * 4).tolist()
    made = [("%016x" % h, [(lines[k], shown[a[k] : b[k]]) for k in range(i, j)]) for h, i, j in zip(section.tolist(), first_line.tolist(), end_line.tolist(), strict=True)]
    held, out = np.searchsorted(of[first_line], np.arange(len(texts) + 1)).tolist(), []
    for k, digest in enumerate(digests):
        sections = made[held[k] : held[k + 1]]
        out.append(Tree(xxhash.xxh3_128_hexdigest(digest + "".join(h for h, _ in sections).encode()) if sections else digest.hex(), sections))
    return out


def fingerprint(text: str) -> str:
    return str(trees([text])[0])


def _apart(a: list[tuple], b: list[tuple]) -> tuple[list, list]:
    """Children (hash, below) of both sides without those that have a partner of the same hash."""
    left, right = Counter(h for h, _ in a), Counter(h for h, _ in b)
    both = left & right
    if not both:
        return a, b
    out = []
    for side in (a, b):
        skip, rest = Counter(both), []
        for x in side:
            if skip[x[0]]:
                skip[x[0]] -= 1
            else:
                rest.append(x)
        out.append(rest)
    return out[0], out[1]


def compare(a: Tree, b: Tree) -> tuple[float, list[str], list[str]]:
    """Likeness (1 for equal roots, else twice the pieces in common by those of both), and the hashes of paragraphs that only a or b has."""
    if a.root == b.root:
        return 1.0, [], []
    if not a.leaves or not b.leaves:
        return 0.0, [p for _, s in a.sections for p, _ in s], [p for _, s in b.sections for p, _ in s]
    x, y = _apart(a.sections, b.sections)
    x, y = _apart(list(chain.from_iterable(s for _, s in x)), list(chain.from_iterable(s for _, s in y)))
    apart = [np.sort(np.frombuffer(b"".join(p for _, p in side), ">u4").astype(np.uint32)) for side in (x, y)]
    return 2.0 * (a.leaves - len(apart[0]) + _common(*apart)) / (a.leaves + b.leaves), [h for h, _ in x], [h for h, _ in y]


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    if not len(a) or not len(b):
        return 0
    (x, m), (y, n) = np.unique(a, return_counts=True), np.unique(b, return_counts=True)
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return int(np.minimum(m[i], n[j]).sum())


def likeness(a: str, b: str) -> float:
    return compare(parse(a), parse(b))[0]


def differences(a: str, b: str) -> list[tuple[int, int]]:
    """Where b differs from a: (section, paragraph) of b that a has no partner for."""
    tree = parse(b)
    missing = Counter(compare(parse(a), tree)[2])
    out = []
    for i, (_, paragraphs) in enumerate(tree.sections):
        for j, (h, _) in enumerate(paragraphs):
            if missing[h]:
                missing[h] -= 1
                out.append((i, j))
    return out


def fingerprints(df: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """df plus its text's fingerprint, which replaces a column of that name."""
    return map_texts(df.withColumn("__text", text_of(text_col)), lambda texts: {out: pa.array(list(map(str, trees(texts))), pa.string())}, f"`{out}` string")


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the beginning of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k] if k else text


def _at_most(bounds: list, value: Column) -> Column:
    """How many of the ascending bounds are at most the value, by halving; the plan holds the bounds as one literal."""
    held = F.array(*map(F.lit, bounds))
    both = lambda lo, hi: F.struct(lo.cast("int").alias("lo"), hi.cast("int").alias("hi"))

    def halve(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        return F.when(s["lo"] >= s["hi"], s).when(F.get(held, mid) <= value, both(mid + 1, s["hi"])).otherwise(both(s["lo"], mid))

    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length())), both(F.lit(0), F.lit(len(bounds))), halve, lambda s: s["lo"])


def with_next(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, text, number, ahead) dealt by descending id: each partition holds
    whole ranges in order, each followed by the first row of the next range (ahead = 1).

    Bounds come from a sample of SAMPLE ids a range; there are as many ranges as shuffle
    partitions, and as many again for rows without id.  Texts are shuffled once.
    """
    spark = df.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    ids = d.select("doc_id").filter("doc_id IS NOT NULL")
    rows = ids.count()
    sample = sorted(r[0] for r in ids.sample(min(1.0, SAMPLE * n / max(rows, 1)), 7).collect()) if n > 1 else []
    bounds = sorted({sample[len(sample) * i // n] for i in range(1, n)}) if sample else []
    # range 0 holds the highest ids; rows without id come last, in the order of their texts' hashes
    hashed = F.xxhash64("text")
    above = F.lit(len(bounds)) - _at_most(bounds, F.col("doc_id")) if bounds else F.lit(0)
    d = d.withColumn("hash", hashed).withColumn("number", F.when(F.col("doc_id").isNotNull(), above).otherwise(len(bounds) + 1 + F.shiftright((F.shiftright("hash", 32) + (1 << 31)) * n, 32)).cast("int"))
    tops = d.groupBy("number").agg(F.max(F.struct("doc_id", F.bitwise_not("hash").alias("hash"))).alias("top"))
    held = sorted((r["number"], r["top"]["doc_id"], ~r["top"]["hash"]) for r in tops.collect())
    labels = placed_labels(spark, n)
    label_of = F.get(F.array(*[F.lit(labels[i % n]) for i in range(len(bounds) + 1 + n)]), F.col("number"))
    heads = [(top, h, held[i - 1][0]) for i, (_, top, h) in enumerate(held)]
    heads = spark.createDataFrame(heads, f"top {dict(d.dtypes)['doc_id']}, top_hash long, back int")  # a row for each range
    d = d.join(F.broadcast(heads), F.col("doc_id").eqNullSafe(F.col("top")) & (F.col("hash") == F.col("top_hash")), "left")
    own = F.struct("number", F.lit(0).alias("ahead"))
    copies = F.when(F.col("back").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("back").alias("number"), F.lit(1).alias("ahead"))))
    d = d.withColumn("copy", F.explode(copies)).select("doc_id", "text", "hash", "copy.number", "copy.ahead").withColumn("label", label_of)
    return d.repartition(n, "label").sortWithinPartitions("number", "ahead", F.col("doc_id").desc_nulls_last(), "hash", "text").select("doc_id", "text", "number", "ahead")


def edited_fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of its edited text, and likeness to it and to the next document.

    Only id and text of df are read; the results have names of their own.
    """
    id_type = dict(df.dtypes)[id_col]

    def run(batches):
        held = None  # (doc_id, text, tree, number)
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                texts = part.column("text").to_pylist()
                rows = list(zip(part.column("doc_id"), texts, trees(texts), part.column("number").to_pylist(), part.column("ahead").to_pylist(), strict=True))
                pairs = []
                for doc_id, text, tree, number, ahead in rows:
                    if held is not None and held[3] == number:
                        pairs.append((*held[:3], edited(held[1], text), tree))
                    held = None if ahead else (doc_id, text, tree, number)
                if not pairs:
                    continue
                out = []
                for (doc_id, was, tree, new, after), made in zip(pairs, trees([p[3] for p in pairs]), strict=True):
                    out.append((doc_id.as_py(), len(was), sha256(new.encode()).hexdigest(), str(tree), str(made), compare(tree, made)[0], compare(tree, after)[0]))
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], part.schema.field("doc_id").type), *[pa.array(c, t) for c, t in zip(cols[1:], KINDS, strict=True)]], names=list(NAMES))

    return with_next(df, id_col, text_col).mapInArrow(run, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
KINDS = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())


def op6_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(documents(spark, sf_dir))
