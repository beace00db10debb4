"""Document log-likelihood under a gated recurrent language model that is trained here.

Words are counted exactly over all training documents.  The most frequent ones are the
model's own; what is left is one symbol, and a word of it shares the symbol's
probability by its smoothed count, so that every word of every text has a probability
and all of them sum to one.  Each document ends with an end symbol.

The model is a gated recurrent unit in numpy.  Its output is a class-factored softmax:
a symbol's class, then the symbol within the class; classes hold like shares of the
square roots of frequency.  It starts as the unigram model (biases are logarithms of exact
shares) and learns by truncated backpropagation: documents lie in lanes, a window of a few
steps is unrolled at a time, and the state is carried to the next window and never over
the end of a document.  All training documents are read whole, and every window gives a gradient.  In a round each task trains a copy
of the weights over its documents, and copies are averaged by the words that they saw, in blocks,
so that what the driver holds is one model.

Scores need the count of any word.  A chunk's own words go out once, meet the counts, and come back
to the chunk: no worker holds the whole vocabulary, and no word of a text is shuffled by itself.

Defined cases: a null or empty text is the end symbol alone; repeated rows are documents
each; without training documents the model is the unigram model of no counts, in which the
only symbol besides the end is a word that was never seen.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import chunked, documents, meet, packed, slices, stored, text_of

#: Words of the model's own, classes, units, seed of the first weights.
WORDS, CLASSES, UNITS, SEED = 2046, 40, 16, 1
#: Training: documents side by side, steps of a window, rounds, step size, longest gradient.
LANES, STEPS, ROUNDS, RATE, CLIP = 256, 16, 2, 0.15, 50.0
#: Scoring: documents side by side, and least steps of a window (it gets longer where fewer documents are left).
SCORE_LANES, SCORE_STEPS = 512, 32
#: Words that are trained on or scored at a time: long documents among them are side by side, and few steps have few documents.
SET_WORDS = 4_000_000
#: Weights of a block when copies are averaged, first-level sums of a block, and words that a worker counts before they go out.
BLOCK, SALTS, HELD = 8192, 32, 400_000
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(texts: pa.Array) -> list[list[bytes]]:
    """Words between white space (20 and 09 to 0D), A-Z in lower case."""
    return [t.translate(LOWER).split() for t in texts.cast(pa.binary()).to_pylist()]


def all_words(texts: pa.Array) -> pa.Array:
    """The same words one after another."""
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()))).flatten()
    return words.filter(pc.greater(pc.binary_length(words), 0))


def _local_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__chunk, word, n): the words of a chunk and how often its training documents have them; "" is the end.  A chunk may come in several parts."""
    held: defaultdict[str, int] = defaultdict(int)
    last = None

    def out():
        n = len(held)
        yield pa.RecordBatch.from_pydict({"__chunk": pa.array([last] * n, pa.int64()), "word": pa.array(list(held), pa.string()), "n": pa.array(list(held.values()), pa.int64())})
        held.clear()

    for batch in batches:
        for part in slices(batch, "__text"):
            chunks, tests = part.column("__chunk").to_numpy(), part.column("__held_out").to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero(chunks[1:] != chunks[:-1]) + 1).tolist()
            for a, b in zip([0, *cuts], [*cuts, len(chunks)], strict=True):
                if last is not None and (chunks[a] != last or len(held) > HELD):
                    yield from out()
                last = int(chunks[a])
                texts, test = part.column("__text").slice(a, b - a), pa.array(tests[a:b])
                for words, own in ((all_words(texts.filter(pc.invert(test))), 1), (all_words(texts.filter(test)), 0)):
                    met = words.value_counts()
                    counts = met.field("counts").to_numpy() * own
                    for w, c in zip(met.field("values").to_numpy(zero_copy_only=False).tolist(), counts.tolist(), strict=True):
                        held[w] += c
                if n := int((~tests[a:b]).sum()):
                    held[""] += n
    if last is not None:
        yield from out()


class Symbols:
    """The model's symbols by falling share: its own words, the end, and `other`, all words that are left."""

    def __init__(self, head: list[tuple[str, int]], end_count: int, tokens: int, vocabulary: int):
        self.below = tokens + vocabulary + 1  # smoothed counts sum to this: one more for a word that was never seen
        counts = {w: c + 1 for w, c in head} | {"": end_count + 1}
        left = self.below - sum(counts.values())
        if not tokens:  # nothing is known, of the end neither
            counts, left, self.below = {"": 1}, 1, 2
        self.known, self.end_count = tokens > 0, end_count
        names = sorted([*counts, None], key=lambda w: (-(left if w is None else counts[w]), w or ""))
        slot = {w: i for i, w in enumerate(names)}
        self.end, self.other = slot.pop(""), slot.pop(None)
        self.slot = {w.encode(): i for w, i in slot.items()}
        self.share = np.array([left if w is None else counts[w] for w in names]) / self.below
        #: What an `other` word's smoothed count is divided by, to be its part of the symbol.
        self.left = left if tokens else 1
        root = np.sqrt(self.share)
        cls = np.minimum((np.cumsum(root) - root / 2) / root.sum() * CLASSES, CLASSES - 1).astype(np.int64)
        self.cls = np.unique(cls, return_inverse=True)[1]
        self.starts = np.searchsorted(self.cls, np.arange(self.cls[-1] + 2))
        self.class_share = np.bincount(self.cls, self.share)

    def read(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of texts, one after another with an end each, and where each text begins and the last ends."""
        get, other, end = self.slot.get, self.other, self.end
        ids: list[int] = []
        starts = [0]
        for words in texts:
            ids.extend([get(w, other) for w in words])
            ids.append(end)
            starts.append(len(ids))
        return np.array(ids, np.int32), np.array(starts)


SHAPES = ("inputs", "carry", "to_class", "class_bias", "to_word", "word_bias")
Weights = dict[str, np.ndarray]


def first_weights(s: Symbols) -> Weights:
    """The unigram model: what depends on the state is zero, and small numbers feed the state."""
    r = np.random.default_rng(SEED)
    n, c, k = len(s.share), len(s.class_share), UNITS
    made = {
        "inputs": r.normal(0, 0.5, (n, 3 * k)),
        "carry": r.normal(0, 0.6 / np.sqrt(k), (k, 3 * k)),
        "to_class": np.zeros((k, c)),
        "class_bias": np.log(s.class_share),
        "to_word": np.zeros((k, n)),
        "word_bias": np.log(s.share / s.class_share[s.cls]),
    }
    return {name: made[name].astype(np.float32) for name in SHAPES}


def flat(w: Weights) -> np.ndarray:
    return np.concatenate([w[n].ravel() for n in SHAPES])


def unflat(v: np.ndarray, like: Weights) -> Weights:
    out, at = {}, 0
    for n in SHAPES:
        out[n] = v[at : at + like[n].size].reshape(like[n].shape).astype(np.float32)
        at += like[n].size
    return out


def recur(w: Weights, xs: np.ndarray, state: np.ndarray, keep: bool = False):
    """States after each step (steps, lanes, units); with keep, also the gates, the proposed states and their carried part (steps, units, lanes).

    A step works on units by lanes, so that gates and states are whole blocks of memory.
    """
    k = state.shape[1]
    fed = w["inputs"][xs]
    carry = np.ascontiguousarray(w["carry"].T)
    states = np.empty((*xs.shape, k), np.float32)
    gates, news, parts = (np.empty((len(xs), n, xs.shape[1]), np.float32) if keep else None for n in (2 * k, k, k))
    state = np.ascontiguousarray(state.T)
    for t in range(len(xs)):
        a = carry @ state
        x = np.ascontiguousarray(fed[t].T)
        g = x[: 2 * k]
        g += a[: 2 * k]
        np.negative(g, out=g)
        np.exp(g, out=g)
        g += 1
        np.reciprocal(g, out=g)
        new = g[:k] * a[2 * k :]
        new += x[2 * k :]
        np.tanh(new, out=new)
        if keep:
            gates[t], news[t], parts[t] = g, new, a[2 * k :]
        state = state - new
        state *= g[k:]
        state += new
        states[t] = state.T
    return states, gates, news, parts


def back(w: Weights, xs: np.ndarray, first: np.ndarray, kept, pull: np.ndarray) -> Weights:
    """Gradients of a window, from pull, the states' own gradients; what came before the window is given."""
    states, gates, news, parts = kept
    k = first.shape[1]
    to_inputs = np.empty((*xs.shape, 3 * k), np.float32)
    later = np.zeros(first.shape[::-1], pull.dtype)
    d_sum, d_fed = (np.empty((3 * k, xs.shape[1]), pull.dtype) for _ in range(2))
    to_carry = np.zeros((k, 3 * k), pull.dtype)
    for t in range(len(xs) - 1, -1, -1):
        d = pull[t].T + later
        g, new, before = gates[t], news[t], np.ascontiguousarray((states[t - 1] if t else first).T)
        z = g[k:]
        d_new = d_fed[2 * k :]
        np.multiply(new, new, out=d_new)
        np.subtract(1, d_new, out=d_new)
        d_new *= d
        d_gate = d_fed[: 2 * k]
        np.multiply(d_new, z, out=d_gate[k:])
        d_new -= d_gate[k:]
        np.multiply(d_new, parts[t], out=d_gate[:k])
        np.subtract(before, new, out=d_gate[k:])
        d_gate[k:] *= d
        slope = 1 - g
        slope *= g
        d_gate *= slope
        d_sum[: 2 * k] = d_gate
        np.multiply(d_new, g[:k], out=d_sum[2 * k :])
        to_inputs[t] = d_fed.T
        to_carry += before @ d_sum.T
        d *= z
        d += w["carry"] @ d_sum
        later = d
    out = {"carry": to_carry, "inputs": np.zeros_like(w["inputs"])}
    ids, rows = xs.ravel(), to_inputs.reshape(-1, 3 * k)
    order = np.argsort(ids.astype(np.min_scalar_type(len(w["inputs"]))), kind="stable")  # few bytes sort by digits
    ids = ids[order]
    at = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
    out["inputs"][ids[at]] = np.add.reduceat(rows[order], at, axis=0)
    return out


def _softmax(x: np.ndarray, at: tuple[np.ndarray, np.ndarray], small: bool, picked: np.ndarray, z: np.ndarray) -> np.ndarray:
    """e, whose quotient by z is the softmax of x by rows; picked gets x at one place of each row.  x is overwritten; where it is small, no power of it overflows."""
    if not small:
        x -= x.max(1, keepdims=True)
    picked[:] = x[at]
    e = np.exp(x, out=x)
    np.dot(e, np.ones(x.shape[1], x.dtype), out=z)
    return e


def emitted(w: Weights, s: Symbols, states: np.ndarray, ys: np.ndarray, grads: Weights | None = None):
    """Natural logarithms of the symbols' probabilities; with grads, which then gets those of the output, also the states' gradients.

    A row's softmax is never divided by its sum: what it is multiplied with is, which is narrower.
    """
    k = states.shape[1]
    rows = np.arange(len(ys))
    cls = s.cls[ys].astype(np.min_scalar_type(len(s.starts)))  # few bytes sort by digits
    order = np.argsort(cls, kind="stable")  # rows of a class lie together
    ys, cls = ys[order], cls[order]
    one = np.ones((len(ys), k + 1), states.dtype)  # biases are weights of a constant
    one[:, :k] = states[order]
    to_class, to_word = (np.concatenate([w[a], w[b][None]]) for a, b in (("to_class", "class_bias"), ("to_word", "word_bias")))
    # states lie within -1 and 1
    small = all(float(np.abs(m).sum(0).max()) < 60 for m in (to_class, to_word))
    picked, z, inner, inner_z = (np.zeros(len(ys), to_word.dtype) for _ in range(4))
    inner_z += 1
    e = _softmax(one @ to_class, (rows, cls), small, picked, z)
    pull = inner_pull = None
    if grads is not None:
        e[rows, cls] -= z
        made = (one / z[:, None]).T @ e
        grads |= {"to_class": made[:k], "class_bias": made[k]}
        pull = e @ w["to_class"].T
        pull /= z[:, None]
        inner_pull, made = np.zeros_like(pull), np.zeros_like(to_word)
    ends = np.concatenate([[0], np.cumsum(np.bincount(cls, minlength=len(s.starts) - 1))]).tolist()
    starts = s.starts.tolist()
    place = ys - s.starts[cls]
    for c in range(len(starts) - 1):
        a, b, u, v = ends[c], ends[c + 1], starts[c], starts[c + 1]
        if a == b or v - u == 1:  # not met, or its only symbol is certain
            continue
        at = (rows[: b - a], place[a:b])
        e = _softmax(one[a:b] @ to_word[:, u:v], at, small, inner[a:b], inner_z[a:b])
        if grads is not None:
            e[at] -= inner_z[a:b]
            np.matmul((one[a:b] / inner_z[a:b, None]).T, e, out=made[:, u:v])
            np.matmul(e, w["to_word"][:, u:v].T, out=inner_pull[a:b])
    out = (picked - np.log(z)).astype(np.float64) + (inner - np.log(inner_z))
    back_ = np.empty(len(ys), np.int64)
    back_[order] = rows
    if grads is not None:
        grads |= {"to_word": made[:k], "word_bias": made[k]}
        inner_pull /= inner_z[:, None]
        pull += inner_pull
    return out[back_], None if pull is None else pull[back_]


def in_lanes(ids: np.ndarray, starts: np.ndarray, lanes: int, least: int, end: int, units: int, fn, cells: int = 0) -> None:
    """fn(xs, ys, valid, state, docs) -> next state, over all windows of documents side by side, long ones first.

    A window has `least` steps, or as many more as fill `cells` with the documents that are left.
    What a symbol follows is the one before it, and the end where its document begins.
    """
    before = np.concatenate([[end], ids[:-1]]).astype(np.int32)
    todo = np.argsort(starts[:-1] - starts[1:], kind="stable")
    docs, todo = todo[:lanes], todo[lanes:]
    pos, last = starts[docs].copy(), starts[docs + 1].copy()
    state = np.zeros((len(docs), units), np.float32)
    while len(docs):
        steps = max(least, cells // len(docs))
        at = pos + np.arange(steps)[:, None]
        valid = at < last
        at = np.minimum(at, last - 1)
        state = fn(before[at], ids[at], valid, state, docs)
        pos += steps
        done = np.flatnonzero(pos >= last)
        if len(done):
            state = state.copy()
            fresh, todo = todo[: len(done)], todo[len(done) :]
            put = done[: len(fresh)]
            docs[put], pos[put], last[put], state[put] = fresh, starts[fresh], starts[fresh + 1], 0
            if len(put) < len(done):
                keep = np.ones(len(docs), bool)
                keep[done[len(put) :]] = False
                docs, pos, last, state = docs[keep], pos[keep], last[keep], state[keep]


class Trainer:
    """A copy of the weights, trained over one task's documents with adaptive steps."""

    def __init__(self, w: Weights, s: Symbols):
        self.w, self.s = {n: v.copy() for n, v in w.items()}, s
        self.seen = 0
        self.past = {n: np.ones_like(v) for n, v in w.items()}
        self.held: list[tuple[np.ndarray, np.ndarray]] = []

    def read(self, texts: list[list[bytes]]) -> None:
        self.held.append(self.s.read(texts))
        if sum(len(ids) for ids, _ in self.held) >= SET_WORDS:
            self.close()

    def close(self) -> None:
        """Trains over what was read."""
        if not self.held:
            return
        ids = np.concatenate([x for x, _ in self.held])
        starts = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(x) for _, x in self.held]))])
        self.held = []
        self.seen += len(ids)
        in_lanes(ids, starts, LANES, STEPS, self.s.end, UNITS, self.window)

    def window(self, xs, ys, valid, state, docs):
        kept = recur(self.w, xs, state, keep=True)
        grads: Weights = {}
        pull = np.zeros_like(kept[0])
        _, pull[valid] = emitted(self.w, self.s, kept[0][valid], ys[valid], grads)
        grads |= back(self.w, xs, state, kept, pull)
        for n, g in grads.items():
            square = g * g
            length = float(np.sqrt(square.sum()))
            if length > CLIP:
                g *= CLIP / length
                np.multiply(g, g, out=square)
            self.past[n] += square
            np.sqrt(self.past[n], out=square)
            g *= RATE
            g /= square
            self.w[n] -= g
        return kept[0][-1]


def likelihood(w: Weights, s: Symbols, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of the probability of each text's symbols."""
    total = np.zeros(len(starts) - 1)

    def window(xs, ys, valid, state, docs):
        states = recur(w, xs, state)[0]
        said = np.zeros(xs.shape)
        said[valid] = emitted(w, s, states[valid], ys[valid])[0]
        total[docs] += said.sum(0)
        return states[-1]

    in_lanes(ids, starts, SCORE_LANES, SCORE_STEPS, s.end, UNITS, window, SCORE_LANES * SCORE_STEPS)
    return total / np.log(10)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of weighted blocks, as they come: a model's worth of numbers, times the salts."""
    held: dict[tuple[int, int], list] = {}
    for batch in batches:
        for block, salt, seen, values in zip(*(batch.column(c).to_pylist() for c in ("block", "salt", "seen", "values")), strict=True):
            v = np.frombuffer(values, np.float64)
            if (got := held.get((block, salt))) is None:
                held[block, salt] = [seen, v.copy()]
            else:
                got[0] += seen
                got[1] += v
    for (block, salt), (seen, v) in held.items():
        yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([salt], pa.int32()), "seen": pa.array([seen], pa.int64()), "values": pa.array([v.tobytes()], pa.binary())})


PARTS = "block int, salt int, seen long, values binary"


def trained(docs: DataFrame, s: Symbols) -> Weights:
    """The model, trained over docs (__text, __held_out), a part of the documents in each round."""
    spark = docs.sparkSession
    w = first_weights(s)
    for r in range(ROUNDS):
        sent = spark.sparkContext.broadcast((w, s))  # of a fixed size

        def run(batches):
            from pyspark import TaskContext

            trainer = Trainer(*sent.value)  # noqa: B023
            for batch in batches:
                for part in slices(batch, "__text"):
                    trainer.read(words_of(part.column("__text")))
            trainer.close()
            if trainer.seen:
                v = flat(trainer.w).astype(np.float64) * trainer.seen
                for b in range(0, len(v), BLOCK):
                    yield pa.RecordBatch.from_pydict({"block": pa.array([b // BLOCK], pa.int32()), "salt": pa.array([TaskContext.get().partitionId() % SALTS], pa.int32()), "seen": pa.array([trainer.seen], pa.int64()), "values": pa.array([v[b : b + BLOCK].tobytes()], pa.binary())})

        part = docs.filter(~F.col("__held_out") & (F.pmod(F.xxhash64("__text"), F.lit(ROUNDS)) == r)).select("__text")
        made = stored(part.mapInArrow(run, PARTS).repartition("block", "salt").mapInArrow(_sums, PARTS))
        rows = made.withColumn("salt", F.lit(0)).repartition("block").mapInArrow(_sums, PARTS).collect()  # one model
        sent.unpersist()
        if rows:
            w = unflat(np.concatenate([np.frombuffer(x["values"], np.float64) / x["seen"] for x in sorted(rows, key=lambda x: x["block"])]), w)
    return w


OUT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored(df: DataFrame, held_out: Column, text: str = "text") -> DataFrame:
    """(__row, held_out, n_tokens, n_known, train_tokens, base_score, score): the row as a struct of its columns but the text; a row that isn't held out is learned from.

    base_score is the unigram model with one added to each count, score the recurrent model's log10 of the text's probability.
    """
    spark = df.sparkSession
    rest = df.drop(text) if len(df.columns) > 1 else df
    docs = packed(df, __text=text_of(text), __held_out=F.coalesce(held_out, F.lit(False))).withColumn("__row", F.struct(*[F.col(f"__row.`{c}`") for c in rest.columns]))
    docs = chunked(docs)
    local = stored(docs.select("__chunk", "__held_out", "__text").mapInArrow(_local_words, "__chunk long, word string, n long"))
    counts = stored(local.groupBy("word").agg(F.sum("n").alias("c")).filter("c > 0"))
    n, v, end = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.max(F.when(F.col("word") == "", F.col("c"))), F.lit(0))).first()
    head = counts.filter("word <> ''").orderBy(F.desc("c"), "word").limit(WORDS).collect()  # WORDS rows
    s = Symbols([(r["word"], r["c"]) for r in head], end, n, v)
    model = spark.sparkContext.broadcast((trained(docs, s), s))
    entries = local.filter("word <> ''").select("__chunk", "word").join(counts, "word")
    below = float(n + v + 1)
    schema = T.StructType([docs.schema["__row"], *T.StructType.fromDDL(OUT).fields])

    def run(stream):
        w, s = model.value
        index: dict[bytes, int] = {}
        table: list[np.ndarray] = []  # by a word's number: symbol, base score, whether it is known, share of `other`
        more: list[tuple[pa.Array, pa.Array]] = []  # words and counts of the chunk that aren't in the tables yet
        rows: list[pa.StructArray] = []
        held: list[tuple] = []  # of each slice of rows: symbols, lengths, base scores, known words, shares of `other`
        size = 0

        def tables():
            nonlocal index, table
            words = [x for a, _ in more for x in a.cast(pa.binary()).to_pylist()]
            index = {x: i + 2 for i, x in enumerate(words)}  # 0 is a word that was never seen, 1 the end
            c = np.concatenate([[0, end], *(c.to_numpy() for _, c in more)])
            symbol = np.array([s.other, s.end] + [s.slot.get(x, s.other) for x in words], np.int32)
            table = [symbol, np.log10((c + 1) / below), (c > 0).astype(np.int64), np.where(symbol == s.other, np.log10((c + 1) / s.left), 0.0)]
            more.clear()

        def close():
            nonlocal size
            ids, lengths, base, known, tail = (np.concatenate(x) for x in zip(*held, strict=True))
            starts = np.concatenate([[0], np.cumsum(lengths)])
            score = likelihood(w, s, ids, starts) + tail
            d = pa.concat_arrays([r.field("__row") for r in rows])
            test = pa.concat_arrays([r.field("__held_out") for r in rows])
            m = len(lengths)
            cols = [d, test, pa.array(lengths, pa.int64()), pa.array(known, pa.int64()), pa.array(np.full(m, n), pa.int64()), pa.array(base), pa.array(score)]
            rows.clear()
            held.clear()
            size = 0
            return pa.RecordBatch.from_arrays(cols, names=schema.names)

        for new, side, piece in stream:
            if new:
                more.clear()
                tables()
            if not side:
                e = piece.column("e")
                more.append((e.field("word"), e.field("c")))
                continue
            if more:
                tables()
            for part in slices(pa.RecordBatch.from_struct_array(piece.column("d")), "__text"):
                words = words_of(part.column("__text"))
                get = index.get
                ids, starts = [], [0]
                for ws in words:
                    ids.extend([get(x, 0) for x in ws])
                    ids.append(1)
                    starts.append(len(ids))
                ids, starts = np.array(ids), np.array(starts)
                held.append((table[0][ids], np.diff(starts), *(np.add.reduceat(t[ids], starts[:-1]) for t in table[1:])))
                rows.append(part.select(["__row", "__held_out"]).to_struct_array())
                size += len(ids)
                if size >= SET_WORDS:
                    yield close()
        if held:
            yield close()

    return meet(docs, entries, ["__chunk"], [], run, schema)


def op12_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    d = scored(docs, F.crc32(F.col("doc_id").cast("string")) % 7 == 2)
    return d.select("__row.doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
