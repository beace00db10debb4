"""Language-model scores: gradients, the likelihood and the unigram base against plain recounts, held-out gain."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cellweave.llm import lm_scoring as lm

LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def symbols(n=60):
    head = [(f"w{i}", 1 + 400 // (i + 1)) for i in range(n)]
    return lm.Symbols(head, 50, 5000, 700)


def odd_weights(s, seed=3):
    r = np.random.default_rng(seed)
    return {n: (v + r.normal(0, 0.3, v.shape)).astype(np.float32) for n, v in lm.first_weights(s).items()}


def plain(w, s, ids):
    """Natural log-likelihood, one step at a time."""
    k, total, state, last = lm.UNITS, 0.0, np.zeros(lm.UNITS), s.end
    sig = lambda x: 1 / (1 + np.exp(-x))
    w = {n: v.astype(np.float64) for n, v in w.items()}
    for y in ids:
        x, a = w["inputs"][last], state @ w["carry"]
        r, z = sig(x[:k] + a[:k]), sig(x[k : 2 * k] + a[k : 2 * k])
        n = np.tanh(x[2 * k :] + r * a[2 * k :])
        state = (1 - z) * n + z * state
        c = s.cls[y]
        u, v = s.starts[c], s.starts[c + 1]
        p, q = state @ w["to_class"] + w["class_bias"], state @ w["to_word"][:, u:v] + w["word_bias"][u:v]
        total += p[c] - np.log(np.exp(p).sum()) + q[y - u] - np.log(np.exp(q).sum())
        last = y
    return total


def test_likelihood_carries_state():
    """Documents of many lengths, more than there are lanes, against one at a time."""
    s = symbols()
    w, r = odd_weights(s), np.random.default_rng(0)
    docs = [[*r.integers(0, len(s.share), int(n)), s.end] for n in [0, 1, 2, 31, 32, 33, 64, 700, *r.integers(0, 90, 600)]]
    ids, starts = np.concatenate(docs).astype(np.int32), np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    got = lm.likelihood(w, s, ids, starts)
    for k in [*range(10), 300, 600]:
        assert got[k] * math.log(10) == pytest.approx(plain(w, s, docs[k]), rel=1e-4)


def test_probabilities_sum_to_one():
    s = symbols()
    w = odd_weights(s)
    state = np.random.default_rng(1).normal(0, 1, (1, lm.UNITS)).astype(np.float32)
    n = len(s.share)
    assert np.exp(lm.emitted(w, s, np.repeat(state, n, 0), np.arange(n))[0]).sum() == pytest.approx(1, abs=1e-5)
    assert s.share.sum() == pytest.approx(1)
    first = lm.emitted(lm.first_weights(s), s, np.repeat(state, n, 0), np.arange(n))[0]
    assert np.exp(first) == pytest.approx(s.share, rel=1e-4)  # it starts as the unigram model


def test_gradients():
    s = symbols(12)
    w = {n: v.astype(np.float64) for n, v in odd_weights(s).items()}
    r = np.random.default_rng(2)
    xs, ys = r.integers(0, len(s.share), (2, 6, 3))
    valid = r.random((6, 3)) < 0.8
    state = r.normal(0, 1, (3, lm.UNITS))

    def loss(w):
        states = lm.recur(w, xs, state)[0]
        return -lm.emitted(w, s, states[valid], ys[valid])[0].sum()

    kept = lm.recur(w, xs, state, keep=True)
    grads, pull = {}, np.zeros_like(kept[0])
    _, pull[valid] = lm.emitted(w, s, kept[0][valid], ys[valid], grads)
    grads |= lm.back(w, xs, state, kept, pull)
    for n, g in grads.items():
        for at in zip(*(r.integers(0, m, 12) for m in g.shape), strict=True):
            up, down = ({k: v.copy() for k, v in w.items()} for _ in range(2))
            up[n][at] += 1e-2
            down[n][at] -= 1e-2
            assert g[at] == pytest.approx((loss(up) - loss(down)) / 2e-2, rel=0.03, abs=3e-3), n


def test_every_window_teaches():
    """Symbols that only later windows hold are learnt from, too."""
    s = symbols()
    w = odd_weights(s)
    t = lm.Trainer(w, s)
    ids = np.repeat(np.array([1, 5, 7], np.int32), lm.STEPS)
    t.held.append((ids, np.array([0, len(ids)])))
    t.close()
    assert np.flatnonzero((t.w["inputs"] != w["inputs"]).any(1)).tolist() == sorted([1, 5, 7, s.end])


def test_words_of_a_chunk():
    """Words counted over whole columns are those of texts one at a time, held-out ones with 0, in each chunk (before, no column was split whole)."""
    texts = ["One two\x0btwo", "", " \x1cA\x85 B\tb\r\n", "né\u3000x ÀB àb \x0c", "\n", "two ONE three", "İ I\u2028i"]
    assert lm.all_words(pa.array(texts)).cast(pa.binary()).to_pylist() == [w for ws in lm.words_of(pa.array(texts)) for w in ws]
    batch = pa.RecordBatch.from_pydict({"__chunk": [0, 0, 0, 1, 1, 1, 1], "__held_out": [False, True, False, False, True, True, False], "__text": texts})
    got = {(r["__chunk"], r["word"]): r["n"] for b in lm._local_words(iter([batch])) for r in b.to_pylist()}
    want = Counter()
    for c, test, ws in zip(batch.column("__chunk").to_pylist(), batch.column("__held_out").to_pylist(), lm.words_of(batch.column("__text")), strict=True):
        for w in ws if test else [*ws, b""]:
            want[c, w.decode()] += not test
    assert got == dict(want)


def test_wide_sums_are_not_divided():
    """Windows' gradients and log-probabilities against a plain softmax where classes are met once, often or not at all."""
    s = symbols()
    w = odd_weights(s)
    r = np.random.default_rng(5)
    ys = np.concatenate([[0, s.end, s.other], r.integers(0, 9, 40)])
    states = r.uniform(-1, 1, (len(ys), lm.UNITS)).astype(np.float32)
    grads = {}
    said, pull = lm.emitted(w, s, states, ys, grads)
    a, b = states @ w["to_class"] + w["class_bias"], states @ w["to_word"] + w["word_bias"]
    p = np.exp(a) / np.exp(a).sum(1, keepdims=True)
    q = np.exp(b) * (s.cls[None, :] == s.cls[ys][:, None])
    q /= q.sum(1, keepdims=True)
    rows = np.arange(len(ys))
    assert said == pytest.approx(np.log(p[rows, s.cls[ys]]) + np.log(q[rows, ys]), rel=1e-4, abs=1e-5)
    p[rows, s.cls[ys]] -= 1
    q[rows, ys] -= 1
    for n, want in {"to_class": states.T @ p, "class_bias": p.sum(0), "to_word": states.T @ q, "word_bias": q.sum(0)}.items():
        assert np.allclose(grads[n], want, atol=2e-5), n
    assert np.allclose(pull, p @ w["to_class"].T + q @ w["to_word"].T, atol=2e-5)


def write(spark, rows, path):
    spark.createDataFrame(rows, "doc_id long, text string, word string, score int").write.parquet(f"{path}/documents.parquet")
    return {tuple(r[:2]) + tuple(r[2:]) for r in map(tuple, lm.op12_lm_scoring(spark, str(path)).collect())}


def test_scores(spark, tmp_path):
    """Base and counts against a recount; nulls, empty and long texts, repeated rows; text with an order is more likely than by words alone, held out too."""
    r = random.Random(4)
    rows = []
    for i in range(900):
        words = []
        for _ in range(r.randint(2, 40)):
            words += r.choice([["One", "two", "three"], ["red", "blue", "green"], [f"rare{r.randint(0, 4000)}", "goes"]])
        rows.append((i, " \n".join(words)))
    rows += [(900, None), (901, ""), (902, " \t\x0b"), (None, "one two"), (7, rows[7][1]), (905, "one two three " * 9000), (906, "né　x ÀB àb")]
    got = write(spark, [(*x, "w", 1) for x in rows], tmp_path)
    tokens = {(i, t): (t or "").encode().translate(LOWER).split() + [b""] for i, t in rows}
    train = Counter()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    for i, t in rows:
        if not out(i):
            train.update(tokens[i, t])
    n, v = sum(train.values()), len(train)
    want = {}
    for i, t in rows:
        ws = tokens[i, t]
        want[i] = (out(i), len(ws), sum(train[w] > 0 for w in ws), n, sum(math.log10((train[w] + 1) / (n + v + 1)) for w in ws))
    gain = {True: 0.0, False: 0.0}
    for i, test, a, b, c, base, score in got:
        assert (test, a, b, c) == want[i][:4]
        assert base == pytest.approx(want[i][4], rel=1e-9)
        assert math.isfinite(score) and score < 0
        gain[test] += score - base
    assert gain[True] > 0 and gain[False] > 0
    held = [(x[5], x[6]) for x in got if x[1] and x[2] > 5]
    assert sum(s for _, s in held) / sum(b for b, _ in held) < 0.98


@pytest.mark.parametrize("rows", [[], [(11, "held out a b", "x", 0)]])
def test_no_training(spark, tmp_path, rows):
    import zlib

    rows = [(next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2), *x[1:]) for x in rows]
    got = write(spark, rows, tmp_path)
    assert len(got) == len(rows)
    for _, test, n, known, total, base, score in got:
        assert (test, n, known, total, base) == (True, 5, 0, 0, 0.0)
        assert score == pytest.approx(5 * math.log10(0.5), rel=1e-5)
