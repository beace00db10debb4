"""The divergence audit against a dense recount."""

import random
import re
from collections import Counter

from cellweave.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows, least):
    rows = [tuple(x or "" for x in r) for r in rows]
    out = []
    for lang in {r[0] for r in rows}:
        docs = [(s, TERM.findall(t.translate(LOWER))) for g, s, t in rows if g == lang]
        df = Counter(t for _, ts in docs for t in set(ts))
        kept = [t for t, n in df.items() if n >= least]
        count = {s: Counter() for s, _ in docs}
        for s, ts in docs:
            count[s].update(t for t in ts if df[t] >= least)
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s, c in count.items():
            pairs = [(sum(f(p(c, t), p(d, t)) for t in kept), o) for o, d in count.items() if o != s]
            terms = [(f(p(c, t), p(whole, t)), t) for t in c if p(c, t) > p(whole, t)]
            for part, xs, most in (("pair", pairs, None), ("term", terms, 10)):
                xs.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(xs[:most])]
    return sorted(out)


def got(df, least):
    """Of both ways to hold the vocabulary, which must agree."""
    d, e = (divergence.divergence(df, least=least, vocabulary_bytes=n) for n in (divergence.VOCABULARY_BYTES, -1))
    assert d.columns == ["lang", "source", "part", "item", "value", "rank"]
    out = sorted(map(tuple, d.collect()))
    assert out == sorted(map(tuple, e.collect()))
    return out


SCHEMA = "lang string, source string, text string, term string, `__chunk` long"


def test_divergence(spark):
    """Nulls, a language without kept terms, repeated rows, odd characters, delimiters side by side, columns named as the operator's."""
    r = random.Random(5)
    words = ["The", "the", "naïve", "ÀB", "àb", "x", " ", "　y", "ab", "a", "b", "zé", "ÉÉ", "漢字", "😀"] + [f"w{'abcdefgh'[i % 8]}{'xyz'[i % 3]}" for i in range(24)]
    rows = []
    for _ in range(300):
        text = "".join(r.choice(words) + r.choice([" ", " ", "\n", ", ", "1", "-", "\x00"]) for _ in range(r.randint(0, 30)))
        rows.append((r.choice(["en", "en", "en", "fr", None, ""]), r.choice(["hot", "hot", "s1", "s2", "é", None]), r.choice([text] * 9 + [None, ""])))
    rows += [("xx", "only", "word word"), ("xx", "other", None), ("yy", "lone", "")] + [rows[0]] * 9
    df = spark.createDataFrame([(*x, "mine", 3) for x in rows], SCHEMA)
    assert got(df, 10) == expected(rows, 10)
    assert got(df, 1) == expected(rows, 1)


def test_chunks_and_long_texts(spark):
    """A text of many chunks' size, and flushes in between, count alike."""
    rows = [("en", f"s{i % 3}", ("Ab, cd-ef " * (1 + i % 5)) + f"q{'abc'[i % 3]} ") for i in range(60)] + [("en", "s1", "ab zz " * 400_000)]
    df = spark.createDataFrame([(*x, "", 0) for x in rows], SCHEMA)
    assert got(df, 2) == expected(rows, 2)


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA), 10) == []
