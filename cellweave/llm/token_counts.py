"""Token counts by a compiled finite-state transducer.

Byte-pair merging is finite-state.  The encoding of a prefix ends in one token, and
that token is the only suffix of the prefix which is a token and may stand after the
last token of what precedes it.  So a state needs only, for those places where a
suffix of the prefix still begins some vocabulary token, the last token there and
the number of tokens since.  A transition on a code point is annotated with the
change in the token count; changes add up to the count.  The split into pre-tokens
is part of the state.  Transitions are compiled when they are first taken, into one
flat table; at most MAX_STATES are held, then the table starts anew.

A text is cut into chunks.  A chunk's map takes the state that comes in to the state
that goes out and a count.  Maps are worked out for the states that can come in: first
for that which the last LOOK code points before the chunk lead to (exactly so from a
place where white space begins, as every state closes its pre-token and starts afresh
there), and then, where the chunk before goes out with another state, for that one,
until every map that is met is known.  All chunks of a slice are read in lock step, so
a text without white space is read in parallel too.  The maps of a text are composed
by a parallel prefix scan: each (chunk, state) points to the one that follows it, and
pointers are doubled.

Classes of code points (letter, number, white space, other) are asked from the
tokenizer's own splitter once and are part of the compiled tables.

Defined cases: null text is empty, 0 tokens.  Strings of added tokens inside a text
count as one token each, as the library takes them by default.  Repeated rows stay.
A column of the table with the name of an output is replaced by it.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.bpe import merge
from cellweave.llm.common import documents, map_texts, text_of

#: Code points of a chunk, and before it that lead to the state that is tried first; states that a worker holds; columns of the table (the last is for code points that got none).
CHUNK, LOOK, MAX_STATES, COLUMNS = 384, 48, 250_000, 128
#: Rows by which the table grows.
ROWS = 1 << 15
LIMIT = 512
#: A table's entry holds the next state and, in the low byte, the change in the count plus MIDDLE.
MIDDLE = 128

#: Contractions that are pre-tokens of their own after an apostrophe: by first letter, the letters that must follow.
ENDINGS = {"s": "", "t": "", "m": "", "d": "", "r": "e", "v": "e", "l": "l"}

#: Before any byte of a pre-token: no suffix but the empty one, after no token.
EMPTY = (b"", ((0, -1, 0),))


#: Planes that hold characters (fixed by Unicode); those between are unassigned, the last two for private use: other.
PLANES = (0, 1, 2, 3, 14)


def classes(split) -> bytes:
    """L, N, W or O for each code point, as split (a function from a text to its pre-tokens as (piece, (start, end))) has it."""
    out = bytearray(b"O" * 0x110000)
    one = lambda text: len(split(text)) == 1
    for plane in PLANES:
        points = [c for c in range(plane << 16, plane + 1 << 16) if not 0xD800 <= c < 0xE000 and c not in (0x20, 0x27)]
        for _, (a, b) in split("".join(map(chr, points))):  # a pre-token holds code points of one class
            first = chr(points[a])
            kind = b"L" if one("a" + first) else b"N" if one("1" + first) else b"O" if one("!" + first) else b"W"
            for c in points[a:b]:
                out[c] = kind[0]
    out[0x20] = b"W"[0]
    return bytes(out)


class Machine:
    """The transducer of one byte-level BPE vocabulary."""

    def __init__(self, ranks: dict[bytes, int], added: list[str], kinds: bytes):
        self.ranks, self.added, self.kinds = ranks, [a for a in added if a], kinds
        self._begin()

    def __getstate__(self):
        return {"ranks": self.ranks, "added": self.added, "kinds": self.kinds}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._begin()

    def _begin(self):
        self.bytes_of = {i: b for b, i in self.ranks.items()}
        self.begins = {b[:k] for b in self.ranks for k in range(1, len(b))}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.column_of = np.zeros(0x110000, np.uint8)
        self.columns = 0
        self.is_space = np.frombuffer(self.kinds, np.uint8) == ord("W")
        self._clear()

    def _clear(self):
        self.table = np.full((ROWS, COLUMNS), -1, np.int32)
        self.states: list[tuple] = []
        self.ids: dict[tuple, int] = {}
        self.closing: list[int] = []
        self.odd: dict[tuple[int, str], int] = {}
        self.start = self.id_of(("", EMPTY, ""))

    # -- merging as a transducer over bytes

    def follows(self, last: int, token: int) -> bool:
        """Whether the encoding of both tokens' bytes is these two (for last = -1: of the token's bytes, this one)."""
        got = self.pairs.get((last, token))
        if got is None:
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
            want = [token] if last < 0 else [last, token]
            got = self.pairs[last, token] = merge(b"".join(self.bytes_of[t] for t in want), self.ranks) == want
        return got

    def byte(self, merged: tuple, b: bytes) -> tuple[tuple, int]:
        """State of the merges after one more byte, and the change in the count."""
        suffix, places = merged
        suffix += b
        for k, last, since in places:
            token = self.ranks.get(suffix[len(suffix) - k - 1 :])
            if token is not None and self.follows(last, token):
                break
        more = since + 1
        kept = tuple((k + 1, last, since - more) for k, last, since in places if suffix[len(suffix) - k - 1 :] in self.begins)
        return (suffix[len(suffix) - kept[0][0] :] if kept else b"", (*kept, (0, token, 0))), more

    def add(self, merged: tuple, text: str) -> tuple[tuple, int]:
        n = 0
        for b in text.encode():
            merged, more = self.byte(merged, bytes([b]))
            n += more
        return merged, n

    # -- pre-tokens

    def step(self, state: tuple, ch: str) -> tuple[tuple, int]:
        """state: kind of the open pre-token, its merges so far, and what waits to be decided."""
        kind, merged, waits = state
        now = chr(self.kinds[ord(ch)])
        if kind == now and kind in "LNO":
            merged, n = self.add(merged, ch)
            return (kind, merged, ""), n
        if kind == "W":  # the last white space waits
            if now == "W":
                merged, n = self.add(merged, waits)
                return ("W", merged, ch), n
            if waits == " ":
                merged, n = self.add(EMPTY, " " + ch)
                return (now, merged, ""), n
            after, n = self.opened(ch)
            return after, n + self.add(EMPTY, waits)[1]
        if kind == "'":
            if ch in ENDINGS:
                return ("p", EMPTY, "'" + ch) if ENDINGS[ch] else ("c", EMPTY, ""), 0 if ENDINGS[ch] else self.add(EMPTY, "'" + ch)[1]
            if now == "O":
                merged, n = self.add(EMPTY, "'" + ch)
                return ("O", merged, ""), n
            after, n = self.opened(ch)
            return after, n + self.add(EMPTY, "'")[1]
        if kind == "p":  # an apostrophe and r, v or l
            if ch == ENDINGS[waits[1]]:
                return ("c", EMPTY, ""), self.add(EMPTY, waits + ch)[1]
            middle, n = self.opened(waits[1])
            after, more = self.step(middle, ch)
            return after, self.add(EMPTY, "'")[1] + n + more
        return self.opened(ch)

    def opened(self, ch: str) -> tuple[tuple, int]:
        now = chr(self.kinds[ord(ch)])
        if ch == "'" or now == "W":
            return ("'" if ch == "'" else "W", EMPTY, ch), 0
        merged, n = self.add(EMPTY, ch)
        return (now, merged, ""), n

    def close(self, state: tuple) -> int:
        """Tokens of what waits, where the text or the pre-token ends."""
        kind, merged, waits = state
        if kind == "p":
            return self.add(EMPTY, "'")[1] + self.add(EMPTY, waits[1:])[1]
        return self.add(merged, waits)[1]

    # -- the table

    def id_of(self, state: tuple) -> int:
        i = self.ids.get(state)
        if i is None:
            i = self.ids[state] = len(self.states)
            self.states.append(state)
            self.closing.append(self.close(state))
            if i == len(self.table):
                self.table = np.concatenate([self.table, np.full((ROWS, COLUMNS), -1, np.int32)])
        return i

    def entry(self, i: int, ch: str) -> int:
        after, n = self.step(self.states[i], ch)
        return self.id_of(after) * 256 + n + MIDDLE

    def columns_of(self, points: np.ndarray) -> np.ndarray:
        """Columns of code points; new ones get columns while there are any."""
        cols = self.column_of[points]
        if not cols.all():
            for p in np.unique(points[cols == 0]).tolist():
                self.columns = min(self.columns + 1, COLUMNS - 1)
                self.column_of[p] = self.columns
            cols = self.column_of[points]
        return cols

    def follow(self, state: np.ndarray, cols: np.ndarray, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One transition in each lane: states after, changes in the count."""
        got = self.table.ravel()[state * COLUMNS + cols]
        if got.min() < 0:
            for k in np.flatnonzero(got < 0).tolist():
                i, c, p = int(state[k]), int(cols[k]), int(points[k])
                if c < COLUMNS - 1:
                    held = int(self.table[i, c])
                    if held < 0:
                        held = self.entry(i, chr(p))
                        self.table[i, c] = held
                else:
                    held = self.odd.get((i, p))
                    if held is None:
                        held = self.odd[i, p] = self.entry(i, chr(p))
                got[k] = held
        return got >> 8, (got & 255) - MIDDLE

    def lanes(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Reads points[starts : starts + lengths] from the given states in lock step: counts, states at the end."""
        order = np.argsort(-lengths, kind="stable")
        starts, lengths, state = starts[order], lengths[order], state[order].astype(np.int64)
        cols, n = self.columns_of(points), np.zeros(len(order), np.int64)
        live = np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")
        for t, m in enumerate(live.tolist()):
            at = starts[:m] + t
            state[:m], more = self.follow(state[:m], cols[at], points[at])
            n[:m] += more
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        return n[back], state[back]

    # -- texts

    def totals(self, texts: list[str], chunk: int = CHUNK, look: int = LOOK) -> np.ndarray:
        """Token counts of texts (cut at added tokens already)."""
        if len(self.states) > MAX_STATES:
            self._clear()
        points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        begins = np.concatenate([[0], ends[:-1]])
        counts = np.maximum(1, -(-(ends - begins) // chunk))
        of = np.repeat(np.arange(len(texts)), counts)
        number = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        at = begins[of] + number * chunk
        size = np.minimum(at + chunk, ends[of]) - at
        goes_on = np.concatenate([number[1:] > 0, [False]])
        # the state that comes in, as far as the code points before tell
        space = self.is_space[points]
        sure = np.flatnonzero(space[1:] & ~space[:-1]) + 1 if len(points) else np.empty(0, np.int64)
        k = np.searchsorted(sure, at) - 1
        low = np.maximum(at - look, begins[of])
        since = np.maximum(low, sure[np.maximum(k, 0)]) if len(sure) else low
        since = np.where((k >= 0) & (since < at), since, low)
        fresh = np.full(len(of), self.start)
        _, entry = self.lanes(points, since, at - since, fresh)
        # maps: (chunk, entry) -> (exit, count), and the map that follows
        n, exit_ = self.lanes(points, at, size, entry)
        maps = [np.arange(len(of)), entry, exit_, n]
        then = np.where(goes_on, np.arange(1, len(of) + 1), -1)
        known = None
        new = np.flatnonzero(goes_on & (exit_ != np.concatenate([entry[1:], [0]])))
        while len(new):
            if known is None:
                known = {x: i for i, x in enumerate(zip(maps[0].tolist(), maps[1].tolist(), strict=True))}
            wanted: dict[tuple[int, int], int] = {}
            for i, c, x in zip(new.tolist(), (maps[0][new] + 1).tolist(), maps[2][new].tolist(), strict=True):
                if (c, x) not in known:
                    known[c, x] = len(maps[0]) + len(wanted)
                    wanted[c, x] = i
                then[i] = known[c, x]
            if not wanted:
                break
            c, x = (np.array(v, np.int64) for v in zip(*wanted, strict=True))
            n, exit_ = self.lanes(points, at[c], size[c], x)
            new = len(maps[0]) + np.flatnonzero(goes_on[c])
            maps = [np.concatenate(v) for v in zip(maps, (c, x, exit_, n), strict=True)]
            then = np.concatenate([then, np.full(len(c), -1)])
        # the scan: a map composed with those that follow, twice as many in each round
        total, exit_ = maps[3].astype(np.int64), maps[2]
        while (on := then >= 0).any():
            total = total + np.where(on, total[then], 0)
            exit_, then = np.where(on, exit_[then], exit_), np.where(on, then[then], -1)
        first = np.cumsum(counts) - counts
        return total[first] + np.array(self.closing)[exit_[first]]

    def counts(self, texts: list[str], chunk: int = CHUNK) -> list[int]:
        """Tokens of each text."""
        parts, of, extra = [], [], []
        for i, t in enumerate(texts):
            cut = self.segments(t)
            parts += cut
            of += [i] * len(cut)
            extra.append(len(cut) - 1)
        if not parts:
            return []
        n = self.totals(parts, chunk)
        return (np.bincount(np.array(of), weights=n, minlength=len(texts)).astype(np.int64) + np.array(extra)).tolist()

    def segments(self, text: str) -> list[str]:
        """Text between added tokens, which stand for themselves."""
        parts = [text]
        for a in self.added:
            if a in text:
                parts = [x for p in parts for x in p.split(a)]
        return parts


def load(path: str) -> Machine:
    """Compiles a byte-level BPE tokenizer file."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    raw = lambda s: bytes(byte_of[c] for c in s)
    added = {a["content"] for a in spec.get("added_tokens", [])}
    ranks = {raw(k): v for k, v in spec["model"]["vocab"].items() if k not in added}
    for k, pair in enumerate(spec["model"]["merges"]):  # a merge's rank must order as its product's id does
        a, b = pair if isinstance(pair, list) else pair.split(" ")
        spec["model"]["merges"][k] = ranks[raw(a + b)]
    if any(x >= y for x, y in zip(spec["model"]["merges"], spec["model"]["merges"][1:], strict=False)):
        raise ValueError("ids of merged tokens don't follow the order of the merges")
    from tokenizers import Tokenizer

    return Machine(ranks, sorted(added, key=len, reverse=True), classes(Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str))


@lru_cache(4)
def machine(path: str) -> Machine:
    return load(path)


def token_counts(df: DataFrame, text_col: str = "text", limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """df's columns but the text, plus n_bytes, n_tokens and over_limit (n_tokens > limit), which replace columns of those names."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    held = df.sparkSession.sparkContext.broadcast(machine(path))

    def fn(texts):
        return {"n_tokens": pa.array(held.value.counts(texts), pa.int64())}

    d = df.withColumn("__text", text_of(text_col)).drop(text_col).withColumn("n_bytes", F.octet_length("__text").cast("long"))
    return map_texts(d, fn, "n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir).select("doc_id", "text"))
