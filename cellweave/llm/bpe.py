"""Byte-level BPE encoding and decoding by a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary (hash and displace) resolves
every pre-token that is itself a token.  Tier two: any other pre-token is merged by
a heap of (rank, position) over a doubly linked list of its bytes.  Tables are built
once on the driver and broadcast; their size is that of the vocabulary.

The pattern's classes (letters, numbers, white space) are those of the library's own
tables, which are older or newer than those of Python's regex: texts that hold a code
point on which both differ are split with the library's classes spelled out.

Defined cases: null text is empty text: no ids, both digests those of no bytes.
Special tokens are ordinary text.  Repeated rows and any ids pass through.  A column
with the name of an output is replaced by it.
"""

from __future__ import annotations

import base64
import heapq
import re
from functools import lru_cache
from hashlib import sha256

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.common import documents, map_texts, text_of

#: Pre-tokens up to so many bytes have their merges remembered by a worker, and at most so many of them.
MEMO_BYTES, MEMO_ITEMS = 64, 300_000
BUCKET = 4


def _slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    """The place of a key with hash h under its bucket's displacement d."""
    x = (h ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
    return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of byte strings: n keys on n slots, one displacement a bucket."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, -(-n // BUCKET))
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, n)
        assert len(np.unique(h)) == n
        of = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(self.buckets + 1))
        self.displace = np.zeros(self.buckets, np.int64)
        self.at = np.zeros(n, np.int64)
        free = np.ones(n, bool)
        sizes = np.diff(starts)
        for b in np.argsort(-sizes, kind="stable"):
            members = order[starts[b] : starts[b + 1]]
            if len(members) < 2:
                break
            tried = 0
            while True:
                d = np.arange(tried, tried + 32, dtype=np.int64)
                s = _slots(h[members][None, :], d[:, None], n)
                good = free[s].all(1)
                if len(members) > 1:
                    t = np.sort(s, 1)
                    good &= (t[:, 1:] != t[:, :-1]).all(1)
                if good.any():
                    k = int(np.argmax(good))
                    self.displace[b], place = d[k], s[k]
                    break
                tried += 32
            free[place] = False
            self.at[place] = members
        left = iter(np.flatnonzero(free))
        for b in np.flatnonzero(sizes == 1):  # a lone key is sent straight to a free slot
            slot = next(left)
            self.displace[b] = -1 - slot
            self.at[slot] = order[starts[b]]

    def find(self, keys: list[bytes]) -> np.ndarray:
        """The key number that each string would have; the caller compares the key itself."""
        h = np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64, len(keys))
        d = self.displace[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.at[np.where(d < 0, -1 - d, _slots(h, np.maximum(d, 0), self.n))]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a pre-token: the lowest rank merges first, the leftmost of equals."""
    n = len(piece)
    left, right, end = list(range(-1, n - 1)), list(range(1, n + 1)), list(range(1, n + 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = right[i] if end[i] else n
        if not end[i] or j >= n or end[j] != stop:
            continue
        end[i], end[j], right[i] = stop, 0, right[j]
        if right[i] < n:
            left[right[i]] = i
            if (r := ranks.get(piece[i : end[right[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[right[i]]))
        if left[i] >= 0 and (r := ranks.get(piece[left[i] : stop])) is not None:
            heapq.heappush(heap, (r, left[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


#: Classes that a pattern may name.
CLASSES = (r"\p{L}", r"\p{N}", r"\s")
_ALL = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)


def _ranges(chars: str) -> str:
    """Code points (in order) as the inside of a set in a pattern."""
    points = np.frombuffer(chars.encode("utf-32-le"), np.uint32).astype(np.int64)
    new = np.flatnonzero(np.diff(points, prepend=-2) != 1)
    last = points[np.append(new[1:], len(points)) - 1] if len(points) else points
    return "".join(rf"\U{a:08x}-\U{b:08x}" for a, b in zip(points[new].tolist(), last.tolist(), strict=True))


@lru_cache(4)
def spelled_out(pattern: str) -> tuple[str, str]:
    """The pattern with its classes as the library has them, and a pattern for code points that Python's regex has otherwise ("" for none)."""
    import tiktoken

    odd: set[str] = set()
    for name in CLASSES:
        if name in pattern:
            # a library's encoder of single bytes gives back what its pattern matches
            own = tiktoken.Encoding("class", pat_str=name, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
            held = own.decode_bytes(own.encode_ordinary(_ALL)).decode()
            odd |= set(held) ^ set(regex.findall(name, _ALL))
            inside = _ranges(held)
            pattern = re.sub(r"\[\^?[^]]*\]", lambda m, n=name, i=inside: m[0].replace(n, i), pattern).replace(name, f"[{inside}]")
            if name == r"\s":
                pattern = pattern.replace(r"\S", f"[^{inside}]")
    return pattern, f"[{_ranges(''.join(sorted(odd)))}]" if odd else ""


class Codec:
    """Encoder and decoder for one rank file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        keys = list(ranks)
        self.keys, self.ids = keys, np.array([ranks[k] for k in keys], np.uint32)
        self.table, self.pattern = PerfectHash(keys), pattern
        self.exact, self.odd = spelled_out(pattern)
        self.first_odd = int(self.odd[3:11], 16) if self.odd else 1 << 21
        self._ready = None

    def __getstate__(self):
        return {**self.__dict__, "_ready": None}

    def ready(self):
        if self._ready is None:
            ranks = dict(zip(self.keys, self.ids.tolist(), strict=True))
            by_id = [b""] * (max(ranks.values(), default=-1) + 1)
            for k, i in ranks.items():
                by_id[i] = k
            self._ready = ranks, by_id, regex.compile(self.pattern), {}, regex.compile(self.odd or r"(?!)"), regex.compile(self.exact)
        return self._ready

    def resolve(self, pieces: list[str]) -> dict[str, bytes]:
        """Each distinct pre-token's ids as little-endian 32-bit integers."""
        ranks, memo = self.ready()[0], self.ready()[3]
        raw = [p.encode() for p in pieces]
        at = self.table.find(raw)
        first = self.ids[at].astype("<u4")
        out: dict[str, bytes] = {}
        for p, b, k, i in zip(pieces, raw, at.tolist(), first, strict=True):
            if self.keys[k] == b:
                out[p] = i.tobytes()
                continue
            ids = memo.get(b)
            if ids is None:
                ids = np.array(merge(b, ranks), "<u4").tobytes()
                if len(b) <= MEMO_BYTES:
                    if len(memo) >= MEMO_ITEMS:
                        memo.clear()
                    memo[b] = ids
            out[p] = ids
        return out

    def low(self, text: str) -> bool:
        """Whether the text is quickly seen to hold no code point on which the tables differ: all are beyond Latin-1."""
        try:
            return text.isascii() or self.first_odd > 255 and bool(text.encode("latin-1"))
        except UnicodeEncodeError:
            return False

    def encode_all(self, texts: list[str]) -> list[bytes]:
        _, _, usual, _, odd, exact = self.ready()
        cut = [usual.findall(t) if self.low(t) or not odd.search(t) else exact.findall(t) for t in texts]
        known = self.resolve(list({p for c in cut for p in c}))
        return [b"".join(map(known.__getitem__, c)) for c in cut]

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_all([text])[0], "<u4").tolist()

    def decode_bytes(self, ids: bytes) -> bytes:
        by_id = self.ready()[1]
        return b"".join(map(by_id.__getitem__, memoryview(ids).cast("I"))) if ids else b""


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    return Codec(load_ranks(path), pattern)


def default_codec() -> Codec:
    import public_tokenizers

    return codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def encode(df: DataFrame, text_col: str = "text", out: str = "ids", coder: Codec | None = None) -> DataFrame:
    """df plus its ids as array<int>, which replace a column of that name; the text stays."""
    held = df.sparkSession.sparkContext.broadcast(coder or default_codec())

    def fn(texts):
        got = [np.frombuffer(x, "<i4") for x in held.value.encode_all(texts)]
        ends = np.cumsum([0, *map(len, got)])
        return {out: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(got) if got else [], pa.int32()))}

    return map_texts(df.withColumn("__text", text_of(text_col)), fn, f"`{out}` array<int>")


def decode(df: DataFrame, ids_col: str = "ids", out: str = "text", coder: Codec | None = None) -> DataFrame:
    """df plus the text of its ids (bytes that are no UTF-8 become U+FFFD), which replaces a column of that name."""
    held = df.sparkSession.sparkContext.broadcast(coder or default_codec())

    def back(s: pd.Series) -> pd.Series:
        return s.map(lambda x: held.value.decode_bytes(np.asarray(x if x is not None else [], "<u4").tobytes()).decode("utf-8", "replace"))

    return df.withColumn(out, F.pandas_udf(back, "string")(F.col(ids_col)))


def encoded_digests(df: DataFrame, text_col: str = "text", coder: Codec | None = None) -> DataFrame:
    """df's columns but the text, plus n_tokens and the digests of ids and of the decoded bytes, which replace columns of those names."""
    held = df.sparkSession.sparkContext.broadcast(coder or default_codec())

    def fn(texts):
        c = held.value
        ids = c.encode_all(texts)
        return {"n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64()), "ids_sha256": pa.array([sha256(x).hexdigest() for x in ids]), "decoded_sha256": pa.array([sha256(c.decode_bytes(x)).hexdigest() for x in ids])}

    return map_texts(df.withColumn("__text", text_of(text_col)).drop(text_col), fn, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded_digests(documents(spark, sf_dir).select("doc_id", "text"))
