"""Removal of byte strings that repeat across documents, by suffix arrays.

Suffix arrays are built by linear grouping.  Suffixes start in groups by their first
byte.  Groups are taken in descending order; when one is taken, its members share
their longest Lyndon prefix.  Each member points to the nearest smaller suffix before
it, and the suffixes pointed to are moved to new groups right above their old ones,
those that more members point to higher.  When all groups are done, each group's order
follows from the order of lower suffixes alone, in one pass over the array: nothing is
renamed and no shorter text is sorted first.

A corpus is not one text.  Every LENGTH-byte window has an anchor, the first least
GRAM-gram in it by hash, so that equal windows have equal anchors at equal offsets.
Runs of windows with one anchor are spans of at most 84 bytes.  Spans whose anchor is
in one document only can't hold a repeated window and go no further.  Equal spans are
one row with the least and the greatest id that holds them, and so are equal texts.
Of the different spans with one anchor, those that share a longer gram around it go
into one suffix array each group, all of them whole: neighbours in its order with a
common prefix of a window's length hold equal windows, and these get the least id that
holds them.  Arrays of many groups are built in lock step.  Every occurrence of a span
then removes the bytes of its windows that a smaller id holds.  Groups of more than
MANY spans are split by longer grams around the anchor: spans that share a window
share one of those.

Defined cases: null text is empty; a row without id comes after all others, and rows
of one id (or without), equal ones too, don't take from each other; an equal row's spans
are made once, however many there are; ids that aren't whole numbers come in their own order; texts under LENGTH bytes lose
nothing; an empty table gives no rows.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellweave.llm.common import documents, slices, stored, text_of
from cellweave.llm.jaccard_join import _P, _PINV, _mix, _powers

LENGTH, GRAM = 50, 16
SPREAD = LENGTH - GRAM + 1
#: Spans of one anchor that meet in one group at most; beyond, they meet by longer grams.
MANY = 4000
#: Bytes of spans whose suffix arrays are built at once, and of a group's from which its array is built by itself.
BATCH, LANE = 1 << 19, 1024
#: Bytes of text whose grams a worker holds at a time (about 100 bytes for each).
SLICE = 1 << 20
#: Spans whose grams are hashed at once.
ROWS = 10_000
#: Steps by which the longer grams around an anchor differ; they have LENGTH - STEP + 1 bytes.
STEP = 9


# -- suffix arrays


def suffix_array(s: bytes | list[int]) -> tuple[list[int], list[int]]:
    """The suffix array of s and its inverse, by linear grouping."""
    n = len(s)
    counts: dict[int, int] = {}
    for c in s:
        counts[c] = counts.get(c, 0) + 1
    fill, total = {}, 0
    end_of = [0] * (n + 1)  # by a group's first place, by which it is known
    for c in sorted(counts):
        fill[c] = total
        total += counts[c]
        end_of[fill[c]] = total
    group = [fill[c] for c in s]
    order, place = [0] * n, [0] * n
    for i, c in enumerate(s):
        p = fill[c]
        order[p] = i
        place[i] = p
        fill[c] = p + 1
    before = [-1] * n
    end = n
    while end:
        i = order[end - 1]
        g = group[i]
        if end - g == 1:  # one member: the suffix that it points to becomes a group of its own
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                old = group[j]
                e = end_of[old] - 1
                if e != old:
                    p, last = place[j], order[e]
                    order[p], order[e] = last, j
                    place[last], place[j] = p, e
                    end_of[old], end_of[e], group[j] = e, e + 1, e
            end = g
            continue
        members = sorted(order[g:end])  # so that a member's pointer is known when a later one passes it
        pointed: dict[int, int] = {}
        for i in members:
            j = i - 1
            while j >= 0 and group[j] >= g:
                j = before[j]
            before[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        if pointed:
            most = max(pointed.values())
            if most == 1:
                batches = [list(pointed)]
            else:
                by: list[list[int]] = [[] for _ in range(most + 1)]
                for j, k in pointed.items():
                    by[k].append(j)
                batches = [b for b in reversed(by) if b]
            for batch in batches:
                moved: dict[int, int] = {}
                for j in batch:  # to the end of its group
                    old = group[j]
                    e = end_of[old] - 1
                    end_of[old] = e
                    p, last = place[j], order[e]
                    order[p], order[e] = last, j
                    place[last], place[j] = p, e
                    moved[old] = moved.get(old, 0) + 1
                news = {old: end_of[old] for old in moved}
                for old, k in moved.items():
                    end_of[news[old]] = news[old] + k
                for j in batch:
                    group[j] = news[group[j]]
        end = g
    # each group's order: a suffix is emitted by the smaller one that follows its Lyndon prefix
    out, rank, free = [0] * n, [-1] * n, list(range(n + 1))
    s_at = n
    for k in range(n + 1):
        j = s_at - 1
        while j >= 0 and rank[j] < 0:
            g = group[j]
            p = free[g]
            free[g] = p + 1
            out[p] = j
            rank[j] = p
            j = before[j]
        if k < n:
            s_at = out[k]
    return out, rank


def common_prefixes(s, order: list[int], rank: list[int], most: int | None = None) -> list[int]:
    """Common prefix of each suffix and the one before it in order, counted up to `most` if that is given."""
    n, h = len(s), 0
    most = n if most is None else most
    lcp = [0] * n
    for i, r in enumerate(rank):
        if r:
            j = order[r - 1]
            stop = min(most, n - (i if i > j else j))
            while h < stop and s[i + h] == s[j + h]:
                h += 1
            lcp[r] = h
            if h:
                h -= 1
        else:
            h = 0
    return lcp


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ..., counts[0] of them, then those of the next."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts - starts, counts)


def _moved_up(batch: np.ndarray, order, place, group, end_of, mark) -> None:
    """Moves the suffixes of batch out of their groups, to new ones right above."""
    batch = batch[np.argsort(group[batch], kind="stable")]
    old = group[batch]
    new = np.flatnonzero(np.concatenate([[True], old[1:] != old[:-1]]))
    k = np.diff(np.append(new, len(batch)))
    end = end_of[old[new]]
    tail = end - k
    to, low = _ranges(tail, k), np.repeat(tail, k)
    mark[batch] = True
    others = ~mark[order[to]]  # what has to leave the tail
    mark[batch] = False
    leaving, below = order[to[others]], place[batch] < low
    vacant, coming = place[batch[below]], batch[below]
    order[vacant], place[leaving] = leaving, vacant
    order[to[others]], place[coming] = coming, to[others]
    end_of[old[new]] = tail
    end_of[tail] = end
    group[batch] = low


def suffix_arrays(text: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The suffix arrays of texts that stand one after another (places in all of them), by linear grouping in lock step.

    All texts take their highest group at the same time; a text's steps are those of suffix_array.
    """
    n = len(text)
    begin = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(lengths)), lengths)
    order = np.argsort(of.astype(np.int64) << 16 | text, kind="stable").astype(np.int32)
    first = np.flatnonzero(np.concatenate([[True], (text[order[1:]] != text[order[:-1]]) | (of[1:] != of[:-1])])) if n else np.empty(0, np.int64)
    size = np.diff(np.append(first, n))
    place, group, end_of = np.empty(n, np.int32), np.empty(n, np.int32), np.zeros(n + 1, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    group[order] = np.repeat(first, size)
    end_of[first] = first + size
    before = np.arange(-1, n - 1, dtype=np.int32)
    mark = np.zeros(n, bool)
    low, end = begin.copy(), begin + lengths
    while True:
        live = end > low
        if not live.all():
            low, end = low[live], end[live]
        if not len(end):
            break
        g = group[order[end - 1]]
        m = end - g
        members = order[_ranges(g, m)]
        least, at = np.repeat(low, m), np.repeat(g, m)
        j = members - 1
        on = np.flatnonzero(j >= least)
        while len(on):  # the nearest suffix before it in a lower group
            on = on[group[j[on]] >= at[on]]
            j[on] = before[j[on]]
            on = on[j[on] >= least[on]]
        before[members] = j
        j = j[j >= least]
        if len(j):
            j.sort()
            new = np.flatnonzero(np.concatenate([[True], j[1:] != j[:-1]]))
            times, j = np.diff(np.append(new, len(j))), j[new]
            most = int(times.max())
            if most == 1:
                _moved_up(j, order, place, group, end_of, mark)
            else:
                for k in np.unique(times)[::-1]:
                    _moved_up(j[times == k], order, place, group, end_of, mark)
        end = g.astype(np.int64)
    # each group's order, a suffix or a step of the pass at a time
    out, done, free = np.zeros(n, np.int32), np.zeros(n, bool), np.arange(n + 1, dtype=np.int32)
    low, j, k, stop = begin.copy(), begin + lengths - 1, begin.copy(), begin + lengths
    while len(j):
        # suffixes before the one that is read, along the pointers
        on = np.flatnonzero(j >= low)
        on = on[~done[j[on]]]
        while len(on):
            x = j[on]
            done[x] = True
            p = free[group[x]]
            free[group[x]] += 1
            out[p] = x
            x = before[x]
            j[on] = x
            on = on[x >= low[on]]
            on = on[~done[j[on]]]
        live = k < stop
        if not live.all():
            low, k, stop = low[live], k[live], stop[live]
        j = out[k].astype(np.int64) - 1
        k = k + 1
    return out


def _window_runs(text: np.ndarray, order: np.ndarray, window: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows in suffix order, and where a new run of equal ones begins: common prefixes of neighbours are compared up to a window's length."""
    at = order[window[order]]
    new = np.ones(len(at), bool)
    if len(at) > 1:
        views = np.lib.stride_tricks.sliding_window_view(text, length)
        for a in range(1, len(at), 1 << 16):
            b = min(len(at), a + (1 << 16))
            new[a:b] = (views[at[a:b]] != views[at[a - 1 : b - 1]]).any(1)
    return at, new


def least_owner(groups: list[list[bytes]], owners: list[list[int]], length: int = LENGTH) -> list[np.ndarray]:
    """For each window of each span, the least owner among the spans of its group that hold it; spans in the order given."""
    spans = [x for g in groups for x in g]
    if not spans:
        return []
    sizes = np.fromiter(map(len, spans), np.int64, len(spans))
    held = np.array([o for g in owners for o in g], np.int64)
    least, windows = _least_owners(np.frombuffer(b"".join(spans), np.uint8), sizes, np.array(list(map(len, groups)), np.int64), held, length)
    return np.split(least, np.cumsum(windows)[:-1])


def _least_owners(data: np.ndarray, sizes: np.ndarray, counts: np.ndarray, owners: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """The same for spans of these sizes that stand one after another in data, so many in each group: owners of all windows, and each span's number of windows."""
    ends = np.cumsum(sizes + 1)
    text = np.zeros(int(ends[-1]), np.uint16)  # 0, below all bytes, between spans
    inside = np.ones(len(text), bool)
    inside[ends - 1] = False
    text[inside] = data.astype(np.uint16) + 1
    # a group without spans has no text
    lengths = np.diff(np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts)])])
    order = np.empty(len(text), np.int64)
    long = lengths > LANE  # in lock step all texts would wait for it
    begin = np.cumsum(lengths) - lengths
    if not long.all():
        own = _ranges(begin[~long], lengths[~long])
        order[own] = own[suffix_arrays(text[own], lengths[~long])]
    for k in np.flatnonzero(long).tolist():
        a = int(begin[k])
        order[a : a + lengths[k]] = a + np.array(suffix_array(text[a : a + lengths[k]].tolist())[0], np.int64)
    left = np.repeat(ends, sizes + 1) - 1 - np.arange(len(text))
    of = np.repeat(np.arange(len(sizes)), sizes + 1)
    at, new = _window_runs(text, order, left >= length, length)
    held = owners[of]
    least = held.copy()
    if len(at):
        group_of = np.repeat(np.arange(len(counts)), counts)[of[at]]
        new[1:] |= group_of[1:] != group_of[:-1]
        starts = np.flatnonzero(new)
        least[at] = np.repeat(np.minimum.reduceat(held[at], starts), np.diff(np.append(starts, len(at))))
    windows = np.maximum(sizes - length + 1, 0)
    return least[_ranges(ends - 1 - sizes, windows)], windows


# -- anchors


_held: dict[int, np.ndarray] = {}


def _powers_of(base: int, n: int) -> np.ndarray:
    """Powers up to the n-th; those that most slices need are kept."""
    if n > 2 * SLICE:
        return _powers(base, n)
    if base not in _held or len(_held[base]) < n:
        _held[base] = _powers(base, 2 * SLICE)
    return _held[base][:n]


def _key(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """One number for a text of a slice and a hash (an odd multiple is told apart from others by all bits)."""
    return h ^ (doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Grams:
    """GRAM-grams of some texts by hash, and the least hash in each window of LENGTH bytes that lies in one text."""

    def __init__(self, raw: list[bytes]):
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        self.begin = np.cumsum(sizes) - sizes
        n = int(sizes.sum())
        self.start = np.empty(0, np.int64)
        if n < LENGTH:
            return
        x = np.frombuffer(b"".join(raw), np.uint8)
        self.of = np.repeat(np.arange(len(raw), dtype=np.int32), sizes)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((x.astype(np.uint64) + np.uint64(1)) * _powers_of(_P, n), out=self.sums[1:])
        self.h = _mix((self.sums[GRAM:] - self.sums[:-GRAM]) * _powers_of(_PINV, n)[: n - GRAM + 1])
        m, size = self.h, 1
        while size * 2 <= SPREAD:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < SPREAD:
            m = np.minimum(m[: size - SPREAD], m[SPREAD - size :])
        self.start = np.flatnonzero(self.of[: n - LENGTH + 1] == self.of[LENGTH - 1 :])
        if not len(self.start):
            return
        self.least = m[self.start]
        doc = self.of[self.start]
        new = np.flatnonzero(np.concatenate([[True], (self.least[1:] != self.least[:-1]) | (doc[1:] != doc[:-1])]))
        #: runs of windows with one least hash in one text
        self.first, self.last = self.start[new], self.start[np.concatenate([new[1:], [len(doc)]]) - 1]
        self.doc, self.hash = doc[new].astype(np.int64), self.least[new]

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(text, hash) of the distinct anchors of each text."""
        _, new = np.unique(_key(self.doc, self.hash), return_index=True)
        return self.doc[new], self.hash[new].view(np.int64)

    def spans(self, doc: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, ...]:
        """Spans whose anchor is among (doc, hashes): text, hash, anchor, first and last window (places in the joined texts)."""
        keep = np.isin(_key(self.doc, self.hash), _key(doc, hashes.view(np.uint64)))
        d, h, at, last = self.doc[keep], self.hash[keep], self.first[keep], self.last[keep]
        found = []
        while len(at):  # again only where a run goes on after its first anchor, that is, where a gram repeats
            p = at + np.argmax(self.h[at[:, None] + np.arange(SPREAD)] == h[:, None], axis=1)
            found.append((d, h, p, at, np.minimum(last, p)))
            on = p < last
            d, h, at, last = d[on], h[on], p[on] + 1, last[on]
        return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.empty(0, np.int64),) * 5

    def hash_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Hash of the bytes from a to b."""
        return (self.sums[b] - self.sums[a]) * _powers_of(_PINV, len(self.sums))[a]


def _anchored(docs: DataFrame) -> DataFrame:
    """docs: td, __text -> (h, td) for every distinct anchor of a text."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                g = Grams([t.encode() for t in part.column("__text").to_pylist()])
                if len(g.start):
                    k, h = g.anchors()
                    yield pa.RecordBatch.from_arrays([pa.array(h), part.column("td").take(pa.array(k))], names=["h", "td"])

    return docs.mapInArrow(run, "h long, td long")


def _in_several(rows: DataFrame) -> DataFrame:
    """The rows whose anchor more than one text holds; rows come sorted by anchor, and those of an anchor are held only as long as they are all of one text."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        last = owner = None
        told = False  # whether rows of the last anchor have been given out
        for batch in batches:
            if not batch.num_rows:
                continue
            h, o = batch.column("h").to_numpy(), batch.column("td").to_numpy()
            new = np.concatenate([[last is None or h[0] != last], h[1:] != h[:-1]])
            starts, group = np.flatnonzero(new), np.cumsum(new)  # group 0 goes on from the batch before
            first = np.concatenate([[o[0] if owner is None else owner], o[starts]])
            shared = np.zeros(len(first), bool)
            shared[0] = told
            shared[group[o != first[group]]] = True
            if not new[0] and shared[0] and not told:  # all rows so far were of one text: one of them stands for them
                yield pa.RecordBatch.from_arrays([pa.array([last]), pa.array([owner])], names=["h", "td"])
            out = batch.filter(pa.array(shared[group]))
            if out.num_rows:
                yield out
            end = group[-1]
            last, owner, told = h[-1], first[end], bool(shared[end])

    return rows.repartition(n, "h").sortWithinPartitions("h").mapInArrow(run, "h long, td long")


def _spans(docs: DataFrame) -> DataFrame:
    """docs: rid, ord, __text, hashes (anchors that several hold) -> (h, sd, off, span, ord, rid, first).

    A span is known by its anchor's hash and its own, sd; the span itself comes with its
    first occurrence in a slice only.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text", SLICE):
                raw = [t.encode() for t in part.column("__text").to_pylist()]
                g, held = Grams(raw), part.column("hashes")
                if not len(g.start):
                    continue
                doc = np.repeat(np.arange(len(raw)), held.value_lengths().to_numpy())
                k, h, p, first, last = g.spans(doc, held.flatten().to_numpy())
                if not len(k):
                    continue
                off = p - first
                sd = _mix(_mix(g.hash_of(first, last + LENGTH)) + (off * 64 + last - first).astype(np.uint64))
                _, new = np.unique(_mix(h) + sd, return_index=True)
                at = first - g.begin[k]
                texts: list[bytes | None] = [None] * len(k)
                for i, q, a, n in zip(new.tolist(), k[new].tolist(), at[new].tolist(), (last - first)[new].tolist(), strict=True):
                    texts[i] = raw[q][a : a + n + LENGTH]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(sd.view(np.int64)), pa.array(off.astype(np.int32)), pa.array(texts, pa.binary()), part.column("ord").take(pa.array(k)), part.column("rid").take(pa.array(k)), pa.array(at.astype(np.int32))], names=["h", "sd", "off", "span", "ord", "rid", "first"])

    return docs.mapInArrow(run, "h long, sd long, off int, span binary, ord long, rid long, first int")


def around(span: bytes, off: int) -> list[tuple[int, bytes]]:
    """The grams of LENGTH - STEP + 1 bytes around the anchor, of which two spans with a common window share one."""
    out = []
    rest = LENGTH - GRAM
    for j in range(0, rest + 1, STEP):
        right = max(0, rest - j - STEP + 1)
        if off >= j and len(span) - off - GRAM >= right:
            out.append((j, span[off - j : off + GRAM + right]))
    return out


def _bytes_of(spans: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of spans one after another, and where each begins and the last ends."""
    spans = spans.cast(pa.binary())
    at = np.frombuffer(spans.buffers()[1], np.int32)[spans.offset : spans.offset + len(spans) + 1].astype(np.int64) if len(spans) else np.zeros(1, np.int64)
    data = np.frombuffer(spans.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.empty(0, np.uint8)
    return data, at - at[0]


def _alike(spans: pa.Array | list[bytes], offs, groups=None) -> list[int]:
    """The spans that can have a window in common with another of their group (without groups, all are one): they share a gram around the anchor.

    Grams are told by hash; spans whose grams meet by chance are told apart by their suffix array.
    """
    spans = spans if isinstance(spans, pa.Array) else pa.array(spans, pa.binary())
    offs = np.asarray(offs, np.int64)
    own = np.zeros(len(spans), np.uint64) if groups is None else np.asarray(groups).astype(np.int64).view(np.uint64)
    rest = LENGTH - GRAM
    keys, rows = [], []
    for start in range(0, len(spans), ROWS):
        data, at = _bytes_of(spans.slice(start, ROWS))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers_of(_P, len(data)), out=sums[1:])
        back = _powers_of(_PINV, len(data) + 1)
        off, group = offs[start : start + ROWS], own[start : start + ROWS]
        for j in range(0, rest + 1, STEP):
            right = max(0, rest - j - STEP + 1)
            k = np.flatnonzero((off >= j) & (np.diff(at) - off - GRAM >= right))
            a, b = (at[:-1] + off)[k] - j, (at[:-1] + off)[k] + GRAM + right
            keys.append(_mix(_mix((sums[b] - sums[a]) * back[a] + np.uint64(j)) + group[k]))
            rows.append(k + start)
    if not keys:
        return []
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(key)
    same = key[order[1:]] == key[order[:-1]]
    live = np.zeros(len(spans), bool)
    live[row[order[1:][same]]] = live[row[order[:-1][same]]] = True
    return np.flatnonzero(live).tolist()


def _window_owners(groups: DataFrame) -> DataFrame:
    """groups (gid, h, sd, off, span, own) -> (h, sd, least) of spans of which a window has a lower owner.

    Dealt by gid; the spans that can have a window in common are collected until they are BATCH bytes, or a
    group is, and their suffix arrays decide.
    """
    n = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        held: list[pa.RecordBatch] = []  # rows of the group that the last batch ended in
        waiting: list[pa.RecordBatch] = []  # alike spans of whole groups
        size = 0

        def solved():
            nonlocal size
            rows = pa.concat_batches(waiting)
            waiting.clear()
            size = 0
            gid, own = rows.column("gid").to_numpy(), rows.column("own").to_numpy()
            data, at = _bytes_of(rows.column("span"))
            first = np.flatnonzero(np.concatenate([[True], gid[1:] != gid[:-1]]))
            least, windows = _least_owners(data, np.diff(at), np.diff(np.append(first, len(gid))), own)
            lower = np.logical_or.reduceat(least < np.repeat(own, windows), np.cumsum(windows) - windows)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(windows[lower])]), pa.int32()), pa.array(least[np.repeat(lower, windows)]))
            mine = pa.array(np.flatnonzero(lower))
            return pa.RecordBatch.from_arrays([rows.column("h").take(mine), rows.column("sd").take(mine), lists], names=["h", "sd", "least"])

        def add(rows):
            """Rows of whole groups."""
            nonlocal size
            gid = rows.column("gid").to_numpy()
            new = np.concatenate([[True], gid[1:] != gid[:-1]])
            several = ~(new & np.append(new[1:], True))
            rows = rows.take(pa.array(np.flatnonzero(several)))
            rows = rows.take(pa.array(_alike(rows.column("span"), rows.column("off").to_numpy(), rows.column("gid").to_numpy()), pa.int64()))
            gid, at = rows.column("gid").to_numpy(), _bytes_of(rows.column("span"))[1]
            start = 0
            for end in [*(np.flatnonzero(gid[1:] != gid[:-1]) + 1).tolist(), len(gid)]:
                if size + at[end] - at[start] > BATCH or end == len(gid):
                    if end > start:
                        waiting.append(rows.slice(start, end - start))
                        size += int(at[end] - at[start])
                        start = end
                    if size > BATCH:
                        yield solved()

        for batch in batches:
            if not batch.num_rows:
                continue
            gid = batch.column("gid").to_numpy()
            cut = int(np.searchsorted(gid, gid[-1]))  # where the last group begins
            if cut or held and held[0].column("gid")[0].as_py() != gid[0]:
                yield from add(pa.concat_batches([*held, batch.slice(0, cut)]))
                held.clear()
            held.append(batch.slice(cut))
        if held:
            yield from add(pa.concat_batches(held))
        if waiting:
            yield solved()

    cols = groups.select("gid", "h", "sd", "off", "span", "own")
    return cols.repartition(n, "gid").sortWithinPartitions("gid").mapInArrow(run, "h long, sd long, least array<bigint>")


def _grouped(distinct: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """distinct spans with the group that each goes to: that of its anchor, and apart, where that is too large, those of its longer grams."""

    many = stored(distinct.groupBy("h").agg(F.count("*").alias("spans")).filter(F.col("spans") > MANY))
    if not many.limit(1).count():
        return distinct.withColumn("gid", F.col("h")), None
    marked = distinct.join(many, "h", "left")

    def run(batches):
        for batch in batches:
            gids, at = [], []
            for i, (h, span, off) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("h", "span", "off")], strict=True)):
                for j, g in around(span, off):
                    gids.append(xxhash.xxh3_64_intdigest(g + b"%d:%d" % (j, h)) - (1 << 63))
                    at.append(i)
            kept = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(gids, pa.int64())], names=[*kept.schema.names, "gid"])

    few = marked.filter("spans IS NULL").drop("spans").withColumn("gid", F.col("h"))
    split = marked.filter("spans IS NOT NULL").drop("spans").mapInArrow(run, "h long, sd long, off int, span binary, own long, gid long")
    return few, split


def _removed(rows: DataFrame) -> DataFrame:
    """rows: ord, rid, first, own, windows, least -> (rid, a, b): bytes to remove.

    own is null for a span that one ord only holds; least is null for one whose windows
    are all its own, and then own is lower than ord.
    """

    def run(batches):
        for batch in batches:
            ord_, rid, first, windows = (batch.column(c).fill_null(0).to_numpy() for c in ("ord", "rid", "first", "windows"))
            own, lists = batch.column("own"), batch.column("least")
            whole = own.is_valid().to_numpy(zero_copy_only=False) & (own.fill_null(0).to_numpy() < ord_)
            a, b = first.astype(np.int64), first + windows.astype(np.int64) - 1 + LENGTH
            # a span's windows are fewer than a window's bytes, so those that go are one range
            k = np.flatnonzero(~whole & lists.is_valid().to_numpy(zero_copy_only=False))
            lists = lists.take(pa.array(k))
            n = lists.value_lengths().to_numpy()
            i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            of = np.repeat(k, n)
            lower = lists.flatten().to_numpy() < ord_[of]
            of, i = of[lower], i[lower]
            new = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
            a[of[new]] += i[new]
            b[of[new]] = first[of[new]] + i[np.append(new[1:], len(of)) - 1] + LENGTH if len(of) else 0
            whole[of] = True
            yield pa.RecordBatch.from_arrays([pa.array(rid[whole]), pa.array(a[whole].astype(np.int32)), pa.array(b[whole].astype(np.int32))], names=["rid", "a", "b"])

    return rows.mapInArrow(run, "rid long, a int, b int")


def _pairs_of(lists: pa.Array) -> list[list[tuple[int, int]]]:
    """Lists of structs (a, b) as lists of pairs; none for null."""
    flat, n = lists.flatten(), lists.value_lengths().fill_null(0).to_numpy()
    pairs = list(zip(flat.field("a").to_numpy().tolist(), flat.field("b").to_numpy().tolist(), strict=True))
    ends = np.cumsum(n)
    return [pairs[a:b] for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True)]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _ordered(docs: DataFrame) -> DataFrame:
    """docs plus ord, a whole number in the order of doc_id, the largest for null: whole numbers as they are, ids of other types by their place in a range sort."""
    last = F.lit((1 << 63) - 1)
    if isinstance(docs.schema["doc_id"].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return docs.withColumn("ord", F.coalesce(F.col("doc_id").cast("long"), last))
    ids = stored(docs.select("doc_id").filter("doc_id IS NOT NULL").distinct())
    ids = stored(ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id").withColumn("ord", F.monotonically_increasing_id()))
    return docs.join(ids, "doc_id", "left").withColumn("ord", F.coalesce("ord", last))


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df's rows as (doc_id, rid, __text, spans): spans are the byte ranges (a, b) to remove, unmerged and each once; null for none.

    Ids of any type that sorts go; rows of one id, equal ones too, remove nothing from each other; a null id comes after all.
    """
    docs = df.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("__text")).withColumn("rid", F.xxhash64("doc_id", "__text"))
    docs = _ordered(docs)
    # a copy of a whole text goes whole, and takes no part in what follows
    whole = docs.select("rid", "ord", F.md5("__text").alias("sum"), F.octet_length("__text").alias("n"))
    firsts = stored(whole.groupBy("sum").agg(F.min("ord").alias("least"), F.max("ord").alias("last")).filter("last > least"))
    copies = stored(whole.join(firsts, "sum").filter("ord > least").select("rid", "n").distinct())
    docs = docs.withColumn("td", F.xxhash64("__text"))
    # anchors are dealt with a text's digest only, which its copies share
    several = _in_several(_anchored(docs.select("td", "__text"))).groupBy("td").agg(F.collect_set("h").alias("hashes"))
    live = stored(docs.select("rid", "td").distinct().join(copies.select("rid"), "rid", "left_anti").join(several, "td").select("rid", "hashes"))
    spans = stored(_spans(docs.select("rid", "ord", "__text").join(live, "rid")))
    distinct = stored(spans.groupBy("h", "sd").agg(F.max("span").alias("span"), F.max("off").alias("off"), F.min("ord").alias("own"), F.max("ord").alias("top")).select("h", "sd", "off", "span", "own", "top"))
    few, split = _grouped(distinct.drop("top"))
    least = stored(_window_owners(few))
    if split is not None:  # a span in several groups takes the least of each window
        each = _window_owners(split).select("h", "sd", F.posexplode("least").alias("i", "x")).groupBy("h", "sd", "i").agg(F.min("x").alias("x"))
        least = least.union(stored(each.groupBy("h", "sd").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("least"))))
    # a span without lower windows of other spans matters only where a later text holds it too
    later = distinct.filter("top > own").select("h", "sd", "own", (F.octet_length("span") - LENGTH + 1).alias("windows"))
    known = stored(later.join(least, ["h", "sd"], "full_outer"))
    rows = spans.select("h", "sd", "ord", "rid", "first").join(known, ["h", "sd"]).filter("ord > own OR least IS NOT NULL")
    entire = copies.filter(F.col("n") >= LENGTH).select("rid", F.lit(0).alias("a"), F.col("n").cast("int").alias("b"))
    gone = stored(_removed(rows).union(entire).groupBy("rid").agg(F.collect_set(F.struct("a", "b")).alias("spans")))
    return docs.join(gone, "rid", "left").select("doc_id", "rid", "__text", "spans")


def _with_spans(df: DataFrame, fn, schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in slices(batch, "__text"):
                raw = [t.encode() for t in part.column("__text").to_pylist()]
                gone = [merged(x) for x in _pairs_of(part.column("spans"))]
                yield fn(part, raw, gone)

    return df.mapInArrow(run, schema)


def kept_bytes(raw: bytes, gone: list[tuple[int, int]]) -> bytes:
    at, out = 0, []
    for a, b in gone:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]])


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text, spans): texts without their repeated bytes (cut characters become U+FFFD) and the byte ranges that went."""
    span = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))

    def fn(part, raw, gone):
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([kept_bytes(r, g).decode("utf-8", "replace") for r, g in zip(raw, gone, strict=True)]), pa.array([[{"a": a, "b": b} for a, b in g] for g in gone], span)], names=["doc_id", "text", "spans"])

    return _with_spans(repeated_spans(df, id_col, text_col), fn, f"doc_id {dict(df.dtypes)[id_col]}, text string, spans array<struct<a:int,b:int>>")


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    def fn(part, raw, gone):
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(list(map(len, raw)), pa.int64()), pa.array([sum(b - a for a, b in g) for g in gone], pa.int64()), pa.array(list(map(len, gone)), pa.int64()), pa.array([sha256(kept_bytes(r, g)).hexdigest() for r, g in zip(raw, gone, strict=True)])],
            names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        )

    return _with_spans(repeated_spans(documents(spark, sf_dir)), fn, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
