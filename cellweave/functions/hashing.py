"""Hashes and digests as column expressions.

The portable profile uses SHA-256, which every SQL engine has, so that results can be
checked elsewhere.  The compatible one uses personalised BLAKE2b in an Arrow UDF and
gives the published sketch values.
"""

from __future__ import annotations

from hashlib import blake2b
from struct import pack

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

PRIME = (1 << 61) - 1
HASHES, BANDS = 64, 16
ROWS = HASHES // BANDS
#: Personalisations of the compatible sketch.
TOKEN_PERSON, PERM_PERSON, BAND_PERSON, POST_PERSON = b"swcopy-token-v1", b"swcopy-perm-v1", b"swcopy-band-v1", b"swcopy-post-v1"


def digest(text: Column) -> Column:
    """First 24 hexadecimal digits of SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 24)


def domain_digest(domain: str, kind: str, payload: Column) -> Column:
    """Digest with its domain and kind in front, so that equal payloads of other kinds differ."""
    return digest(F.concat(F.lit(f"{domain}{kind}\x00"), payload))


def hash60(text: Column) -> Column:
    """First 15 hexadecimal digits of SHA-256 as a whole number."""
    return F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("long")


def portable_permutations(n: int = HASHES) -> list[tuple[int, int]]:
    from hashlib import sha256

    h = lambda s: int(sha256(s.encode()).hexdigest()[:15], 16)
    return [(h(f"a{i}") % (PRIME - 1) + 1, h(f"b{i}") % PRIME) for i in range(n)]


def compatible_permutations(n: int = HASHES) -> list[tuple[int, int]]:
    out = []
    for i in range(n):
        d = blake2b(pack(">I", i), digest_size=16, person=PERM_PERSON).digest()
        out.append((int.from_bytes(d[:8], "big") % (PRIME - 1) + 1, int.from_bytes(d[8:], "big") % PRIME))
    return out


def compatible_token(token: str) -> int:
    return int.from_bytes(blake2b(token.encode(), digest_size=8, person=TOKEN_PERSON).digest(), "big") % PRIME


def compatible_bands(signature: list[int]) -> list[str]:
    """Band keys of a signature; none for that of no tokens."""
    if all(v == PRIME for v in signature):
        return []
    return ["%02d:%s" % (b, blake2b(pack(f">B{ROWS}Q", b, *signature[b * ROWS : (b + 1) * ROWS]), digest_size=16, person=BAND_PERSON).hexdigest()) for b in range(BANDS)]


def _mod(x: np.ndarray) -> np.ndarray:
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.where(x >= p, x - p, x)


def multiply_mod(a: np.ndarray, v: np.ndarray) -> np.ndarray:
    """a * v mod 2^61 - 1 on unsigned 64-bit arrays, by halves of a."""
    lo_bits, p = np.uint64(31), np.uint64(PRIME)
    a_hi, a_lo = a >> lo_bits, a & np.uint64((1 << 31) - 1)
    v_hi, v_lo = v >> lo_bits, v & np.uint64((1 << 31) - 1)
    low = a_lo * v_lo  # < 2^62
    mid = a_hi * v_lo + a_lo * v_hi  # < 2^62
    high = a_hi * v_hi  # < 2^60, stands for 2^62 times it, that is twice it
    mid_hi, mid_lo = mid >> np.uint64(30), mid & np.uint64((1 << 30) - 1)
    return _mod(_mod(low) + _mod(_mod(mid_hi) + (mid_lo << lo_bits)) + _mod(high << np.uint64(1)) % p)


def least_values(values: np.ndarray, starts: np.ndarray, permutations: list[tuple[int, int]]) -> np.ndarray:
    """For each range of values (starts ascend from 0) the least (a v + b) mod 2^61 - 1 under each permutation."""
    a = np.array([x for x, _ in permutations], np.uint64)
    b = np.array([x for _, x in permutations], np.uint64)
    out = np.full((len(starts), len(a)), PRIME, np.uint64)
    for at in range(0, len(values), 4096):
        v = values[at : at + 4096].astype(np.uint64)
        low, high = np.searchsorted(starts, (at, at + len(v)), side="left")
        cuts = np.concatenate([[0], starts[low:high] - at]) if low == len(starts) or starts[low] != at else starts[low:high] - at
        first = low - (len(cuts) - (high - low))
        got = np.minimum.reduceat(_mod(multiply_mod(a[None, :], v[:, None]) + b[None, :]), cuts, axis=0)
        out[first : first + len(got)] = np.minimum(out[first : first + len(got)], got)
    return out


def minhash(values: Column, permutations: list[tuple[int, int]]) -> Column:
    """array<long> of token values -> array<long>: least (a v + b) mod 2^61 - 1 for each permutation; 2^61 - 1 for no values."""
    a = np.array([x for x, _ in permutations], np.uint64)
    b = np.array([x for _, x in permutations], np.uint64)

    def run(col: pd.Series) -> pd.Series:
        def one(x):
            best = np.full(len(a), PRIME, np.uint64)
            if x is None or not len(x):
                return best.astype(np.int64)
            x = np.unique(np.asarray(x, np.int64)).astype(np.uint64)
            for at in range(0, len(x), 4096):
                np.minimum(best, _mod(multiply_mod(a[None, :], x[at : at + 4096, None]) + b[None, :]).min(0), out=best)
            return best.astype(np.int64)

        return col.map(one)

    return F.pandas_udf(run, "array<bigint>")(values)


def compatible_values(tokens: str) -> Column:
    """array<string> -> array<long> of token values."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda ts: [compatible_token(t) for t in ts])

    return F.pandas_udf(run, "array<bigint>")(F.col(tokens))


def compatible_buckets(sig: str) -> Column:
    """array<long> -> array<string> of band keys."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: compatible_bands([int(x) for x in v]))

    return F.pandas_udf(run, "array<string>")(F.col(sig))
