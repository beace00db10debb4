"""Secret scans: fixed patterns, and a token-efficiency test for random strings.

The patterns find assignments, access keys and hexadecimal runs.  The method then
looks at every run of token characters: under a BPE vocabulary learned from prose,
words take few tokens while random strings take about one for each one or two
characters.  A run with a low ratio of characters to tokens is a secret, unless it
is a known digest or an identifier.  Readable text joined to a secret raises the
ratio of the whole, so a run that isn't one itself is also tested in parts: what lies
between separators, and neighbours that aren't identifiers taken together.

Not found as random: letters of one case alone, which the ratio doesn't tell from rare
words, and a secret joined to readable text without a separator.

Defined cases: null text is empty and has no spans; offsets are code points, ends
exclusive; a text of any length is scanned whole; repeated rows stay.
"""

from __future__ import annotations

import re
from functools import lru_cache
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.llm.bpe import load_ranks
from cellweave.llm.common import documents, map_texts, packed, text_of

KINDS = ("assign", "access", "hex", "random")
#: Least length of a candidate, and characters a token under which it counts as random.
LEAST, RATIO = 20, 2.1
#: Least length of a candidate without separators; characters between parts of one candidate.
SHORT, APART = 12, 8
#: Lengths of digests in hexadecimal (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = (32, 40, 56, 64, 96, 128)


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(_any_case, ("password", "passwd", "secret", "token")), _any_case("api") + "_?" + _any_case("key")])
ASSIGN = re.compile(r"(" + _NAMES + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
_LONG = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % SHORT)
_ALNUM = re.compile(r"[A-Za-z0-9]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_INNER_UUID = re.compile(rf"(?<![A-Za-z0-9]){_UUID.pattern}(?![A-Za-z0-9])")
_STAMP = re.compile(r"[0-9]{8}T[0-9]{4,9}Z?")
_HEXRUN = re.compile(r"[0-9A-Fa-f]+")
#: Parts of identifiers, paths and versions: words in any usual spelling with digits only at the end, or numbers.
_PART = re.compile(r"(?:[A-Z]*[a-z]*|(?:[A-Z][a-z]+)+|[a-z]+(?:[A-Z][a-z]+)*)[0-9]{0,4}|[0-9]+")

# A text's bytes with each of a class as "h": a run is looked for as a plain string, so that most texts need no pattern at all.
_TO_HEX = bytes(ord("h") if c in b"0123456789abcdef" else ord(" ") for c in range(256))
_TO_RUN = bytes(ord("h") if re.match(rb"[A-Za-z0-9+/_.=-]", bytes([c])) else ord(" ") for c in range(256))


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=load_ranks(path), special_tokens={})


def _known(s: str) -> bool:
    """Whether a part between separators is an identifier, a number, a time or a digest."""
    return bool(_PART.fullmatch(s) or _STAMP.fullmatch(s) or _HEXRUN.fullmatch(s) and len(s) in DIGESTS)


def is_random(s: str, tokens: int, least: int = LEAST) -> bool:
    """Whether a candidate of so many tokens is a random string and neither digest nor identifier."""
    if len(s) < least or len(s) >= RATIO * tokens:
        return False
    if _UUID.fullmatch(s) or _HEXRUN.fullmatch(s) and len(s) in DIGESTS:
        return False
    return not all(_PART.fullmatch(p) for p in re.split(r"[-+/_.=]+", s))


def random_spans(s: str, count) -> list[tuple[int, int]]:
    """The random strings of a run: all of it, or else those of its parts; count gives a string's tokens."""
    parts = [(m.start(), m.end(), _PART.fullmatch(m[0])) for m in _ALNUM.finditer(s)]
    if all(p for _, _, p in parts):
        return []
    a, b = len(s) - len(s.lstrip("=.-/_+")), len(s.rstrip("=.-/_+"))
    if b - a >= LEAST and is_random(s[a:b], count(s[a:b])):
        return [(a, b)]
    bare = _INNER_UUID.sub(lambda m: " " * len(m[0]), s)
    near: list[list[tuple[int, int]]] = []
    for m in _ALNUM.finditer(bare):
        if not _known(m[0]):
            if near and m.start() - near[-1][-1][1] < APART:
                near[-1].append(m.span())
            else:
                near.append([m.span()])
    found = []
    for group in near:
        a, b = group[0][0], group[-1][1]
        if b - a >= LEAST and is_random(s[a:b], count(s[a:b])):
            found.append((a, b))
        else:
            found += [(a, b) for a, b in group if b - a >= SHORT and is_random(s[a:b], count(s[a:b]), SHORT)]
    return found


class Scanner:
    def __init__(self, path: str, pattern: str):
        self.path, self.pattern = path, pattern

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) by start, then kind."""
        raw = text.encode()
        found = []
        if b":" in raw or b"=" in raw:
            found += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
        if b"AKIA" in raw:
            found += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
        if b"h" * 16 in raw.translate(_TO_HEX):
            found += [("hex", *m.span()) for m in HEX.finditer(text) if m.end() - m.start() >= 16]
        if b"h" * SHORT in raw.translate(_TO_RUN):
            enc = _encoding(self.path, self.pattern)
            for m in _LONG.finditer(text):
                found += [("random", m.start() + a, m.start() + b) for a, b in random_spans(m[0], lambda x: len(enc.encode_ordinary(x)))]
        return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))

    def redact(self, text: str) -> str:
        """The text with each secret replaced by its kind."""
        out, at = [], 0
        for kind, start, end in self.spans(text):
            if end <= at:
                continue
            if start >= at:
                out += [text[at:start], f"<{kind}>"]
            at = end
        return "".join([*out, text[at:]]) if out else text


def default_scanner() -> Scanner:
    import public_tokenizers

    return Scanner(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def find_secrets(df: DataFrame, text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """df's columns but the text, plus secrets: array of (kind, start, end), which replaces a column of that name."""
    s = scanner or default_scanner()
    kind = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def fn(texts):
        return {"secrets": pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s.spans(t)] for t in texts], pa.list_(kind))}

    return map_texts(df.withColumn("__text", text_of(text_col)).drop(text_col), fn, "secrets array<struct<kind:string,start:bigint,end:bigint>>")


def redacted(df: DataFrame, text_col: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """df with secrets in its text replaced; other columns as they are, a null text stays null."""
    s = scanner or default_scanner()

    def fn(texts):
        return {"__clean": pa.array([s.redact(t) for t in texts], pa.string())}

    d = map_texts(packed(df, __text=text_of(text_col)), fn, "__clean string")
    clean = F.when(F.col("__row")[text_col].isNotNull(), F.col("__clean")).alias(text_col)
    return d.select(*[clean if c == text_col else F.col("__row")[c].alias(c) for c in df.columns])


def op3_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of all kinds, counts of the fixed ones, and the digest of the fixed ones."""
    s = default_scanner()

    def fn(texts):
        spans = [s.spans(t) for t in texts]
        base = [[x for x in y if x[0] != "random"] for y in spans]
        told = lambda y: ",".join(f"{k}:{a}:{b}" for k, a, b in y)
        counts = {f"n_{k}": pa.array([sum(x[0] == k for x in y) for y in spans], pa.int64()) for k in KINDS}
        return counts | {"base_sha256": pa.array([sha256(told(y).encode()).hexdigest() for y in base], pa.string()), "spans": pa.array([told(y) for y in spans], pa.string())}

    d = documents(spark, sf_dir).select("doc_id", text_of().alias("__text"))
    return map_texts(d, fn, "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")
