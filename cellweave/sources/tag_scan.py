"""Geometry of documents of any form, read tag by tag over chunks of bytes.

A document's content is dealt as numbered chunks to a table function, one document to
a call, which carries what a chunk leaves open to the next: no task holds a document's
tree or text, only the chunk at hand and at most one tag.  Points come out as they are
met; what is wrong with the document comes as one more row, with an error.

Comments and character data are passed over, quoted values may hold ">".  Errors: an
empty document, one over 64 MiB, one whose first element isn't the root that is expected,
document types and entities, a tag over 2 MiB, a comment, character data or tag that
doesn't end, more than 500,000 points, and none.  After an error nothing of the document follows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from xml.sax.saxutils import unescape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: Bytes of a tag and of a document, points of a document, characters of a kind.
TAG_BYTES, DOCUMENT_BYTES, POINTS, KIND = 2 << 20, 64 << 20, 500_000, 80
ROOT = "vehicle"
CHUNK = 64 << 10
_WHOLE = re.compile(rb"<[^\"'>]*+(?:(?:\"[^\"]*+\"|'[^']*+')[^\"'>]*+)*+>")
_NAME = re.compile(rb"<(/?)\s*(?:[\w.-]*:)?([A-Za-z_][\w.-]*)")
_VALUES = re.compile(rb"(?<![^\s\"'])(?:[\w.-]*:)?([A-Za-z_][\w.-]*)\s*=\s*(?:\"([^\"]*)\"|'([^']*)')")
_TYPES = re.compile(rb"<!\s*(?:DOCTYPE|ENTITY)\b", re.I)
#: What begins and ends a part that holds no tags.
_PASSED = {b"<!--": b"-->", b"<![CDATA[": b"]]>"}
_SAID = {b"-->": "comment", b"]]>": "character data"}


class Tags:
    """Whole tags out of pieces of bytes."""

    def __init__(self):
        self.held, self.until = b"", b""

    def feed(self, data: bytes) -> Iterator[bytes]:
        data, at = self.held + data, 0
        self.held = b""
        while at < len(data):
            if self.until:
                end = data.find(self.until, at)
                if end < 0:
                    self.held = data[max(at, len(data) - 2) :]
                    return
                at, self.until = end + 3, b""
                continue
            at = data.find(b"<", at)
            if at < 0:
                return
            head = data[at : at + 9]
            opened = next((o for o in _PASSED if head.startswith(o)), None)
            if opened:
                at, self.until = at + len(opened), _PASSED[opened]
                continue
            whole = None if any(o.startswith(head) for o in _PASSED) else _WHOLE.match(data, at)
            if (whole.end() if whole else len(data)) - at > TAG_BYTES:
                raise ValueError("a tag is over 2 MiB")
            if whole is None:
                self.held = data[at:]
                return
            yield whole[0]
            at = whole.end()

    def close(self) -> None:
        if self.until:
            raise ValueError(f"{_SAID[self.until]} without an end")
        if self.held:
            raise ValueError("a tag without an end")


class Points:
    """(idx, x, y, z, kind) of a document's tags: each place is one of the innermost open component."""

    def __init__(self):
        self.open: list[str] = []
        self.n, self.started = 0, False

    def of(self, tag: bytes) -> tuple | None:
        if tag[1:2] in (b"?", b"!"):
            if _TYPES.match(tag):
                raise ValueError("DTDs and entities are refused")
            return None
        m = _NAME.match(tag)
        if m is None:
            return None
        closing, name = bool(m[1]), m[2].lower().decode()
        if not self.started and (closing or name != ROOT):
            raise ValueError(f"root element is not {ROOT}")
        self.started = True
        if name == "c" and closing:
            if self.open:
                self.open.pop()
        elif name == "c" and not tag.endswith(b"/>"):
            value = self.values(tag)
            self.open.append(next((value[a] for a in ("d", "type", "t") if value.get(a)), "")[:KIND].casefold())
        elif name == "vp" and not closing and self.open:
            value = self.values(tag)
            try:
                at = tuple(int(value[a]) for a in "xyz")
            except (KeyError, ValueError):
                return None
            self.n += 1
            if self.n > POINTS:
                raise ValueError("more than 500,000 points")
            return self.n - 1, *at, self.open[-1]
        return None

    @staticmethod
    def values(tag: bytes) -> dict[str, str]:
        return {k.decode(): unescape((a or b).decode("utf-8", "replace"), {"&quot;": '"', "&apos;": "'"}) for k, a, b in _VALUES.findall(tag)}

    def close(self) -> None:
        if not self.started:
            raise ValueError(f"root element is not {ROOT}")
        if not self.n:
            raise ValueError("no points")


@udtf(returnType="doc_id string, idx long, x long, y long, z long, kind string, error string")
class ScanTags:
    def __init__(self):
        self.tags, self.points, self.size, self.key, self.error = Tags(), Points(), 0, None, None

    def eval(self, row):
        self.key = row["doc_id"]
        if self.error is None:
            try:
                chunk = row["chunk"] or b""
                self.size += len(chunk)
                if self.size > DOCUMENT_BYTES:
                    raise ValueError("file is over 64 MiB")
                for tag in self.tags.feed(bytes(chunk)):
                    if (p := self.points.of(tag)) is not None:
                        yield self.key, *p, None
            except ValueError as e:
                self.error = str(e)

    def terminate(self):
        if self.error is None:
            try:
                if not self.size:
                    raise ValueError("empty file")
                self.tags.close()
                self.points.close()
            except ValueError as e:
                self.error = str(e)
        if self.error is not None:
            yield self.key, None, None, None, None, None, self.error


def chunks(files: DataFrame, key: str = "path", size: int = CHUNK) -> DataFrame:
    """(doc_id, n, chunk) of files (key, content); an empty or null content is one empty chunk."""
    content = F.coalesce(F.col("content"), F.lit(b""))
    d = files.select(F.col(key).cast("string").alias("doc_id"), content.alias("content"), F.explode(F.sequence(F.lit(0), F.floor(F.greatest(F.octet_length(content) - 1, F.lit(0)) / size).cast("int"))).alias("n"))
    return d.select("doc_id", "n", F.substr("content", F.col("n") * size + 1, F.lit(size)).alias("chunk"))


def geometry(files: DataFrame, key: str = "path", size: int = CHUNK) -> DataFrame:
    """(doc_id, idx, x, y, z, kind, category, error): the points of each document in their order, and a row with an error where it isn't whole."""
    from cellweave.functions.text import category

    d = ScanTags(chunks(files, key, size).asTable().partitionBy("doc_id").orderBy("n"))
    return d.withColumn("category", category(F.col("kind")))
