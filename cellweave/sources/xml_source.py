"""XML documents of placed components: scan, sniff, repair, parse, rows.

Parsing is the one step that Spark's readers can't do, since files may hold attributes
with numbers as names or twice in a tag.  It runs once for a file in an Arrow UDF and
gives rows; all features are then made of rows by DataFrame operators.
"""

from __future__ import annotations

import json
import re
import xml.etree.ElementTree as ET
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellweave.functions.text import plain_decimal

#: Limits on a file.
MAX_BYTES, MAX_COMPONENTS = 64 << 20, 500_000
#: Attributes that don't count, and elements with channels of their own.
IGNORED = frozenset(
    "id unique_id name username steam_id data_version bodies_id sc bc ac color colour paint custom_name description created modified id_counter id_counter_node component_id built_slot_index transform_index".split()
)
OLD_IGNORED = frozenset("id unique_id name username steam_id data_version bodies_id sc color colour paint created modified".split())
SEPARATE = frozenset("microprocessor_definition logic_slots logic_node_links logic_node_link".split())
MICRO_IGNORED = IGNORED - {"steam_id", "bodies_id", "custom_name", "description", "transform_index"}

_INPUT = re.compile(r"in\d+")
_ATTRIBUTE = re.compile(rb"(\s+)([^\s=/>]+)(\s*=\s*(?:\"[^\"]*\"|'[^']*'))", re.S)
_PIECE = re.compile(rb"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|</[^>]*>?|<[!?](?:[^>\"']|\"[^\"]*\"|'[^']*')*>?|<(?:[^>\"']|\"[^\"]*\"|'[^']*')*>?", re.S)

ROWS = "kind string, body int, ord long, x long, y long, z long, sig string, type string, x1 long, y1 long, z1 long, def_id int, node_id int, port string, slot string, source int, mode string, flags string, text string"


def scan(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, path, mtime, size, content) of all XML files below root; item_id is the first folder below it, or local."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xml").option("recursiveFileLookup", "true").load(root)
    base = re.escape(root.rstrip("/").rsplit("/", 1)[-1])
    below = F.regexp_extract("path", rf"/{base}/(.*)$", 1)
    return files.select(F.when(below.contains("/"), F.substring_index(below, "/", 1)).otherwise("local").alias("item_id"), "path", F.col("modificationTime").alias("mtime"), F.col("length").alias("size"), "content")


def sniffed(text: Column) -> Column:
    """Whether the first 4096 characters open the root element."""
    return F.substring(text, 1, 4096).rlike(r"<vehicle(?=[\s/>])")


def repaired(data: bytes) -> bytes:
    """Legal attribute names: numbered ones get a prefix, repeated ones a number."""

    def tag(m: re.Match) -> bytes:
        piece = m[0]
        if piece[:2] in (b"</", b"<!", b"<?"):
            return piece
        seen: set[bytes] = set()

        def name(a: re.Match) -> bytes:
            first = now = b"sw_" + a[2] if a[2][:1].isdigit() else a[2]
            k = 1
            while now in seen:
                k += 1
                now = first + b"__dup%d" % k
            seen.add(now)
            return a[1] + now + a[3]

        return _ATTRIBUTE.sub(name, piece)

    return _PIECE.sub(tag, data)


def parsed(data: bytes) -> ET.Element:
    if len(data) > MAX_BYTES:
        raise ValueError("file is over 64 MiB")
    if re.search(rb"<!\s*(?:DOCTYPE|ENTITY)\b", data, re.I):
        raise ValueError("DTDs and entities are refused")
    try:
        root = ET.fromstring(data)
    except ET.ParseError:
        try:
            root = ET.fromstring(repaired(data))
        except ET.ParseError as e:
            raise ValueError(f"not XML: {e}") from e
    if local(root.tag) != "vehicle":
        raise ValueError("root element is not vehicle")
    return root


def local(tag: str) -> str:
    return tag[tag.rfind("}") + 1 :]


def short(text: str) -> str:
    return sha256(text.encode()).hexdigest()[:24]


def collapsed(text: str | None) -> str:
    return " ".join((text or "").split())


def content_key(node: ET.Element, old: bool = False) -> str:
    """Canonical text of a component without place and looks."""
    skip = OLD_IGNORED if old else IGNORED
    attrs = [(local(k) if not old else k, v) for k, v in node.attrib.items()]
    attrs = sorted((k, v if old else plain_decimal(v, k)) for k, v in attrs if k not in skip and k not in ("x", "y", "z"))
    inner = sorted(content_key(c, old) for c in node if local(c.tag) != "vp" and (old or local(c.tag) not in SEPARATE))
    text = collapsed(node.text)
    return json.dumps((local(node.tag), attrs, short(text) if len(text) > 128 else text, inner), separators=(",", ":"))


def place(node: ET.Element | None) -> tuple[int, int, int] | None:
    if node is None:
        return None
    try:
        return int(node.get("x", "")), int(node.get("y", "")), int(node.get("z", ""))
    except ValueError:
        return None


def object_key(node: ET.Element, depth: int = 0) -> tuple:
    """Canonical properties of a controller's node: fields in any order, repeated ones in theirs; wiring and layout left out."""
    if depth > 64:
        raise ValueError("controller is nested too deep")
    script = lambda s: short("lua:" + s.replace("\r\n", "\n").strip())
    attrs = sorted((k, script(v) if k == "script" else v) for k, v in node.attrib.items() if k not in MICRO_IGNORED and not k.startswith("sym"))
    fields: dict[str, list] = {}
    for c in node:
        if c.tag in ("pos", "position") or c.tag.startswith("out") or _INPUT.fullmatch(c.tag):
            continue
        fields.setdefault(c.tag, []).append(object_key(c, depth + 1))
    return node.tag, attrs, script(node.text or "") if node.tag in ("script", "lua") else collapsed(node.text), sorted(fields.items())


def rows_of(data: bytes, old: bool = False) -> list[dict]:
    """Cells, placed kinds, links, controllers' nodes, edges, ports and scripts of a document."""
    root, out, n = parsed(data), [], 0
    bodies = [root] if old else [b for b in root.iter() if local(b.tag) == "body"] or [root]
    for b, body in enumerate(bodies):
        for c in body.iter():
            if local(c.tag) == "c" and (at := place(next((v for v in c.iter() if local(v.tag) == "vp"), None))):
                n += 1
                if n > MAX_COMPONENTS:
                    raise ValueError("document has too many components")
                out.append({"kind": "cell", "body": b, "ord": n, "x": at[0], "y": at[1], "z": at[2], "sig": short(content_key(c, old))})
    defs: list[tuple[ET.Element, tuple | None]] = []
    owned = set()
    for c in root.iter("c"):
        if (at := place(c.find(".//vp"))) and c.get("d") is not None:
            out.append({"kind": "placed", "ord": len(out), "x": at[0], "y": at[1], "z": at[2], "type": c.get("d")})
            for d in c.iter("microprocessor_definition"):
                defs.append((d, at))
                owned.add(d)
    defs += [(d, None) for d in root.iter("microprocessor_definition") if d not in owned]
    for k, link in enumerate(root.iter("logic_node_link")):
        a, b = place(link.find("voxel_pos_0")), place(link.find("voxel_pos_1"))
        if a and b:
            out.append({"kind": "link", "ord": k, "type": link.get("type", ""), "x": a[0], "y": a[1], "z": a[2], "x1": b[0], "y1": b[1], "z1": b[2]})
    for k, (d, at) in enumerate(defs):
        spot = dict(zip("xyz", at or (None,) * 3, strict=True))
        objects = [c.find("object") for c in d.iter("c")]
        known = {o.get("id"): i for i, o in enumerate(objects) if o is not None and o.get("id") is not None}
        for i, (c, o) in enumerate(zip(d.iter("c"), objects, strict=True)):
            base = short("node:" + json.dumps((c.get("type", ""), object_key(o) if o is not None else None), separators=(",", ":"), sort_keys=True, ensure_ascii=False))
            out.append({"kind": "node", "def_id": k, "node_id": i, "sig": base, **spot})
            if o is None:
                continue
            if o.get("script"):
                out.append({"kind": "script", "def_id": k, "text": o.get("script"), **spot})
            for e in o:
                if _INPUT.fullmatch(e.tag) and (source := known.get(e.get("component_id"))) is not None:
                    out.append({"kind": "edge", "def_id": k, "node_id": i, "port": e.tag, "slot": e.get("node_index", ""), "source": source})
        for p in d.findall("./nodes/n"):
            if (q := p.find("node")) is not None:
                out.append({"kind": "port", "def_id": k, "slot": p.get("built_slot_index", ""), "mode": q.get("mode", ""), "type": q.get("type", ""), "flags": q.get("flags", ""), "node_id": known.get(p.get("component_id"))})
    return out


def parse_rows(files: DataFrame, key: str = "path", old: bool = False) -> DataFrame:
    """(doc_id, error, rows...): one row for each part of each document; a document that can't be read gives one row with its error."""
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    fields = [tuple(f.strip().split(" ")) for f in f"doc_id string, error string, {ROWS}".split(",")]
    schema = pa.schema([(name, types[t]) for name, t in fields])

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(key).to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    got = [{"doc_id": k, **r} for r in rows_of(data, old)]
                except ValueError as e:
                    got = [{"doc_id": k, "error": str(e)}]
                yield pa.RecordBatch.from_pylist(got, schema)

    return files.select(key, "content").mapInArrow(run, f"doc_id string, error string, {ROWS}")


def cells(rows: DataFrame) -> DataFrame:
    return rows.filter("kind = 'cell'").select("doc_id", "body", "x", "y", "z", "sig", "ord")


def semantic_features(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Logic and controller features (doc_id, hash, cnt, x, y, z)."""
    from cellweave.operators import semantics as s

    links = rows.filter("kind = 'link'").select("doc_id", "type", "ord", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0"), "x1", "y1", "z1")
    placed = rows.filter("kind = 'placed'").select("doc_id", "x", "y", "z", F.col("type").alias("kind"))
    nodes = rows.filter("kind = 'node'").select("doc_id", "def_id", "node_id", F.col("sig").alias("base"))
    edges = rows.filter("kind = 'edge'").select("doc_id", "def_id", F.col("node_id").alias("target"), "port", "slot", "source")
    ports = rows.filter("kind = 'port'").select("doc_id", "def_id", "slot", "mode", "type", "flags", "node_id")
    scripts = rows.filter("kind = 'script'").select("doc_id", "def_id", F.col("text").alias("script"))
    found = s.graph_features(s.refined_labels(nodes, edges), edges, ports).union(s.script_features(scripts))
    at = rows.filter("kind = 'node'").groupBy("doc_id", "def_id").agg(F.first("x").alias("x"), F.first("y").alias("y"), F.first("z").alias("z"))
    micro = found.join(at, ["doc_id", "def_id"]).groupBy("doc_id", "hash").agg(F.count("*").alias("cnt"), F.min_by(F.struct("x", "y", "z"), "def_id").alias("at"))
    return s.logic_features(links, placed), micro.select("doc_id", "hash", "cnt", "at.x", "at.y", "at.z")


def points_of(data: bytes, key: str) -> list[tuple]:
    """(key, idx, x, y, z, kind) of a document's places; a document that can't be read to its end raises ValueError."""
    parser = ET.XMLPullParser(("start", "end"))
    out: list[tuple] = []
    open_: list[str] = []
    try:
        parser.feed(repaired(data))
        for event, e in parser.read_events():
            tag = local(e.tag).lower()
            if tag == "c" and event == "start":
                open_.append(next((e.get(a) for a in ("d", "type", "t") if e.get(a)), "")[:80].casefold())
            elif tag == "c":
                open_.pop()
            elif tag == "vp" and event == "start" and open_ and (at := place(e)):
                out.append((key, len(out), *at, open_[-1]))
        parser.close()
    except ET.ParseError as e:
        raise ValueError(f"{key}: {e}") from e
    return out


def geometry(files: DataFrame, key: str = "path") -> DataFrame:
    """(doc_id, idx, x, y, z, category, kind, error): a point for every place of every component, in document order; a document that can't be read gives one row with its error."""
    from cellweave.functions.text import category

    schema = pa.schema([("doc_id", pa.string()), ("idx", pa.int64()), ("x", pa.int64()), ("y", pa.int64()), ("z", pa.int64()), ("kind", pa.string()), ("error", pa.string())])

    def run(batches):
        for batch in batches:
            for k, data in zip(batch.column(key).to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    points = [(*p, None) for p in points_of(data, k)]
                except ValueError as e:
                    points = [(k, None, None, None, None, None, str(e))]
                cols = list(zip(*points, strict=True)) or [()] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, schema.types, strict=True)], schema=schema)

    d = files.select(key, "content").mapInArrow(run, "doc_id string, idx long, x long, y long, z long, kind string, error string")
    return d.withColumn("category", category(F.col("kind")))
