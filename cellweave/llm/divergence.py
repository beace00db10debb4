"""Audit of how sources diverge within a language, by a two-pass vocabulary automaton.

Terms are runs of ASCII letters (in lower case) and of all that isn't ASCII.  The first
pass counts exactly in how many documents of its language each term occurs; terms of
`least` documents and more are kept.  The second pass counts occurrences of kept terms
only: an Aho-Corasick automaton of terms between delimiters reads texts whose
delimiters are all alike.  A vocabulary of at most VOCABULARY_BYTES goes to all workers.
A larger one never meets in one place: texts are dealt in chunks of some megabytes, a chunk's own
terms come from the first pass, those of them that are kept go to the chunk, and its
automaton is made of these.

Counts become sparse postings (language, source, term).  Terms that neither of two sources
has differ alike, so they need a number only; those that one source has are summed by their
probabilities; only terms that both have are met by a join.  Arithmetic is on whole numbers.

Defined cases: null text, language and source are empty strings; a language with no kept
term has a pair's divergence 0 and no terms; repeated rows count as documents each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellweave.llm.common import chunked, documents, meet, slices, stored

#: Documents that a kept term is in at least; terms that are reported of a group (a fixed length of a report).
LEAST_DOCS, TOP_TERMS = 10, 10
#: Counts become parts of this, after PRIOR is added.
SCALE, PRIOR = 1_000_000_000, 2
#: Bytes to bytes: letters in lower case, what isn't ASCII as it is, all else a space.
SPACED = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Counts that a worker holds before they go out; bytes of terms that automata may hold in each worker (some 25 bytes of memory for each).
HELD, VOCABULARY_BYTES = 500_000, 8 << 20


def spaced(texts: pa.Array) -> list[bytes]:
    return [t.translate(SPACED) for t in texts.cast(pa.binary()).to_pylist()]


def _vocabulary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(__chunk, lang, term, df): documents of the chunk and language that hold the term; a chunk may come in several parts."""
    held: dict[tuple, Counter] = {}
    size = 0

    def out():
        for (chunk, lang), terms in held.items():
            terms.pop(b"", None)
            n = len(terms)
            yield pa.RecordBatch.from_pydict({"__chunk": pa.array([chunk] * n, pa.int64()), "lang": pa.array([lang] * n, pa.string()), "term": pa.array(list(terms), pa.binary()).cast(pa.string()), "df": pa.array(list(terms.values()), pa.int64())})
        held.clear()

    last = None
    for batch in batches:
        for chunk, lang, text in zip(batch.column("__chunk").to_pylist(), batch.column("lang").to_pylist(), spaced(batch.column("__text")), strict=True):
            if last is not None and chunk != last or size > HELD:
                yield from out()
                size = 0
            last = chunk
            terms = set(text.split(b" "))
            c = held.setdefault((chunk, lang), Counter())
            size -= len(c)
            c.update(terms)
            size += len(c)
    yield from out()


class Audit:
    """Occurrences by language, source and term, found by one automaton for each language."""

    def __init__(self):
        self.terms: dict[str, list[str]] = {}
        self.automata: dict[str, object] = {}
        self.found: dict[tuple[str, str], Counter] = {}

    def read(self, langs: list[str], sources: list[str], texts: list[bytes]) -> None:
        by: dict[tuple[str, str], list[bytes]] = {}
        for lang, source, text in zip(langs, sources, texts, strict=True):
            if lang in self.terms:
                by.setdefault((lang, source), []).append(text)
        for (lang, source), own in by.items():
            if lang not in self.automata:
                self.automata[lang] = automaton(self.terms[lang])
            # neighbours share a delimiter: matches may overlap in it
            found = self.automata[lang].iter(" " + b" ".join(own).decode() + " ")
            self.found.setdefault((lang, source), Counter()).update(map(itemgetter(1), found))

    def counts(self) -> Iterator[tuple[str, str, Counter]]:
        """(lang, source, occurrences by the term's number in its language), which then are forgotten."""
        found, self.found = self.found, {}
        yield from ((*k, c) for k, c in found.items())


def automaton(terms: list[str]):
    """Finds terms between delimiters; a match's value is the term's number."""
    import ahocorasick

    made = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for i, t in enumerate(terms):
        made.add_word(f" {t} ", i)
    made.make_automaton()
    return made


#: The whole vocabulary's audit, kept by a worker for the tasks of one broadcast.
_WHOLE: dict[int, Audit] = {}


def counted_whole(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, source, term, n) by automata of the whole vocabulary, for one of a checked size: texts aren't shuffled, and tasks send terms as numbers."""
    spark = docs.sparkSession
    words = pa.Table.from_pylist([{"lang": r["lang"], "term": r["term"]} for r in kept.orderBy("lang", "term").collect()], pa.schema([("lang", pa.string()), ("term", pa.string())]))
    words = words.append_column("id", pa.array(range(words.num_rows), pa.int32()))
    vocabulary: dict[str, list[str]] = {}
    first: dict[str, int] = {}
    for i, (lang, term) in enumerate(zip(words.column("lang").to_pylist(), words.column("term").to_pylist(), strict=True)):
        first.setdefault(lang, i)
        vocabulary.setdefault(lang, []).append(term)
    sent = spark.sparkContext.broadcast(vocabulary)
    name = sent._jbroadcast.id()

    def run(batches):
        from cellweave.llm.divergence import _WHOLE

        if name not in _WHOLE:
            _WHOLE.clear()
            _WHOLE[name] = Audit()
            _WHOLE[name].terms = sent.value
        audit = _WHOLE[name]
        audit.found = {}  # of a task that was stopped

        def out():
            for lang, source, c in audit.counts():
                ids = np.fromiter(c.keys(), np.int32, len(c)) + first[lang]
                yield pa.RecordBatch.from_pydict({"source": pa.repeat(pa.scalar(source, pa.string()), len(c)), "id": pa.array(ids, pa.int32()), "n": pa.array(np.fromiter(c.values(), np.int64, len(c)))})

        for batch in batches:
            for part in slices(batch, "__text"):
                audit.read(part.column("lang").to_pylist(), part.column("source").to_pylist(), spaced(part.column("__text")))
                if sum(map(len, audit.found.values())) > HELD:
                    yield from out()
        yield from out()

    counted = docs.mapInArrow(run, "source string, id int, n long").groupBy("source", "id").agg(F.sum("n").alias("n"))
    return counted.join(spark.createDataFrame(words), "id").select("lang", "source", "term", "n")


def counted_by_chunk(docs: DataFrame, least: int) -> DataFrame:
    """The same for a vocabulary of any size: each chunk's automata hold the kept terms that occur in the chunk."""
    docs = chunked(docs)
    local = stored(docs.mapInArrow(_vocabulary, "__chunk long, lang string, term string, df long"))
    kept = local.groupBy("lang", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= least).select("lang", "term")
    entries = local.select("__chunk", "lang", "term").join(kept, ["lang", "term"])

    def run(stream):
        audit = Audit()

        def out():
            for lang, source, c in audit.counts():
                terms = audit.terms[lang]
                same = lambda x: pa.repeat(pa.scalar(x, pa.string()), len(c))  # noqa: B023, E731
                yield pa.RecordBatch.from_pydict({"lang": same(lang), "source": same(source), "term": pa.array([terms[i] for i in c], pa.string()), "n": pa.array(list(c.values()), pa.int64())})

        for new, side, piece in stream:
            if new:
                yield from out()
                audit = Audit()
            if not side:
                e = piece.column("e")
                audit.terms.setdefault(e.field("lang")[0].as_py(), []).extend(e.field("term").to_pylist())
            else:
                for part in slices(pa.RecordBatch.from_struct_array(piece.column("d")), "__text"):
                    audit.read(part.column("lang").to_pylist(), part.column("source").to_pylist(), spaced(part.column("__text")))
        yield from out()

    counted = meet(docs, entries, ["__chunk", "lang"], [], run, "lang string, source string, term string, n long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"))


def share(n: str, total: str = "total") -> Column:
    """1 + floor(SCALE * (n + PRIOR) / (total + PRIOR * vocabulary)), exactly."""
    return F.expr(f"1 + (cast({SCALE} AS decimal(10, 0)) * cast({n} + {PRIOR} AS decimal(20, 0))) div cast({total} + {PRIOR} * vocabulary AS decimal(20, 0))")


def apart(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)) of whole numbers up to SCALE + 1: no step leaves 64 bits."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def divergence(df: DataFrame, lang: str = "lang", source: str = "source", text: str = "text", least: int = LEAST_DOCS, top: int = TOP_TERMS, vocabulary_bytes: int = VOCABULARY_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): part pair has each other source of the language by divergence, part term the `top` terms that the source has more of than the language."""
    said = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))
    docs = df.select(said(lang).alias("lang"), said(source).alias("source"), said(text).alias("__text"))
    local = docs.select(F.lit(0).cast("long").alias("__chunk"), "lang", "__text").mapInArrow(_vocabulary, "__chunk long, lang string, term string, df long")
    kept = stored(local.groupBy("lang", "term").agg(F.sum("df").alias("df")).filter(F.col("df") >= least).select("lang", "term"))
    size = kept.agg(F.coalesce(F.sum(F.octet_length("term") + 1), F.lit(0))).first()[0]
    posts = stored(counted_whole(docs, kept) if size <= vocabulary_bytes else counted_by_chunk(docs, least))

    sizes = kept.groupBy("lang").agg(F.count("*").alias("vocabulary"))
    totals = posts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sizes, "lang", "left").join(totals, ["lang", "source"], "left").fillna(0, ["vocabulary", "total", "terms"])
    groups = groups.withColumn("zero", F.when(F.col("vocabulary") > 0, share("0")).otherwise(0))
    groups = stored(groups.withColumn("lang_total", F.sum("total").over(Window.partitionBy("lang"))))
    known = posts.withColumn("all", F.sum("n").over(Window.partitionBy("lang", "term"))).join(groups, ["lang", "source"])
    known = stored(known.select("lang", "source", "term", "zero", share("n").alias("p"), share("`all`", "lang_total").alias("q")))
    group = Window.partitionBy("lang", "source")

    more = known.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart("p", "q").alias("value"))
    more = more.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item"))).filter(F.col("rank") <= top)

    # a source's terms where the other has none, by their different probabilities
    alone = known.drop("q").groupBy("lang", "source", "p").agg(F.count("*").alias("m"))
    other = groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("q"))
    alone = alone.join(other, "lang").filter("source <> other").groupBy("lang", "source", "other").agg(F.sum(F.col("m") * apart("p", "q")).alias("alone"))
    # terms that both have: what they are apart, instead of what was counted for each alone
    y = known.select("lang", "term", F.col("source").alias("other"), F.col("p").alias("q"), F.col("zero").alias("q0"))
    both = known.select("lang", "term", "source", "p", F.col("zero").alias("p0")).join(y, ["lang", "term"]).filter("source < other")
    both = stored(both.groupBy("lang", "source", "other").agg(F.sum(apart("p", "q") - apart("p", "q0") - apart("p0", "q")).alias("both"), F.count("*").alias("shared")))
    turned = lambda d: d.select("lang", F.col("other").alias("source"), F.col("source").alias("other"), *d.columns[3:])
    alone = stored(alone)
    pairs = groups.join(groups.select("lang", F.col("source").alias("other"), F.col("zero").alias("q0"), F.col("terms").alias("theirs")), "lang").filter("source <> other")
    on = ["lang", "source", "other"]
    pairs = pairs.join(alone, on, "left").join(turned(alone.withColumnRenamed("alone", "back")), on, "left").join(both.unionByName(turned(both)), on, "left").fillna(0, ["alone", "back", "both", "shared"])
    neither = F.expr("vocabulary - terms - theirs + shared") * F.when(F.col("vocabulary") > 0, apart("zero", "q0")).otherwise(0)
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), (F.expr("alone + back + both") + neither).alias("value"))
    pairs = pairs.withColumn("rank", F.row_number().over(group.orderBy(F.desc("value"), "item")))
    return pairs.unionByName(more)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(documents(spark, sf_dir))


ORACLE = r"""
WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
k AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(ts)) AS term FROM d) GROUP BY ALL HAVING count(*) >= 10),
o AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(ts) AS term FROM d) JOIN k USING (lang, term) GROUP BY ALL),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0)::HUGEINT AS t FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN v USING (lang) LEFT JOIN o USING (lang, source) GROUP BY ALL),
p AS (SELECT g.lang, g.source, k.term, coalesce(n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(n, 0) + 2)) // (t + 2 * v) AS p FROM g JOIN k ON k.lang = g.lang LEFT JOIN o ON o.lang = g.lang AND o.source = g.source AND o.term = k.term),
l AS (SELECT lang, term, n, sum(n) OVER (PARTITION BY lang) AS t FROM (SELECT lang, term, sum(n) AS n FROM p GROUP BY lang, term)),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2))::HUGEINT // (t::HUGEINT + 2 * v) AS q FROM l JOIN v USING (lang)),
pr AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)), 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN p x ON x.lang = a.lang AND x.source = a.source LEFT JOIN p y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
te AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pr UNION ALL SELECT lang, source, 'term' AS part, item, value FROM te)
SELECT lang, source, part, item, value, rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM r) WHERE part = 'pair' OR rank <= 10
"""
