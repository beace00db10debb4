"""Operators against brute force on small inputs, and what must not change them."""

import random
from collections import Counter, defaultdict
from hashlib import sha256

from pyspark.sql import functions as F

from cellweave.operators import catalog, grid, overlay, postings, rank, search, sketch

CELLS = "doc_id string, body int, x long, y long, z long, sig string, ord long"


def short(s):
    return sha256(s.encode()).hexdigest()[:24]


def cells(spark, places, doc="a", body=0):
    return spark.createDataFrame([(doc, body, x, y, z, short(k), i) for i, (x, y, z, k) in enumerate(places)], CELLS)


def bag(df):
    return {r["hash"]: r["cnt"] for r in df.collect()}


def rightmost(hashes, w):
    """Winnowing by its definition."""
    n = len(hashes)
    spans = [range(n)] if n < w else [range(i, i + w) for i in range(n - w + 1)]
    return sorted({min(s, key=lambda i: (hashes[i], -i)) for s in spans}) if n else []


def test_winnow_definition(spark):
    r = random.Random(5)
    places = [(x, y, 0, r.choice("abc")) for y in range(6) for x in range(r.randint(1, 14))]
    got = bag(grid.winnow_features(cells(spark, places), axes=("x",)))
    want, rows = Counter(), defaultdict(list)
    for x, y, _, k in places:
        rows[y].append(short(grid.DOMAIN + "cell\0[\"" + short(k) + "\"]"))
    for t in rows.values():
        grams = [short(grid.DOMAIN + "x\0[" + ",".join(f'"{v}"' for v in t[i : i + 5]) + "]") for i in range(len(t) - 4)]
        want.update(grams[i] for i in rightmost(grams, 4))
    assert got == dict(want)


def test_shift_and_order_do_not_matter(spark):
    r = random.Random(2)
    places = [(r.randrange(5), r.randrange(5), r.randrange(5), r.choice("abcd")) for _ in range(200)]
    moved = [(x + 7, y - 3, z + 100, k) for x, y, z, k in places]
    r.shuffle(moved)
    for make in (grid.neighbourhood_features, grid.winnow_features):
        a, b = bag(make(cells(spark, places))), bag(make(cells(spark, moved)))
        assert a == b and a
    two = cells(spark, places).union(cells(spark, places, body=1))
    assert bag(grid.neighbourhood_features(two)) == {h: 2 * n for h, n in bag(grid.neighbourhood_features(cells(spark, places))).items()}


def test_neighbourhoods_by_brute_force(spark):
    r = random.Random(8)
    places = [(r.randrange(4), r.randrange(4), r.randrange(2), r.choice("ab")) for _ in range(25)]
    want = Counter()
    for x, y, z, k in places:
        near = sorted((a - x, b - y, c - z, short(m)) for a, b, c, m in places if 0 < abs(a - x) + abs(b - y) + abs(c - z) <= 2)
        if len(near) >= 2:
            want[short(f'["{short(k)}",[' + ",".join(f'[{a},{b},{c},"{m}"]' for a, b, c, m in near) + "]]")] += 1
    assert bag(grid.neighbourhood_features(cells(spark, places))) == dict(want)


def test_gap_breaks_runs(spark):
    line = [(x, 0, 0, str(x)) for x in (0, 1, 2, 4, 5, 6)]
    assert grid.winnow_features(cells(spark, line), axes=("x",)).count() == 0
    assert {(r["first"], r["cells"]) for r in grid.run_lengths(grid.cell_tokens(cells(spark, line)), ("x",)).collect()} == {(0, 3), (4, 3)}


def test_sample_sizes(spark):
    f = spark.range(20_000).select(F.lit("a").alias("doc_id"), F.lit("g").alias("channel"), F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    assert postings.bottom_k(f).count() == 2000
    assert postings.bottom_k(f.limit(600).withColumn("channel", F.lit("m"))).count() == 128
    got = spark.range(1).select(*[postings.frequency_cutoff(n) for n in (40, 10_000, 10**6)]).first()
    assert tuple(got) == (32, 200, 2000)


def test_crowded_postings_give_no_candidates(spark):
    p = spark.range(40).select(F.col("id").alias("doc_id"), F.lit("g").alias("channel"), F.lit("h").alias("hash"))
    q = spark.createDataFrame([("q", "g", "h")], "query_id string, channel string, hash string")
    assert search.posting_votes(q, p, 40).count() == 0
    assert search.posting_votes(q, p.limit(30), 40).count() == 30
    assert search.posting_votes(q, p.limit(30), 40, budget=29).count() == 0


def test_top_candidates_and_turns(spark):
    v = spark.createDataFrame([("q", d, 1.0) for d in range(5)] + [("q", 4, 0.5)], "query_id string, doc_id long, votes double")
    assert [r["doc_id"] for r in search.top_candidates(v, 3).orderBy("rank").collect()] == [4, 0, 1]
    p = spark.createDataFrame([("q", c, c + str(i)) for c in "gw" for i in range(2)] + [("q", "m", "m0")], "query_id string, channel string, hash string")
    assert [r["hash"] for r in search.interleaved(p).orderBy("place").collect()] == ["g0", "w0", "m0", "g1", "w1"]


def test_clusters(spark):
    line = {(i, 0, 0) for i in range(12)}
    far = {(10 * i, 0, 0) for i in range(12)}
    assert rank.largest_cluster_of(line) == 12 and rank.largest_cluster_of(far) == 1 and rank.largest_cluster_of(set()) == 0
    assert rank.largest_cluster_of({(0, 0, 0), (2, 1, 0)}) == 2 and rank.largest_cluster_of({(0, 0, 0), (2, 2, 0)}) == 1
    rows = [("q", 1, x, 0, 0, x + 5, 1, 1) for x in range(12)] + [("q", 1, x, 0, 0, 3 * x, 9, 9) for x in range(30, 40)]
    a = spark.createDataFrame(rows, "query_id string, doc_id int, qx int, qy int, qz int, dx int, dy int, dz int")
    assert rank.aligned_cluster(a).first()["cluster"] == 12


def test_overlay(spark):
    schema = "pair_id int, idx int, x int, y int, z int, kind string"
    left = spark.createDataFrame([(1, i, i, 0, 0, "a") for i in range(6)] + [(1, 6, 6, 0, 0, "b"), (1, 7, 50, 0, 0, "a")], schema)
    right = spark.createDataFrame([(1, i, i, 0, 0, "a") for i in range(6)] + [(1, 6, 6, 0, 0, "c"), (1, 7, 0, 0, 0, "a")], schema)
    got = overlay.labels(left, right)
    n = {(r["side"], r["label"]): r["count"] for r in got.groupBy("side", "label").count().collect()}
    assert n == {("input", "matched"): 6, ("match", "matched"): 6, ("input", "changed"): 1, ("match", "changed"): 1, ("input", "unmatched"): 1, ("match", "unmatched"): 1}
    none = spark.createDataFrame([], "pair_id int")
    assert overlay.accepted(got, none).first()["verified"] is False
    assert overlay.accepted(got, spark.createDataFrame([(1,)], "pair_id int")).first()["verified"] is True
    same = overlay.extent_offset(left.filter("idx < 6"), right.filter("idx < 6").withColumn("x", F.col("x") + 3))
    assert tuple(same.first()) == (1, -3, 0, 0)


def test_offset_tie_gives_none(spark):
    schema = "pair_id int, channel string, qx int, qy int, qz int, mx int, my int, mz int"
    two = [(1, "geometry", i, 0, 0, i + s, 0, 0) for s in (1, 5) for i in range(3)]
    assert overlay.offset_votes(spark.createDataFrame(two, schema)).count() == 0
    assert tuple(overlay.offset_votes(spark.createDataFrame(two + [(1, "winnowing", 9, 0, 0, 10, 0, 0)], schema)).first()) == (1, -1, 0, 0)


def test_estimate_of_nothing(spark):
    d = spark.createDataFrame([([sketch.PRIME] * 64, [sketch.PRIME] * 64), ([sketch.PRIME] * 64, [1] * 64), ([1] * 32 + [2] * 32, [1] * 64)], "a array<bigint>, b array<bigint>")
    assert [r[0] for r in d.select(sketch.estimate(F.col("a"), F.col("b"))).collect()] == [1.0, 0.0, 0.5]


def test_upsert_rules(spark):
    items = spark.createDataFrame([("1", "old", 100, 5, 100, 0, 50), ("2", "b", 10, None, 0, 0, 9)], "id string, title string, updated long, size_bytes long, downloaded long, retry_after long, tag_checked long")
    batch = spark.createDataFrame([("1", None, 200, None, 1), ("3", "new", None, 7, 2), ("2", "c", 5, 8, 3)], "id string, title string, updated long, size_bytes long, seq long")
    got = {r["id"]: r for r in catalog.upserted(items, batch).collect()}
    assert (got["1"]["title"], got["1"]["updated"], got["1"]["size_bytes"], got["1"]["tag_checked"]) == ("old", 200, 5, 0)
    assert (got["2"]["title"], got["2"]["updated"], got["2"]["size_bytes"], got["2"]["tag_checked"]) == ("c", 10, 8, 9)
    assert got["3"]["updated"] == 0


def test_unknown_tags_are_not_absent(spark):
    items = spark.createDataFrame([("1", 0), ("2", 10**9)], "id string, tag_checked long")
    tags = spark.createDataFrame([("9", "x", "x")], "item_id string, tag string, tag_key string")
    assert [r["id"] for r in catalog.with_tags(items, tags, excluded=["Air"], now=10**9).collect()] == ["2"]


def test_queue_order(spark):
    rows = [("300", 5, 0, 1), ("200", None, 0, 1), ("400", 9, 0, 1), ("x", 1, 0, 1), ("100", 1, 99, 1)]
    items = spark.createDataFrame(rows, "id string, size_bytes long, retry_after long, updated long").withColumn("downloaded", F.lit(0))
    assert [r["id"] for r in catalog.queue(items, 50).collect()] == ["300", "400", "200"]


def test_bags_in_place_are_the_winnowing_features_of_the_grid(spark):
    """Repeats within and across lines, lines under the window, none at all, and a bag that is sampled."""
    docs = spark.createDataFrame([(1, "a b c d e f a b c d e f g\n\na b c d e\nx y"), (2, None), (3, "one two three four"), (4, " ".join(f"w{i}" for i in range(3000))), (5, "Ä b c d e " * 9)], "doc_id long, text string")
    whole = grid.text_bags(docs)
    rows = lambda d: sorted(map(tuple, d.select("doc_id", "hash", "cnt", "x", "y", "z").collect()))
    assert rows(grid.bag_rows(whole)) == rows(grid.winnow_features(grid.document_grid(docs), axes=("x",)))
    kinds = lambda d: sorted(map(tuple, d.select("doc_id", "kind", "cnt").collect()))
    assert kinds(grid.text_types(docs)) == kinds(grid.component_types(grid.document_grid(docs)))
    posts = lambda d: sorted(map(tuple, d.select("doc_id", "channel", "hash").collect()))
    assert posts(postings.bottom_k_of_bags(whole, "w")) == posts(postings.bottom_k(grid.bag_rows(whole).withColumn("channel", F.lit("w"))))
    assert "Exchange" not in grid.bag_rows(whole)._jdf.queryExecution().executedPlan().toString()


def test_features_in_place_are_those_of_the_grid(spark):
    """Both channels, their samples and signatures; two texts that lie next to each other don't become neighbours."""
    from cellweave.plans import scan

    docs = spark.createDataFrame([(1, "a b c d e f a b c d e f g\n\na b c d e\nx y"), (2, None), (3, "one two three four"), (4, " ".join(f"w{i}" for i in range(3000))), (5, "Ä b c d e " * 9)], "doc_id long, text string")
    made = grid.text_features(docs, {c: postings.Sample(c) for c in "gw"})
    want = scan.text_features(docs)
    rows = lambda d, *c: sorted(map(tuple, d.select("doc_id", "channel", "hash", *c).collect()))
    assert rows(made.filter("hash IS NOT NULL"), "cnt", "x", "y", "z") == rows(want, "cnt", "x", "y", "z")
    assert rows(made.filter("sampled")) == rows(postings.bottom_k(want))
    signed = lambda d: sorted((r["doc_id"], tuple(r["sig"])) for r in d.select("doc_id", "sig").collect())
    assert signed(made.filter("sig IS NOT NULL")) == signed(sketch.signatures(want.select("doc_id", F.concat_ws(":", "channel", "hash").alias("token"))))


def test_a_scan_of_known_queries_writes_less_than_it_reads(spark, small):
    """The rows of its queries only: an index of all features is several times the texts."""
    import os

    from cellweave.queries import QUERIES
    from cellweave.sources.store import checkpoint_dir

    held = lambda: sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(checkpoint_dir(spark)) for name in names)
    before = held()
    assert QUERIES["scan_report"](spark, small).count() > 0
    assert held() - before < 2 * os.path.getsize(f"{small}/documents.parquet")


def test_queries_on_passages_read_documents_once(spark, small):
    """What is left of a plan reads rows that were written, not texts a second time."""
    from cellweave.queries import QUERIES

    for name in ("matched_data", "directional_containment", "rare_shared_counts", "evidence_topn", "aligned_cluster"):
        assert not any("documents.parquet" in f for f in QUERIES[name](spark, small).inputFiles()), name


def test_pairs_of_copies_by_classes(spark):
    banded = spark.createDataFrame([(1, "p"), (1, "q"), (2, "p"), (2, "q"), (3, "p"), (4, "q"), (4, "r")], "doc_id long, bucket string")
    classes = banded.filter("doc_id <> 2").withColumnRenamed("doc_id", "rep").withColumn("size", F.when(F.col("rep") == 1, 2).otherwise(1))
    members = spark.createDataFrame([(1, 1), (1, 2), (3, 3), (4, 4)], "rep long, doc_id long")
    for cutoff in (None, 3, 2):
        want = sorted(map(tuple, sketch.candidate_pairs(banded, cutoff=cutoff).collect()))
        assert sorted(map(tuple, sketch.expanded(sketch.class_pairs(classes, cutoff), members).select("a", "b", "shared").collect())) == want


def test_sketches_in_place_are_those_of_the_features(spark):
    """Repeats, copies, a text without features, one of many, and none; a bag's features in order are its set."""
    texts = ["a b c d e f a b c d e f g\n\na b c d e\nx y", None, "one two three four", " ".join(f"w{i}" for i in range(3000)), "Ä b c d e " * 9, "a b c d e f a b c d e f g\n\na b c d e\nx y"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bags = grid.text_bags(docs)
    made = grid.text_sketches(docs, tokens=True)
    got = {r["doc_id"]: r for r in made.collect()}
    want = sketch.signatures(grid.bag_rows(bags).withColumnRenamed("hash", "token"))
    assert {k: tuple(r["sig"]) for k, r in got.items()} == {r["doc_id"]: tuple(r["sig"]) for r in want.collect()} and set(got) == {0, 3, 4, 5}
    assert {k: [t.hex() for t in r["tokens"]] for k, r in got.items()} == {r["doc_id"]: [f["hash"] for f in r["bag"]] for r in bags.collect() if r["bag"]}
    assert got[0]["set"] == got[5]["set"] and len({bytes(r["set"]) for r in got.values()}) == 3
    keys = {(r["doc_id"], bytes(k)) for r in made.select("doc_id", sketch.bucket_keys("sig").alias("keys")).collect() for k in r["keys"]}
    assert keys == {(r["doc_id"], bytes.fromhex(r["bucket"].replace(":", ""))) for r in sketch.bands(want).collect()}


def test_bands_of_documents_shuffle_nothing(spark, small):
    from cellweave.queries import QUERIES

    assert "Exchange" not in QUERIES["lsh_bands"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_votes_of_buckets_deal_no_documents(spark, small, monkeypatch):
    """Documents' buckets are made where their texts lie; only those that passages have are written."""
    from cellweave import queries

    plans = []
    monkeypatch.setattr(queries, "stored", lambda df, *how, to=queries.stored: plans.append(df._jdf.queryExecution().executedPlan().toString()) or to(df, *how))
    queries.QUERIES["lsh_votes"](spark, small)
    mine = [p for p in plans if "documents.parquet" in p]
    assert mine and not any("hashpartitioning(doc_id" in p for p in mine)


def test_candidate_pairs_keep_less_than_a_quarter_of_the_texts(spark, small):
    """Buckets of documents and of classes, no features: those take more room than the texts."""
    import os

    import pyarrow.parquet as pq

    from cellweave.queries import QUERIES
    from cellweave.sources.store import checkpoint_dir

    held = lambda: sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(checkpoint_dir(spark)) for name in names if name.endswith(".parquet"))
    before = held()
    assert QUERIES["lsh_candidate_pairs"](spark, small).count() > 0
    assert held() - before < sum(map(len, pq.read_table(f"{small}/documents.parquet", columns=["text"]).column(0).cast("binary").to_pylist())) / 4


def test_frequencies_deal_terms_once(spark, small):
    """One exchange, of counted terms, and nothing is kept: no cells, runs or grams."""
    import os

    from cellweave.queries import QUERIES
    from cellweave.sources.store import checkpoint_dir

    for name in ("capped_document_frequency", "frequency_cutoff_filter"):
        before = set(os.listdir(checkpoint_dir(spark)))
        plan = QUERIES[name](spark, small)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and set(os.listdir(checkpoint_dir(spark))) == before, name


def test_exact_copies_keep_digests_only(spark, small):
    import os

    from cellweave.queries import QUERIES
    from cellweave.sources.store import checkpoint_dir

    held = lambda: sum(os.path.getsize(f"{at}/{name}") for at, _, names in os.walk(checkpoint_dir(spark)) for name in names if name.endswith(".parquet"))
    before = held()
    got = QUERIES["small_exact_copy"](spark, small)
    assert got.columns == ["query_id", "doc_id"]
    assert held() - before < 100 * spark.read.parquet(f"{small}/documents.parquet").count() + 2000


def test_older_votes_that_differ_past_six_places_keep_their_order(spark):
    much, less = (33, 41, 51, 61), (38, 43, 46, 56)  # frequencies plus one; their products differ by one
    rows = [(doc, f"{doc}:{t}") for doc, terms in ((2, much), (1, less)) for t in terms]
    rows += [(1000 + i, f"{doc}:{t}") for doc, terms in ((2, much), (1, less)) for t in terms for i in range(t - 2)]
    f = spark.createDataFrame(rows, "doc_id long, hash string")
    q = f.filter("doc_id < 3").select(F.lit(7).alias("query_id"), "hash")
    assert [r.doc_id for r in search.older_candidates(q, f, 10**6).orderBy("rank").filter("doc_id < 3").collect()] == [2, 1]
