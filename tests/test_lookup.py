"""Batched lookups over a transport that writes down what it was asked."""

import json
import os
import uuid

import pytest

from cellweave.sources import lookup


def files(folder, down=()):
    """A service kept in a folder: requests are written down; ids of 7s are unknown, of 9s refused, of 8s another app's."""

    def ask(ids, folder=str(folder), down=frozenset(down)):
        with open(os.path.join(folder, uuid.uuid4().hex), "w") as f:
            json.dump(ids, f)
        if down & set(ids):
            raise lookup.Refused(403)
        out = [{"publishedfileid": i, "title": f"t{i}", "time_updated": 5, "file_size": "12", "consumer_app_id": 1, "tags": [{"tag": " A "}], "description": "d"} for i in ids if "7" not in i]
        for r in out:
            if "9" in r["publishedfileid"]:
                r["result"] = 9
            elif "8" in r["publishedfileid"]:
                r["consumer_app_id"] = 2
        return out + out[:1]

    return ask


def test_each_id_once(spark, tmp_path):
    n = 433
    ids = spark.range(n).selectExpr("cast(id AS string) AS id").union(spark.range(50).selectExpr("cast(id AS string) AS id")).union(spark.sql("SELECT explode(array('x1', '', null)) AS id"))
    got = lookup.details(ids, files(tmp_path), app="1")
    assert got.count() == n and got.filter("error IS NULL").count() == got.filter("error IS NULL").count()  # read twice, asked once
    calls = [json.load(open(p)) for p in tmp_path.iterdir()]
    asked = [i for c in calls for i in c]
    assert len(asked) == len(set(asked)) == n and max(map(len, calls)) <= 50 and len(calls) <= n // 50 + 4
    for r in got.collect():
        want = "not in the answer" if "7" in r.id else "result 9" if "9" in r.id else "of app 2" if "8" in r.id else None
        assert r.error == want and (want is not None or (r.title, r.updated, r.size_bytes, r.tags) == (f"t{r.id}", 5, 12, ["A"]))


def test_a_batch_that_fails_stops_no_other(spark, tmp_path):
    got = lookup.details(spark.range(100, 300).selectExpr("cast(id AS string) AS id"), files(tmp_path, ["150"]), partitions=2)
    bad = got.filter("error = 'HTTP 403'").count()
    assert 1 <= bad <= 50 and got.count() == 200
    assert lookup.details(spark.sql("SELECT '5' AS id LIMIT 0"), files(tmp_path)).count() == 0


def test_waits():
    def service(answers):
        left = list(answers)

        def ask(ids):
            x = left.pop(0)
            if isinstance(x, Exception):
                raise x
            return x

        return ask

    slept = []
    R = lookup.Refused
    assert lookup.asked(service([R(429), R(503, 33), R(None), [{"a": 1}]]), ["1"], slept.append, 2.0) == [{"a": 1}]
    assert slept == [5, 33, 20, 2.0]
    for answers, tries in (([R(404)], 0), ([R(500, 900)] * 5, 4)):
        slept.clear()
        with pytest.raises(R):
            lookup.asked(service(answers), ["1"], slept.append)
        assert len(slept) == tries and all(s <= 120 for s in slept)


def test_what_is_known_after_a_lookup(spark):
    items = spark.createDataFrame([("1", "old", 3, None, 0, 0, 0), ("2", "b", 9, 4, 0, 0, 77), ("3", "c", 1, 1, 0, 0, 55)], "id string, title string, updated long, size_bytes long, downloaded long, retry_after long, tag_checked long")
    found = spark.createDataFrame([("1", "new", 5, 12, "1", None, ["A"], None), ("2", None, None, None, None, None, None, "result 9")], lookup.FIELDS)
    got = {r.id: (r.title, r.updated, r.size_bytes, r.tag_checked, r.tried) for r in lookup.merged(items, found, 1000).collect()}
    assert got == {"1": ("new", 5, 12, 1000, 1000), "2": ("b", 9, 4, 0, 1000), "3": ("c", 1, 1, 55, None)}


def test_url(tmp_path):
    """A service on this machine: a form in, rows out, its own wait and errors."""
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs

    told = [(429, {"Retry-After": "7"}, b""), (200, {}, json.dumps({"response": {"publishedfiledetails": [{"publishedfileid": "4", "title": "x"}]}}).encode() + b"")]
    seen = []

    class Service(BaseHTTPRequestHandler):
        def do_POST(self):
            seen.append(parse_qs(self.rfile.read(int(self.headers["Content-Length"])).decode()))
            code, headers, body = told[len(seen) - 1]
            self.send_response(code)
            for h in headers.items():
                self.send_header(*h)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    slept = []
    try:
        got = lookup.asked(lookup.Url(f"http://127.0.0.1:{server.server_port}/"), ["4"], slept.append)
    finally:
        server.shutdown()
    assert got == [{"publishedfileid": "4", "title": "x"}] and slept == [7]
    assert seen[0] == {"itemcount": ["1"], "publishedfileids[0]": ["4"]}
