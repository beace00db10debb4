import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellweave.functions import hashing, text
from cellweave.operators.catalog import check_filters, pass_mode


def one(spark, col, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(col).first()[0]


def test_multiply_mod():
    r = random.Random(1)
    a = [r.randrange(hashing.PRIME) for _ in range(500)] + [hashing.PRIME - 1] * 2
    b = [r.randrange(hashing.PRIME) for _ in range(500)] + [hashing.PRIME - 1, 1]
    got = hashing.multiply_mod(np.array(a, np.uint64), np.array(b, np.uint64))
    assert got.tolist() == [x * y % hashing.PRIME for x, y in zip(a, b, strict=True)]


def test_compatible_sketch(spark):
    """The signature of three tokens by the definition, and none for no tokens."""
    perms = hashing.compatible_permutations()
    d = spark.createDataFrame([(["alpha", "beta", "gamma"],), ([],)], "t array<string>")
    got = [r.sig for r in d.select(hashing.minhash(hashing.compatible_values("t"), perms).alias("sig")).collect()]
    vs = [hashing.compatible_token(t) for t in ("alpha", "beta", "gamma")]
    assert got[0] == [min((a * v + b) % hashing.PRIME for v in vs) for a, b in perms]
    assert got[1] == [hashing.PRIME] * 64 and hashing.compatible_bands(got[1]) == [] and len(hashing.compatible_bands(got[0])) == 16


@pytest.mark.parametrize(("value", "name", "want"), [("1.000, 0e0, -0.0", "m", "1,0,0"), ("1.000", "label_text", "1.000"), ("1e31", "x", "1e31"), ("abc", "x", "abc"), (" 1.50 ", "x", "1.5"), ("10", "x", "10"), ("1e3", "x", "1000"), (",", "x", ",")])
def test_plain_decimal(value, name, want):
    assert text.plain_decimal(value, name) == want


def test_text_rules(spark):
    assert one(spark, text.collapse(F.col("t")), t=" a  b\n\tc ") == "a b c"
    assert one(spark, text.scrub(F.col("t"), 8), t="ab\x07cd efghij") == "ab cd..."
    assert one(spark, text.unsigned_id(F.col("t")), t="00042") == "42"
    assert one(spark, text.unsigned_id(F.col("t")), t="18446744073709551616") is None
    assert one(spark, text.unsigned_id(F.col("t")), t="0") is None
    assert one(spark, text.bytes_text(F.col("n")), n=1536) == "1.5 KiB"
    assert one(spark, text.duration_text(F.col("n")), n=3725) == "1h 02m 05s"
    assert one(spark, text.epoch_text(F.col("n")), n=-1) is None
    assert one(spark, text.strip_namespace(F.col("t")), t="{urn:x}body") == "body"
    assert one(spark, text.casefold(F.col("t")), t="Straße") == "strasse"
    assert one(spark, text.decimals(F.col("t"), F.col("n")), t="2.50,3", n="scale") == "2.5,3"
    assert [one(spark, text.backoff_seconds(F.col("n")), n=n) for n in (1, 2, 8, 99)] == [30, 60, 3600, 3600]
    assert one(spark, text.request_wait(F.lit(1), F.lit(1), F.lit("7"))) == 7 and one(spark, text.request_wait(F.lit(9), F.lit(1), F.lit("x"))) == 120


def test_description(spark):
    told = lambda x, **k: one(spark, text.description(F.col("t"), **k), t=x)
    assert told("[b]Hi[/b] [img]http://x[/img]<p>a &amp; b</p><script>no</script>\n\n\n\nend") == "Hi\na & b\n\nend"
    assert told("  ") is None and told("<style>x") is None and told("&lt;b&gt;x&lt;/b&gt; 1 &amp;lt; 2<!-- y") == "x 1 < 2"
    assert len(told("x" * 5000)) == text.MAX_DESCRIPTION + 1 and len(told("x" * 5000, limit=None)) == 5000
    assert told("<a " * 20_000, limit=None) == ("<a " * 20_000).strip()


def test_sizes_up_to_a_largest_unit(spark):
    assert one(spark, text.bytes_text(F.col("n"), "GiB"), n=3 << 40) == "3072.0 GiB"
    assert one(spark, text.bytes_text(F.col("n")), n=3 << 40) == "3.0 TiB" and one(spark, text.bytes_text(F.col("n"), "GiB"), n=1 << 20) == "1.0 MiB"


def test_one_decimal_of_the_exact_value_with_ties_to_even(spark):
    assert [one(spark, text.percent_text(F.col("v")), v=v) for v in (6.25, 6.75, 0.35, 100.0)] == ["6.2%", "6.8%", "0.3%", "100.0%"]
    assert one(spark, text.percent_text(F.lit(None))) is None and one(spark, text.bytes_text(F.col("n")), n=1280) == "1.2 KiB"


def test_description_that_decodes_only_named_references(spark):
    told = one(spark, text.description(F.col("t"), limit=None, named=(("&quot;", '"'), ("&amp;", "&"))), t="<p>a&amp b &amp;lt; &copy; &quot;c&quot;</p>")
    assert told == 'a&amp b &lt; &copy; "c"'


def test_padded_ids(spark):
    ids = lambda t: one(spark, text.unsigned_id(F.col("t"), padded=True), t=t)
    assert ids("001000007398406970738") == "1000007398406970738" and ids("000") is None and ids("0018446744073709551616") is None and ids("x1") is None
    assert one(spark, text.unsigned_id(F.col("t")), t="001000007398406970738") is None


def test_pass_mode():
    day = 86_400
    assert pass_mode(100 * day, False, None, False, None) == "full"
    assert pass_mode(100 * day, False, 99 * day, False, 100 * day - 60) == "skip"
    assert pass_mode(100 * day, False, 99 * day, False, 99 * day) == "refresh"
    assert pass_mode(100 * day, False, 70 * day, False, 100 * day) == "full"
    assert pass_mode(100 * day, False, 99 * day, True, None) == pass_mode(100 * day, True, 99 * day, False, None) == "full"
    with pytest.raises(ValueError):
        check_filters(["Air"], ["air"])
