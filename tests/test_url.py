import random

import pytest
from pyspark.sql import functions as F

from tidewatch.functions import url as ur


def norms(spark, urls):
    return [r.n for r in spark.createDataFrame([(u,) for u in urls], "u string").coalesce(1).select(ur.normalize_url(F.col("u")).alias("n")).collect()]


@pytest.mark.parametrize(
    "a, b, equal",
    [
        ("https://EXAMPLE.org:443/a?b=2&a=1&utm_source=x#top", "https://example.org/a?a=1&b=2", True),
        ("https://example.org/?p=1", "https://example.org/?p=2", False),
        ("https://example.org/a?k=1&k=2", "https://example.org/a?k=2&k=1", False),
        ("http://example.org/a", "https://example.org/a", False),
        ("https://example.org/%7Epaper", "https://example.org/~paper", True),
        ("https://example.org/a%2fb", "https://example.org/a%2Fb", True),
        ("https://example.org/a%2Fb", "https://example.org/a/b", False),
        (" https://example.org/a/ ", "https://example.org/a", True),
        ("https://example.org", "https://example.org/", True),
        ("https://www.example.org/a", "https://example.org/a", False),
    ],
)
def test_pairs(spark, a, b, equal):
    x, y = norms(spark, [a, b])
    assert x and y and (x == y) is equal


@pytest.mark.parametrize("bad", ["", None, "ftp://example.org/a", "mailto:x@y", "https://hosthttps://host", "https://", "http://h:x/", "http://h:70000/", "http://[::1/"])
def test_unusable(spark, bad):
    assert norms(spark, [bad]) == [""]


def test_normal_form_is_stable(spark):
    rnd = random.Random(5)
    once = norms(spark, ["https://Example.org/" + "".join(rnd.choice("abcXYZ019/%?&=#:.~-_é*+") for _ in range(rnd.randrange(40))) for _ in range(2000)])
    assert all(once) and norms(spark, once) == once


@pytest.mark.parametrize(
    "url, expected",
    [
        ("HTTPS://WWW.Example.org:443/A/b/?utm_x=1", "https://www.example.org/A/b"),
        ("https://e.org/%41%2f%zz%e9", "https://e.org/A%2F%zz%E9"),
        ("https://e.org/a;p=1/b;q?x=%7e*+y&x=&z", "https://e.org/a;p=1/b;q?x=~%2A+y&x=&z="),
        ("http://u:p@e.org:0080/a?b=%&a=%C3%A9", "http://u:p@e.org/a?a=%C3%A9&b=%25"),
        ("https://e.org/x\n/y//", "https://e.org/x/y"),
    ],
)
def test_normal_forms(spark, url, expected):
    assert norms(spark, [url]) == [expected]


@pytest.mark.parametrize(
    "raw, page, expected",
    [
        ("https://other.org/x", "https://example.org/a", "https://example.org/a"),
        ("https://example.org/", "https://example.org/a", "https://example.org/a"),
        ("https://hosthttps://host", "https://example.org/a", "https://example.org/a"),
        ("/x", "https://example.org/a", "https://example.org/x"),
        (None, "https://example.org/a#f", "https://example.org/a"),
        (None, None, ""),
        ("../c/./d?x", "https://example.org/a/b/e", "https://example.org/a/c/d?x"),
        ("//example.org/z", "https://example.org/a", "https://example.org/z"),
        ("?q=2", "https://example.org/a", "https://example.org/a?q=2"),
        ("https://www.example.org/b?q=1", "https://example.org/a", "https://www.example.org/b?q=1"),
    ],
)
def test_canonical(spark, raw, page, expected):
    assert spark.createDataFrame([(raw, page)], "r string, p string").select(ur.resolve_canonical(F.col("r"), F.col("p"))).first()[0] == expected


def test_domains_and_types(spark):
    df = spark.createDataFrame([("https://a.b.example.org:8080/events/x",), ("https://evil.org/report",)], "u string")
    got = df.select(ur.host_of(F.col("u")), ur.domain_suffixes(ur.host_of(F.col("u"))), ur.item_type(F.col("u")), ur.within_domain(ur.host_of(F.col("u")), F.lit("example.org"))).collect()
    assert tuple(got[0]) == ("a.b.example.org", ["a.b.example.org", "b.example.org", "example.org", "org"], "event", True)
    assert got[1][2:] == ("report", False)
    assert not spark.range(1).select(ur.within_domain(F.lit("badexample.org"), F.lit("example.org"))).first()[0]
