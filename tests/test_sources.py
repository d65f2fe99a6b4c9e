import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidewatch.sources import feeds, html, remote, state
from tidewatch.streaming import ledger as stream

RSS = """<rss><channel><item><title> A &amp; B </title><link>https://e.org/a?p=1&amp;u=2</link><description><![CDATA[<p>Hi</p>]]></description>
<category>x</category><category>y</category><pubDate>Sun, 14 Jun 2026 13:00:00 +1000</pubDate><dc:creator>Me</dc:creator></item><item><title>none</title></item></channel></rss>"""
ATOM = """<feed><entry><title>T</title><link rel="alternate" href="https://e.org/?p=123&amp;utm_source=feed"/><updated>2026-06-14T03:00:00Z</updated></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([(1, RSS), (2, ATOM), (3, None), (4, ""), (5, "not xml")], "k int, xml string")
    got = {r.k: r for r in feeds.feed_items(df, "k", "xml").collect()}
    assert set(got) == {1, 2}
    assert (got[1].title, got[1].url, got[1].summary, got[1].author, got[1].tags) == ("A & B", "https://e.org/a?p=1&u=2", "Hi", "Me", ["x", "y"])
    assert got[1].published_at == datetime.datetime(2026, 6, 14, 3) and got[1].date_source == "rss_published"
    assert (got[2].url, got[2].published_at, got[2].date_source) == ("https://e.org/?p=123&utm_source=feed", None, "rss_updated_only")


def test_sitemaps_and_crawl(spark, rows):
    root = "<sitemapindex><sitemap><loc>m1</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>"
    leaf = "<urlset><url><loc>https://e.org/a</loc><lastmod>2026-01-01</lastmod></url><url><loc> https://e.org/b </loc></url></urlset>"
    snapshot = spark.createDataFrame([("root", root), ("m1", leaf)], "url string, xml string")
    assert rows(feeds.sitemap_entries(snapshot.where("url = 'm1'").withColumnRenamed("url", "map"), "map", "xml")) == [("m1", "url", "https://e.org/a", "2026-01-01"), ("m1", "url", "https://e.org/b", None)]
    start = spark.createDataFrame([("s", "root")], "root string, url string")
    assert rows(feeds.crawl(start, snapshot)) == [("s", "https://e.org/a", "2026-01-01"), ("s", "https://e.org/b", None)]


def test_robots_name_sitemaps(spark, rows):
    df = spark.createDataFrame([(1, "User-agent: *\r\nSitemap: https://e.org/a.xml\nsitemap:https://e.org/b.xml \nSitemap: https://e.org/a.xml"), (2, None), (3, "")], "k int, t string")
    assert rows(feeds.robots_sitemaps(df, "k", "t")) == [(1, "https://e.org/a.xml"), (1, "https://e.org/b.xml")]


def test_index_pages():
    page = "<nav>" + "".join(f'<a href="/n{i}">Navigation {i}</a>' for i in range(100)) + '</nav><div><a href="/reports/x">A long enough title</a><span>3 May 2026</span></div>'
    assert html.links_of(page, "https://e.org/", 1) == [{"url": "https://e.org/reports/x", "title": "A long enough title", "near_date": "2026-05-03"}]
    two = '<div><a href="/a">First long title</a><a href="/b">Second long title</a><span>3 May 2026</span></div>'
    assert [r["near_date"] for r in html.links_of(two, "https://e.org/")] == [None, None]


def test_pages():
    body = "Critical mineral processing is discussed here at length. " * 10
    page = f"""<html><head><meta property="og:title" content="T"><link rel="canonical" href="https://e.org/a"></head>
    <body><nav><p>Menu text that is long enough to count as a block</p></nav><article><time datetime="2026-09-08">8 Sep</time><p>{body}</p><p>{body}</p></article></body></html>"""
    assert html.body_of(page).count("Critical mineral") == 10 and "Menu" not in html.body_of(page)
    assert html.canonical_of(page) == "https://e.org/a" and html.dates_of(page) == "2026-09-08"
    assert html.metas_of(page) == [{"name": "og:title", "content": "T"}]
    ld = '<script type="application/ld+json">' + json.dumps({"@graph": [{"articleBody": "B" * 400, "url": "https://e.org/a"}]}) + "</script>"
    assert html.body_of(ld, "https://e.org/a/") == "B" * 400
    assert html.body_of(ld, "https://e.org/other") == ""
    assert html.body_of("<p>outer <p>" + "x" * 40 + "</p></p>") == "x" * 40
    short = '<script type="application/ld+json">' + json.dumps({"articleBody": "B" * 100}) + "</script>"
    assert html.body_of(short + f'<div class="x entry-content"><p>{body}</p></div>').count("Critical") == 10
    assert html.body_of(None) == "" and html.links_of("", "") == []
    assert html.dates_of("<time>1 May 2026</time><time>2 May 2026</time>") is None


def test_page_operators(spark):
    df = spark.createDataFrame([(1, '<a href="/x">A long enough title</a>', "https://e.org"), (2, None, None)], "k int, h string, u string")
    assert [tuple(r) for r in html.links(df, "k", "h", "u").collect()] == [(1, 1, "https://e.org/x", "A long enough title", None)]
    assert html.extracts(df, "k", "h", "u").count() == 2


def test_versioned_table(spark, tmp_path):
    t = state.VersionedTable(spark, f"file://{tmp_path}/t", "a int")
    assert t.read().collect() == []
    for i in range(4):
        t.write(spark.createDataFrame([(i,)], "a int"))
    assert t.version() == 4 and [r.a for r in t.read().collect()] == [3]
    for p in (tmp_path / "t").glob("current-*"):
        p.unlink()
    with pytest.raises(RuntimeError):
        t.read()


def test_stream_counts_a_batch_once(spark, tmp_path):
    t = stream.ledger_table(spark, f"file://{tmp_path}/l")
    day = datetime.date(2026, 1, 1)
    batch = spark.createDataFrame([("a", day), ("a", day), ("b", day)], "k string, run date")
    stream.merge_batch(t, batch, 0, "k", "run")
    stream.merge_batch(t, batch, 0, "k", "run")  # a restart repeats it
    stream.merge_batch(t, batch, 1, "k", "run")
    assert sorted((r.key, r.run_count) for r in t.read().collect()) == [("a", 2), ("b", 2)]


def test_json_lines_take_their_day_from_the_name(spark, tmp_path):
    (tmp_path / "items_2026-06-10.jsonl").write_text('{"a": 1}\nbroken\n\n{"a": 2}\n')
    got = state.read_json_lines(spark, f"file://{tmp_path}", "a int", r"_(\d{4}-\d{2}-\d{2})\.")
    assert sorted((r.a, str(r.run_date)) for r in got.collect()) == [(1, "2026-06-10"), (2, "2026-06-10")]


def test_cache(spark):
    now = F.lit("2026-01-10 00:00:00").cast("timestamp")
    cache = spark.createDataFrame([("a", "2026-01-09 00:00:00"), ("b", "2025-01-01 00:00:00")], "cache_key string, t string").select("cache_key", F.col("t").cast("timestamp").alias("cached_at"))
    asked = spark.createDataFrame([("a",), ("b",), ("c",)], "cache_key string")
    assert {r.cache_key: r.cache_status for r in state.cached(asked, cache, now).collect()} == {"a": "fresh", "b": "stale", "c": "miss"}


def test_retries():
    calls = []

    def flaky(url):
        calls.append(url)
        return (503, "") if len(calls) < 3 else (200, "ok")

    assert remote.with_retries(flaky, 3, 0)("u") == (200, "ok") and len(calls) == 3
    assert remote.with_retries(lambda u: (404, ""), 3, 0)("u") == (404, "")


def test_asking(spark):
    def ask(payloads):
        return json.dumps([{"n": 0, "score": len(payloads)}, {"n": 1, "score": 5}, {"n": 1, "score": 6}, {"n": 9}])

    df = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, p string").coalesce(1)
    got = {r.k: r.answer and r.answer.score for r in remote.ask_in_batches(df, "k", "p", ask, "n int, score int").collect()}
    assert got == {1: 3, 2: None, 3: None}
