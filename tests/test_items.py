import datetime

from pyspark.sql import functions as F

from tidewatch.functions import items as it
from tidewatch.operators import states


def one(spark, schema, row, *columns):
    return tuple(spark.createDataFrame([row], schema).select(*columns).first())


def test_kinds_and_states(spark):
    kind = it.content_kind(F.col("u"), F.col("t"), F.col("x"))
    for row, expected in ((("https://e.org/events/1", None, None), "event"), (("https://e.org/a", "A Webinar", "podcast"), "event"), (("https://e.org/a", "t", "y" * 1000 + "podcast"), "report"), ((None, None, "Listen"), "podcast")):
        assert one(spark, "u string, t string, x string", row, kind) == (expected,)
    for said, expected in ((None, "available"), ("3 found via RSS, 2 failed", "degraded"), ("HTTP 403", "unavailable"), ("no recent items", "empty"), ("ok", "available")):
        assert one(spark, "s string", (said,), it.source_state(F.col("s"))) == (expected,)


def test_small_forms(spark):
    c = F.col("s")
    assert one(spark, "s string", ("/reports/grid-storage-now/",), it.title_of_slug(c)) == ("Grid Storage Now",)
    assert one(spark, "s string", ("javascript:x",), it.safe_url(c)) == ("",)
    assert one(spark, "s string", (None,), it.pdf_text(c), it.clamped_score(c), it.unwrapped(c)) == ("", 3, "")
    assert one(spark, "s string", (" a \t b\n\n\n\nc ",), it.pdf_text(c)) == ("a b\n\nc",)
    assert [one(spark, "s string", (s,), it.clamped_score(c))[0] for s in ("9", "0", "x", "4")] == [5, 1, 3, 4]
    assert one(spark, "s string", ("https://s.example/l/?uddg=https%3A%2F%2Fe.org%2Fa%3Fb%3D1&rut=2",), it.unwrapped(c)) == ("https://e.org/a?b=1",)
    tags = spark.createDataFrame([(["b", "x", "a", "b", "c", "d"],), (None,)], "t array<string>").select(it.badges(F.col("t"), ["a", "b", "c", "d"]).alias("b")).collect()
    assert [(r.b.shown, r.b.hidden) for r in tags] == [(["b", "a", "c"], 1), ([], 0)]


def test_dates_that_count(spark):
    day = [datetime.datetime(2026, 1, d) for d in range(1, 5)]
    found = it.date_status(F.col("p"), F.col("s"), F.col("by"), F.lit(day[1]), F.lit(day[2]))
    schema = "p timestamp, s timestamp, by string"
    for row, expected in (
        ((day[1], day[3], "rss_published"), ("verified_in_window", "high", "page_publication")),
        ((None, day[3], "index_publication"), ("verified_out_of_window", "medium", "index_publication")),
        ((None, day[2], "sitemap"), ("date_unknown", "low", "")),
        ((None, None, None), ("date_unknown", "low", "")),
    ):
        assert tuple(one(spark, schema, row, found)[0]) == expected


def test_state_joins(spark, rows):
    def kv(*pairs):
        return spark.createDataFrame(list(pairs), "k string, note string")

    assert rows(states.notes_merged(kv(("a", "x"), ("b", "y")), kv(("b", "z"), ("c", "w")), "k", "; ")) == [("a", "x"), ("b", "y; z"), ("c", "w")]
    assert rows(states.filled_up(kv(("a", "1"), ("a", "0")), kv(("a", "9"), ("b", "8")), "k", "note")) == [("a", "0", False), ("b", "8", True)]
    assert rows(states.prepared(kv(("a", "")), kv(("a", ""), ("b", "")), "k")) == [("a", True, True, True), ("b", False, True, True)]
    assert states.newest(kv(), "note", "k", 3).collect() == []
