"""Feeds and sitemaps: XML texts to rows, with Spark's own XML parser."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions import dates
from tidewatch.functions.text import squeeze, strip_white

ITEM = "title STRING, link STRING, description STRING, author STRING, creator STRING, category ARRAY<STRING>, pubDate STRING, published STRING, updated STRING, date STRING"
# Where sitemaps usually are.
SITEMAP_PATHS = (
    "/sitemap.xml",
    "/sitemap_index.xml",
    "/sitemap-index.xml",
    "/sitemap-news.xml",
    "/news-sitemap.xml",
    "/post-sitemap.xml",
    "/page-sitemap.xml",
)


@F.pandas_udf(T.TimestampType())
def feed_time(texts: pd.Series) -> pd.Series:
    """Instant of a feed date; UTC where no zone is stated."""
    return pd.to_datetime(texts.map(dates.feed_instant), utc=True)


def feed_items(feeds: DataFrame, key: str, xml: str) -> DataFrame:
    """Items of RSS and Atom texts, one row each, in document order from 1.

    A date of publication comes from ``pubDate``, ``published`` or
    ``dc:date``; with ``updated`` alone the item has none.
    """
    rows = feeds.where(F.col(xml).isNotNull()).select(F.col(key), F.posexplode(F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<(?:item|entry)[\s>].*?</(?:item|entry)>)"), 1)).alias("pos", "element"))
    plain = F.regexp_replace(F.col("element"), r"<(/?)(?:dc|content|atom|media):", "<$1")
    href = F.regexp_extract(plain, r"<link[^>]*\bhref=[\"']([^\"']*)[\"']", 1)
    parsed = rows.withColumn("x", F.from_xml(F.regexp_replace(plain, r"<link([^>]*)/>", ""), ITEM)).withColumn("href", href)
    link = F.coalesce(F.nullif(F.trim("href"), F.lit("")), F.trim("x.link"))
    stated = F.coalesce("x.pubDate", "x.published", "x.date")
    strip = F.regexp_replace(F.coalesce("x.description", F.lit("")), r"<[^>]*>", " ")
    found = parsed.select(
        key,
        (F.col("pos") + 1).alias("item_no"),
        squeeze(F.col("x.title")).alias("title"),
        F.replace(link, F.lit("&amp;"), F.lit("&")).alias("url"),
        squeeze(strip).alias("summary"),
        F.coalesce("x.author", "x.creator").alias("author"),
        F.coalesce("x.category", F.array().cast("array<string>")).alias("tags"),
        feed_time(stated).alias("published_at"),
        F.when(stated.isNotNull(), "rss_published").when(F.col("x.updated").isNotNull(), "rss_updated_only").alias("date_source"),
    )
    return found.where("url <> ''")


def sitemap_entries(maps: DataFrame, key: str, xml: str) -> DataFrame:
    """(key, kind, url, lastmod): pages and nested maps of sitemap texts."""
    block = F.regexp_extract_all(F.col(xml), F.lit(r"(?s)(<(?:url|sitemap)>.*?</(?:url|sitemap)>)"), 1)
    rows = maps.select(F.col(key), F.explode(block).alias("b"))
    return rows.select(
        key,
        F.when(F.col("b").startswith("<sitemap"), "sitemap").otherwise("url").alias("kind"),
        F.replace(F.trim(F.regexp_extract("b", r"(?s)<loc>(.*?)</loc>", 1)), F.lit("&amp;"), F.lit("&")).alias("url"),
        F.nullif(F.trim(F.regexp_extract("b", r"(?s)<lastmod>(.*?)</lastmod>", 1)), F.lit("")).alias("lastmod"),
    ).where("url <> ''")


def sitemap_candidates(sources: DataFrame, paths=SITEMAP_PATHS) -> DataFrame:
    """(institution, url): where a source's sitemaps usually are.  The paths are an array, not a second table."""
    base = F.regexp_replace("base_url", "/+$", "")
    return sources.select("institution", F.explode(F.transform(F.array(*map(F.lit, paths)), lambda p: F.concat(base, p))).alias("url"))


def robots_sitemaps(robots: DataFrame, key: str, text: str) -> DataFrame:
    """(key, url): the sitemaps that robots.txt texts name, each once."""
    lines = robots.select(key, F.explode(F.split(text, r"\r\n|\r|\n")).alias("line"))
    return lines.select(key, strip_white(F.regexp_extract("line", r"(?i)^sitemap:(.*)$", 1)).alias("url")).where("url <> ''").distinct()


def crawl(start: DataFrame, snapshot: DataFrame, max_maps: int = 20, max_urls: int = 2500) -> DataFrame:
    """(root, url, lastmod) of pages reachable from ``start`` (root, url) through nested maps in ``snapshot`` (url, xml).

    Level by level; per root at most ``max_maps`` maps and ``max_urls`` pages a map, as limits of politeness.
    """
    from pyspark.sql import Window

    from tidewatch.session import materialize

    seen = materialize(start.select("root", "url").distinct(), "maps")
    level, pages = seen, None
    while True:
        fetched = level.join(snapshot.select(F.col("url").alias("u"), "xml"), F.col("url") == F.col("u")).select(F.struct("root", "url").alias("at"), "xml")
        entries = materialize(sitemap_entries(fetched, "at", "xml"), "entries")
        rank = F.row_number().over(Window.partitionBy("at").orderBy("url"))
        found = entries.where("kind = 'url'").withColumn("n", rank).where(F.col("n") <= max_urls).select("at.root", "url", "lastmod")
        pages = found if pages is None else pages.unionByName(found)
        nested = entries.where("kind = 'sitemap'").select("at.root", "url").distinct().join(seen, ["root", "url"], "left_anti")
        room = seen.groupBy("root").agg(F.count(F.lit(1)).alias("had"))
        ranked = nested.join(room, "root").withColumn("n", F.row_number().over(Window.partitionBy("root").orderBy("url")))
        level = materialize(ranked.where(F.col("n") + F.col("had") <= max_maps).select("root", "url"), "maps")
        if level.isEmpty():
            return pages.groupBy("root", "url").agg(F.max("lastmod").alias("lastmod"))
        seen = materialize(seen.unionByName(level), "maps")
