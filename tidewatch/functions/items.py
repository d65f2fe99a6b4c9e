"""Small judgements on single items: kinds, states, badges, statuses of dates.  All are Column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.functions.text import strip_white

# What tells an event or a broadcast by its address, title or first lines.
EVENT_SIGNS = ("/event", "webinar", "conference", "panel discussion")
BROADCAST_SIGNS = ("podcast", "video", "youtube", "listen", "watch")
# What a status text says of a source that failed, or had nothing.
FAILED_SIGNS = ("fail", "unavailable", "blocked", "403", "429", "not checked")
EMPTY_SIGNS = ("no qualifying", "no raw", "no content", "no recent")
# Statements of a date that count besides the page's own.
DATED_BY = ("rss_published", "index_publication")
VERIFIED = ("verified_in_window", "verified_out_of_window")
ENOUGH_CHARS = 300


def _any_of(text: Column, signs: Sequence[str]) -> Column:
    return reduce(or_, [text.contains(s) for s in signs])


def content_kind(url: Column, title: Column, text: Column, lead: int = 1000) -> Column:
    """event, podcast or report, by the address, the title and the text's first ``lead`` characters."""
    said = F.lower(F.concat_ws(" ", url, title, F.left(text, F.lit(lead))))
    return F.when(_any_of(said, EVENT_SIGNS), "event").when(_any_of(said, BROADCAST_SIGNS), "podcast").otherwise("report")


def title_of_slug(path: Column) -> Column:
    """The last segment of a path as a title."""
    return F.initcap(F.translate(F.element_at(F.split(F.regexp_replace(path, "/+$", ""), "/"), -1), "-", " "))


def safe_url(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?:"), url).otherwise("")


def source_state(status: Column) -> Column:
    """unavailable, degraded, empty or available, by what the status text says."""
    said = F.lower(status)
    found = said.contains(" found ") | said.contains("/found ")
    return F.when(_any_of(said, FAILED_SIGNS), F.when(found, "degraded").otherwise("unavailable")).when(_any_of(said, EMPTY_SIGNS), "empty").otherwise("available")


def pdf_text(text: Column) -> Column:
    """Runs of spaces and tabs made one space, of line ends at most two; '' for null."""
    return strip_white(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), "[ \\t]+", " "), "\n{3,}", "\n\n"))


def known_topics(topics: Column, allowed: Sequence[str]) -> Column:
    """Distinct allowed topics, in the order in which they were named."""
    return F.array_intersect(F.coalesce(topics, F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))


def clamped_score(value: Column, low: int = 1, high: int = 5, otherwise: int = 3) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), F.coalesce(value.try_cast("int"), F.lit(otherwise))))


def badges(tags: Column, known: Sequence[str], limit: int = 3) -> Column:
    """struct(shown, hidden): the first known tags, and how many more there are."""
    own = known_topics(tags, known)
    return F.struct(F.slice(own, 1, limit).alias("shown"), F.greatest(F.size(own) - limit, F.lit(0)).alias("hidden"))


def display_date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "dd MMMM yyyy"), F.lit(""))


def date_status(page: Column, stated: Column, source: Column, start: Column, end: Column) -> Column:
    """struct(date_status, date_confidence, date_source): the page's own date, else one stated by feed or index; no other counts."""
    by = F.when(page.isNotNull(), F.lit("page_publication")).otherwise(source)
    at = F.coalesce(page, F.when(source.isin(*DATED_BY), stated))
    status = F.when(at.isNull(), "date_unknown").when(at.between(start, end), VERIFIED[0]).otherwise(VERIFIED[1])
    confidence = F.when(at.isNull(), "low").when(by == "index_publication", "medium").otherwise("high")
    return F.struct(status.alias("date_status"), confidence.alias("date_confidence"), F.when(at.isNull(), "").otherwise(by).alias("date_source"))


def verified_date(verified: Column, status: Column, *others: Column) -> Column:
    """The verified date, else for items verified before the first other date there is; '' without."""
    filled = [F.nullif(c, F.lit("")) for c in others]
    return F.coalesce(F.nullif(verified, F.lit("")), F.when(status.isin(*VERIFIED), F.coalesce(*filled)), F.lit(""))


def enough_evidence(text: Column, paywall: Column, least: int = ENOUGH_CHARS) -> Column:
    return (F.length(F.coalesce(text, F.lit(""))) >= least) & ~F.coalesce(paywall, F.lit(False))


def search_query(domain: Column, terms: Sequence[str]) -> Column:
    """What a search engine is asked for a domain and any of the terms."""
    quoted = [f'"{t}"' if " " in t else t for t in terms]
    return F.concat(F.lit("site:"), domain, F.lit(f" ({' OR '.join(quoted)})"))


def unwrapped(url: Column) -> Column:
    """The target of a search engine's redirect, or the URL itself, without fragment."""
    target = F.try_url_decode(F.regexp_extract(url, r"/l/\?(?:[^#]*&)?uddg=([^&#]*)", 1))
    return strip_white(F.regexp_extract(F.coalesce(F.nullif(target, F.lit("")), url, F.lit("")), "(?s)^([^#]*)", 1))
