"""Queries over the small judgements on items and the joins with what is known of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import items as it
from tidewatch.functions import url as ur
from tidewatch.operators import audit, states
from tidewatch.plans.catalogue import Catalogue
from tidewatch.plans.reference import _PATH, _strip
from tidewatch.session import table

CATALOGUE = Catalogue()
Q = CATALOGUE.query

TOPICS = ("Health security", "Resource security", "Space", "Cyber policy")
TAGS = ("border health", "grid storage", "data localisation", "critical minerals", "nuclear safeguards")

_BARE = "split_part(url, '#', 1)"
_SAID = "lower(concat_ws(' ', url, title, substr(extracted_text, 1, 1000)))"


@Q(
    "u11_content_kinds",
    f"SELECT item_id, CASE WHEN regexp_matches(h, '/event|webinar|conference|panel discussion') THEN 'event' WHEN regexp_matches(h, 'podcast|video|youtube|listen|watch') THEN 'podcast' ELSE 'report' END AS kind "
    f"FROM (SELECT item_id, {_SAID} AS h FROM enriched_items)",
)
def u11_content_kinds(spark, d):
    e = table(spark, d, "enriched_items")
    return e.select("item_id", it.content_kind(F.col("url"), F.col("title"), F.col("extracted_text")).alias("kind"))


@Q(
    "u12_slug_titles",
    "SELECT candidate_id, array_to_string(list_transform(string_split(replace(string_split(regexp_replace(p, '/+$', ''), '/')[-1], '-', ' '), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ') AS slug_title "
    f"FROM (SELECT candidate_id, {_PATH} AS p FROM candidates)",
)
def u12_slug_titles(spark, d):
    c = table(spark, d, "candidates")
    return c.select("candidate_id", it.title_of_slug(ur.path_of(F.col("url"))).alias("slug_title"))


@Q("u14_safe_urls", "SELECT candidate_id, CASE WHEN regexp_matches(lower(url), '^https?:') THEN url ELSE '' END AS safe FROM candidates")
def u14_safe_urls(spark, d):
    return table(spark, d, "candidates").select("candidate_id", it.safe_url(F.col("url")).alias("safe"))


@Q(
    "u15_source_states",
    "SELECT state, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(s, 'fail|unavailable|blocked|403|429|not checked') THEN CASE WHEN regexp_matches(s, ' found |/found ') THEN 'degraded' ELSE 'unavailable' END "
    "WHEN regexp_matches(s, 'no qualifying|no raw|no content|no recent') THEN 'empty' ELSE 'available' END AS state FROM (SELECT lower(concat_ws(' ', extraction_status, http_status, content_format)) AS s FROM enriched_items)) GROUP BY state",
)
def u15_source_states(spark, d):
    e = table(spark, d, "enriched_items")
    said = F.concat_ws(" ", "extraction_status", F.col("http_status").cast("string"), "content_format")
    return e.groupBy(it.source_state(said).alias("state")).agg(F.count(F.lit(1)).alias("n"))


@Q(
    "t16_pdf_texts",
    "SELECT item_id, md5(" + _strip(r"regexp_replace(regexp_replace(coalesce(extracted_text, ''), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')") + ") AS digest FROM enriched_items WHERE content_format = 'pdf'",
)
def t16_pdf_texts(spark, d):
    e = table(spark, d, "enriched_items").where("content_format = 'pdf'")
    return e.select("item_id", F.md5(it.pdf_text(F.col("extracted_text"))).alias("digest"))


@Q(
    "t22_known_topics",
    "SELECT item_id, array_to_string(list_sort(list_distinct(list_filter(list_transform(coalesce(topic_hints, []), lambda h: h.topic), lambda t: t IN ("
    + ", ".join(f"'{t}'" for t in TOPICS)
    + ")))), ',') AS topics, greatest(1, least(5, coalesce(extracted_text_chars, 3))) AS score FROM enriched_items",
)
def t22_known_topics(spark, d):
    e = table(spark, d, "enriched_items")
    topics = it.known_topics(F.transform("topic_hints", lambda h: h["topic"]), TOPICS)
    return e.select("item_id", F.array_join(F.array_sort(topics), ",").alias("topics"), it.clamped_score(F.col("extracted_text_chars").cast("string")).alias("score"))


@Q(
    "t23_badges",
    "SELECT candidate_id, CAST(greatest(len(k) - 3, 0) AS INTEGER) AS hidden, CAST(least(len(k), 3) AS INTEGER) AS shown FROM (SELECT candidate_id, list_distinct(list_filter(coalesce(tags, []), lambda t: t IN ("
    + ", ".join(f"'{t}'" for t in TAGS)
    + "))) AS k FROM candidates)",
)
def t23_badges(spark, d):
    c = table(spark, d, "candidates").select("candidate_id", it.badges(F.col("tags"), TAGS).alias("b"))
    return c.select("candidate_id", "b.hidden", F.size("b.shown").alias("shown"))


@Q("d2_display_dates", "SELECT item_id, strftime(CAST(fetched_at AS TIMESTAMP), '%d %B %Y') AS shown FROM enriched_items")
def d2_display_dates(spark, d):
    return table(spark, d, "enriched_items").select("item_id", it.display_date(F.col("fetched_at")).alias("shown"))


@Q(
    "d5_date_statuses",
    "SELECT item_id, CASE WHEN t IS NULL THEN 'date_unknown' WHEN t >= e - INTERVAL 48 HOURS AND t <= e THEN 'verified_in_window' ELSE 'verified_out_of_window' END AS date_status, "
    "CASE WHEN t IS NULL THEN 'low' WHEN src = 'index_publication' THEN 'medium' ELSE 'high' END AS date_confidence, CASE WHEN t IS NULL THEN '' ELSE src END AS date_source FROM ("
    "SELECT item_id, CASE WHEN date_source = 'page_publication' AND p IS NOT NULL THEN 'page_publication' ELSE date_source END AS src, e, CASE WHEN date_source = 'page_publication' THEN p WHEN date_source IN ('rss_published', 'index_publication') THEN p END AS t "
    "FROM (SELECT item_id, date_source, CAST(scan_run_date AS TIMESTAMP) + INTERVAL 3 HOURS AS e, CAST(TRY_CAST(published_at_verified AS TIMESTAMPTZ) AS TIMESTAMP) AS p FROM enriched_items))",
)
def d5_date_statuses(spark, d):
    """The verified times as the page's own where the page stated them, else as stated by feed or index."""
    e = table(spark, d, "enriched_items")
    at, end = F.col("published_at_verified").try_cast("timestamp"), F.col("scan_run_date").cast("timestamp") + F.expr("INTERVAL 3 HOURS")
    own = F.when(F.col("date_source") == "page_publication", at)
    found = it.date_status(own, at, F.col("date_source"), end - F.expr("INTERVAL 48 HOURS"), end)
    return e.select("item_id", found.alias("s")).select("item_id", "s.*")


@Q(
    "d10_verified_dates",
    "SELECT item_id, coalesce(nullif(published_at_verified, ''), CASE WHEN date_status IN ('verified_in_window', 'verified_out_of_window') THEN CAST(scan_run_date AS VARCHAR) END, '') AS verified FROM enriched_items",
)
def d10_verified_dates(spark, d):
    e = table(spark, d, "enriched_items")
    return e.select("item_id", it.verified_date(F.col("published_at_verified"), F.col("date_status"), F.col("scan_run_date").cast("string")).alias("verified"))


@Q("f9_sufficient", "SELECT item_id, length(coalesce(extracted_text, '')) >= 300 AND NOT coalesce(paywall_detected, false) AS sufficient FROM enriched_items")
def f9_sufficient(spark, d):
    e = table(spark, d, "enriched_items")
    return e.select("item_id", it.enough_evidence(F.col("extracted_text"), F.col("paywall_detected")).alias("sufficient"))


@Q("s9_search_queries", "SELECT institution, 'site:' || domain || ' (sanctions OR \"export control\" OR \"supply chain\")' AS query FROM sources")
def s9_search_queries(spark, d):
    return table(spark, d, "sources").select("institution", it.search_query(F.col("domain"), ["sanctions", "export control", "supply chain"]).alias("query"))


@Q("s11_unwrapped", f"SELECT candidate_id, {_strip(_BARE)} AS target FROM candidates WHERE url <> ''")
def s11_unwrapped(spark, d):
    """Redirects made of the candidates' URLs, taken apart again."""
    c = table(spark, d, "candidates").where("url <> ''")
    wrapped = F.concat(F.lit("https://search.example/l/?uddg="), F.url_encode("url"), F.lit("&rut=1#x"))
    return c.select("candidate_id", it.unwrapped(wrapped).alias("target"))


@Q(
    "j3_reported_before",
    "SELECT item_id, EXISTS (SELECT 1 FROM ledger l WHERE l.last_reported_run_date IS NOT NULL AND (l.seen_item_key = n.seen_item_key OR list_contains(l.urls, n.url))) AS reported FROM new_items n",
)
def j3_reported_before(spark, d):
    n = table(spark, d, "new_items").select("item_id", "seen_item_key", "url")
    found = states.reported_before(n, table(spark, d, "ledger"), "seen_item_key", "url", "last_reported_run_date", "urls")
    return found.select("item_id", "reported")


@Q(
    "j7_source_checkpoints",
    "SELECT s.institution, c.at AS last_run, c.at IS NULL AS never_run FROM sources s LEFT JOIN (SELECT institution, max(scan_run_date) AS at FROM candidates WHERE discovery_method = 'rss' GROUP BY institution) c ON c.institution = s.institution",
)
def j7_source_checkpoints(spark, d):
    runs = table(spark, d, "candidates").where("discovery_method = 'rss'").groupBy("institution").agg(F.max("scan_run_date").alias("last_run"))
    return table(spark, d, "sources").select("institution").join(runs, "institution", "left").withColumn("never_run", F.col("last_run").isNull())


@Q(
    "j10_status_notes",
    "SELECT coalesce(a.institution, b.institution) AS institution, concat_ws('; native ', a.note, b.note) AS note FROM (SELECT institution, 'rss ' || count(*) AS note FROM candidates WHERE discovery_method = 'rss' GROUP BY institution) a "
    "FULL OUTER JOIN (SELECT institution, 'items ' || count(*) AS note FROM enriched_items WHERE http_status >= 400 GROUP BY institution) b ON a.institution = b.institution",
)
def j10_status_notes(spark, d):
    def notes(rows, word):
        return rows.groupBy("institution").agg(F.concat(F.lit(f"{word} "), F.count(F.lit(1)).cast("string")).alias("note"))

    rss = notes(table(spark, d, "candidates").where("discovery_method = 'rss'"), "rss")
    return states.notes_merged(rss, notes(table(spark, d, "enriched_items").where("http_status >= 400"), "items"), "institution", "; native ")


@Q(
    "j12_resolved",
    "SELECT institution, count(*) AS n FROM (SELECT DISTINCT institution, url FROM candidates EXCEPT SELECT institution, url FROM candidates WHERE date IS NULL OR trim(date) = '') GROUP BY institution",
)
def j12_resolved(spark, d):
    """URLs of which no sighting still waits for a date."""
    c = table(spark, d, "candidates")
    pending = F.bool_or(F.coalesce(F.trim("date") == "", F.lit(True)))
    return c.groupBy("institution", "url").agg(pending.alias("waits")).where("NOT waits").groupBy("institution").agg(F.count(F.lit(1)).alias("n"))


@Q(
    "j13_backlog",
    "WITH f AS (SELECT seen_item_key, min(item_id) AS item_id FROM new_items GROUP BY 1), b AS (SELECT seen_item_key, min(item_id) AS item_id FROM ledger GROUP BY 1) "
    "SELECT seen_item_key, item_id, false AS from_backlog FROM f UNION ALL SELECT seen_item_key, item_id, true FROM b WHERE seen_item_key NOT IN (SELECT seen_item_key FROM f)",
)
def j13_backlog(spark, d):
    fresh, backlog = (table(spark, d, t).select("seen_item_key", "item_id") for t in ("new_items", "ledger"))
    return states.filled_up(fresh, backlog, "seen_item_key", "item_id")


@Q(
    "x7_prepared",
    "WITH n AS (SELECT DISTINCT seen_item_key AS k FROM new_items), p AS (SELECT DISTINCT seen_item_key AS k FROM ledger WHERE last_reported_run_date IS NULL) "
    "SELECT coalesce(n.k, p.k) AS seen_item_key, n.k IS NOT NULL AS is_new, p.k IS NOT NULL AS pending_waiting, p.k IS NOT NULL AS force_refresh FROM n FULL OUTER JOIN p ON n.k = p.k",
)
def x7_prepared(spark, d):
    pending = table(spark, d, "ledger").where("last_reported_run_date IS NULL")
    return states.prepared(table(spark, d, "new_items"), pending, "seen_item_key")


@Q("a5_reasons", "SELECT CASE WHEN extraction_status = 'ok' THEN 'selected:' ELSE 'skipped:' END || extraction_status AS reason, count(*) AS n FROM enriched_items GROUP BY 1")
def a5_reasons(spark, d):
    e = table(spark, d, "enriched_items")
    reason = F.concat(F.when(F.col("extraction_status") == "ok", "selected:").otherwise("skipped:"), "extraction_status")
    return e.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n")).orderBy("reason")


@Q(
    "a7_statuses",
    " UNION ALL ".join(f"SELECT '{c}' AS dimension, {c} AS value, count(*) AS n FROM enriched_items GROUP BY {c}" for c in ("extraction_status", "date_status", "evidence_quality", "content_format")),
)
def a7_statuses(spark, d):
    return audit.counts_by(table(spark, d, "enriched_items"), ["extraction_status", "date_status", "evidence_quality", "content_format"])


@Q(
    "a11_scores",
    "SELECT institution, count(*) AS items, round(coalesce(avg(h.score), 0), 4) AS mean_score FROM (SELECT institution, unnest(CASE WHEN len(topic_hints) > 0 THEN topic_hints ELSE [NULL] END) AS h FROM enriched_items) GROUP BY institution",
)
def a11_scores(spark, d):
    e = table(spark, d, "enriched_items").select("institution", F.explode_outer("topic_hints").alias("h"))
    return e.groupBy("institution").agg(F.count(F.lit(1)).alias("items"), F.round(states.mean_score(F.col("h.score")), 4).alias("mean_score"))


@Q("a14_usage", "SELECT extraction_status, count(*) AS calls, CAST(sum(coalesce(extracted_text_chars, 0)) AS BIGINT) AS chars FROM enriched_items GROUP BY 1")
def a14_usage(spark, d):
    e = table(spark, d, "enriched_items")
    return e.groupBy("extraction_status").agg(F.count(F.lit(1)).alias("calls"), F.sum(F.coalesce("extracted_text_chars", F.lit(0))).alias("chars"))


@Q("o7_newest", "SELECT capture_id FROM page_captures ORDER BY captured_at DESC, capture_id LIMIT 50")
def o7_newest(spark, d):
    """What a cache of 50 entries keeps; the limit is the feature."""
    return states.newest(table(spark, d, "page_captures"), "captured_at", "capture_id", 50).select("capture_id")
