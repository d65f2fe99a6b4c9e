"""Queries over the operators for scanning, identifying, merging and counting documents.

Names are ``<operator id>_<what>`` in lower case, with ``s`` for sources, ``u``
for URL and identity, ``t`` text, ``d`` dates, ``j`` joins, ``a`` aggregates,
``w`` windows, ``o`` orders, ``x`` set operations and ``k`` kept state.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import text as tx
from tidewatch.functions import url as ur
from tidewatch.operators import audit, hints, identity, ledger, merging, ranking
from tidewatch.plans.catalogue import Catalogue
from tidewatch.session import shared_dir, table
from tidewatch.sources import feeds, html, state

CATALOGUE = Catalogue()
Q = CATALOGUE.query

_W = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace({c}, '^{_W}+|{_W}+$', '', 'g')"


def _squeeze(c: str) -> str:
    return f"regexp_replace({_strip(c)}, '{_W}+', ' ', 'g')"


_HOST = "lower(regexp_extract(trim(url, chr(32) || chr(9) || chr(10) || chr(13) || chr(160)), '^[A-Za-z][A-Za-z0-9+.-]*://([^/:?#]*)', 1))"
_PATH = "lower(regexp_extract(" + _strip("url") + ", '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1))"

# -- URLs, identity, hashes ----------------------------------------------------


@Q("u1_normal_urls")
def u1_normal_urls(spark, d):
    """No SQL: percent-decoding and query rules; tested against fixtures and a reference function."""
    return table(spark, d, "candidates").select("candidate_id", ur.normalize_url(F.col("url")).alias("normal_url"))


@Q("u2_normal_titles", f"SELECT candidate_id, coalesce(lower({_squeeze('title')}), '') AS title_key FROM candidates")
def u2_normal_titles(spark, d):
    return table(spark, d, "candidates").select("candidate_id", tx.normal_title(F.col("title")).alias("title_key"))


@Q("u3_identity")
def u3_identity(spark, d):
    c = table(spark, d, "candidates")
    found = c.select("candidate_id", identity.identity(F.col("canonical_url"), F.col("url"), F.col("institution"), F.col("title")).alias("i"))
    return found.select("candidate_id", "i.kind", "i.value", identity.identity_key(F.col("i.kind"), F.col("i.value")).alias("item_key"))


@Q("u4_keys", "SELECT item_id, seen_item_key, identity_kind || ':' || sha256(identity_kind || ':' || identity_value) AS made_key FROM ledger")
def u4_keys(spark, d):
    return table(spark, d, "ledger").select("item_id", "seen_item_key", identity.identity_key(F.col("identity_kind"), F.col("identity_value")).alias("made_key"))


@Q(
    "u5_content_hash",
    f"SELECT item_id, CASE WHEN regexp_matches(extracted_text, '[^' || substr('{_W}', 2)) THEN sha256(lower({_squeeze('extracted_text')})) END AS text_hash FROM enriched_items",
)
def u5_content_hash(spark, d):
    return table(spark, d, "enriched_items").select("item_id", tx.content_digest(F.col("extracted_text")).alias("text_hash"))


@Q("u6_cache_keys")
def u6_cache_keys(spark, d):
    return table(spark, d, "page_captures").select("capture_id", F.sha2(ur.cache_url(F.col("url")), 256).alias("cache_key"))


@Q("u7_canonical")
def u7_canonical(spark, d):
    return table(spark, d, "candidates").select("candidate_id", ur.resolve_canonical(F.col("canonical_url"), F.col("url")).alias("resolved_url"))


@Q(
    "u8_aliases",
    "SELECT candidate_id, u AS alias FROM (SELECT candidate_id, unnest(list_distinct(list_filter([url, canonical_url], lambda x: x IS NOT NULL AND x <> ''))) AS u FROM candidates)",
)
def u8_aliases(spark, d):
    c = table(spark, d, "candidates")
    return c.select("candidate_id", F.explode(identity.aliases(F.col("url"), F.col("canonical_url"))).alias("alias"))


@Q(
    "u10_item_types",
    f"SELECT item_type, CASE WHEN contains(p, '/event') THEN 'event' WHEN regexp_matches(p, '/podcast|/video') THEN 'podcast' ELSE 'report' END AS by_path, count(*) AS n "
    f"FROM (SELECT item_type, {_PATH} AS p FROM candidates) GROUP BY ALL",
)
def u10_item_types(spark, d):
    c = table(spark, d, "candidates")
    return c.groupBy("item_type", ur.item_type(F.col("url")).alias("by_path")).agg(F.count(F.lit(1)).alias("n"))


@Q("u13_slugs", "SELECT institution, trim(regexp_replace(lower(institution), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM sources")
def u13_slugs(spark, d):
    return table(spark, d, "sources").select("institution", tx.slug(F.col("institution")).alias("slug"))


# -- Text -----------------------------------------------------------------------


@Q("t10_excerpts")
def t10_excerpts(spark, d):
    rows = table(spark, d, "enriched_items").where(F.length("extracted_text") > 0)
    return rows.select("item_id", tx.excerpt(F.col("extracted_text")).alias("excerpt"))


@Q("t12_first_sentences")
def t12_first_sentences(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.first_sentences(F.col("text")).alias("opening"))


@Q(
    "t13_short_titles",
    "SELECT candidate_id, CASE WHEN length(title) <= 40 THEN title ELSE (CASE WHEN contains(h, ' ') THEN regexp_replace(h, ' [^ ]*$', '') ELSE h END) || '…' END AS short_title "
    "FROM (SELECT candidate_id, title, substr(title, 1, 37) AS h FROM candidates)",
)
def t13_short_titles(spark, d):
    return table(spark, d, "candidates").select("candidate_id", tx.shorten_title(F.col("title"), 40).alias("short_title"))


@Q(
    "t14_truncated",
    f"SELECT doc_id, CASE WHEN length(t) <= 260 THEN t ELSE rtrim(substr(t, 1, 257), ' ') || '...' END AS truncated FROM (SELECT doc_id, coalesce({_squeeze('text')}, '') AS t FROM documents)",
)
def t14_truncated(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.truncate(F.col("text")).alias("truncated"))


@Q(
    "t15_controls",
    r"SELECT doc_id, length(regexp_replace(text, '[\x00-\x08\x0B\x0C\x0E-\x1F]', '', 'g')) AS chars FROM documents",
)
def t15_controls(spark, d):
    return table(spark, d, "documents").select("doc_id", F.length(tx.strip_controls(F.col("text"))).cast("bigint").alias("chars"))


#: Topics and keywords for the hint queries.
LEXICON = {
    "energy": ["grid storage", "gas transit", "hydrogen trade"],
    "security": ["arms control", "port security", "coastal defence"],
    "health": ["border health", "vaccine procurement"],
    "data": ["data localisation", "digital identity", "cyber insurance"],
}


def _hint_sql() -> str:
    topics = []
    for n, (topic, words) in enumerate(LEXICON.items()):
        flags = ", ".join(f"CASE WHEN regexp_matches(t, '(^|[^\\pL\\pN_]){w.replace(' ', chr(92) + 's+')}($|[^\\pL\\pN_])') THEN '{w}' END" for w in sorted(words))
        topics.append(f"SELECT item_id, '{topic}' AS topic, list_filter([{flags}], lambda x: x IS NOT NULL) AS m FROM low")
    return (
        "WITH low AS (SELECT item_id, lower(concat_ws(' ', title, extracted_text)) AS t FROM enriched_items), hits AS (" + " UNION ALL ".join(topics) + ") "
        "SELECT item_id, topic, array_to_string(m, ', ') AS matched_keywords, CAST(len(m) AS INTEGER) AS score FROM hits WHERE len(m) > 0"
    )


@Q("t17_topic_hints", _hint_sql())
def t17_topic_hints(spark, d):
    rows = table(spark, d, "enriched_items")
    found = rows.select("item_id", F.explode(hints.hints(F.lower(F.concat_ws(" ", "title", "extracted_text")), LEXICON)).alias("h"))
    return found.select("item_id", "h.topic", F.array_join("h.matched_keywords", ", ").alias("matched_keywords"), "h.score")


@Q(
    "t21_telling_titles",
    f"SELECT candidate_id, coalesce(length(t) >= 18 AND len(string_split(t, ' ')) >= 3 AND t NOT IN ('all events', 'publications', 'research'), false) AS telling "
    f"FROM (SELECT candidate_id, coalesce(lower({_squeeze('title')}), '') AS t FROM candidates)",
)
def t21_telling_titles(spark, d):
    c = table(spark, d, "candidates")
    return c.select("candidate_id", tx.telling_title(F.col("title"), ["all events", "publications", "research"]).alias("telling"))


# -- Dates ----------------------------------------------------------------------


@Q(
    "d9_date_keys",
    f"SELECT candidate_id, CASE WHEN regexp_matches(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN regexp_extract(date, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}', 0) "
    f"ELSE lower({_strip('date')}) END AS date_key FROM candidates WHERE date IS NOT NULL",
)
def d9_date_keys(spark, d):
    c = table(spark, d, "candidates").where("date IS NOT NULL")
    day = F.regexp_extract("date", r"[0-9]{4}-[0-9]{2}-[0-9]{2}", 0)
    return c.select("candidate_id", F.when(day != "", day).otherwise(F.lower(tx.strip_white(F.col("date")))).alias("date_key"))


@Q(
    "d4_windows",
    "SELECT scan_run_date, count(*) AS n, count(*) FILTER (WHERE fetched_at >= CAST(scan_run_date AS TIMESTAMP) - INTERVAL 45 HOURS AND fetched_at <= CAST(scan_run_date AS TIMESTAMP) + INTERVAL 3 HOURS) AS inside "
    "FROM (SELECT scan_run_date, CAST(fetched_at AS TIMESTAMP) AS fetched_at FROM candidates) GROUP BY scan_run_date",
)
def d4_windows(spark, d):
    """Rows fetched within the 48 hours before 03:00 of their run, both ends counting."""
    c = table(spark, d, "candidates")
    end = F.col("scan_run_date").cast("timestamp") + F.expr("INTERVAL 3 HOURS")
    inside = F.col("fetched_at").between(end - F.expr("INTERVAL 48 HOURS"), end)
    return c.groupBy("scan_run_date").agg(F.count(F.lit(1)).alias("n"), F.count_if(inside).alias("inside"))


# -- Joins ----------------------------------------------------------------------


@Q("j1_known_keys", "SELECT n.item_id, l.item_id AS ledger_id, l.first_seen_run_date AS known_since FROM new_items n LEFT JOIN ledger l ON n.seen_item_key = l.seen_item_key")
def j1_known_keys(spark, d):
    n, entries = table(spark, d, "new_items"), table(spark, d, "ledger")
    entries = entries.select("seen_item_key", F.col("item_id").alias("ledger_id"), F.col("first_seen_run_date").alias("known_since"))
    return n.select("item_id", "seen_item_key").join(entries, "seen_item_key", "left").select("item_id", "ledger_id", "known_since")


@Q(
    "j2_alias_lookup",
    "WITH e AS (SELECT seen_item_key AS k, item_id AS o, unnest(urls) AS a FROM ledger), b AS (SELECT n.item_id, arg_min(e.k, e.o) AS k FROM new_items n JOIN e ON e.a = n.url GROUP BY n.item_id) "
    "SELECT n.item_id, coalesce(l.seen_item_key, b.k) AS matched_key, CASE WHEN l.seen_item_key IS NOT NULL THEN 'key' WHEN b.k IS NOT NULL THEN 'alias' END AS matched_by "
    "FROM new_items n LEFT JOIN ledger l ON l.seen_item_key = n.seen_item_key LEFT JOIN b ON b.item_id = n.item_id",
)
def j2_alias_lookup(spark, d):
    items = table(spark, d, "new_items").select(F.col("item_id").alias("tw_row"), "item_id", "seen_item_key", F.array("url").alias("own_urls"))
    entries = table(spark, d, "ledger").select(F.col("seen_item_key").alias("entry_key"), F.col("item_id").alias("entry_order"), "urls")
    found = identity.lookup(items, entries, "seen_item_key", "entry_key", "own_urls", "urls", "entry_order")
    return found.select("item_id", "matched_key", "matched_by")


@Q("j4_unknown", "SELECT item_id, institution FROM new_items n WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.seen_item_key = n.seen_item_key)")
def j4_unknown(spark, d):
    n, entries = table(spark, d, "new_items"), table(spark, d, "ledger")
    return n.select("item_id", "institution", "seen_item_key").join(entries.select("seen_item_key"), "seen_item_key", "left_anti").select("item_id", "institution")


@Q(
    "j11_counts_by_source",
    "WITH k AS (SELECT institution FROM candidates UNION SELECT institution FROM enriched_items UNION SELECT institution FROM new_items) SELECT institution, "
    "(SELECT count(*) FROM candidates c WHERE c.institution = k.institution) AS candidates, (SELECT count(*) FROM enriched_items e WHERE e.institution = k.institution) AS enriched, "
    "(SELECT count(*) FROM new_items n WHERE n.institution = k.institution) AS arrivals FROM k",
)
def j11_counts_by_source(spark, d):
    tables = {"candidates": table(spark, d, "candidates"), "enriched": table(spark, d, "enriched_items"), "arrivals": table(spark, d, "new_items")}
    return audit.side_by_side(tables, "institution")


@Q(
    "j14_sitemap_urls",
    "SELECT institution, regexp_replace(base_url, '/+$', '') || p AS url FROM sources, (SELECT unnest([" + "'/sitemap.xml', '/sitemap_index.xml', '/sitemap-index.xml', '/sitemap-news.xml', '/news-sitemap.xml', '/post-sitemap.xml', '/page-sitemap.xml'" + "]) AS p)",
)
def j14_sitemap_urls(spark, d):
    return feeds.sitemap_candidates(table(spark, d, "sources"))


@Q(
    "j16_hosts_of_sources",
    f"SELECT s.institution, count(*) AS n FROM (SELECT {_HOST} AS h FROM candidates) c JOIN sources s ON c.h = s.domain OR ends_with(c.h, '.' || s.domain) GROUP BY s.institution",
)
def j16_hosts_of_sources(spark, d):
    """A suffix match as an equality join: each host is exploded into the domains above it."""
    hosts = table(spark, d, "candidates").groupBy(ur.host_of(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))
    below = hosts.select(F.explode(ur.domain_suffixes(F.col("host"))).alias("domain"), "n")
    return below.join(table(spark, d, "sources").select("domain", "institution"), "domain").groupBy("institution").agg(F.sum("n").alias("n"))


@Q("j17_components")
def j17_components(spark, d):
    """Candidates that share a URL or canonical URL, directly or through others.  No SQL: iterative; tested by brute force."""
    c = table(spark, d, "candidates")
    links = c.select("candidate_id", F.explode(identity.aliases(ur.normalize_url(F.col("url")), ur.normalize_url(F.col("canonical_url")))).alias("alias"))
    return identity.components(links, "candidate_id", "alias")


# -- Aggregates -----------------------------------------------------------------


@Q(
    "a1_summary",
    " UNION ALL ".join(f"SELECT '{c}' AS dimension, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM candidates GROUP BY {c}" for c in ("institution", "discovery_method", "date_source", "item_type")),
)
def a1_summary(spark, d):
    return audit.counts_by(table(spark, d, "candidates"), ["institution", "discovery_method", "date_source", "item_type"])


@Q("a1_methods", "SELECT m AS method, count(*) AS n FROM (SELECT unnest(discovery_methods) AS m FROM candidates) GROUP BY m")
def a1_methods(spark, d):
    return table(spark, d, "candidates").select(F.explode("discovery_methods").alias("method")).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@Q(
    "a2_date_poor",
    "SELECT institution, count(*) AS rows, count(*) FILTER (WHERE date IS NULL OR trim(date) = '') AS flagged, round(count(*) FILTER (WHERE date IS NULL OR trim(date) = '') / count(*), 3) AS share "
    "FROM candidates GROUP BY institution HAVING count(*) FILTER (WHERE date IS NULL OR trim(date) = '') >= 0.08 * count(*)",
)
def a2_date_poor(spark, d):
    return audit.share_where(table(spark, d, "candidates"), "institution", F.coalesce(F.trim("date") == "", F.lit(True)), 0.08)


@Q(
    "a3_source_health",
    "SELECT institution, count(*) AS rows, count(*) FILTER (WHERE extraction_status = 'ok') AS ok, count(*) FILTER (WHERE http_status >= 400) AS http_errors, count(*) FILTER (WHERE paywall_detected) AS paywalled, "
    "count(*) FILTER (WHERE extracted_text IS NULL OR extracted_text = '') AS without_text, round(count(*) FILTER (WHERE extraction_status = 'ok') / count(*), 3) AS ok_rate, max(extracted_text_chars) AS longest FROM enriched_items GROUP BY institution",
)
def a3_source_health(spark, d):
    e = table(spark, d, "enriched_items")
    flags = {
        "ok": F.col("extraction_status") == "ok",
        "http_errors": F.col("http_status") >= 400,
        "paywalled": F.col("paywall_detected"),
        "without_text": F.coalesce(F.col("extracted_text") == "", F.lit(True)),
    }
    found = audit.conditional_counts(e, "institution", flags).withColumn("ok_rate", audit.rate(F.col("ok"), F.col("rows")))
    return found.join(e.groupBy("institution").agg(F.max("extracted_text_chars").alias("longest")), "institution")


@Q(
    "a4_topic_counts",
    "SELECT t AS topic, count(*) AS items FROM (SELECT unnest(CASE WHEN topic_hints IS NULL OR len(topic_hints) = 0 THEN [NULL] ELSE list_transform(topic_hints, lambda h: h.topic) END) AS t FROM enriched_items) GROUP BY t",
)
def a4_topic_counts(spark, d):
    return hints.topic_counts(table(spark, d, "enriched_items"), "topic_hints")


@Q(
    "a6_samples",
    "SELECT institution, total, array_to_string(list_sort(ids)[1:5], ',') AS examples FROM (SELECT institution, count(*) AS total, list(candidate_id) AS ids FROM candidates GROUP BY institution)",
)
def a6_samples(spark, d):
    found = audit.samples(table(spark, d, "candidates"), "institution", "candidate_id", 5)
    return found.select("institution", "total", F.array_join(F.transform("examples", lambda x: x.cast("string")), ",").alias("examples"))


@Q(
    "a10_outcomes",
    "SELECT institution, " + ", ".join(f"count(*) FILTER (WHERE item_type = '{t}') AS {t}" for t in ("report", "event", "podcast")) + " FROM candidates GROUP BY institution",
)
def a10_outcomes(spark, d):
    found = audit.matrix(table(spark, d, "candidates"), "institution", "item_type", ["report", "event", "podcast"], F.count(F.lit(1)))
    return found.na.fill(0, ["report", "event", "podcast"])


@Q(
    "a12_comparison",
    "SELECT url, max(CASE WHEN discovery_method = 'rss' THEN 'seen ' || n END) AS rss, max(CASE WHEN discovery_method = 'sitemap' THEN 'seen ' || n END) AS sitemap "
    "FROM (SELECT url, discovery_method, count(*) AS n FROM candidates GROUP BY ALL) GROUP BY url",
)
def a12_comparison(spark, d):
    c = table(spark, d, "candidates")
    counted = c.groupBy("url", "discovery_method").agg(F.count(F.lit(1)).alias("n"))
    return audit.matrix(counted, "url", "discovery_method", ["rss", "sitemap"], F.max(F.concat(F.lit("seen "), F.col("n").cast("string"))))


@Q("a13_tagged", "SELECT institution, count(*) FILTER (WHERE list_contains(discovery_methods, 'sitemap')) AS by_sitemap, count(*) FILTER (WHERE len(tags) > 0) AS tagged FROM candidates GROUP BY institution")
def a13_tagged(spark, d):
    c = table(spark, d, "candidates")
    return c.groupBy("institution").agg(F.count_if(F.exists("discovery_methods", lambda m: m == "sitemap")).alias("by_sitemap"), F.count_if(F.size("tags") > 0).alias("tagged"))


@Q(
    "a15_merged",
    "SELECT url, min(candidate_id) AS candidate_id, count(*) AS merged_rows, arg_min(author, candidate_id) FILTER (WHERE author IS NOT NULL AND author <> '') AS author, "
    "arg_max(coalesce(summary, ''), (length(coalesce(summary, '')), -candidate_id)) AS summary, array_to_string(list_sort(list_distinct(flatten(list(discovery_methods)))), ',') AS discovery_methods FROM candidates GROUP BY url",
)
def a15_merged(spark, d):
    found = merging.merge(table(spark, d, "candidates"), "url", "candidate_id", ["author"], ["summary"], ["discovery_methods"])
    return found.select("url", "candidate_id", "merged_rows", "author", F.coalesce("summary", F.lit("")).alias("summary"), F.array_join("discovery_methods", ",").alias("discovery_methods"))


@Q(
    "a16_ledger_merged",
    "SELECT institution, min(first_seen_run_date) AS first_seen_run_date, max(last_seen_run_date) AS last_seen_run_date, max(seen_run_count) AS seen_run_count, min(content_hash) AS content_hash, "
    "CAST(count(DISTINCT u) AS INTEGER) AS urls FROM (SELECT *, unnest(urls) AS u FROM ledger) GROUP BY institution",
)
def a16_ledger_merged(spark, d):
    found = ledger.merge_entries(table(spark, d, "ledger"), "institution", "item_id")
    return found.select("institution", "first_seen_run_date", "last_seen_run_date", "seen_run_count", "content_hash", F.size("urls").alias("urls"))


@Q(
    "a17_recent_titles",
    "WITH f AS (SELECT institution, title, min(candidate_id) AS place FROM candidates WHERE title IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY institution ORDER BY place DESC, title DESC) AS n FROM f) "
    "SELECT institution, string_agg(title, chr(10) ORDER BY place) AS titles FROM r WHERE n <= 12 GROUP BY institution",
)
def a17_recent_titles(spark, d):
    found = merging.recent_distinct(table(spark, d, "candidates"), "institution", "title", "candidate_id", 12)
    return found.select("institution", F.array_join("values", "\n").alias("titles"))


@Q(
    "a20_replay",
    "SELECT url AS key, min(scan_run_date) AS first_seen, max(scan_run_date) AS last_seen, count(DISTINCT scan_run_date) AS run_count FROM candidates GROUP BY url",
)
def a20_replay(spark, d):
    return ledger.sightings(table(spark, d, "candidates"), "url", "scan_run_date").withColumnRenamed("url", "key")


# -- Windows and order ------------------------------------------------------------


@Q(
    "w1_capped",
    "SELECT candidate_id, institution, CAST(n AS INTEGER) AS group_rank FROM (SELECT candidate_id, institution, row_number() OVER (PARTITION BY institution ORDER BY fetched_at DESC, candidate_id) AS n FROM candidates WHERE NOT list_contains(discovery_methods, 'rss')) WHERE n <= 25",
)
def w1_capped(spark, d):
    c = table(spark, d, "candidates").where(~F.array_contains("discovery_methods", "rss"))
    return ranking.cap_per_group(c, "institution", [F.desc("fetched_at"), F.asc("candidate_id")], 25).select("candidate_id", "institution", "group_rank")


@Q(
    "w5_round_robin",
    "SELECT candidate_id, institution FROM (SELECT candidate_id, institution, row_number() OVER (PARTITION BY institution ORDER BY candidate_id) AS n FROM candidates) ORDER BY n, institution LIMIT 100",
)
def w5_round_robin(spark, d):
    return ranking.round_robin(table(spark, d, "candidates"), "institution", [F.asc("candidate_id")], 100).select("candidate_id", "institution")


@Q("w7_first_rows", "SELECT arg_min(title, candidate_id) AS title, min(candidate_id) AS candidate_id, url FROM candidates GROUP BY url")
def w7_first_rows(spark, d):
    return merging.keep_first(table(spark, d, "candidates").select("candidate_id", "url", "title"), "url", "candidate_id")


@Q("w7_last_rows", "SELECT arg_max(title, candidate_id) AS title, max(candidate_id) AS candidate_id, url FROM candidates GROUP BY url")
def w7_last_rows(spark, d):
    return merging.keep_last(table(spark, d, "candidates").select("candidate_id", "url", "title"), "url", "candidate_id")


@Q("w8_folded")
def w8_folded(spark, d):
    """Order-dependent fold within a source; no SQL, tested against a plain loop."""
    c = table(spark, d, "candidates")
    rows = c.select("candidate_id", "institution", ur.normalize_url(F.coalesce(F.nullif("canonical_url", F.lit("")), F.col("url"))).alias("u"), tx.normal_title(F.col("title")).alias("t"))
    return merging.fold_titles(rows, "institution", "u", "t", "candidate_id", tx.telling_title(F.col("t"), []))


@Q(
    "w9_changes",
    "SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) <> event_type, false) AS changed FROM events",
)
def w9_changes(spark, d):
    return ranking.changes(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "previous", "changed")


@Q(
    "w11_sections",
    "SELECT event_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS INTEGER) AS section_no FROM "
    "(SELECT *, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NOT DISTINCT FROM event_type THEN 0 ELSE 1 END AS new FROM events)",
)
def w11_sections(spark, d):
    return ranking.sections(table(spark, d, "events"), "user_id", "event_type", ["ts", "event_id"]).select("event_id", "section_no")


@Q("o2_top", "SELECT candidate_id, institution FROM candidates ORDER BY length(title) DESC, candidate_id LIMIT 20")
def o2_top(spark, d):
    """A top-k report; Spark keeps k rows per task."""
    return table(spark, d, "candidates").orderBy(F.desc(F.length("title")), "candidate_id").limit(20).select("candidate_id", "institution")


@Q(
    "o9_batches",
    "SELECT item_id, CAST(floor((row_number() OVER (PARTITION BY institution ORDER BY item_id) - 1) / 3) AS INTEGER) AS batch_id, institution FROM new_items",
)
def o9_batches(spark, d):
    return ranking.batches(table(spark, d, "new_items"), "institution", [F.asc("item_id")], 3).select("item_id", "batch_id", "institution")


# -- Sets ------------------------------------------------------------------------


@Q(
    "x1_union",
    "SELECT 'candidate' AS origin, institution, url FROM candidates UNION ALL SELECT 'arrival', institution, url FROM new_items",
)
def x1_union(spark, d):
    c, n = table(spark, d, "candidates"), table(spark, d, "new_items")
    parts = [df.select(F.lit(o).alias("origin"), "institution", "url") for o, df in (("candidate", c), ("arrival", n))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)


@Q("x3_except", "SELECT url FROM candidates EXCEPT SELECT url FROM enriched_items")
def x3_except(spark, d):
    return table(spark, d, "candidates").select("url").subtract(table(spark, d, "enriched_items").select("url"))


@Q("x4_intersect", "SELECT seen_item_key FROM new_items INTERSECT SELECT seen_item_key FROM ledger")
def x4_intersect(spark, d):
    return table(spark, d, "new_items").select("seen_item_key").intersect(table(spark, d, "ledger").select("seen_item_key"))


@Q("x5_complete", "SELECT count(*) AS rows, sum(CASE WHEN item_type IN ('report', 'event', 'podcast') THEN 1 ELSE 0 END) = count(*) AS complete FROM candidates")
def x5_complete(spark, d):
    c = table(spark, d, "candidates")
    return c.agg(F.count(F.lit(1)).alias("rows"), (F.count_if(F.col("item_type").isin("report", "event", "podcast")) == F.count(F.lit(1))).alias("complete"))


# -- State and streams -----------------------------------------------------------

_UPSERT = (
    "SELECT key, min(first_seen) AS first_seen, max(last_seen) AS last_seen, CAST(sum(n) AS BIGINT) AS run_count FROM ("
    "SELECT seen_item_key AS key, first_seen_run_date AS first_seen, last_seen_run_date AS last_seen, seen_run_count AS n FROM ledger UNION ALL "
    "SELECT seen_item_key, min(scan_run_date), max(scan_run_date), count(DISTINCT scan_run_date) FROM new_items GROUP BY 1) GROUP BY key"
)


@Q("k2_upsert", _UPSERT)
def k2_upsert(spark, d):
    old = table(spark, d, "ledger").select(
        F.col("seen_item_key").alias("key"), F.col("first_seen_run_date").alias("first_seen"), F.col("last_seen_run_date").alias("last_seen"), F.col("seen_run_count").cast("bigint").alias("run_count")
    )
    new = ledger.sightings(table(spark, d, "new_items"), "seen_item_key", "scan_run_date").withColumnRenamed("seen_item_key", "key")
    return ledger.upsert(old, new)


@Q(
    "k1_checkpoints",
    "SELECT institution, max(CAST(fetched_at AS TIMESTAMP)) AS checkpoint, max(CAST(fetched_at AS TIMESTAMP)) - INTERVAL 6 HOURS AS resume_from FROM candidates GROUP BY institution",
)
def k1_checkpoints(spark, d):
    found = ledger.checkpoints(table(spark, d, "candidates"), "institution", "fetched_at")
    return found.select("institution", F.col("checkpoint").cast("timestamp_ntz").alias("checkpoint"), F.col("resume_from").cast("timestamp_ntz").alias("resume_from"))


@Q(
    "k3_stream_ledger",
    "SELECT seen_item_key AS key, min(scan_run_date) AS first_seen, max(scan_run_date) AS last_seen, count(DISTINCT scan_run_date) AS run_count FROM new_items GROUP BY 1",
)
def k3_stream_ledger(spark, d):
    """New items read as a stream and merged into a versioned ledger, micro-batch by micro-batch."""
    import uuid

    from tidewatch.session import materialize
    from tidewatch.streaming import ledger as stream

    n = table(spark, d, "new_items").select("seen_item_key", "scan_run_date")
    arrivals = f"{shared_dir(spark)}/arrivals-{uuid.uuid4().hex}"
    n.write.parquet(arrivals)
    kept = stream.ledger_table(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")
    source = spark.readStream.schema(n.schema).parquet(arrivals)
    stream.run_available(source, kept, f"{shared_dir(spark)}/progress-{uuid.uuid4().hex}", "seen_item_key", "scan_run_date")
    return materialize(kept.read().select("key", "first_seen", "last_seen", "run_count"), "ledger")


@Q(
    "k6_cache_status",
    "SELECT CASE WHEN c.seen IS NULL THEN 'miss' WHEN c.seen >= TIMESTAMP '2026-11-01 00:00:00' - INTERVAL 168 HOURS THEN 'fresh' ELSE 'stale' END AS cache_status, count(*) AS n "
    "FROM candidates k LEFT JOIN (SELECT url, max(CAST(captured_at AS TIMESTAMP)) AS seen FROM page_captures GROUP BY url) c ON c.url = k.url GROUP BY 1",
)
def k6_cache_status(spark, d):
    pages = table(spark, d, "page_captures").select(F.col("url").alias("cache_key"), F.col("captured_at").alias("cached_at"))
    requests = table(spark, d, "candidates").select(F.col("url").alias("cache_key"))
    found = state.cached(requests, pages, F.lit("2026-11-01 00:00:00").cast("timestamp"))
    return found.groupBy("cache_status").agg(F.count(F.lit(1)).alias("n"))


# -- Sources ----------------------------------------------------------------------


def _escaped(c: str):
    return F.replace(F.replace(F.replace(F.coalesce(F.col(c), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


@Q(
    "s1_feed_items",
    f"SELECT candidate_id, 1 AS item_no, {_squeeze('title')} AS title, {_strip('url')} AS url, CAST(fetched_at AS TIMESTAMP) - (CAST(fetched_at AS TIMESTAMP) - date_trunc('second', CAST(fetched_at AS TIMESTAMP))) AS published_at FROM candidates",
)
def s1_feed_items(spark, d):
    """Feed texts made of the candidates, read back by the feed reader."""
    c = table(spark, d, "candidates")
    xml = F.concat(
        F.lit("<rss><channel><item><title>"), _escaped("title"), F.lit("</title><link>"), _escaped("url"), F.lit("</link><pubDate>"),
        F.date_format(F.col("fetched_at"), "dd MMM yyyy HH:mm:ss"), F.lit(" GMT</pubDate></item></channel></rss>"),
    )
    found = feeds.feed_items(c.select("candidate_id", xml.alias("xml")), "candidate_id", "xml")
    return found.select("candidate_id", "item_no", "title", tx.strip_white(F.col("url")).alias("url"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))


@Q(
    "s4_sitemap_entries",
    f"SELECT institution, 'url' AS kind, {_strip('url')} AS url, CAST(scan_run_date AS VARCHAR) AS lastmod FROM candidates",
)
def s4_sitemap_entries(spark, d):
    """Sitemap texts of a source and run, read back entry by entry."""
    c = table(spark, d, "candidates")
    entry = F.concat(F.lit("<url><loc>"), _escaped("url"), F.lit("</loc><lastmod>"), F.col("scan_run_date").cast("string"), F.lit("</lastmod></url>"))
    maps = c.select("institution", "scan_run_date", entry.alias("e")).groupBy("institution", "scan_run_date").agg(F.array_join(F.collect_list("e"), "").alias("xml"))
    found = feeds.sitemap_entries(maps, "institution", "xml")
    return found.select("institution", "kind", tx.strip_white(F.col("url")).alias("url"), "lastmod")


@Q("s6_links", f"SELECT candidate_id, 1 AS no, {_squeeze('title')} AS title FROM candidates WHERE length({_squeeze('title')}) >= 8")
def s6_links(spark, d):
    """Index pages made of the candidates: the content link comes back, the navigation doesn't."""
    c = table(spark, d, "candidates")
    page = F.concat(
        F.lit('<html><body><nav><a href="/research/all-of-it">All research</a></nav><main><div><a href="'), F.replace(_escaped("url"), F.lit('"'), F.lit("&quot;")), F.lit('">'),
        _escaped("title"), F.lit("</a></div></main></body></html>"),
    )
    found = html.links(c.select("candidate_id", page.alias("html"), "url"), "candidate_id", "html", "url")
    return found.select("candidate_id", "no", "title")
