"""URL normalisation, evaluated in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import strip_white

# Query keys that only track the visitor.
TRACKING_PREFIX = "utm_"
TRACKING_KEYS = ("fbclid", "gclid", "mc_cid", "mc_eid")
# Default ports, and characters that never need an escape.
DEFAULT_PORT = {"http": 80, "https": 443}
UNRESERVED = "A-Za-z0-9._~-"

#: A URL for which normalising means no more than dropping trailing slashes.
PLAIN = r"^https?://[a-z0-9-]+(\.[a-z0-9-]+)+(/[A-Za-z0-9._~-]+)*/*$"
#: Scheme, authority, path and query.
PARTS = r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(?:\?([^#]*))?.*$"
GLUED = r"https?://"


def _plain_escapes(path: Column) -> Column:
    """Escapes of characters that need none are undone, the others written in upper case."""
    pieces = F.split(path, "%", -1)

    def piece(p: Column) -> Column:
        code, rest = F.substring(p, 1, 2), F.substring(p, 3, 1 << 30)
        sign = F.char(F.conv(code, 16, 10).cast("int"))
        escape = F.when(sign.rlike(f"^[{UNRESERVED}]$"), sign).otherwise(F.concat(F.lit("%"), F.upper(code)))
        return F.when(code.rlike("^[0-9A-Fa-f]{2}$"), F.concat(escape, rest)).otherwise(F.concat(F.lit("%"), p))

    undone = F.concat(F.get(pieces, F.lit(0)), F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), piece), ""))
    return F.when(path.contains("%"), undone).otherwise(path)


def _decoded(c: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25"))


def _encoded(c: Column) -> Column:
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _plain_query(query: Column) -> Column:
    """Fields that track nobody, sorted unless a key is repeated: the order of repeated keys can carry meaning."""
    fields = F.filter(F.split(query, "&", -1), lambda f: f != "")
    pairs = F.transform(
        fields, lambda f: F.struct(_decoded(F.regexp_extract(f, "(?s)^([^=]*)", 1)).alias("k"), _decoded(F.regexp_extract(f, "(?s)^[^=]*=(.*)$", 1)).alias("v"))
    )
    kept = F.filter(pairs, lambda p: ~F.lower(p["k"]).isin(*TRACKING_KEYS) & ~F.lower(p["k"]).startswith(TRACKING_PREFIX))
    once = F.size(F.array_distinct(F.transform(kept, lambda p: p["k"]))) == F.size(kept)
    ordered = F.when(once, F.array_sort(kept)).otherwise(kept)
    return F.array_join(F.transform(ordered, lambda p: F.concat(_encoded(p["k"]), F.lit("="), _encoded(p["v"]))), "&")


def _raw(c: Column) -> Column:
    return F.translate(strip_white(c), "\t\r\n", "")


def _parts(raw: Column) -> Column:
    """[scheme, authority, path, query] of what isn't plain; null for plain URLs, one element for what is no URL."""
    return F.when(~raw.rlike(PLAIN), F.split(F.regexp_replace(raw, PARTS, "$1\n$2\n$3\n$4"), "\n"))


def _normal(raw: Column, parts: Column) -> Column:
    slashless = F.rtrim(raw, F.lit("/"))
    plain = F.when(F.length(slashless) - F.length(F.replace(slashless, F.lit("/"))) == 2, F.concat(slashless, F.lit("/"))).otherwise(slashless)

    scheme, authority = F.lower(F.get(parts, F.lit(0))), F.lower(F.get(parts, F.lit(1)))
    whole, query = F.get(parts, F.lit(2)), F.get(parts, F.lit(3))
    port = F.regexp_extract(authority, r":([^:@\]]*)$", 1)
    usable = scheme.isin(*DEFAULT_PORT) & (authority != "") & (authority.contains("[") == authority.contains("]"))
    usable &= ~authority.contains(":") | (port == "") | port.rlike("^0*([0-9]{1,4}|[1-5][0-9]{4}|6[0-4][0-9]{3}|65[0-4][0-9]{2}|655[0-2][0-9]|6553[0-5])$")
    usable &= ~(F.lower(whole).contains("://") | authority.contains(":")) | (~F.lower(F.concat(authority, whole)).rlike(GLUED) & ~authority.rlike("https?:$"))  # a second URL glued to the first
    bare = F.when(scheme == "http", F.regexp_replace(authority, ":0*80$", "")).otherwise(F.regexp_replace(authority, ":0*443$", ""))
    host = F.when(authority.contains(":"), bare).otherwise(authority)
    # parameters of the last segment stand outside the path
    base = F.when(whole.contains(";"), F.regexp_extract(whole, "(?s)^((?:.*/)?[^/;]*)", 1)).otherwise(whole)
    params = F.when(whole.contains(";"), F.regexp_extract(whole, "(?s)^(?:.*/)?[^/;]*(;[^/]+)$", 1)).otherwise("")
    path = F.rtrim(base, F.lit("/"))
    tail = F.when(query == "", F.lit("")).otherwise(_plain_query(query))
    rest = F.concat(scheme, F.lit("://"), host, F.when(path == "", F.lit("/")).otherwise(_plain_escapes(path)), params, F.when(query == "", "").otherwise(F.regexp_replace(F.concat(F.lit("?"), tail), r"^\?$", "")))
    return F.when(parts.isNull(), plain).when(usable, rest)


def normalize_url(c: Column) -> Column:
    """Normal form of a URL; '' for null and for what is not a usable http(s) URL."""
    raw = _raw(c)
    return F.coalesce(_normal(raw, _parts(raw)), F.lit(""))


def with_normal_urls(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``rows`` with each of ``columns`` in normal form, null where there is none.

    The same as ``normalize_url``, but what is used several times is a column
    of its own and is evaluated once.
    """
    kept = rows.columns
    rows = rows.select(*kept, *[_raw(F.col(c)).alias(f"tw_raw_{c}") for c in columns])
    rows = rows.select("*", *[_parts(F.col(f"tw_raw_{c}")).alias(f"tw_parts_{c}") for c in columns])
    return rows.select(*[_normal(F.col(f"tw_raw_{c}"), F.col(f"tw_parts_{c}")).alias(c) if c in columns else c for c in kept])


def host_of(c: Column) -> Column:
    """Lower-case host without port and user."""
    return F.lower(F.regexp_extract(strip_white(c), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def path_of(c: Column) -> Column:
    """Path of a URL, lower case; '' if there is none."""
    return F.lower(F.regexp_extract(strip_white(c), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))


def cache_url(c: Column) -> Column:
    """The looser form under which pages are cached: lower-case scheme and host, no trailing slash, no fragment."""
    parts = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)([^?#;]*)(?:;[^?#]*)?(\?[^#]*)?.*$"
    raw = strip_white(c)
    path = F.regexp_extract(raw, parts, 2)
    bare = F.regexp_replace(path, "/+$", "")
    return F.concat(F.lower(F.regexp_extract(raw, parts, 1)), F.when(bare == "", path).otherwise(bare), F.regexp_replace(F.regexp_extract(raw, parts, 3), r"^\?$", ""))


def item_type(c: Column) -> Column:
    """Kind of item by its path: event, podcast or report."""
    path = path_of(c)
    return F.when(path.contains("/event"), "event").when(path.rlike("/podcast|/video"), "podcast").otherwise("report")


def within_domain(host: Column, domain: Column) -> Column:
    """The domain itself or a name below it."""
    return (host == F.lower(domain)) | host.endswith(F.concat(F.lit("."), F.lower(domain)))


def domain_suffixes(host: Column) -> Column:
    """The host and all domains above it, for equality joins with a registry of domains."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))


def _without_dots(path: Column) -> Column:
    """A path without ``.`` and ``..`` segments."""
    start = F.array().cast("array<string>")
    kept = F.aggregate(
        F.split(path, "/", -1), start,
        lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(1)))).when(s == ".", done).otherwise(F.concat(done, F.array(s))),
    )
    ends = F.when(path.rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit(""))
    return F.when(path.rlike(r"(^|/)\.{1,2}(/|$)"), F.concat(F.array_join(kept, "/"), ends)).otherwise(path)


def resolve_canonical(raw: Column, fallback: Column) -> Column:
    """A stated canonical URL made absolute, else the page's own.

    The statement counts if it is an http(s) URL on the page's host, ``www.``
    not counting, and isn't the root of a deeper page.
    """
    page, said = (strip_white(F.regexp_extract(F.coalesce(c, F.lit("")), "(?s)^([^#]*)", 1)) for c in (fallback, raw))
    said = F.when(said == "", page).otherwise(said)

    def part(url: Column, i: int) -> Column:
        return F.regexp_extract(url, r"(?s)^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)(\?.+)?$", i)

    origin, own_path = F.concat(part(page, 1), F.lit("://"), part(page, 2)), part(page, 3)
    path, query = F.regexp_extract(said, "(?s)^([^?]*)", 1), F.regexp_extract(said, r"(?s)(\?.*)$", 1)
    folder = F.concat(F.regexp_extract(own_path, "(?s)^(.*/)?", 0), F.when(own_path == "", F.lit("/")).otherwise(F.lit("")))
    absolute = (
        F.when(said.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), said)
        .when(said.startswith("//"), F.concat(part(page, 1), F.lit(":"), said))
        .when(said.startswith("/"), F.concat(origin, _without_dots(path), query))
        .when(said.startswith("?"), F.concat(origin, own_path, said))
        .otherwise(F.concat(origin, _without_dots(F.concat(folder, path)), query))
    )
    scheme, authority, found = F.lower(part(absolute, 1)), F.lower(part(absolute, 2)), part(absolute, 3)
    host, own_host = (F.regexp_replace(host_of(u), r"^www\.", "") for u in (absolute, page))
    counts = scheme.isin("http", "https") & (authority != "") & (host == own_host)
    counts &= ~F.lower(F.concat(authority, found)).rlike(GLUED) & ~authority.rlike("https?:$")
    counts &= ~(found.isin("", "/") & ~own_path.isin("", "/"))
    stated = F.concat(scheme, F.lit("://"), authority, F.when(found == "", F.lit("/")).otherwise(found), part(absolute, 4))
    return F.when(counts, stated).otherwise(page)
