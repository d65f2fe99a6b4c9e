"""Identity of items: keys, aliases, lookups against a ledger, and merged identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import normal_title
from tidewatch.functions.url import normalize_url
from tidewatch.session import materialize


def identity(canonical: Column, url: Column, institution: Column, title: Column) -> Column:
    """struct(kind, value): the canonical URL, else the URL, else source and title."""
    by_url = F.coalesce(F.nullif(normalize_url(canonical), F.lit("")), F.nullif(normalize_url(url), F.lit("")))
    by_title = F.concat(normal_title(institution), F.lit("|"), normal_title(title))
    return F.struct(F.when(by_url.isNotNull(), "url").otherwise("title").alias("kind"), F.coalesce(by_url, by_title).alias("value"))


def identity_key(kind: Column, value: Column) -> Column:
    text = F.concat(kind, F.lit(":"), value)
    return F.concat(kind, F.lit(":"), F.sha2(text, 256))


def aliases(*urls: Column) -> Column:
    """The distinct non-empty URLs of an item."""
    return F.array_distinct(F.filter(F.array(*urls), lambda u: u.isNotNull() & (u != "")))


def lookup(items: DataFrame, ledger: DataFrame, key: str, ledger_key: str, items_aliases: str, ledger_aliases: str, order: str) -> DataFrame:
    """``items`` with ``matched_key`` and ``matched_by`` (key or alias); of several entries the first by ``order``.

    Aliases are exploded on both sides and joined by value, never compared in
    pairs.  ``items`` must have a column ``tw_row`` that names the row.
    """
    entries = ledger.select(F.col(ledger_key).alias("tw_entry"), F.col(order).alias("tw_order"), F.explode_outer(ledger_aliases).alias("tw_alias"))
    own = items.select("tw_row", F.explode(items_aliases).alias("tw_alias")).where("tw_alias <> ''")
    by_alias = own.join(entries.where("tw_alias <> ''"), "tw_alias").groupBy("tw_row").agg(F.min_by("tw_entry", "tw_order").alias("tw_by_alias"))
    keys = ledger.select(F.col(ledger_key).alias("tw_by_key")).distinct()
    found = items.join(keys, F.col(key) == F.col("tw_by_key"), "left").join(by_alias, "tw_row", "left")
    how = F.when(F.col("tw_by_key").isNotNull(), "key").when(F.col("tw_by_alias").isNotNull(), "alias")
    return found.withColumn("matched_key", F.coalesce("tw_by_key", "tw_by_alias")).withColumn("matched_by", how).drop("tw_by_key", "tw_by_alias")


def components(links: DataFrame, node: str, value: str) -> DataFrame:
    """(node, component): nodes that share values, directly or through others; the smallest node names them.

    Nodes and values take turns in passing on the smallest node they know
    until nothing changes; a value that a third of all nodes have is one row
    per map task in each turn.  Lineage is cut by tables.
    """
    edges = materialize(links.select(F.col(node).alias("n"), F.col(value).alias("v")).where("n IS NOT NULL AND v IS NOT NULL").distinct(), "links")
    label = materialize(edges.select("n").distinct().withColumn("c", F.col("n")), "labels")
    while True:
        by_value = edges.join(label, "n").groupBy("v").agg(F.min("c").alias("c"))
        near = edges.join(by_value, "v").groupBy("n").agg(F.min("c").alias("near"))
        # a component's own label may have found a smaller one: jump there as well
        roots = label.select(F.col("n").alias("c"), F.col("c").alias("root"))
        after = label.join(near, "n").join(roots, "c", "left").select("n", F.col("c").alias("before"), F.least("c", "near", "root").alias("c"))
        after = materialize(after, "labels")
        if after.where("before <> c").isEmpty():
            return after.select(F.col("n").alias(node), F.col("c").alias("component"))
        label = after.select("n", "c")
