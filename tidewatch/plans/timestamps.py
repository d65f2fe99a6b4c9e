"""Queries of problem 2."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import timestamps
from tidewatch.plans.catalogue import Catalogue
from tidewatch.session import broadcast_if_small, table

CATALOGUE = Catalogue()


@CATALOGUE.query("p2_found")
def p2_found(spark, sf_dir):
    return timestamps.normalise(table(spark, sf_dir, "candidates"), table(spark, sf_dir, "sources"))


@CATALOGUE.query("p2_zones")
def p2_zones(spark, sf_dir):
    """Zones estimated from the values alone, with the registry held out, beside the registered ones.

    ``same_offsets`` tells whether both had the same offsets on every day of
    two years; zones that did can't be told apart by any text.
    """
    candidates, sources = table(spark, sf_dir, "candidates"), table(spark, sf_dir, "sources")
    zones = sorted({r["time_zone"] for r in sources.select("time_zone").distinct().collect() if r["time_zone"]})
    orders = broadcast_if_small(sources.select("institution", sources["date_order"].alias("tw_order")))
    estimated = timestamps.estimate_zones(candidates.join(orders, "institution", "left"), zones, "institution", timestamps.FIELDS, "fetched_at")
    registered = sources.select("institution", sources["time_zone"].alias("registered_zone"))
    offsets = spark.createDataFrame([(z, timestamps.offsets_of(z, 2025, 2)) for z in zones], "zone string, offsets array<int>")
    both = estimated.join(registered, "institution", "left")
    for c in ("time_zone", "registered_zone"):
        both = both.join(offsets.select(F.col("zone").alias(c), F.col("offsets").alias(f"of_{c}")), c, "left")
    return both.select("institution", "time_zone", "violations", "readings", "registered_zone", (F.col("of_time_zone") == F.col("of_registered_zone")).alias("same_offsets"))
