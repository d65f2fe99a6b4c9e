"""Queries of the problems on training text, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.llm import incremental, merkle, packing, page_body, residue, sentences, site_lines, splitting, tokens
from tidewatch.plans.catalogue import Catalogue
from tidewatch.session import materialize, table

CATALOGUE = Catalogue()

_SITE_LINES = """
WITH lines AS (
  SELECT item_id, institution, unnest(l) AS key, unnest(range(1, len(l) + 1)) AS line_no
  FROM (SELECT item_id, institution,
               string_split(regexp_replace(replace(lower(upper(extracted_text)), 'ς', 'σ'), '[^\\p{L}\\p{N}\\n]+', '', 'g'), chr(10)) AS l
        FROM enriched_items)),
totals AS (SELECT institution, count(*) AS n FROM enriched_items GROUP BY institution),
frequent AS (
  SELECT institution, key, count(DISTINCT item_id) AS documents
  FROM lines WHERE key <> '' GROUP BY institution, key),
chosen AS (
  SELECT f.institution, f.key, f.documents, t.n AS source_rows FROM frequent f JOIN totals t ON t.institution = f.institution
  WHERE f.documents >= 5 AND f.documents >= 0.05 * t.n)
"""


@CATALOGUE.query(
    "p1_found",
    _SITE_LINES + "SELECT l.item_id, CAST(l.line_no AS INTEGER) AS line_no FROM lines l JOIN chosen c ON l.institution = c.institution AND l.key = c.key",
)
def p1_found(spark, sf_dir):
    return site_lines.find(table(spark, sf_dir, "enriched_items"))


@CATALOGUE.query(
    "p1_sources",
    _SITE_LINES + "SELECT institution, count(*) AS frequent_lines, max(documents) AS most_documents, max(source_rows) AS source_rows FROM chosen GROUP BY institution",
)
def p1_sources(spark, sf_dir):
    lines = site_lines.frequent_lines(table(spark, sf_dir, "enriched_items"))
    return lines.groupBy(F.col("tw_source").alias("institution")).agg(
        F.count(F.lit(1)).alias("frequent_lines"), F.max("documents").alias("most_documents"), F.max("source_rows").alias("source_rows")
    )


@CATALOGUE.query("p1_clean")
def p1_clean(spark, sf_dir):
    items = table(spark, sf_dir, "enriched_items").select("item_id", "institution", "extracted_text")
    return site_lines.clean(items)


@CATALOGUE.query("p4_found")
def p4_found(spark, sf_dir):
    return merkle.copies(table(spark, sf_dir, "candidates"))


@CATALOGUE.query("p4_records")
def p4_records(spark, sf_dir):
    return merkle.records(table(spark, sf_dir, "candidates"))


@CATALOGUE.query("p7_found", "SELECT item_id FROM enriched_items WHERE length(extracted_text) > 12000")
def p7_found(spark, sf_dir):
    return splitting.oversized(table(spark, sf_dir, "enriched_items"))


@CATALOGUE.query("p7_pieces")
def p7_pieces(spark, sf_dir):
    return splitting.pieces(table(spark, sf_dir, "enriched_items"))


@CATALOGUE.query("p8_ids")
def p8_ids(spark, sf_dir):
    return tokens.token_ids(table(spark, sf_dir, "documents"))


@CATALOGUE.query("p9_containers")
def p9_containers(spark, sf_dir):
    return packing.containers(_sizes(spark, sf_dir))


@CATALOGUE.query("p9_fill")
def p9_fill(spark, sf_dir):
    """How full each container is."""
    bins = packing.containers(_sizes(spark, sf_dir)).groupBy("bin_id")
    return bins.agg(F.count(F.lit(1)).alias("items"), F.sum("n_tokens").alias("n_tokens"), F.max("capacity").alias("capacity"))


@CATALOGUE.query("p9_lengths")
def p9_lengths(spark, sf_dir):
    """Containers of several permitted lengths, each as short as its content allows."""
    return packing.containers(_sizes(spark, sf_dir), capacities=packing.LENGTHS)


@CATALOGUE.query("p9_costs")
def p9_costs(spark, sf_dir):
    """Containers, room and fill with one permitted length and with several."""
    sizes, found = _sizes(spark, sf_dir), None
    for name, lengths in (("one", {packing.CAPACITY: packing.LENGTHS[packing.CAPACITY]}), ("several", packing.LENGTHS)):
        bins = packing.containers(sizes, capacities=lengths).groupBy("bin_id").agg(F.sum("n_tokens").alias("n"), F.max("capacity").alias("room"))
        row = bins.agg(F.count(F.lit(1)).alias("containers"), F.sum("n").alias("n_tokens"), F.sum("room").alias("room")).select(F.lit(name).alias("lengths"), "*")
        found = row if found is None else found.unionByName(row)
    return found.withColumn("fill", F.round(F.col("n_tokens") / F.col("room"), 4))


def _sizes(spark, sf_dir):
    return materialize(tokens.token_counts(table(spark, sf_dir, "documents")), "token-counts")


@CATALOGUE.query("p10_found")
def p10_found(spark, sf_dir):
    return sentences.sentence_ends(table(spark, sf_dir, "documents"))


@CATALOGUE.query("p5_found")
def p5_found(spark, sf_dir):
    return incremental.deduplicate(table(spark, sf_dir, "ledger"), table(spark, sf_dir, "new_items"))


@CATALOGUE.query("p3_found")
def p3_found(spark, sf_dir):
    return page_body.find(table(spark, sf_dir, "page_captures"))


@CATALOGUE.query("p6_found")
def p6_found(spark, sf_dir):
    return residue.found(table(spark, sf_dir, "enriched_items"))
