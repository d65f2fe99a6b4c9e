"""Problem 1: lines that a site puts into very many of its documents.

Method: hash the normalised lines, count distinct documents per source and
hash, threshold by the share of the source's documents, join back, rebuild the
documents without the frequent lines.

Scale.  The only shuffle is that of the counts, which are combined on the map
side, so a source or a line that holds a third of all rows arrives as one row
per map task.  The frequent lines are few by construction: with a share ``s``
and ``m`` lines per document on average, a source has at most ``m / s`` of
them.  They are written out, counted and broadcast only below
``BROADCAST_BYTES``; beyond it the join shuffles and adaptive execution splits
hot keys.  Texts are never shuffled.

Defined cases.  A null text has no lines and stays null; an empty text is one
line without letters and stays as it is.  Every input row is one document, so
repeated rows count as often as they stand there.  Rows without a source form
one source of their own.  Extra columns are ignored by ``find`` and kept by
``clean``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import digest128, fold_case
from tidewatch.session import broadcast_if_small, materialize

MIN_DOCUMENTS = 5
MIN_SHARE = 0.05


def line_keys(text: Column) -> Column:
    """The array of line keys: letters and digits in order, caseless; '' for a line with none."""
    return F.split(F.regexp_replace(fold_case(text), r"[^\p{L}\p{N}\n]+", ""), "\n", -1)


def frequent_lines(
    docs: DataFrame,
    source: str = "institution",
    text: str = "extracted_text",
    min_documents: int = MIN_DOCUMENTS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(tw_source, h1, h2, documents, source_rows) of each line to be removed."""
    rows = docs.select(F.col(source).alias("tw_source"), F.col(text).alias("tw_text"))
    totals = rows.groupBy(F.col("tw_source").alias("tw_all")).agg(F.count(F.lit(1)).alias("source_rows"))
    # array_distinct makes a line count once per document without a distinct aggregate
    lines = rows.select("tw_source", F.explode(F.array_distinct(line_keys(F.col("tw_text")))).alias("key"))
    h1, h2 = digest128(F.col("tw_source"), F.col("key"))
    counts = (
        lines.where(F.col("key") != "")
        .select("tw_source", h1.alias("h1"), h2.alias("h2"))
        .groupBy("tw_source", "h1", "h2")
        .agg(F.count(F.lit(1)).alias("documents"))
        .where(F.col("documents") >= min_documents)
    )
    return (
        counts.join(totals, F.col("tw_source").eqNullSafe(F.col("tw_all")))
        .where(F.col("documents") >= F.lit(min_share) * F.col("source_rows"))
        .drop("tw_all")
    )


def find(
    docs: DataFrame,
    key: str = "item_id",
    source: str = "institution",
    text: str = "extracted_text",
    min_documents: int = MIN_DOCUMENTS,
    min_share: float = MIN_SHARE,
) -> DataFrame:
    """(key, line_no) of each line to be removed, lines numbered from 1."""
    frequent = materialize(frequent_lines(docs, source, text, min_documents, min_share).select("h1", "h2"), "site-lines")
    rows = docs.select(F.col(key).alias("tw_key"), F.col(source).alias("tw_source"), F.col(text).alias("tw_text"))
    lines = rows.select("tw_key", "tw_source", F.posexplode(line_keys(F.col("tw_text"))).alias("pos", "key"))
    h1, h2 = digest128(F.col("tw_source"), F.col("key"))
    hashed = lines.where(F.col("key") != "").select("tw_key", "pos", h1.alias("h1"), h2.alias("h2"))
    return hashed.join(broadcast_if_small(frequent), ["h1", "h2"], "left_semi").select(
        F.col("tw_key").alias(key), (F.col("pos") + 1).cast("int").alias("line_no")
    )


def clean(
    docs: DataFrame,
    source: str = "institution",
    text: str = "extracted_text",
    min_documents: int = MIN_DOCUMENTS,
    min_share: float = MIN_SHARE,
    keep: Column | None = None,
) -> DataFrame:
    """``docs`` with ``text`` rebuilt without its frequent lines and a column ``lines_removed``.

    Counts are taken over all documents; with ``keep`` only those it is true
    for are rebuilt and come out.

    The frequent lines of a source travel as one array (at most
    ``average lines / share`` entries), so documents are rebuilt in place.
    """
    frequent = frequent_lines(docs, source, text, min_documents, min_share)  # of all of them
    per_source = materialize(
        frequent.groupBy("tw_source").agg(F.collect_list(F.struct("h1", "h2")).alias("tw_frequent")), "site-line-sets"
    )
    columns = docs.columns
    docs = docs if keep is None else docs.where(keep)
    # the document's own columns stand apart, whatever they are called
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("tw_doc"))
    own, body = F.col("tw_doc").getField(source), F.col("tw_doc").getField(text)
    joined = whole.join(broadcast_if_small(per_source), own.eqNullSafe(F.col("tw_source")), "left")
    lines = F.split(body, "\n", -1)

    def kept(pair: Column) -> Column:
        key = pair["key"]
        h1, h2 = digest128(own, key)
        hit = F.array_contains(F.col("tw_frequent"), F.struct(h1.alias("h1"), h2.alias("h2")))
        return (key == "") | ~F.coalesce(hit, F.lit(False))

    pairs = F.arrays_zip(lines.alias("line"), line_keys(body).alias("key"))
    left = F.filter(pairs, kept)
    rebuilt = F.array_join(F.transform(left, lambda p: p["line"]), "\n")
    return joined.select(
        *[F.col("tw_doc").getField(c).alias(c) for c in columns if c != text],
        F.when(body.isNotNull(), rebuilt).alias(text),
        F.when(body.isNotNull(), F.size(lines) - F.size(left)).otherwise(0).alias("lines_removed"),
    )
