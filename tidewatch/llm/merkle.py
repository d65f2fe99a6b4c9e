"""Problem 4: records that differ only in how they are written.

Method: Merkle-style hashing from the leaves up.  Leaves are normalised and
hashed; a node hashes its children's digests, in order for ordered nodes and
sorted for unordered ones; records are grouped by their root digest and every
group is confirmed by comparing the normalised structure in full.

Scale.  The keyed rows (id, digest, normalised structure) are written once.
Grouping uses min, max and count only, which are combined on the map side: a
record with a third of all rows reaches the reducer as one row per map task.
A group whose smallest and largest structure agree is confirmed as a whole.
Groups that fail (two structures under one 128-bit digest) are grouped again
by the structure itself.  Copies are found by joining ids and digests, 24
bytes a row, with the groups of two or more; adaptive execution splits a hot
digest there.

Defined cases.  A null title counts as an empty one.  A null, empty or blank
canonical URL stands for the URL.  What is no usable URL is compared as its
stripped text.  Rows with a null id are left out of the pairs.  Rows that
repeat an id count as copies but yield no pair with themselves.  Of equal
smallest ids one is first.  Extra columns are ignored.
"""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.text import fold_case, strip_white
from tidewatch.functions.url import with_normal_urls
from tidewatch.session import materialize


def leaf(c: Column) -> Column:
    """Digest of a normalised leaf; null has one of its own."""
    return F.unhex(F.md5(F.concat(F.lit("L"), F.coalesce(c.cast("string"), F.lit("\x00")))))


def ordered(*children: Column) -> Column:
    """Digest of a node whose children stand in a fixed order."""
    return F.unhex(F.md5(F.concat(F.encode(F.lit("O"), "UTF-8"), *children)))


def unordered(children: Column) -> Column:
    """Digest of a node given as an array of digests whose order carries no meaning."""
    hexes = F.array_sort(F.transform(children, lambda d: F.hex(d)))
    return F.unhex(F.md5(F.concat(F.lit("U"), F.coalesce(F.array_join(hexes, ","), F.lit("\x00")))))


def named_fields(**fields: Column) -> Column:
    """Digest of a struct: name and child digest of each field, the order of fields not counting."""
    return unordered(F.array(*[ordered(leaf(F.lit(name)), child) for name, child in fields.items()]))


@F.pandas_udf(T.StringType())
def _composed(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def letters_and_digits(c: Column) -> Column:
    """Letters and digits in order, caseless and composed; '' for null."""
    ascii_only = c.rlike(r"^\p{ASCII}*$")
    composed = F.when(ascii_only, c).otherwise(_composed(F.when(~ascii_only, c)))
    return F.coalesce(F.regexp_replace(fold_case(composed), r"[^\p{L}\p{N}]+", ""), F.lit(""))


def keyed(records: DataFrame, key: str, url: str, canonical: str, title: str) -> DataFrame:
    """(tw_id, digest, structure): the root digest of each record and what it was made from."""
    rows = records.select(
        F.col(key).alias("tw_id"),
        F.col(url).alias("u"),
        F.when(strip_white(F.col(canonical)) != "", F.col(canonical)).alias("c"),
        F.col(title).alias("t"),
    )
    normal = with_normal_urls(rows.select("*", F.col("u").alias("normal_u"), F.col("c").alias("normal_c")), ["normal_u", "normal_c"])

    def url_leaf(c: str) -> Column:
        """The normal form, or the stripped text (marked) where there is none."""
        return F.coalesce(f"normal_{c}", F.concat(F.lit("="), F.coalesce(strip_white(F.col(c)), F.lit(""))))

    leaves = normal.select("tw_id", url_leaf("u").alias("u"), F.when(F.col("c").isNotNull(), url_leaf("c")).alias("c"), letters_and_digits(F.col("t")).alias("t"))
    leaves = leaves.withColumn("c", F.coalesce("c", "u"))
    root = named_fields(url=leaf(F.col("u")), canonical_url=leaf(F.col("c")), title=leaf(F.col("t")))
    # the canonical URL is mostly the URL itself; naming that case keeps the rows short
    structure = F.concat_ws("\n", "u", F.when(F.col("c") == F.col("u"), F.lit("")).otherwise(F.col("c")), "t")
    return leaves.select("tw_id", root.alias("digest"), structure.alias("structure"))


def records(rows: DataFrame, key: str = "candidate_id", url: str = "url", canonical: str = "canonical_url", title: str = "title") -> DataFrame:
    """(first_id, copies) of each record: its smallest id and its number of rows."""
    groups, _ = _confirmed(materialize(keyed(rows, key, url, canonical, title), "merkle"))
    return groups.select("first_id", F.col("n").alias("copies"))


def copies(rows: DataFrame, key: str = "candidate_id", url: str = "url", canonical: str = "canonical_url", title: str = "title") -> DataFrame:
    """(first_id, copy_id) of each further row of a record."""
    groups, members = _confirmed(materialize(keyed(rows, key, url, canonical, title), "merkle"))
    several = groups.where("n > 1").select("digest", "variant", "first_id")
    return members.join(several, ["digest", "variant"]).where("tw_id > first_id").select("first_id", F.col("tw_id").alias("copy_id"))


def _confirmed(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Groups (digest, variant, first_id, n) and members (digest, variant, tw_id).

    ``variant`` is null where the digest alone names one structure, else the
    structure itself.
    """
    rows = rows.where(F.col("tw_id").isNotNull())
    groups = rows.groupBy("digest").agg(
        F.min("tw_id").alias("first_id"), F.count(F.lit(1)).alias("n"), F.min("structure").alias("low"), F.max("structure").alias("high")
    )
    groups = materialize(groups.withColumn("same", F.col("low") == F.col("high")).drop("low", "high"), "merkle-groups")
    one = F.lit("").alias("variant")
    good = groups.where("same").select("digest", one, "first_id", "n")
    members = rows.select("digest", one, "tw_id")
    mixed = groups.where("NOT same").select("digest")
    if mixed.isEmpty():
        return good, members
    again = rows.join(mixed, "digest", "left_semi").withColumn("variant", F.concat(F.lit("="), "structure"))
    regrouped = again.groupBy("digest", "variant").agg(F.min("tw_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    return good.unionByName(regrouped), members.join(mixed, "digest", "left_anti").unionByName(again.select("digest", "variant", "tw_id"))
