"""Keyword hints: which topics of a lexicon a text speaks of."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.text import squeeze

#: What may not stand beside a keyword: letters, digits and underscores of any script.
EDGE = r"\p{L}\p{N}_"


def hints(text: Column, lexicon: Mapping[str, Sequence[str]]) -> Column:
    """array<struct<topic, matched_keywords, score>>, best score first, then in the lexicon's order.

    One pass over the text, in the JVM: all keywords stand in one alternation,
    longest first, looked ahead for at every word's beginning, so matches may
    overlap.  A keyword that begins a longer one found is there as well.  There
    is no join of texts with keywords.
    """
    words = sorted({_spaced(w) for ws in lexicon.values() for w in ws}, key=lambda w: (-len(w), w))
    if not words:
        return F.array().cast("array<struct<topic:string,matched_keywords:array<string>,score:int>>")
    pattern = rf"(?<![{EDGE}])(?=({'|'.join(map(re.escape, words))})(?![{EDGE}]))"
    met = F.array_distinct(F.regexp_extract_all(squeeze(text), F.lit(pattern), 1))
    begun = {w: [v for v in words if v != w and re.match(rf"{re.escape(v)}(?!\w)", w)] for w in words}
    longer = {w: vs for w, vs in begun.items() if vs}
    if longer:
        also = F.create_map(*[x for w, vs in longer.items() for x in (F.lit(w), F.array(*map(F.lit, vs)))])
        met = F.array_union(met, F.flatten(F.transform(F.filter(met, lambda w: F.map_contains_key(also, w)), lambda w: F.element_at(also, w))))

    def of(met: Column) -> Column:
        found = []
        for number, (topic, keywords) in enumerate(lexicon.items()):
            own = F.array(*[F.struct(F.lit(_spaced(w)).alias("met"), F.lit(w).alias("word")) for w in sorted(set(keywords))])
            matched = F.transform(F.filter(own, lambda p: F.array_contains(met, p["met"])), lambda p: p["word"])
            found.append(F.struct((-F.size(matched)).alias("rank"), F.lit(number).alias("no"), F.lit(topic).alias("topic"), matched.alias("matched_keywords")))
        kept = F.array_sort(F.filter(F.array(*found), lambda h: F.size(h["matched_keywords"]) > 0))
        return F.transform(kept, lambda h: F.struct(h["topic"].alias("topic"), h["matched_keywords"].alias("matched_keywords"), F.size(h["matched_keywords"]).alias("score")))

    # evaluated once: a lambda's variable stands for it in all that follows
    none = F.array().cast("array<struct<topic:string,matched_keywords:array<string>,score:int>>")
    return F.coalesce(F.when(text.isNotNull(), F.element_at(F.transform(F.array(met), of), 1)), none)


def _spaced(keyword: str) -> str:
    return " ".join(keyword.lower().split())


def topic_counts(rows: DataFrame, hints_column: str) -> DataFrame:
    """(topic, items): rows by topic, null for those without any."""
    return rows.select(F.explode_outer(F.col(hints_column)).alias("h")).groupBy(F.col("h.topic").alias("topic")).agg(F.count(F.lit(1)).alias("items"))
