"""Problem 7: items above a size limit, cut into overlapping pieces at natural boundaries.

Method (balanced targets): compute the smallest number of pieces, place cuts
for pieces of equal length, move every cut to the strongest boundary near it,
and take one piece more whenever a piece would exceed the limit.

Scale.  A filter on the length runs in the JVM before any Python; only the
texts that must be cut are handed over.  There is no shuffle.  The work on a
text is linear in its length for each number of pieces tried.

Defined cases.  Null texts yield nothing.  Texts within the limit, empty ones
included, yield nothing from ``pieces`` unless ``whole`` is set; they then come
out as one piece.  Every row is cut for itself, so repeated rows come out
repeatedly.  Pieces joined without their overlaps give the text back exactly.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 12_000
OVERLAP = 200

#: Boundaries, strongest first; a match's end is where a cut may stand.
BOUNDARIES = (
    re.compile(r"\n[^\S\n]*\n\s*"),
    re.compile(r"\n"),
    re.compile("(?:[.!?…][\"'”’»)\\]]*\\s+|[。！？]+[”’」』）]*|[।؟]\\s*)"),
    re.compile(r"[,;:、，；：—]\s*"),
    re.compile(r"\s+"),
)


def _inside_character(text: str, at: int) -> bool:
    """True if a cut at ``at`` would part a letter from its marks."""
    if not 0 < at < len(text):
        return False
    return unicodedata.category(text[at])[0] == "M" or text[at] in "‍️" or text[at - 1] == "‍"


def _snap(text: str, target: int, reach: int, low: int, high: int) -> int:
    """The cut in [low, high] for ``target``: the strongest boundary within ``reach``, the nearest of equals."""
    a, b = max(low, target - reach), min(high, target + reach)
    if a > b:
        return min(max(target, low), high)
    window = text[a:b]
    for pattern in BOUNDARIES:
        ends = [a + m.end() for m in pattern.finditer(window)]
        ends = [e for e in ends if a <= e <= b]
        if ends:
            return min(ends, key=lambda e: (abs(e - target), e))
    at = min(max(target, a), b)
    while at > a and _inside_character(text, at):
        at -= 1
    return at


def cut(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """The (start, end) of each piece of ``text``."""
    if not 0 <= overlap < limit:
        raise ValueError("the overlap must be smaller than the limit")
    n = len(text)
    if n <= limit:
        return [(0, n)]
    count = -(-(n - overlap) // (limit - overlap))
    while True:
        length = (n + (count - 1) * overlap) / count
        reach = max(1, int(min(length, limit) // 8))
        cuts = [0]
        for i in range(1, count):
            target = round(i * length - (i - 1) * overlap)
            # a cut leaves the piece before it within the limit, and something new in it
            most = cuts[-1] + limit - (overlap if i > 1 else 0)
            cuts.append(_snap(text, target, reach, max(cuts[-1] + 1, overlap + 1), min(most, n - 1)))
        cuts.append(n)
        spans = [(max(0, a - overlap) if i else 0, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
        if all(a < b and b - a <= limit for a, b in spans) and all(x < y for x, y in zip(cuts, cuts[1:])):
            return spans
        count += 1


def pieces(
    items: DataFrame,
    key: str = "item_id",
    text: str = "extracted_text",
    limit: int = LIMIT,
    overlap: int = OVERLAP,
    whole: bool = False,
) -> DataFrame:
    """(key, piece_no, pieces, start_char, end_char, piece): consecutive pieces, numbered from 1, ends exclusive."""
    rows = items.select(F.col(key), F.col(text).alias("tw_text")).where(
        F.col("tw_text").isNotNull() if whole else F.length("tw_text") > limit
    )
    kind = rows.schema[key].dataType.simpleString()

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k, t in zip(batch[key], batch["tw_text"]):
                spans = cut(t, limit, overlap)
                yield pd.DataFrame(
                    {
                        key: [k] * len(spans),
                        "piece_no": range(1, len(spans) + 1),
                        "pieces": len(spans),
                        "start_char": [a for a, _ in spans],
                        "end_char": [b for _, b in spans],
                        "piece": [t[a:b] for a, b in spans],
                    }
                )

    schema = f"`{key}` {kind}, piece_no int, pieces int, start_char int, end_char int, piece string"
    return rows.mapInPandas(split, schema)


def oversized(items: DataFrame, key: str = "item_id", text: str = "extracted_text", limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(key) of each item that had to be cut."""
    return pieces(items, key, text, limit, overlap).where("piece_no = 1").select(key)
