"""Problem 2: timestamps in mixed formats and zones, brought to instants in UTC.

Every text is read into wall-clock time and whatever zone it states.  What
states none needs the zone of its source.  A registry names that zone; for
sources it does not name, the zone is estimated.  Each candidate zone (a whole
history of offsets) is scored by its violations:

* statements of an offset other than UTC's that the zone did not have on that
  day, less those it had, and less half of the statements of UTC on days when the
  zone had UTC: UTC is stated everywhere, so it can't count against a zone, but
  where little else is stated it counts for itself.  The zone with the fewest is
  taken, of equals
* the one under which the fewest zoneless times lie later than their ingestion,
  and of these the one that leaves the least time between both, since any zone
  further east is never late either; last the first by name.

Scale.  Reading is one pass without a shuffle; copies of a text meet a cache in
the worker.  Estimation runs over the sources without a registered zone only.
Readings are counted by source, day, statement and lead over ingestion in
quarters of an hour, before and after the shuffle; zones are scored by these
counts, so neither rows nor a hot source meet the candidate zones.  The
registry's size is checked before it is broadcast.

Defined cases.  Null, empty and blank texts, texts that name no day, and days
that do not exist give no row.  A time of day that does not exist counts as
none.  A source without registered or estimable zone leaves its zoneless texts
out; its zoned ones still come out.  Repeated rows come out repeatedly.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence
from datetime import datetime, time, timedelta, timezone
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions import dates
from tidewatch.session import broadcast_if_small, materialize

FIELDS = ("date", "extracted_date", "event_start_at")
#: Ahead of ingestion by more than this counts as a violation (clocks differ).
AHEAD = timedelta(minutes=5)


@lru_cache(maxsize=200_000)
def _reading(text: str, order: str) -> dates.Reading | None:
    return dates.read(text, order)


@lru_cache(maxsize=200_000)
def _instant(text: str | None, order: str, zone: str | None) -> str | None:
    at = dates.to_utc(dates.read(text, order), zone)
    return at.isoformat() + "Z" if at else None


def _readings(rows: DataFrame, source: str, fields: Sequence[str], ingested: str | None) -> DataFrame:
    """(source, day, statement, lead, n): how often a day is named with a statement of zone, or how far ahead of its ingestion without."""
    order = F.col("tw_order") if "tw_order" in rows.columns else F.lit("DMY")
    at = F.col(ingested).cast("timestamp") if ingested else F.lit(None).cast("timestamp")
    narrow = rows.select(
        F.col(source).cast("string").alias("source"),
        F.coalesce(order, F.lit("DMY")).alias("zone_order"),
        F.unix_timestamp(at).alias("at"),
        *[F.col(f).cast("string").alias(f"f{i}") for i, f in enumerate(fields)],
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: Counter = Counter()
            names, orders, ats, *texts = (c.to_pylist() for c in batch.columns)
            for i, column in enumerate(texts):
                for name, order, at, text in zip(names, orders, ats, column):
                    reading = _reading(text, order) if text else None
                    if reading is None or reading.local is None:
                        continue
                    day = reading.local.toordinal()
                    if reading.offset is not None or reading.abbreviation or reading.region:
                        found[name, day, f"{'' if reading.offset is None else int(reading.offset)}|{reading.abbreviation or ''}|{reading.region or ''}", None] += 1
                    elif i == 0 and at is not None and reading.local.time() != time(0):  # other fields name what is to come; days alone have no hour
                        lead = ((reading.local - AHEAD).replace(tzinfo=timezone.utc).timestamp() - at) / 900
                        if abs(lead) <= 15 * 4:  # beyond, no offset decides
                            found[name, day, "", math.ceil(lead)] += 1
            keys = list(found)
            columns = [pa.array([k[j] for k in keys], t) for j, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(list(found.values()), pa.int64())], names=["source", "day", "statement", "lead", "n"])

    counted = narrow.mapInArrow(count, "source string, day int, statement string, lead int, n bigint")
    return counted.groupBy("source", "day", "statement", "lead").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=500_000)
def _offset(zone: str, day: int) -> int:
    """Minutes east of UTC at noon of a day."""
    return int(datetime.fromordinal(day).replace(hour=12, tzinfo=dates.zone_info(zone)).utcoffset().total_seconds()) // 60


def offsets_of(zone: str, year: int, years: int = 1) -> list[int]:
    """Minutes east of UTC at noon of each day of some years."""
    first = datetime(year, 1, 1).toordinal()
    return [_offset(zone, day) for day in range(first, datetime(year + years, 1, 1).toordinal())]


def estimate_zones(rows: DataFrame, candidates: Sequence[str], source: str, fields: Sequence[str], ingested: str | None) -> DataFrame:
    """(source, time_zone, violations, readings) estimated for each source in ``rows``.

    ``rows`` may hold a column ``tw_order``; without it day stands before month.
    """
    zones = list(candidates)

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: dict[tuple[str, str], list[int]] = {}
            for row in batch.itertuples(index=False):
                offset, abbreviation, region = row.statement.split("|") if row.statement else ("", "", "")
                for zone in zones:
                    tally = found.setdefault((row.source, zone), [0, 0, 0, 0, 0])
                    own = _offset(zone, row.day)
                    tally[4] += row.n
                    if row.statement:
                        reading = dates.Reading(datetime.fromordinal(row.day).replace(hour=12), int(offset) if offset else None, abbreviation or None, region or None)
                        stated = dates.stated_offset(reading, zone)
                        minutes = None if stated is None else int(stated.total_seconds()) // 60
                        tally[0] += row.n * (minutes not in (None, 0, own))
                        tally[1] += row.n * (0 if minutes is None or minutes == 0 != own else -1 if minutes == own == 0 else -2 if minutes == own else 2)
                    else:
                        late = row.lead * 15 > own
                        tally[2] += row.n * late
                        tally[3] += 0 if late else row.n * (own - row.lead * 15)
            yield pd.DataFrame([(s, z, *t) for (s, z), t in found.items()], columns=["source", "time_zone", "violations", "disagreement", "late", "slack", "readings"])

    scored = "source string, time_zone string, violations bigint, disagreement bigint, late bigint, slack bigint, readings bigint"
    tallies = _readings(rows, source, fields, ingested).mapInPandas(score, scored)
    sums = [F.sum(c).alias(c) for c in ("violations", "disagreement", "late", "slack", "readings")]
    totals = tallies.groupBy("source", "time_zone").agg(*sums)
    best = totals.groupBy("source").agg(F.min(F.struct("disagreement", "violations", "late", "slack", "time_zone", "readings")).alias("best"))
    return best.select(F.col("source").alias(source), "best.time_zone", "best.violations", "best.readings")


def zones_of(rows: DataFrame, registry: DataFrame, source: str = "institution", fields: Sequence[str] = FIELDS, ingested: str | None = "fetched_at") -> DataFrame:
    """(tw_source, tw_zone, tw_order) for every source: from the registry, estimated where it has no zone."""
    named = registry.groupBy(F.col(source).alias("tw_source")).agg(
        F.first("time_zone", ignorenulls=True).alias("tw_zone"), F.first("date_order", ignorenulls=True).alias("tw_order")
    )
    named = materialize(named.where("tw_source IS NOT NULL"), "zones")
    zoned = named.where("tw_zone IS NOT NULL")
    missing = rows.join(broadcast_if_small(zoned, of=named), F.col(source) == F.col("tw_source"), "left_anti").where(F.col(source).isNotNull())
    candidates = [r["tw_zone"] for r in zoned.select("tw_zone").distinct().orderBy("tw_zone").limit(600).collect()]  # the tz database has under 600 zones
    if not candidates or missing.isEmpty():
        return named
    orders = named.select(F.col("tw_source").alias("tw_s"), "tw_order")
    ordered = missing.join(broadcast_if_small(orders, of=named), F.col(source) == F.col("tw_s"), "left")
    guessed = materialize(estimate_zones(ordered, candidates, source, fields, ingested), "zones-estimated")
    guessed = guessed.select(F.col(source).alias("tw_source"), F.col("time_zone").alias("tw_zone"))
    with_order = guessed.join(orders, F.col("tw_source") == F.col("tw_s"), "left").select("tw_source", "tw_zone", "tw_order")
    return zoned.unionByName(with_order)


def normalise(
    rows: DataFrame,
    registry: DataFrame,
    key: str = "candidate_id",
    source: str = "institution",
    fields: Sequence[str] = FIELDS,
    ingested: str | None = "fetched_at",
) -> DataFrame:
    """(key, field_name, utc): the instant that each text names, ``YYYY-MM-DDTHH:MM:SSZ``."""
    zones = zones_of(rows, registry, source, fields, ingested)
    narrow = rows.select(F.col(key).alias("tw_key"), F.col(source).alias("tw_s"), *[F.col(f).cast("string").alias(f"tw_{f}") for f in fields])
    joined = narrow.where(" OR ".join(f"length(`tw_{f}`) > 0" for f in fields)).join(
        broadcast_if_small(zones), F.col("tw_s") == F.col("tw_source"), "left"
    )
    joined = joined.select("tw_key", "tw_zone", "tw_order", *[f"tw_{f}" for f in fields])
    kind = joined.schema["tw_key"].dataType.simpleString()

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            zone, order = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for i, field in enumerate(fields):
                utc = [_instant(t, o or "DMY", z) if t else None for t, o, z in zip(batch.column(3 + i).to_pylist(), order, zone)]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([field] * batch.num_rows, pa.string()), pa.array(utc, pa.string())], names=[key, "field_name", "utc"]
                )
                yield out.filter(out.column(2).is_valid())

    return joined.mapInArrow(convert, f"`{key}` {kind}, field_name string, utc string")
