from tidewatch.operators import timestamps

SCHEMA = "candidate_id bigint, institution string, date string, extracted_date string, event_start_at string, fetched_at timestamp, utc string, field_name string, tw_zone string"
REGISTRY = "institution string, time_zone string, date_order string, utc string"


def test_nulls_blanks_repeats_and_clashing_columns(spark, rows):
    import datetime

    at = datetime.datetime(2026, 1, 1)
    data = [
        (1, "A", "2025-08-21", None, "", at, "x", "y", "z"),
        (1, "A", "2025-08-21", None, "", at, "x", "y", "z"),
        (2, None, "2025-08-21T10:00:00Z", "5 May 2025", None, at, None, None, None),
        (3, "A", " ", "n/a", "31/02/2026", None, None, None, None),
        (None, "A", "1 May 2025", None, None, None, None, None, None),
        (4, "B", "x" * 100_000 + " 2025-01-01", None, None, None, None, None, None),
    ]
    got = timestamps.normalise(spark.createDataFrame(data, SCHEMA), spark.createDataFrame([("A", "Asia/Tokyo", "YMD", "u"), ("B", "UTC", None, None)], REGISTRY))
    assert rows(got) == sorted(
        [(1, "date", "2025-08-20T15:00:00Z")] * 2 + [(2, "date", "2025-08-21T10:00:00Z"), (None, "date", "2025-04-30T15:00:00Z"), (4, "date", "2025-01-01T00:00:00Z")],
        key=repr,
    )


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert timestamps.normalise(none, spark.createDataFrame([], REGISTRY)).collect() == []


def test_zone_of_an_unregistered_source_is_estimated(spark, rows):
    data = [(i, "C", f"2025-{m:02d}-10T10:00:00{o}", None, None, None, None, None, None) for i, (m, o) in enumerate([(1, "+01:00"), (7, "+02:00"), (12, "+01:00")])]
    data.append((9, "C", "2025-07-01T12:00", None, None, None, None, None, None))
    registry = [("A", "Asia/Tokyo", "YMD", ""), ("B", "Europe/Berlin", "DMY", ""), ("D", "Africa/Lagos", "DMY", "")]
    got = timestamps.normalise(spark.createDataFrame(data, SCHEMA), spark.createDataFrame(registry, REGISTRY))
    assert (9, "date", "2025-07-01T10:00:00Z") in rows(got)


def test_zone_by_ingestion_alone_and_utc(spark):
    import datetime as dt

    data = []
    for n in range(60):  # local times of New York, fetched minutes to hours later; and a source that states UTC only
        utc = dt.datetime(2025, 1 + n % 12, 10, 6 + n % 12, 30)
        hours = 4 if 3 < utc.month < 11 else 5
        data.append((n, "N", (utc - dt.timedelta(hours=hours)).strftime("%Y-%m-%d %H:%M"), None, None, utc + dt.timedelta(minutes=10 + 200 * (n % 3)), None, None, None))
        data.append((n, "U", utc.strftime("%Y-%m-%dT%H:%M:00Z"), None, None, utc, None, None, None))
    zones = ["America/New_York", "America/Los_Angeles", "Asia/Singapore", "Europe/London", "UTC"]
    got = timestamps.estimate_zones(spark.createDataFrame(data, SCHEMA), zones, "institution", timestamps.FIELDS, "fetched_at")
    assert {r.institution: r.time_zone for r in got.collect()} == {"N": "America/New_York", "U": "UTC"}
