import pytest

from tidewatch.functions import dates


def utc(text, zone="UTC", order="DMY"):
    at = dates.to_utc(dates.read(text, order), zone)
    return at and at.isoformat()


@pytest.mark.parametrize(
    "text, zone, order, expected",
    [
        ("Sun, 14 Jun 2026 13:00:00 +1000", "UTC", "DMY", "2026-06-14T03:00:00"),
        ("2026-06-14T03:00:00Z", "Asia/Tokyo", "DMY", "2026-06-14T03:00:00"),
        ("20260614", "Europe/Berlin", "DMY", "2026-06-13T22:00:00"),
        ("1755739183", "Europe/Berlin", "DMY", "2025-08-21T01:19:43"),
        ("1755739183999", "Europe/Berlin", "DMY", "2025-08-21T01:19:43"),
        ("07/08/2026", "UTC", "DMY", "2026-08-07T00:00:00"),
        ("07/08/2026", "UTC", "MDY", "2026-07-08T00:00:00"),
        ("26/08/07", "UTC", "YMD", "2026-08-07T00:00:00"),
        ("31/02/2026", "UTC", "DMY", None),
        ("29 February 2025", "UTC", "DMY", None),
        ("2026-W19-1", "UTC", "DMY", "2026-05-04T00:00:00"),
        ("2024-366", "UTC", "DMY", "2024-12-31T00:00:00"),
        ("2025-366", "UTC", "DMY", None),
        ("13–15 February 2025", "UTC", "DMY", "2025-02-13T00:00:00"),
        ("30 December – 2 January 2026", "UTC", "DMY", "2025-12-30T00:00:00"),
        ("June 20 - 21, 2026", "UTC", "MDY", "2026-06-20T00:00:00"),
        ("2026-11-12/2026-11-13", "UTC", "DMY", "2026-11-12T00:00:00"),
        ("18 April 2026, 10:00–11:30 (UTC+09:00)", "Asia/Tokyo", "YMD", "2026-04-18T01:00:00"),
        ("9:12 am, June 17 2025 AEST", "Australia/Sydney", "DMY", "2025-06-16T23:12:00"),
        ("5 May 2025 10:00 IST", "Asia/Kolkata", "DMY", "2025-05-05T04:30:00"),
        ("5 May 2025 10:00 CST", "America/Chicago", "MDY", "2025-05-05T16:00:00"),
        ("12:05 AM, 1st March 2024", "UTC", "DMY", "2024-03-01T00:05:00"),
        ("5 août 2025 à 9h13", "Europe/Paris", "DMY", "2025-08-05T07:13:00"),
        ("30. März 2025, 19:26 Uhr", "Europe/Berlin", "DMY", "2025-03-30T17:26:00"),
        ("13 de septiembre de 2026, 14:52 h", "Europe/Madrid", "DMY", "2026-09-13T12:52:00"),
        ("2024年10月28日 8時19分", "Asia/Tokyo", "YMD", "2024-10-27T23:19:00"),
        ("2026-06-09T22:24:00[Australia/Sydney]", "UTC", "DMY", "2026-06-09T12:24:00"),
        ("Thursday 1st January 2026", "UTC", "DMY", "2026-01-01T00:00:00"),
        ("Q3 2026", "UTC", "DMY", None),
        ("Spring 2026", "UTC", "DMY", None),
        ("2 hours ago", "UTC", "DMY", None),
        ("", "UTC", "DMY", None),
        (None, "UTC", "DMY", None),
    ],
)
def test_readings(text, zone, order, expected):
    assert utc(text, zone, order) == expected


def test_hours_that_occur_twice_or_never():
    assert utc("2026-10-25T02:30", "Europe/Berlin") == "2026-10-25T00:30:00"  # the first of two
    assert utc("2026-03-29T02:30", "Europe/Berlin") == "2026-03-29T01:30:00"  # skipped: the offset before
    assert utc("2026-10-25T02:30:00+01:00", "Europe/Berlin") == "2026-10-25T01:30:00"


def test_feed_and_document_dates():
    assert dates.feed_instant("2026-06-14 03:00:00").isoformat() == "2026-06-14T03:00:00"
    assert dates.pdf_instant("D:20260614130000+10'00'").isoformat() == "2026-06-14T03:00:00"
    assert dates.pdf_instant("D:2026").isoformat() == "2026-01-01T00:00:00"
    assert dates.pdf_instant("nothing") is None
