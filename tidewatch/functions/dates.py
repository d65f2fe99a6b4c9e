"""Reading dates and times as people and feeds write them.

``read`` turns one text into wall-clock time plus whatever zone it states;
``to_utc`` makes it an instant.  Both are plain Python and are called from
Arrow-batched functions only.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta
from functools import lru_cache
from typing import NamedTuple
from zoneinfo import ZoneInfo

# Month names and abbreviations, without accents, in English,
# German, French, Spanish, Italian and Portuguese.
MONTHS = {
    1: "january jan januar janner janvier janv enero ene gennaio gen janeiro",
    2: "february feb februar feber fevrier fevr fev febrero febbraio fevereiro",
    3: "march mar marz mrz mars marzo marco",
    4: "april apr avril avr abril abr aprile",
    5: "may mai mayo maggio mag maio",
    6: "june jun juni juin junio giugno giu junho",
    7: "july jul juli juillet juil julio luglio lug julho",
    8: "august aug aout agosto ago",
    9: "september sep sept septembre septiembre setiembre settembre set setembro",
    10: "october oct oktober okt octobre octubre ottobre ott outubro out",
    11: "november nov novembre noviembre novembro",
    12: "december dec dezember dez decembre diciembre dic dicembre dezembro",
}
# Minutes east of UTC of zone abbreviations, where the writer's
# own zone does not use the abbreviation itself.
ABBREVIATIONS = {
    "z": 0, "ut": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 60, "bst": 60, "cet": 60, "mez": 60, "wat": 60,
    "cest": 120, "mesz": 120, "eet": 120, "cat": 120, "sast": 120, "eest": 180, "msk": 180, "eat": 180,
    "gst": 240, "pkt": 300, "ist": 330, "npt": 345, "sgt": 480, "hkt": 480, "awst": 480, "jst": 540, "kst": 540,
    "acst": 570, "aest": 600, "acdt": 630, "aedt": 660, "nzst": 720, "nzdt": 780, "brt": -180, "art": -180,
    "clt": -240, "ast": -240, "edt": -240, "est": -300, "cdt": -300, "cot": -300, "pet": -300, "cst": -360,
    "mdt": -360, "mst": -420, "pdt": -420, "pst": -480, "akdt": -480, "akst": -540, "hst": -600,
}

_MONTH = {name: n for n, names in MONTHS.items() for name in names.split()}
_M = "(" + "|".join(sorted(_MONTH, key=len, reverse=True)) + r")(?![a-z])\.?"
_D = r"(\d{1,2})(?!\d)(?:st|nd|rd|th|er|º|°|\.)?"
_Y = r"['’]?(\d{4}|\d{2})(?![\d:])"
_OF = r"(?:[\s,]*(?:of|de|del)\s+|[\s,]*[-/]\s*|[\s,]*)"
_TO = r"\s*(?:-|–|—|/|\bto\b|\bbis\b|\bau\b|\bal?\b|\by\b|\bet\b|\bund\b|\band\b|&)\s*"

_EPOCH = re.compile(r"(?<![\d.])(\d{10}|\d{13}|\d{16}|\d{19})(?:\.\d+)?(?!\d)")
_WEEK = re.compile(r"(?<!\d)(\d{4})-?w(\d{2})-?([1-7])(?!\d)")
_ISO = re.compile(r"(?<!\d)(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?!\d)")
_ORDINAL = re.compile(r"(?<!\d)(\d{4})-(\d{3})(?!\d)")
_COMPACT = re.compile(r"(?<!\d)((?:19|20|21)\d{2})(\d{2})(\d{2})(?:t?(\d{2})(\d{2})(\d{2})?(?:[.,]\d+)?)?(?!\d)")
_EAST = re.compile(r"(\d{4})\s*[年년]\s*(\d{1,2})\s*[月월]\s*(\d{1,2})\s*[日일]")
_NUMERIC = re.compile(r"(?<![\d:])(\d{1,4})([-/.])(\d{1,2})\2(\d{4}|\d{2})(?![\d])")
_SPAN_DMY = re.compile(rf"(?<!\d){_D}(?:{_OF}{_M})?{_TO}{_D}{_OF}{_M}{_OF}{_Y}")
_DMY = re.compile(rf"(?<![\d:]){_D}{_OF}{_M}{_OF}{_Y}")
_SPAN_MDY = re.compile(rf"(?<![a-z]){_M}\s*{_D}{_TO}(?:{_M}\s*)?{_D}[\s,]+{_Y}")
_MDY = re.compile(rf"(?<![a-z]){_M}[\s-]*{_D}(?:\s*,\s*|\s+|-){_Y}")
_YMD = re.compile(rf"(?<!\d)(\d{{4}})[\s,-]+{_M}[\s-]*{_D}(?!\d)")

_HALF = r"(?:\s*([ap])\.?\s?m\b\.?)"
_TIME = re.compile(rf"(?<![\d:+-])(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,]\d+)?)?(?!\d){_HALF}?")
_TIME_EAST = re.compile(r"(午前|午後|오전|오후)?\s*(\d{1,2})\s*[時시]\s*(?:(\d{1,2})\s*[分분])?")
_TIME_H = re.compile(r"(?<![\d:])(\d{1,2})\s?h\s?(\d{2})?(?![a-z\d])")
_TIME_DOT = re.compile(r"(?<![\d.])(\d{1,2})\.(\d{2})\s*uhr")
_TIME_HALF = re.compile(rf"(?<![\d:.])(\d{{1,2}}){_HALF}")
_TIME_TO = re.compile(r"^\s*(?:[–—]|-\s|\bto\b|\bbis\b)\s*\d{1,2}(?:[:.h]\d{2})?(?:\s*[ap]\.?m\b\.?)?")
_ZONE_WORD = re.compile(r"(?:(utc|gmt|ut)\s*)?([+–−-])(\d{1,2})(?!\d)(?::?(\d{2}))?(?!\d)|(?:(utc|gmt|ut)\s*)?([+-])(\d{2})(\d{2})(?!\d)|([a-z]{1,5})(?![a-z])")
_ONLY_ZONE = re.compile(r"^[\s,]*\(?(z|utc|gmt|ut|[+-]\d{2}:?\d{2})\)?\s*$")
_REGION = re.compile(r"\[([A-Za-z_]+(?:/[A-Za-z_+-]+)*)\]")


# The two commonest shapes, read without the search through all others.
_QUICK_ISO = re.compile(r"\s*(\d{4})-(\d\d)-(\d\d)(?:[T ](\d\d):(\d\d)(?::(\d\d)(?:\.\d+)?)? ?(?:(Z|UTC)|([+-])(\d\d)(?::?(\d\d))?)?)?\s*", re.IGNORECASE)
_QUICK_DMY = re.compile(r"\s*(\d{1,2}) ([A-Za-z]+)\.? (\d{4})\s*")


class Reading(NamedTuple):
    """Wall-clock time; ``offset`` in minutes, ``region`` or ``abbreviation`` if the text states a zone."""

    local: datetime | None
    offset: int | None = None
    region: str | None = None
    abbreviation: str | None = None


def _plain(text: str) -> str:
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKD", text).lower()
    if not folded.isascii():
        folded = "".join(c for c in folded if not unicodedata.combining(c)).replace("−", "-")
        folded = unicodedata.normalize("NFC", folded)
    return " ".join(folded.split())


def _year(y: str) -> int:
    return int(y) + 2000 if len(y) == 2 else int(y)


def _find_day(text: str, order: str) -> tuple[int, int, int, int, int] | tuple[date, int, int] | None:
    """(year, month, day, start, end) of the first day named, or (date, start, end)."""
    if m := _WEEK.search(text):
        try:
            return date.fromisocalendar(int(m[1]), int(m[2]), int(m[3])), m.start(), m.end()
        except ValueError:
            return 0, 0, 0, m.start(), m.end()
    if m := _ISO.search(text):
        return int(m[1]), int(m[3]), int(m[4]), m.start(), m.end()
    if m := _EAST.search(text):
        return int(m[1]), int(m[2]), int(m[3]), m.start(), m.end()
    if any("a" <= c <= "z" for c in text):
        for span, month_first in ((_SPAN_DMY, False), (_SPAN_MDY, True)):
            if m := span.search(text):
                first, second = (m[1], m[3]) if month_first else (m[2], m[4])
                day = m[2] if month_first else m[1]
                a, b, y = _MONTH[first or second], _MONTH[second or first], _year(m[5])
                earlier = (_DMY if not month_first else _MDY).search(text)
                if not (earlier and earlier.start() < m.start()):
                    return y - (a > b), a, int(day), m.start(), m.end()
        found = [(m.start(), kind, m) for kind, pattern in enumerate((_DMY, _MDY, _YMD)) if (m := pattern.search(text))]
        if found:
            _, kind, m = min(found, key=lambda f: f[:2])
            y, mon, d = ((m[3], m[2], m[1]), (m[3], m[1], m[2]), (m[1], m[2], m[3]))[kind]
            return _year(y), _MONTH[mon], int(d), m.start(), m.end()
    if m := _NUMERIC.search(text):
        a, b, c = m[1], m[3], m[4]
        if len(a) == 3 or len(a) == 4:
            return None
        if order == "YMD" and len(c) == 2:
            y, mon, d = a, b, c
        elif order == "DMY":
            d, mon, y = a, b, c
        else:  # MDY; a year at the end of a YMD writer's date leaves month before day
            mon, d, y = a, b, c
        return _year(y.zfill(2)), int(mon), int(d), m.start(), m.end()
    if m := _ORDINAL.search(text):
        days = int(m[2])
        try:
            found = date(int(m[1]), 1, 1) + timedelta(days - 1)
        except (ValueError, OverflowError):
            return None
        return (found, m.start(), m.end()) if days and found.year == int(m[1]) else (0, 0, 0, m.start(), m.end())
    return None


def _find_time(text: str) -> tuple[int, int, int, int, int] | None:
    """(hour, minute, second, start, end) of the first time of day."""
    best = None
    if m := _TIME.search(text):
        best = int(m[1]), int(m[2]), int(m[3] or 0), m.start(), m.end(), m[4]
    elif m := _TIME_EAST.search(text):
        best = int(m[2]), int(m[3] or 0), 0, m.start(), m.end(), {"午後": "p", "오후": "p", "午前": "a", "오전": "a"}.get(m[1])
    elif m := _TIME_H.search(text):
        best = int(m[1]), int(m[2] or 0), 0, m.start(), m.end(), None
    elif m := _TIME_DOT.search(text):
        best = int(m[1]), int(m[2]), 0, m.start(), m.end(), None
    elif m := _TIME_HALF.search(text):
        best = int(m[1]), 0, 0, m.start(), m.end(), m[2]
    if best is None:
        return None
    h, mi, s, a, b, half = best
    if half and 1 <= h <= 12:
        h = h % 12 + 12 * (half == "p")
    if h > 24 or mi > 59 or s > 60 or h == 24 and (mi or s):
        return None
    return h, mi, s, a, b


def _zone(text: str) -> tuple[int | None, str | None]:
    """(offset in minutes, abbreviation) from what follows a time of day."""
    for m in _ZONE_WORD.finditer(text):
        if m[9]:
            if m[9] in ABBREVIATIONS or m[9] in ("et", "pt", "ct", "mt") or 3 <= len(m[9]) <= 5 and m[9].endswith("t"):
                return None, m[9]
            continue
        sign, h, mi = (m[2], m[3], m[4]) if m[2] else (m[6], m[7], m[8])
        if sign == "–" and not m[1]:
            continue
        minutes = int(h) * 60 + int(mi or 0)
        if minutes <= 18 * 60:
            return -minutes if sign != "+" else minutes, None
    return None, None


def read(text: str | None, order: str = "DMY") -> Reading | None:
    """What one text says, or null if it names no existing day."""
    if not text:
        return None
    if text.isascii():
        if m := _QUICK_ISO.fullmatch(text):
            y, mo, d, h, mi, sec, utc, sign, oh, om = m.groups()
            try:
                local = datetime(int(y), int(mo), int(d), int(h or 0), int(mi or 0), int(sec or 0))
                offset = 0 if utc else (int(oh) * 60 + int(om or 0)) * (-1 if sign == "-" else 1) if oh else None
                return Reading(local, offset)
            except ValueError:
                pass  # no such day or time: the full reading decides
        elif (m := _QUICK_DMY.fullmatch(text)) and m[2].lower() in _MONTH:
            try:
                return Reading(datetime(int(m[3]), _MONTH[m[2].lower()], int(m[1])))
            except ValueError:
                return None
    region = m[1] if "[" in text and (m := _REGION.search(text)) else None
    plain = _plain(text if region is None else text[: m.start()] + " " + text[m.end() :])
    if not any(c.isdigit() for c in plain):
        return None
    if m := _EPOCH.search(plain):
        if not re.search(r"\d", plain[: m.start()] + plain[m.end() :]):
            try:
                seconds = int(m[1]) // 10 ** (len(m[1]) - 10)
                return Reading(datetime(1970, 1, 1) + timedelta(seconds=seconds), 0)
            except OverflowError:
                return None
    clock = None
    if (m := _COMPACT.search(plain)) and not _ISO.search(plain):
        if m[4]:
            clock = int(m[4]), int(m[5]), int(m[6] or 0)
            if clock[0] > 23 or clock[1] > 59 or clock[2] > 60:
                clock = 0, 0, 0
        found = int(m[1]), int(m[2]), int(m[3]), m.start(), m.end()
    else:
        found = _find_day(plain, order)
    if found is None:
        return None
    *ymd, start, end = found
    try:
        day = ymd[0] if isinstance(ymd[0], date) else date(*ymd)
    except ValueError:
        return None
    rest = plain[:start] + " " + plain[end:]
    offset = name = None
    if clock is None:
        if time := _find_time(rest):
            clock = time[:3]
            rest = rest[time[4] :]
            if m := _TIME_TO.match(rest):
                rest = rest[m.end() :]
            offset, name = _zone(rest)
        elif m := _ONLY_ZONE.match(plain[end:]):
            offset, name = _zone(m[1])
    else:
        offset, name = _zone(rest)
    h, mi, s = clock or (0, 0, 0)
    try:
        local = datetime(day.year, day.month, day.day) + timedelta(hours=h, minutes=mi, seconds=s)
    except OverflowError:
        return None
    return Reading(local, offset, region if offset is None else None, name)


@lru_cache(maxsize=1000)
def zone_info(name: str | None) -> ZoneInfo | None:
    try:
        return ZoneInfo(name) if name else None
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(maxsize=1000)
def own_abbreviations(zone: str | None) -> dict[str, int]:
    """Offsets in minutes of the abbreviations that a zone itself has used since 1990."""
    info, found = zone_info(zone), {}
    if info:
        for year in range(1990, 2031):
            for month in range(1, 13):
                at = datetime(year, month, 15, tzinfo=info)
                name = (at.tzname() or "").lower()
                if name.isalpha():
                    found[name] = int(at.utcoffset().total_seconds() // 60)
    return found


# Names of North American time without summer or winter.
GENERIC = {"et": "America/New_York", "ct": "America/Chicago", "mt": "America/Denver", "pt": "America/Los_Angeles"}


def stated_offset(reading: Reading, zone: str | None) -> timedelta | None:
    """The offset that the text itself states; abbreviations as used in ``zone``."""
    if reading.offset is not None:
        return timedelta(minutes=reading.offset)
    if reading.abbreviation:
        minutes = own_abbreviations(zone).get(reading.abbreviation, ABBREVIATIONS.get(reading.abbreviation))
        if minutes is not None:
            return timedelta(minutes=minutes)
    region = zone_info(reading.region or GENERIC.get(reading.abbreviation or ""))
    return reading.local.replace(tzinfo=region).utcoffset() if region else None


def to_utc(reading: Reading | None, zone: str | None) -> datetime | None:
    """The instant, in UTC and without fractions of a second.

    Wall-clock time without a stated zone is read in ``zone``: an hour that
    occurs twice is its first occurrence, a skipped one has the offset from
    before the change (both are what ``fold=0`` means).  Null without a zone.
    """
    if reading is None or reading.local is None:
        return None
    offset = stated_offset(reading, zone)
    try:
        if offset is None:
            info = zone_info(zone)
            if info is None:
                return None
            offset = reading.local.replace(tzinfo=info).utcoffset()
        return reading.local - offset
    except OverflowError:
        return None


def feed_instant(text: str | None) -> datetime | None:
    """Date of a feed entry as an instant in UTC; without a zone it is UTC."""
    return to_utc(read(text), "UTC") if text else None


_PDF = re.compile(r"D?:?(\d{4})(\d{2})?(\d{2})?(\d{2})?(\d{2})?(\d{2})?(?:(Z)|([+-])(\d{2})'?(\d{2})?'?)?")


def pdf_instant(text: str | None, zone: str = "UTC") -> datetime | None:
    """A document's ``D:YYYYMMDDhhmmss`` date as an instant in UTC; fields left out are the earliest."""
    m = _PDF.match(text or "")
    if not m:
        return None
    y, mo, d, h, mi, s, utc, sign, oh, om = m.groups()
    try:
        local = datetime(int(y), int(mo or 1), int(d or 1), int(h or 0), int(mi or 0), int(s or 0))
    except ValueError:
        return None
    offset = 0 if utc else (int(oh) * 60 + int(om or 0)) * (-1 if sign == "-" else 1) if oh else None
    return to_utc(Reading(local, offset), zone)
