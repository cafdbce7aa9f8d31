"""Reading one written date or time: every format, precision and zone form the sources use.

parse_instant is pure Python and is called once per distinct string, source zone and day order.
"""

from __future__ import annotations

import re
from datetime import date, datetime
from functools import lru_cache
from zoneinfo import ZoneInfo

# Zone letters and their offsets from UTC in minutes.
ZONE_LETTERS = {
    "Z": 0, "UT": 0, "UTC": 0, "GMT": 0, "WET": 0,
    "IST": 330, "BST": 60, "CET": 60, "CEST": 120, "WEST": 60, "EET": 120, "EEST": 180, "MSK": 180,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420,
    "GST": 240, "PKT": 300, "NPT": 345, "ICT": 420, "WIB": 420, "SGT": 480, "MYT": 480, "HKT": 480, "AWST": 480,
    "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "NZST": 720, "NZDT": 780,
}
# Month names as they may be shortened.
MONTHS = {m: k for k, ms in enumerate((
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may",), ("jun", "june"),
    ("jul", "july"), ("aug", "august"), ("sep", "sept", "september"), ("oct", "october"), ("nov", "november"), ("dec", "december"),
), 1) for m in ms}

_CLOCK = r"(?P<h>\d{1,2}):(?P<mi>\d{2})(?::(?P<s>\d{2})(?:[.,](?P<f>\d{1,9}))?)?(?:\s*(?P<ap>[AaPp])\.?[Mm]\.?)?"
_ZONE = r"(?:\s*(?P<off>[+-]\d{2}(?::?\d{2})?)|\s*(?P<let>[A-Za-z]{1,5})(?![A-Za-z]))?(?:\s*\[(?P<iana>[A-Za-z0-9_+\-/]+)\])?"
_TAIL = rf"(?:(?:\s*,\s*|\s+|\s*,?\s+at\s+){_CLOCK}{_ZONE})?"
_DAY = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_ISO = re.compile(rf"(?P<y>\d{{4}})(?P<sep>[-/.])(?P<m>\d{{1,2}})(?P=sep)(?P<d>\d{{1,2}})(?:(?:[Tt]|\s+){_CLOCK}{_ZONE})?", re.ASCII)
_BASIC = re.compile(rf"(?P<y>\d{{4}})(?P<m>\d{{2}})(?P<d>\d{{2}})(?:[Tt](?P<h>\d{{2}})(?P<mi>\d{{2}})(?:(?P<s>\d{{2}})(?:[.,](?P<f>\d{{1,9}}))?)?(?P<ap>(?!))?{_ZONE})?", re.ASCII)
_DMY = re.compile(rf"{_DAY}(?P<d>\d{{1,2}})(?:st|nd|rd|th)?[\s-]+(?P<mon>[a-z]+)\.?,?[\s-]+(?P<y>\d{{4}}|\d{{2}}){_TAIL}", re.I | re.ASCII)
_MDY = re.compile(rf"{_DAY}(?P<mon>[a-z]+)\.?\s+(?P<d>\d{{1,2}})(?:st|nd|rd|th)?,?\s+(?P<y>\d{{4}}){_TAIL}", re.I | re.ASCII)
_NUM = re.compile(rf"(?P<a>\d{{1,2}})(?P<sep>[-/.])(?P<b>\d{{1,2}})(?P=sep)(?P<y>\d{{4}}|\d{{2}}){_TAIL}", re.ASCII)
_EPOCH = re.compile(r"(?P<n>\d{9,10}|\d{12,13})(?:\.(?P<f>\d{1,9}))?", re.ASCII)
_FORMS = (_ISO, _DMY, _NUM, _BASIC, _MDY)
_EPOCH_DAY = date(1970, 1, 1).toordinal()


@lru_cache(maxsize=1024)
def _zone(name: str) -> ZoneInfo | None:
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


def _micros(fraction: str | None) -> int:
    return int((fraction + "000000")[:6]) if fraction else 0


def parse_instant(raw: str | None, zone: str | None = "UTC", day_first: bool | None = True) -> int | None:
    """Microseconds since 1970-01-01 UTC, or None where raw gives no calendar date and no count since 1970.

    A wall time without zone is read in zone; of two occurrences the first counts, and one that a change skips is
    read with the offset in force before. day_first orders all-numeric dates; None counts as day first.
    """
    if raw is None:
        return None
    text = raw.strip()
    if not text:
        return None
    if text.isascii() and text[:9].isdigit() and (m := _EPOCH.fullmatch(text)):
        count = m["n"]
        if len(count) > 10:
            return int(count) * 1000 + _micros(m["f"]) // 1000
        return int(count) * 1_000_000 + _micros(m["f"])
    for form in _FORMS:
        if m := form.fullmatch(text):
            g = m.groupdict()
            break
    else:
        return None
    year = int(g["y"])
    if len(g["y"]) == 2:
        year += 2000 if year < 70 else 1900
    if form is _NUM:
        a, b = int(g["a"]), int(g["b"])
        day, month = (b, a) if day_first is False else (a, b)
    else:
        day = int(g["d"])
        month = MONTHS.get(g["mon"].lower()) if "mon" in g else int(g["m"])
        if month is None:
            return None
    hour, minute, second = int(g["h"] or 0), int(g["mi"] or 0), int(g["s"] or 0)
    if g["ap"]:
        if not 1 <= hour <= 12:
            return None
        hour = hour % 12 + (12 if g["ap"] in "pP" else 0)
    if minute > 59 or second > 60 or hour > 24 or hour == 24 and (minute or second):
        return None
    try:
        days = date(year, month, day).toordinal() - _EPOCH_DAY
    except ValueError:
        return None
    wall = (days * 86400 + hour * 3600 + minute * 60 + second) * 1_000_000 + _micros(g["f"])
    if g["off"]:
        digits = g["off"][1:].replace(":", "")
        minutes = int(digits[:2]) * 60 + int(digits[2:] or 0)
        return wall - (minutes if g["off"][0] == "+" else -minutes) * 60_000_000
    if g["let"]:
        minutes = ZONE_LETTERS.get(g["let"].upper())
        return None if minutes is None else wall - minutes * 60_000_000
    zi = _zone(g["iana"] or zone or "UTC")
    if zi is None:
        if g["iana"]:
            return None
        zi = _zone("UTC")
    at = datetime(year, month, day, min(hour, 23), minute, min(second, 59), tzinfo=zi)
    offset = at.utcoffset()
    return wall - (offset.days * 86400 + offset.seconds) * 1_000_000 - offset.microseconds
