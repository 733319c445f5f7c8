"""Readings of a written moment: every calendar date and time that a text can name, by family of notation."""

from __future__ import annotations

import re
import unicodedata
from datetime import date, datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo

# Month names in English, German and Spanish, and offsets in minutes of zone abbreviations.
MONTHS = {
    **{n: i for i, names in enumerate(("jan january januar enero", "feb february februar febrero", "mar march märz maerz marzo", "apr april abril", "may mai mayo", "jun june juni junio", "jul july juli julio", "aug august agosto", "sep sept september septiembre setiembre", "oct october oktober octubre", "nov november noviembre", "dec december dezember diciembre"), 1) for n in names.split()},
    "dez": 12, "okt": 10, "mär": 3, "ene": 1, "abr": 4, "ago": 8, "dic": 12,
}
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "JST": 540,
    "AWST": 480, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660, "LHST": 630, "LHDT": 660, "NZST": 720, "NZDT": 780,
    "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "BRT": -180, "BRST": -120,
}

_DOW = r"(?:(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+)?"
_DATES = (
    ("ymd", re.compile(r"(?P<y>\d{4})-(?P<m>\d{1,2})-(?P<d>\d{1,2})(?!\d)")),
    ("ymd_slash", re.compile(r"(?P<y>\d{4})/(?P<m>\d{1,2})/(?P<d>\d{1,2})(?!\d)")),
    ("ymd_dot", re.compile(r"(?P<y>\d{4})\.(?P<m>\d{1,2})\.(?P<d>\d{1,2})(?!\d)")),
    ("slash", re.compile(r"(?P<a>\d{1,2})/(?P<b>\d{1,2})/(?P<y>\d{4}|\d{2})(?!\d)")),
    ("dotted", re.compile(r"(?P<d>\d{1,2})\.(?P<m>\d{1,2})\.(?P<y>\d{4}|\d{2})(?!\d)")),
    ("dashed", re.compile(r"(?P<d>\d{1,2})-(?P<m>\d{1,2})-(?P<y>\d{4})(?!\d)")),
    ("day_month", re.compile(_DOW + r"(?P<d>\d{1,2})(?:st|nd|rd|th)?\.?[\s-]+(?:de\s+)?(?P<n>[^\W\d_]+)\.?,?[\s-]+(?:de\s+)?(?P<y>\d{4}|\d{2})(?!\d)", re.I)),
    ("month_day", re.compile(_DOW + r"(?P<n>[^\W\d_]+)\.?\s+(?P<d>\d{1,2})(?:st|nd|rd|th)?,?\s+(?P<y>\d{4})(?!\d)", re.I)),
    ("week", re.compile(r"(?P<y>\d{4})-?W(?P<w>\d{2})-?(?P<k>[1-7])(?!\d)")),
    ("ordinal", re.compile(r"(?P<y>\d{4})-(?P<o>\d{3})(?!\d)")),
    ("compact", re.compile(r"(?P<y>\d{4})(?P<m>\d{2})(?P<d>\d{2})(?=$|T)")),
)
_CTIME = re.compile(r"(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,?\s+(?P<n>[a-z]+)\.?\s+(?P<d>\d{1,2})\s+(?P<t>\d{1,2}:\d{2}(?::\d{2})?)\s+(?:(?P<z>[A-Z]{2,5}|[+-]\d{2}:?\d{2})\s+)?(?P<y>\d{4})", re.I)
_TIME = re.compile(
    r"(?:\s*T\s*|\s*,\s*|\s+)(?:at\s+|um\s+|a\s+las\s+)?(?P<h>\d{1,2})(?::(?P<mi>\d{2}))?(?::(?P<s>\d{2})(?:[.,](?P<f>\d+))?)?\s*(?P<ap>[ap]\.?\s?m\b\.?)?(?:\s*Uhr\b)?\s*"
    r"(?P<z>Z|[A-Za-z]+(?:[_-][A-Za-z]+)*/[A-Za-z_/+-]+\d*|[A-Za-z]{2,5}|(?:UTC|GMT)?[+-]\d{1,2}(?::?\d{2})?)?\s*(?:\[(?P<r>[^\]]*)\])?",
    re.I,
)
_TIGHT = re.compile(r"T(?P<h>\d{2})(?P<mi>\d{2})(?P<s>\d{2})?(?:[.,](?P<f>\d+))?(?P<z>Z|[+-]\d{2}:?(?:\d{2})?)?(?:\[(?P<r>[^\]]*)\])?", re.I)
_NUMBER = re.compile(r"\d+(?:[.,]\d+)?")
_SPACES = re.compile(r"\s+")
#: No notation is this long: the longest date, time and zone name, with 100 digits of a second.
LONGEST = 200
EPOCH_1970 = datetime(1970, 1, 1)
EPOCH_2001 = datetime(2001, 1, 1)


@lru_cache(512)
def zone(name: str):
    """A zone by IANA name or abbreviation; None when it is not known."""
    if (m := ABBREVIATIONS.get(name.upper())) is not None:
        return timezone(timedelta(minutes=m))
    try:
        return ZoneInfo(name)
    except (KeyError, ValueError, OSError):
        return None


@lru_cache(4096)
def _offset(text: str):
    """An offset such as +05:30, -0330, +2 or UTC+1; None when it is out of range."""
    text = re.sub("^(UTC|GMT)", "", text, flags=re.I)
    body = text[1:].replace(":", "")
    hours, minutes = (int(body), 0) if len(body) <= 2 else (int(body[:-2]), int(body[-2:]))
    if hours > 18 or minutes > 59:
        return None
    return timezone(timedelta(minutes=(-1 if text[0] == "-" else 1) * (hours * 60 + minutes)))


def _day(family: str, g: dict, number: str) -> date | None:
    try:
        y = int(g["y"])
        y += 2000 if len(g["y"]) == 2 else 0
        if family == "week":
            return date.fromisocalendar(y, int(g["w"]), int(g["k"]))
        if family == "ordinal":
            day = date(y, 1, 1) + timedelta(days=int(g["o"]) - 1)
            return day if int(g["o"]) > 0 and day.year == y else None
        if family == "slash":
            return date(y, int(g["b"]), int(g["a"])) if number == "dmy" else date(y, int(g["a"]), int(g["b"]))
        m = MONTHS.get(g["n"].lower()) if "n" in g else int(g["m"])
        return date(y, m, int(g["d"])) if m else None
    except (ValueError, OverflowError):
        return None


def _clock(g: dict) -> tuple[int, int, int, int] | None:
    h, mi, s = int(g["h"]), int(g["mi"] or 0), int(g["s"] or 0)
    if g.get("ap"):
        if not 1 <= h <= 12:
            return None
        h = h % 12 + (12 if g["ap"][0] in "pP" else 0)
    elif g["mi"] is None:
        return None
    return (h, mi, s, int((g["f"] or "0")[:6].ljust(6, "0"))) if h < 24 and mi < 60 and s < 60 else None


def _zone_of(g: dict):
    """(known, zone): the zone or offset in the text; known is False when one is named that cannot be resolved."""
    z, region = g.get("z"), g.get("r")
    if z:
        found = zone(z) if z[0] not in "+-" and not re.match("(UTC|GMT)[+-]", z, re.I) else _offset(z)
        return found is not None, found
    if region:
        found = zone(region)
        return found is not None, found
    return True, None


def _bare(text: str, epoch_2001: bool) -> list:
    if len(text) == 8 and text.isdigit():
        try:
            return [("compact", datetime(int(text[:4]), int(text[4:6]), int(text[6:])), None)]
        except ValueError:
            return []
    whole, _, part = text.replace(",", ".").partition(".")
    n = int(whole) if len(whole) < 25 else 0
    if not n:
        return []
    start = EPOCH_2001 if epoch_2001 else EPOCH_1970
    scales = ((10**11, 10**6, "seconds"), (10**20, 0, "nanoseconds")) if epoch_2001 else ((10**11, 10**6, "seconds"), (10**14, 10**3, "millis"), (10**17, 1, "micros"), (10**20, 0, "nanoseconds"))
    for below, micros, name in scales:
        if n < below:
            us = n * micros if micros else n // 1000
            if part and micros > 1:
                us += int(part[:12].ljust(12, "0")) * micros // 10**12
            try:
                return [("epoch_" + name, start + timedelta(microseconds=us), timezone.utc)]
            except OverflowError:
                return []
    return []


def readings(text: str | None, epoch_2001: bool = False) -> list[tuple[str, datetime, object]]:
    """(family, wall time, zone or None) for every way the text names one existing date with a possible time; [] when none does.

    Null, empty and placeholder texts have no reading, nor has what is longer than any notation once white space is folded. Only slashed numbers can have two
    readings, slash_dmy and slash_mdy.
    """
    if not text:
        return []
    text = _SPACES.sub(" ", unicodedata.normalize("NFKC", text).replace("−", "-").replace("–", "-")).strip()
    if len(text) > LONGEST:
        return []
    if _NUMBER.fullmatch(text):
        return _bare(text, epoch_2001)
    if m := _CTIME.fullmatch(text):
        g = m.groupdict()
        h, mi, *s = map(int, g["t"].split(":"))
        ok, tz = _zone_of({"z": g["z"]})
        day = _day("ctime", g, "")
        return [("ctime", datetime(day.year, day.month, day.day, h, mi, s[0] if s else 0), tz)] if ok and day and h < 24 and mi < 60 and (not s or s[0] < 60) else []
    for family, pattern in _DATES:
        m = pattern.match(text)
        if not m:
            continue
        rest, g = text[m.end() :], m.groupdict()
        if not rest:
            clock, ok, tz = (0, 0, 0, 0), True, None
        else:
            t = _TIME.fullmatch(rest) or _TIGHT.fullmatch(rest)
            if not t:
                continue
            clock = _clock(t.groupdict())
            ok, tz = _zone_of(t.groupdict())
        if not clock or not ok:
            return []
        out = []
        for order in ("dmy", "mdy") if family == "slash" else ("",):
            if day := _day(family, g, order):
                out.append((family + ("_" + order if order else ""), datetime(day.year, day.month, day.day, *clock), tz))
        return out
    return []


def to_utc(wall: datetime, tz) -> datetime | None:
    """UTC time of a wall time. A skipped wall time takes the offset before the change, one shown twice is the first."""
    try:
        return wall.replace(tzinfo=tz, fold=0).astimezone(timezone.utc)
    except (OverflowError, ValueError):
        return None
