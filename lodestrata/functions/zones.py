"""Zone-offset intervals of the IANA time zone database, as a table.

An interval says that in ``zone`` the offset ``offset_s`` holds for wall-clock
seconds ``local_start <= t < local_end`` (seconds since 1970-01-01T00:00:00 as
read off the clock).  Intervals of one zone overlap where a clock is put back
and leave a gap where it is put forward.
"""

from __future__ import annotations

import functools
import struct
import zoneinfo
from datetime import datetime, timedelta, timezone
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Wall-clock seconds before and after every real date.
FIRST_S, LAST_S = -(10**12), 10**12

#: Rules of zones are followed up to this year; the last offset holds beyond.
LAST_YEAR = 2100

#: First years of the first and the last bucket, and years in a bucket; times beyond use the nearest bucket.
FIRST_BUCKET, LAST_BUCKET, BUCKET_YEARS = 1900, LAST_YEAR - 10, 10

#: Offsets in minutes of zone abbreviations, whatever the season.
ABBREVIATIONS = {
    "UTC": 0, "GMT": 0, "UT": 0, "Z": 0, "WET": 0, "WEST": 60, "BST": 60, "CET": 60, "CEST": 120,
    "MEZ": 60, "MESZ": 120, "EET": 120, "EEST": 180, "MSK": 180, "IST": 330, "HKT": 480, "SGT": 480,
    "AWST": 480, "JST": 540, "KST": 540, "ACST": 570, "ACDT": 630, "AEST": 600, "AEDT": 660,
    "NZST": 720, "NZDT": 780, "AST": -240, "ADT": -180, "EST": -300, "EDT": -240, "CST": -360,
    "CDT": -300, "MST": -420, "MDT": -360, "PST": -480, "PDT": -420, "AKST": -540, "AKDT": -480,
    "HST": -600,
}


def _file_transitions(zone: str) -> tuple[list[int], str]:
    """UTC seconds at which the zone's file names a change, and the rule that holds after them."""
    data = b""
    for root in zoneinfo.TZPATH:
        path = Path(root, zone)
        if path.is_file():
            data = path.read_bytes()
            break
    if not data:
        try:
            import tzdata

            data = Path(tzdata.__file__).parent.joinpath("zoneinfo", zone).read_bytes()
        except (ImportError, OSError):
            return [], "unknown,"
    if data[:4] != b"TZif" or data[4:5] < b"2":
        return [], "unknown,"

    def counts(at: int) -> tuple[int, ...]:
        return struct.unpack(">6l", data[at + 20 : at + 44])

    isut, isstd, leap, times, types, chars = counts(0)
    second = 44 + times * 5 + types * 6 + chars + leap * 8 + isstd + isut
    times = counts(second)[3]
    rule = data[second:].rstrip(b"\n").rpartition(b"\n")[2].decode("ascii", "replace")
    return list(struct.unpack(f">{times}q", data[second + 44 : second + 44 + 8 * times])), rule


def _offset(info: zoneinfo.ZoneInfo, at: int) -> int:
    moment = datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=at)
    return int(moment.astimezone(info).utcoffset().total_seconds())


#: Changes by closing rule, for the many zones that share one.
_BY_RULE: dict[tuple[str, int], list[int]] = {}


def _rule_transitions(info: zoneinfo.ZoneInfo, after: int, rule: str) -> list[int]:
    """Changes that follow from the zone's closing rule, found month by month."""
    if "," not in rule:
        return []
    if (rule, after) not in _BY_RULE:
        _BY_RULE[rule, after] = _by_month(info, after)
    return _BY_RULE[rule, after]


def _by_month(info: zoneinfo.ZoneInfo, after: int) -> list[int]:
    found, step = [], 28 * 86400
    start = max(after + 1, 0)
    end = int(datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    offsets = {start: _offset(info, start)}
    while start < end:
        stop = start + step
        offsets[stop] = _offset(info, stop)
        if offsets[start] != offsets[stop]:
            low, high = start, stop
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if _offset(info, middle) == offsets[start] else (low, middle)
            found.append(high)
        start = stop
    return found


@functools.lru_cache(maxsize=None)
def intervals_of(zone: str) -> tuple[tuple[int, int, int], ...]:
    """(local_start, local_end, offset_s) of one zone, in order."""
    info = zoneinfo.ZoneInfo(zone)
    earliest = int(datetime(1, 1, 2, tzinfo=timezone.utc).timestamp())
    latest = int(datetime(LAST_YEAR, 1, 1, tzinfo=timezone.utc).timestamp())
    named, rule = _file_transitions(zone)
    written = sorted(t for t in set(named) if earliest < t < latest)
    changes = written + _rule_transitions(info, written[-1] if written else earliest, rule)
    pieces, start, offset = [], None, _offset(info, earliest + 86400)
    for at in changes:
        new = _offset(info, at)
        if new != offset:
            pieces.append((FIRST_S if start is None else start + offset, at + offset, offset))
            start, offset = at, new
    pieces.append((FIRST_S if start is None else start + offset, LAST_S, offset))
    return tuple(pieces)


@functools.lru_cache(maxsize=1)
def known_zones() -> tuple[str, ...]:
    return tuple(sorted(z for z in zoneinfo.available_timezones() if z != "localtime"))


def bucket_of(seconds):
    """First year of the bucket of wall-clock seconds (a Column)."""
    year = F.year(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")))
    bucket = (F.floor(year / BUCKET_YEARS) * BUCKET_YEARS).cast("int")
    return F.least(F.greatest(bucket, F.lit(FIRST_BUCKET)), F.lit(LAST_BUCKET))


def zone_intervals(spark: SparkSession) -> DataFrame:
    """One row (zone, year, spans) per zone and bucket of years.

    ``spans`` holds, in order, the intervals that touch the bucket, with the one
    before them so that a gap finds the offset in force before it.  The table's
    size is fixed by the time zone database (about 600 zones and 20 buckets),
    whatever the data, so it may be broadcast.
    """
    names = known_zones()

    def rows(batches):
        for batch in batches:
            out = []
            for zone in batch["zone"]:
                pieces = intervals_of(zone)
                starts = [p[0] for p in pieces]
                low = 0
                for year in range(FIRST_BUCKET, LAST_BUCKET + 1, BUCKET_YEARS):
                    begin = FIRST_S if year == FIRST_BUCKET else _year_start(year)
                    end = LAST_S if year == LAST_BUCKET else _year_start(year + BUCKET_YEARS)
                    while low < len(pieces) - 1 and pieces[low][1] <= begin:
                        low += 1
                    high = low
                    while high < len(pieces) and starts[high] < end:
                        high += 1
                    out.append((zone, year, [list(p) for p in pieces[max(0, low - 1) : high]]))
            yield pd.DataFrame(out, columns=["zone", "year", "spans"])

    zones = spark.createDataFrame([(z,) for z in names], "zone string").repartition(4)
    return zones.mapInPandas(rows, "zone string, year int, spans array<array<bigint>>")


@functools.lru_cache(maxsize=None)
def _year_start(year: int) -> int:
    return (datetime(year, 1, 1) - datetime(1970, 1, 1)).days * 86400
