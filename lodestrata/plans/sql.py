"""Pieces of DuckDB SQL that express the engine's text functions."""

from __future__ import annotations

import re
import unicodedata

from lodestrata.functions import dates, zones
from lodestrata.operators import timestamps

# Characters of these ranges have one plain equal each; DuckDB has no NFKC.
_RANGES = [(0xFF01, 0xFF5F), (0x2070, 0x207A), (0x2460, 0x2469), (0x2F00, 0x2FD6), (0x2000, 0x200B)]
_SINGLES = [0x00A0, 0x202F, 0x205F, 0x3000, 0x00B2, 0x00B3, 0x00B9, 0x2011]
_PAIRS = [(chr(c), unicodedata.normalize("NFKC", chr(c))) for a, b in _RANGES for c in range(a, b)] + [(chr(c), unicodedata.normalize("NFKC", chr(c))) for c in _SINGLES]
_ONE = [(a, b) for a, b in _PAIRS if len(b) == 1 and a != b]
_MANY = ["…", "ﬀ", "ﬁ", "ﬂ", "ﬃ", "ﬄ"]


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def nfkc(expression: str) -> str:
    out = f"translate(nfc_normalize({expression}), {quoted(''.join(a for a, _ in _ONE))}, {quoted(''.join(b for _, b in _ONE))})"
    for char in _MANY:
        out = f"replace({out}, {quoted(char)}, {quoted(unicodedata.normalize('NFKC', char))})"
    return f"nfc_normalize({out})"


def fold(expression: str) -> str:
    return rf"regexp_replace(regexp_replace(lower({nfkc(expression)}), '[\s\p{{Z}}\x{{FEFF}}]+', ' ', 'g'), '^ | $', '', 'g')"


def tokens(expression: str, compatible: bool = True) -> str:
    """List of distinct tokens (in any order)."""
    base = f"lower({nfkc(expression) if compatible else expression})"
    pieces = (
        rf"flatten(list_transform(regexp_extract_all({base}, '\p{{Han}}+'), lambda r: CASE WHEN length(r) = 1 THEN [r] "
        rf"ELSE list_transform(range(1, length(r)), lambda i: substring(r, i::INT, 2)) END))"
    )
    words = rf"regexp_extract_all(regexp_replace({base}, '\p{{Han}}+', ' ', 'g'), '[\p{{L}}\p{{N}}]+')"
    return f"list_distinct(list_concat({pieces}, {words}))"


def body(expression: str) -> str:
    return rf"regexp_replace(regexp_replace({expression}, '\r\n?', chr(10), 'g'), '^[\s\p{{Z}}\x{{FEFF}}]+|[\s\p{{Z}}\x{{FEFF}}]+$', '', 'g')"


def infer_date(expression: str, folded: bool = False) -> str:
    """The first real date; ``folded`` says that the expression is plain already."""
    value = expression if folded else nfkc(expression)
    found = []
    for pattern in dates.NOTATIONS:
        parts = re.compile(pattern).groups
        group = [f"regexp_extract(x, {quoted(pattern)}, {n + 1})" for n in range(parts)]
        text = " || '-' || ".join([group[0], *[f"lpad({g}, 2, '0')" for g in group[1:]]])
        found.append(f"CASE WHEN {group[0]} <> '' AND try_cast({text} || '{'-01' * (3 - parts)}' AS DATE) IS NOT NULL THEN {text} END")
    # Written once, whatever the expression's length.
    return f"list_transform([{value}], lambda x: coalesce({', '.join(found)}))[1]"


SOURCES = "(SELECT DISTINCT * FROM sources)"
OBJECTS = "(SELECT hash, min(content) AS content, min(created_at) AS created_at FROM objects GROUP BY hash)"
CHUNKS = (
    "(SELECT id, any_value(object_hash) AS object_hash, any_value(ordinal) AS ordinal, any_value(start_line) AS start_line, any_value(end_line) AS end_line, "
    "any_value(content) AS content, coalesce(CAST(any_value(heading_path) AS JSON)::VARCHAR[], []) AS heading_path, any_value(occurred_at) AS occurred_at FROM chunks GROUP BY id)"
)
LIVE = f"(SELECT * FROM {SOURCES} WHERE deleted_at IS NULL AND is_current = 1)"


_CLOCK = r"(\d{1,2})[:h](\d{2})(?::(\d{2})(?:[.,](\d{1,12}))?)?"
_ZONE = r"(\[[A-Za-z_/+\-0-9]+\]|Z|z|[A-Za-z]{2,5}|[A-Z][A-Za-z_]+(?:/[A-Za-z0-9_+\-]+)+|(?:GMT|UTC)?[+\-]\d{2}(?::?\d{2})?)?"
_HALF = "AM|PM|am|pm"

#: Each notation with what its groups are: year, month, day, half of day, hour, minute, second, fraction, zone.
_TIMES = [
    (rf"^(\d{{4}})(?:(?:年|[-/.])(\d{{1,2}})(?:(?:月|[-/.])(\d{{1,2}})日?(?:[T\s]\s*(上午|下午|{_HALF})?\s*{_CLOCK}\s*{_ZONE})?|月)?|年)?$", "y mo d half h mi s f z"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})T?(\d{{2}})(\d{{2}})(\d{{2}})(?:[.,](\d{{1,12}}))?\s*{_ZONE}$", "y mo d h mi s f z"),
    (rf"^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:,?\s+{_CLOCK}\s*{_ZONE})?$", "d mo y h mi s f z"),
    (rf"^(?:\p{{L}}{{2,10}}\.?,?\s+)?(\d{{1,2}})\.?\s+(\p{{L}}{{3,10}})\.?,?\s+(\d{{4}})(?:,?\s+(?:um\s+|à\s+|at\s+)?{_CLOCK}(?:\s*({_HALF}))?\s*{_ZONE})?$", "d mo y h mi s f half z"),
    (rf"^(?:\p{{L}}{{2,10}}\.?,\s+)?(\p{{L}}{{3,10}})\.?\s+(\d{{1,2}}),?\s+(\d{{4}})(?:,?\s+(?:at\s+)?{_CLOCK}(?:\s*({_HALF}))?\s*{_ZONE})?$", "mo d y h mi s f half z"),
]


def normal_times(values: str, value: str = "value", zone: str = "zone", out: str = "normal_form") -> str:
    """CTEs after ``values`` (a table) that end in ``timed``: its rows with the normal form of their time, NULL without one."""
    names = "y mo d half h mi s f z".split()
    cases = {n: [] for n in names}
    for pattern, groups in _TIMES:
        places = groups.split()
        for n in names:
            picked = f"nullif(regexp_extract(c, {quoted(pattern)}, {places.index(n) + 1}), '')" if n in places else "NULL"
            cases[n].append(f"WHEN regexp_full_match(c, {quoted(pattern)}) THEN {picked}")
    parts = ", ".join(f"CASE WHEN e THEN NULL {' '.join(cases[n])} END AS {n}" for n in names)
    months = " ".join(f"WHEN lower(mo) IN ({', '.join(quoted(x) for x in spelled.split())}) THEN {n}" for n, spelled in timestamps.MONTHS.items())
    abbreviations = " ".join(f"WHEN {quoted(k)} THEN {v}" for k, v in zones.ABBREVIATIONS.items())
    return rf"""
clean AS (SELECT *, regexp_replace(translate({value}, {quoted(timestamps.WIDE)}, {quoted(timestamps.PLAIN)}), '^[\s\p{{Z}}\p{{Cf}}]+|[\s\p{{Z}}\p{{Cf}}]+$', '', 'g') AS c FROM {values}),
marked AS (SELECT *, regexp_full_match(c, '\d{{10}}([.,]\d+)?|\d{{13}}') AS e FROM clean),
parted AS (SELECT *, {parts} FROM marked),
typed AS (SELECT * EXCLUDE (y, mo, d, h, mi, s, z), try_cast(y AS INT) AS y, mo IS NULL AS no_month, CASE WHEN regexp_full_match(mo, '\d+') THEN try_cast(mo AS INT) {months} END AS mo, try_cast(d AS INT) AS d,
  CASE WHEN half IS NULL THEN try_cast(h AS INT) WHEN try_cast(h AS INT) BETWEEN 1 AND 12 THEN try_cast(h AS INT) % 12 + CASE WHEN lower(half) IN ('下午', 'pm') THEN 12 ELSE 0 END END AS h, h IS NULL AS no_clock,
  try_cast(mi AS INT) AS mi, coalesce(try_cast(s AS INT), 0) AS s, CAST(rpad(substring(coalesce(f, ''), 1, 3), 3, '0') AS INT) AS ms, regexp_replace(regexp_replace(z, '^\[|\]$', '', 'g'), '^(GMT|UTC)([+\-])', '\2') AS z FROM parted),
dated AS (SELECT *, try_cast(lpad(y::VARCHAR, 4, '0') || '-' || lpad(mo::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) AS day FROM typed),
local AS (SELECT *, CASE WHEN y >= 1 AND h BETWEEN 0 AND 23 AND mi BETWEEN 0 AND 59 AND s BETWEEN 0 AND 59 THEN day::TIMESTAMP + to_seconds(h * 3600 + mi * 60 + s) END AS wall,
  CASE WHEN regexp_full_match(z, '[+\-]\d{{2}}:?(\d{{2}})?') THEN (CAST(substring(z, 2, 2) AS INT) * 60 + coalesce(try_cast(nullif(regexp_extract(z, '^[+\-]\d{{2}}:?(\d{{2}})$', 1), '') AS INT), 0)) * CASE WHEN z LIKE '-%' THEN -1 ELSE 1 END
    ELSE CASE upper(z) {abbreviations} END END AS fixed, CASE WHEN z IS NULL THEN coalesce({zone}, 'UTC') WHEN contains(z, '/') THEN z END AS region FROM dated),
known AS (SELECT l.*, n.name AS known FROM local l LEFT JOIN (SELECT DISTINCT name FROM pg_timezone_names()) n ON n.name = l.region),
-- The later of two instants is given; one with the same wall clock before it, if there is one, has the offset in force before the change.
utc AS (SELECT *, CASE WHEN fixed IS NOT NULL THEN wall - to_minutes(fixed) WHEN known IS NOT NULL THEN (SELECT coalesce(max(CASE WHEN timezone(known, timezone('UTC', u - m)) = wall THEN u - m END), u) FROM (VALUES (INTERVAL 1 HOUR), (INTERVAL 30 MINUTE)) t(m))
    WHEN z IS NULL THEN wall END AS instant FROM (SELECT *, timezone('UTC', timezone(known, wall)) AS u FROM known)),
timed AS (SELECT * EXCLUDE (c, e, half, h, mi, s, f, z, y, mo, d, no_month, no_clock, ms, day, wall, fixed, region, known, u, instant), CASE
  WHEN e THEN strftime(make_timestamp(CASE WHEN length(c) = 13 AND c NOT LIKE '%.%' AND c NOT LIKE '%,%' THEN CAST(c AS BIGINT) * 1000 ELSE CAST(substring(c, 1, 10) AS BIGINT) * 1000000 + CAST(rpad(substring(regexp_extract(c, '[.,](\d+)$', 1), 1, 3), 3, '0') AS BIGINT) * 1000 END), '%Y-%m-%dT%H:%M:%S.%gZ')
  WHEN y IS NULL OR y < 1 THEN NULL
  WHEN no_month AND d IS NULL THEN lpad(y::VARCHAR, 4, '0')
  WHEN d IS NULL THEN CASE WHEN mo BETWEEN 1 AND 12 THEN lpad(y::VARCHAR, 4, '0') || '-' || lpad(mo::VARCHAR, 2, '0') END
  WHEN no_clock THEN strftime(day, '%Y-%m-%d')
  ELSE strftime(instant, '%Y-%m-%dT%H:%M:%S.') || lpad(ms::VARCHAR, 3, '0') || 'Z' END AS {out} FROM utc)"""
