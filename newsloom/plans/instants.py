"""The instant of a written date in SQL, from the statement of the problem: for comparison with what the dictionary gives."""

from __future__ import annotations

from newsloom.functions.timestamps import MONTHS, ZONE_LETTERS

_MONTH = "CASE lower(mon) " + " ".join(f"WHEN '{name}' THEN {k}" for name, k in MONTHS.items()) + " END"
_LETTERS = "CASE upper(z) " + " ".join(f"WHEN '{name}' THEN {minutes}" for name, minutes in ZONE_LETTERS.items()) + " END"
# a zone's offset in force at a time of UTC
_OFFSET = lambda at: f"(timezone(tz, ({at})::TIMESTAMPTZ) - ({at}))"


def sql_instants(rows: str) -> str:
    """Rows with utc_micros of the query rows, which gives x, zone and day_first and whatever other columns; null where x gives no instant."""
    return rf"""(WITH src AS ({rows}), s0 AS (SELECT *, regexp_replace(x, '\A[\t-\r \x{{85}}\p{{Z}}]+|[\t-\r \x{{85}}\p{{Z}}]+\z', '', 'g') AS s FROM src),
s1 AS (SELECT *, regexp_extract(s, '^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(.*)$', ['y', 'm', 'd', 'r']) AS iso, regexp_extract(s, '^(\d{{4}})(\d{{2}})(\d{{2}})(T\d{{4,6}}.*)?$', ['y', 'm', 'd', 'r']) AS basic,
  regexp_extract(s, '^(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}})(.*)$', ['a', 'b', 'y', 'r']) AS num, regexp_extract(s, '^(?:[A-Za-z]+\.?,?\s+)?(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+([A-Za-z]+)\.?,?[\s-]+(\d{{4}})(.*)$', ['d', 'mon', 'y', 'r']) AS dmy,
  regexp_extract(s, '^(?:[A-Za-z]+\.?,?\s+)?([A-Za-z]+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(.*)$', ['mon', 'd', 'y', 'r']) AS mdy FROM s0),
s2 AS (SELECT *, coalesce(nullif(dmy.mon, ''), mdy.mon) AS mon FROM s1),
s3 AS (SELECT *, CASE WHEN iso.y <> '' THEN iso.y || '-' || iso.m || '-' || iso.d WHEN basic.y <> '' THEN basic.y || '-' || basic.m || '-' || basic.d
    WHEN num.y <> '' THEN num.y || '-' || CASE WHEN day_first THEN num.b || '-' || num.a ELSE num.a || '-' || num.b END
    WHEN dmy.y <> '' THEN dmy.y || '-' || {_MONTH} || '-' || dmy.d WHEN mdy.y <> '' THEN mdy.y || '-' || {_MONTH} || '-' || mdy.d END AS day,
  CASE WHEN iso.y <> '' THEN iso.r WHEN basic.y <> '' THEN regexp_replace(basic.r, '^T(\d\d)(\d\d)(\d\d)?', 'T\1:\2:\3') WHEN num.y <> '' THEN num.r WHEN dmy.y <> '' THEN dmy.r ELSE mdy.r END AS rest FROM s2),
s4 AS (SELECT *, regexp_extract(rest, '^(?:T|\s*,?\s*(?:at\s+)?)(\d{{1,2}}):(\d{{2}})(?::(\d{{2}})(?:[.,](\d{{1,9}}))?)?\s*(?:([AaPp])\.?[Mm]\.?)?\s*(.*)$', ['h', 'mi', 's', 'f', 'ap', 'z']) AS c FROM s3),
s5 AS (SELECT *, coalesce(c.h, '') <> '' AS timed, coalesce(c.z, '') AS z, regexp_extract(c.z, '^\[([A-Za-z0-9_+\-/]+)\]$', 1) AS named,
  try_cast(c.h AS INT) % CASE WHEN c.ap <> '' THEN 12 ELSE 24 END + CASE WHEN lower(c.ap) = 'p' THEN 12 ELSE 0 END AS hour FROM s4),
s6 AS (SELECT *, try_cast(day AS DATE)::TIMESTAMP + CASE WHEN timed THEN to_hours(coalesce(hour, 0)::BIGINT) + to_minutes(coalesce(try_cast(c.mi AS BIGINT), 0)) + to_seconds(coalesce(try_cast(c.s AS BIGINT), 0))
    + to_microseconds(coalesce(try_cast(rpad(left(c.f, 6), 6, '0') AS BIGINT), 0)) ELSE to_hours(0) END AS wall,
  CASE WHEN regexp_full_match(z, '[+-]\d{{2}}:?\d{{2}}') THEN CASE WHEN z[1] = '-' THEN -1 ELSE 1 END * (try_cast(z[2:3] AS INT) * 60 + try_cast(z[-2:] AS INT)) WHEN regexp_full_match(z, '[A-Za-z]+') THEN {_LETTERS} END AS minutes,
  coalesce(nullif(named, ''), zone, 'UTC') AS tz, timed OR coalesce(rest, '') = '' AS whole, z = '' OR coalesce(named, '') <> '' AS zoneless FROM s5),
s7 AS (SELECT *, {_OFFSET("wall - INTERVAL 24 HOURS")} AS o1, {_OFFSET("wall + INTERVAL 24 HOURS")} AS o2 FROM s6),
s8 AS (SELECT *, CASE WHEN {_OFFSET("wall - o1")} = o1 OR {_OFFSET("wall - o2")} <> o2 THEN wall - o1 ELSE wall - o2 END AS local FROM s7)
SELECT * EXCLUDE (s, iso, basic, num, dmy, mdy, mon, day, rest, c, timed, z, named, hour, wall, minutes, tz, whole, zoneless, o1, o2, local),
  CASE WHEN regexp_full_match(s, '\d{{9,10}}(\.\d+)?') THEN round(try_cast(s AS DECIMAL(20, 6)) * 1000000)::BIGINT WHEN regexp_full_match(s, '\d{{12,13}}(\.\d+)?') THEN round(try_cast(s AS DECIMAL(20, 3)) * 1000)::BIGINT
    WHEN NOT whole THEN NULL WHEN zoneless THEN epoch_us(local) ELSE epoch_us(wall - to_minutes(minutes::BIGINT)) END AS utc_micros FROM s8)"""


#: published_date and cached_date of every article with the zone and day order that hold for them.
BOTH_FIELDS = """SELECT n.id, f.field_name, CASE WHEN f.field_name = 'published_date' THEN n.published_date ELSE n.cached_date END AS x,
  CASE WHEN f.field_name = 'published_date' THEN coalesce(s.home_zone, 'UTC') ELSE 'Asia/Kolkata' END AS zone, f.field_name = 'cached_date' OR coalesce(s.day_first, true) AS day_first
FROM news_cache n LEFT JOIN news_sources s ON s.source_name = n.source_name, (VALUES ('published_date'), ('cached_date')) AS f(field_name)"""
#: Instants of an expiry, which is written like the time of caching.
EXPIRES = "SELECT id, company_symbol, expires_date AS x, 'Asia/Kolkata' AS zone, true AS day_first FROM news_cache"
PUBLISHED = f"SELECT id, utc_micros FROM {sql_instants(BOTH_FIELDS)} WHERE field_name = 'published_date'"
P2_FOUND = f"SELECT id, field_name, utc_micros FROM {sql_instants(BOTH_FIELDS)} WHERE utc_micros IS NOT NULL"
