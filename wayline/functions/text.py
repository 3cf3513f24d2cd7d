"""Text and time expressions of the ingest: headers, counts, dates, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]


def header_key(c: Column) -> Column:
    """A header as a plain key: signs spelled out, lower case, single spaces, none inside brackets' edges."""
    c = F.regexp_replace(F.regexp_replace(c, "°", "deg"), "[µμ]", "u")
    c = F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))
    return F.regexp_replace(F.regexp_replace(c, r"\( ", "("), r" \)", ")")


def satellite_counts(c: Column) -> Column:
    """struct<used,visible,recovered> of '18 / 19', or of what a spreadsheet made of it ('Dec-14', '10-Dec')."""
    month = lambda name: F.array_position(F.array(*map(F.lit, _MONTHS)), name)
    part = lambda p, g: F.nullif(F.regexp_extract(c, p, g), F.lit(""))
    plain, first, last = r"^\s*(\d+)\s*/\s*(\d+)\s*$", r"^([A-Z][a-z]{2})-(\d{2})$", r"^(\d{1,2})-([A-Z][a-z]{2})$"
    m1, m2 = month(part(first, 1)), month(part(last, 2))
    used = F.coalesce(part(plain, 1).cast("long"), F.nullif(m1, F.lit(0)), F.when(m2 > 0, part(last, 1).cast("long")))
    visible = F.coalesce(part(plain, 2).cast("long"), F.when(m1 > 0, part(first, 2).cast("long")), F.nullif(m2, F.lit(0)))
    return F.struct(used.alias("used"), visible.alias("visible"), F.coalesce((m1 > 0) | (m2 > 0), F.lit(False)).alias("recovered"))


def strict_datetime(c: Column) -> Column:
    """'2019-09-07 09:13:29:506'; any other form is null."""
    return F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss:SSS"))


def local_to_utc(c: Column, zone: str) -> Column:
    """A civil time as UTC; null where the clock skipped it or showed it twice."""
    u = F.to_utc_timestamp(c, zone)
    hour = F.expr("interval 1 hour")
    back = lambda x: F.from_utc_timestamp(x, zone)
    return F.when((back(u) == c) & (back(u - hour) != c) & (back(u + hour) != c), u)


def route_group(c: Column) -> Column:
    """A session name without the letter of its segment: S3a is S3."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"^(.*\d)([a-z])$", 1), F.lit("")), c)


def slug(c: Column) -> Column:
    """The part before the first comma as a plain name."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.split(c, ",")[0]), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def file_meta(path: Column) -> Column:
    """struct<kind,session> of '.../S-V2a.csv'; nulls for any other name."""
    p = r"([^/]*)$"
    name = F.regexp_extract(path, p, 1)
    get = lambda g: F.nullif(F.regexp_extract(name, r"^([SV])-([A-Za-z0-9]+)\.csv$", g), F.lit(""))
    return F.struct(get(1).alias("kind"), get(2).alias("session"))


def csv_field(c: Column) -> Column:
    """A field quoted as CSV asks for it."""
    return F.when(c.rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def finite(c: Column) -> Column:
    """Null for a value that JSON cannot hold."""
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def shown(c: Column, digits: int, unit: str) -> Column:
    """A number and its unit, a dash for null."""
    return F.coalesce(F.concat(F.format_number(c, digits), F.lit(unit)), F.lit("—"))
