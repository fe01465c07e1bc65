"""Derived-column expressions: dates, seasons, codes, transforms, formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .casting import col_, to_double

# Season codes by month (upper-case variant and accented variant).
SEASON_CODES = {"PRINTEMPS": (3, 4, 5), "ETE": (6, 7, 8), "AUTOMNE": (9, 10, 11), "HIVER": (12, 1, 2)}
SEASON_LABELS = {"Printemps": (3, 4, 5), "Été": (6, 7, 8), "Automne": (9, 10, 11), "Hiver": (12, 1, 2)}
# Weekday order Monday..Sunday.
WEEKDAYS = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def building_age(year, ref_year: int) -> Column:
    """max(ref_year - construction year, 0); null stays null."""
    y = to_double(year) if isinstance(year, str) else year
    return F.when(y.isNotNull(), F.greatest(F.lit(float(ref_year)) - y, F.lit(0.0)))


def wall_seconds(c) -> Column:
    """Seconds since 1970-01-01 00:00 of the wall-clock value. For
    ``timestamp_ntz`` this does not depend on the session time zone (a cast
    to ``timestamp`` would, and would shift day counts across DST changes)."""
    x = col_(c)
    return (F.unix_date(F.to_date(x)).cast("double") * 86400.0 + F.hour(x) * 3600.0 + F.minute(x) * 60.0
            + F.extract(F.lit("SECOND"), x).cast("double"))


def closing_delay_days(claim_date, close_date) -> Column:
    """Whole days close - claim, floored (negative delays kept)."""
    return F.floor((wall_seconds(close_date) - wall_seconds(claim_date)) / 86400.0).cast("int")


def season(date, labels=SEASON_CODES) -> Column:
    m = F.month(col_(date))
    e = F.when(m.isNull(), F.lit(None))
    for lab, months in labels.items():
        e = e.when(m.isin(list(months)), F.lit(lab))
    return e


def decade(year) -> Column:
    return (F.floor(to_double(year) / 10) * 10).cast("int")


def department(postal, pad: bool = True) -> Column:
    """First two characters of the postal code, zero-padded to 5 first
    (longer codes are kept whole: ``lpad`` alone would truncate them)."""
    c = F.trim(col_(postal).cast("string"))
    if pad:
        c = F.when(F.length(c) < 5, F.lpad(c, 5, "0")).otherwise(c)
    return F.substring(c, 1, 2)


def month_start(date) -> Column:
    """First instant of the month as ``timestamp_ntz``, time-zone free
    (``date_trunc`` would return a session-zone timestamp)."""
    return F.trunc(F.to_date(col_(date)), "MM").cast("timestamp_ntz")


def month_label(date, fmt: str = "MMyyyy") -> Column:
    return F.date_format(col_(date), fmt)


def month_from_parts(year, month) -> Column:
    """First day of the month from year and month columns; month outside
    1..12 or missing parts -> null."""
    y = to_double(year)
    m = to_double(month)
    ok = y.isNotNull() & m.isNotNull() & (m >= 1) & (m <= 12) & (m == F.floor(m))
    return F.when(ok, F.make_date(y.cast("int"), m.cast("int"), F.lit(1)))


def format_number(x, kind: str = "currency") -> Column:
    """currency '1,234 €', percentage '12.34%', decimal '1.23'; null -> 'N/A'."""
    v = to_double(x)
    if kind == "currency":
        s = F.concat(F.format_number(v, 0), F.lit(" €"))
    elif kind == "percentage":
        s = F.concat(F.format_number(v * 100, 2), F.lit("%"))
    elif kind == "decimal":
        s = F.format_number(v, 2)
    else:
        s = v.cast("string")
    return F.coalesce(s, F.lit("N/A"))
