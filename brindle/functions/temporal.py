"""Date and time functions on dates and timestamps (or their usual text forms), in the session's zone."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .registry import scalar


def _ts(c: Column) -> Column:
    return c.cast("timestamp")


# MySQL's date_format letters and Spark's patterns.
LETTERS = {
    "Y": "yyyy", "y": "yy", "m": "MM", "c": "M", "d": "dd", "e": "d", "H": "HH", "k": "H", "h": "hh", "I": "hh", "l": "h", "i": "mm", "s": "ss", "S": "ss",
    "f": "SSSSSS", "p": "a", "M": "MMMM", "b": "MMM", "W": "EEEE", "a": "EEE", "j": "DDD", "T": "HH:mm:ss", "r": "hh:mm:ss a", "%": "'%'",
}


def spark_pattern(mysql: str) -> str:
    """A %-pattern as a Spark datetime pattern."""
    out = []
    for m in re.finditer(r"%(.)|([A-Za-z]+)|(.)", mysql, re.S):
        out.append(LETTERS.get(m[1], f"'{m[1]}'") if m[1] else f"'{m[2]}'" if m[2] else m[3].replace("'", "''"))
    return "".join(out)


def _part(name: str):
    return lambda t: F.date_part(F.lit(name), _ts(t)).cast("int")


for _names, _f in {
    ("now", "current_timestamp"): lambda: F.current_timestamp(),
    ("current_date", "curdate"): lambda: F.current_date(),
    ("current_time", "curtime"): lambda: F.date_format(F.current_timestamp(), "HH:mm:ss"),
    ("year",): lambda t: F.year(_ts(t)),
    ("month",): lambda t: F.month(_ts(t)),
    ("day", "dayofmonth"): lambda t: F.dayofmonth(_ts(t)),
    ("hour",): lambda t: F.hour(_ts(t)),
    ("minute",): lambda t: F.minute(_ts(t)),
    ("second",): lambda t: F.second(_ts(t)),
    ("date",): lambda t: F.to_date(_ts(t)),
    ("time",): lambda t: F.date_format(_ts(t), "HH:mm:ss"),
    ("datediff",): lambda a, b: ((F.unix_timestamp(_ts(a)) - F.unix_timestamp(_ts(b))) / 86400).cast("long"),
    ("dayname", "day_name"): lambda t: F.date_format(_ts(t), "EEEE"),
    ("monthname", "month_name"): lambda t: F.date_format(_ts(t), "MMMM"),
    ("dayofweek", "day_of_week"): lambda t: F.dayofweek(_ts(t)),
    ("dayofyear", "day_of_year"): lambda t: F.dayofyear(_ts(t)),
    ("week", "weekofyear"): lambda t: F.weekofyear(_ts(t)),
    ("quarter",): lambda t: F.quarter(_ts(t)),
    ("last_day",): lambda t: F.last_day(_ts(t)),
    ("unix_timestamp", "epoch"): lambda t: F.unix_timestamp(_ts(t)),
    ("from_unixtime", "to_timestamp"): lambda n: F.timestamp_seconds(n),
    ("make_time",): lambda h, m, s: F.format_string("%02d:%02d:%02d", h.cast("int"), m.cast("int"), s.cast("int")),
    ("make_timestamp",): lambda y, mo, d, h, mi, s: F.make_timestamp(y, mo, d, h, mi, s),
    ("century",): lambda t: F.floor((F.year(_ts(t)) - 1) / 100).cast("int") + 1,
    ("millennium",): lambda t: F.floor((F.year(_ts(t)) - 1) / 1000).cast("int") + 1,
    ("decade",): lambda t: F.floor(F.year(_ts(t)) / 10).cast("int"),
    ("era",): lambda t: F.when(F.year(_ts(t)) > 0, "AD").otherwise("BC"),
    ("isodow", "iso_day_of_week"): _part("DAYOFWEEK_ISO"),
    ("isoyear", "iso_year"): _part("YEAROFWEEK"),
    ("julian_day",): lambda t: F.unix_timestamp(_ts(t)) / 86400 + 2440587.5,
    ("year_week",): lambda t: _part("YEAROFWEEK")(t) * 100 + F.weekofyear(_ts(t)),
    ("date_trunc", "datetrunc"): lambda unit, t: F.call_function("date_trunc", unit, _ts(t)),
    ("time_bucket",): lambda n, t: F.timestamp_seconds(F.unix_timestamp(_ts(t)) - F.pmod(F.unix_timestamp(_ts(t)), n)),
}.items():
    scalar(*_names)(_f)


@scalar("make_date")
def make_date(y, m, d):
    """Months and days out of range run on into the next or former year or month."""
    months = y.cast("int") * 12 + m.cast("int") - 1
    first = F.make_date(F.floor(months / 12).cast("int"), F.pmod(months, F.lit(12)) + 1, F.lit(1))
    return F.date_add(first, d.cast("int") - 1)


def date_format(t: Column, pattern: str) -> Column:
    """``pattern`` in MySQL's %-letters, a constant."""
    return F.date_format(_ts(t), spark_pattern(pattern))


scalar("date_format")(lambda t, pattern=None, spec="%Y-%m-%d %H:%i:%s": date_format(t, spec))


@scalar("extract", "date_part")
def extract(unit, t):
    """A part by name; dow counts from 0 for Sunday."""
    t = _ts(t)
    unit = F.lower(unit)
    parts = {
        "year": F.year(t), "month": F.month(t), "day": F.dayofmonth(t), "hour": F.hour(t), "minute": F.minute(t), "second": F.second(t), "dow": F.dayofweek(t) - 1,
        "doy": F.dayofyear(t), "week": F.weekofyear(t), "quarter": F.quarter(t), "epoch": F.unix_timestamp(t),
    }
    out = F.lit(None).cast("long")
    for name, value in parts.items():
        out = F.when(unit == name, value.cast("long")).otherwise(out)
    return out


def _shift(t: Column, n: Column, unit: str, sign: int) -> Column:
    """Add n units; where the day does not exist in the new month, its surplus days run on."""
    t, n, unit = _ts(t), n.cast("int") * sign, unit.lower().rstrip("s")
    if unit in ("month", "quarter", "year"):
        months = n * {"month": 1, "quarter": 3, "year": 12}[unit]
        first = F.trunc(t, "month")
        there = F.add_months(first, months)
        return _ts(F.date_add(there, F.dayofmonth(t) - 1)) + (t - _ts(F.to_date(t)))
    seconds = {"second": 1, "minute": 60, "hour": 3600, "day": 86400, "week": 604800}[unit]
    return F.timestamp_micros(F.unix_micros(t) + n.cast("long") * seconds * 1_000_000)


scalar("date_add", "adddate")(lambda t, n, unit=None, by="day": _shift(t, n, by, 1))
scalar("date_sub", "subdate")(lambda t, n, unit=None, by="day": _shift(t, n, by, -1))


@scalar("age")
def age(a, b):
    """'X years Y months Z days' from b to a, with a leading minus if a is before b."""
    a, b = _ts(a), _ts(b)
    late, early = F.greatest(a, b), F.least(a, b)
    months = F.floor(F.months_between(F.to_date(late), F.to_date(early), False)).cast("int")
    days = F.datediff(late, F.add_months(F.to_date(early), months))
    text = F.concat((months / 12).cast("int").cast("string"), F.lit(" years "), (months % 12).cast("string"), F.lit(" months "), days.cast("string"), F.lit(" days"))
    return F.concat(F.when(a < b, "-").otherwise(""), text)
