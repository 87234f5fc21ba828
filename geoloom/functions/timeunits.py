"""Reference-time units, decimal years and physical units as column expressions."""

from __future__ import annotations

import re
from datetime import datetime, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Seconds in a time unit (fixed values).
SECONDS = {"microseconds": 1e-6, "milliseconds": 1e-3, "seconds": 1.0, "minutes": 60.0, "hours": 3600.0, "days": 86400.0, "weeks": 604800.0}
#: unit -> (dimension, scale, offset); value in base units = v * scale + offset (fixed values).
UNITS = {
    "mm": ("length", 1e-3, 0.0), "cm": ("length", 1e-2, 0.0), "m": ("length", 1.0, 0.0), "km": ("length", 1e3, 0.0),
    "g": ("mass", 1e-3, 0.0), "kg": ("mass", 1.0, 0.0), "t": ("mass", 1e3, 0.0), "Gt": ("mass", 1e12, 0.0),
    "s": ("time", 1.0, 0.0), "min": ("time", 60.0, 0.0), "h": ("time", 3600.0, 0.0), "day": ("time", 86400.0, 0.0),
    "K": ("temperature", 1.0, 0.0), "degC": ("temperature", 1.0, 273.15), "degF": ("temperature", 5.0 / 9.0, 459.67 * 5.0 / 9.0),
    "Pa": ("pressure", 1.0, 0.0), "hPa": ("pressure", 1e2, 0.0), "kPa": ("pressure", 1e3, 0.0),
    "rad": ("angle", 1.0, 0.0), "degree": ("angle", 0.017453292519943295, 0.0),
}
GREGORIAN = ("standard", "gregorian", "proleptic_gregorian")


def parse_reference(unit: str, calendar: str = "standard") -> tuple[float, datetime]:
    """Seconds per step and origin of "<steps> since <time>"; other calendars are refused."""
    if calendar not in GREGORIAN:
        raise ValueError(f"calendar {calendar} is not supported")
    m = re.match(r"\s*(\w+)\s+since\s+(.+?)\s*$", unit)
    if not m:
        raise ValueError(f"no reference time in {unit!r}")
    step = m[1] if m[1].endswith("s") else m[1] + "s"
    if step not in SECONDS:
        raise ValueError(f"unknown step {m[1]!r}")
    return SECONDS[step], datetime.fromisoformat(m[2]).replace(tzinfo=timezone.utc)


def rebase(unit: Column, step: str = "seconds") -> Column:
    """The same reference time with another step; an error without one."""
    named = F.regexp_replace(unit, r"^\S*", step)
    return F.when(unit.rlike(r"^\S+\s+since\s"), named).otherwise(F.raise_error(F.concat(F.lit("no reference time in "), unit)))


def decode(value: Column, unit: str, calendar: str = "standard") -> Column:
    """Time of a number of steps since the origin, cut to whole seconds."""
    step, origin = parse_reference(unit, calendar)
    return F.timestamp_seconds(F.floor(value.cast("double") * step + origin.timestamp()).cast("long"))


def encode(time: Column, unit: str, calendar: str = "standard") -> Column:
    """Steps since the origin."""
    step, origin = parse_reference(unit, calendar)
    return (F.unix_micros(time.cast("timestamp")) - int(origin.timestamp() * 1_000_000)) / (step * 1_000_000.0)


def convert_steps(value: Column, unit: str, to: str) -> Column:
    """Numbers of one reference unit in another one's."""
    (a, a0), (b, b0) = parse_reference(unit), parse_reference(to)
    return (value * a + (a0 - b0).total_seconds()) / b


def convert(value: Column, unit: str, to: str) -> Column:
    """Physical units of one dimension."""
    (d1, s1, o1), (d2, s2, o2) = UNITS[unit], UNITS[to]
    if d1 != d2:
        raise ValueError(f"{unit} is a {d1}, {to} is a {d2}")
    return (value * s1 + (o1 - o2)) / s2


def year_fraction(time: Column) -> Column:
    """Decimal year in UTC."""
    t = time.cast("timestamp")
    start = F.make_timestamp(F.year(t), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    end = F.make_timestamp(F.year(t) + 1, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    sec = F.unix_seconds
    return F.year(t) + (sec(t) - sec(start)) / (sec(end) - sec(start)).cast("double")


def midpoint(a: Column, b: Column) -> Column:
    """Halfway between two times, in whole microseconds."""
    lo, hi = F.unix_micros(a.cast("timestamp")), F.unix_micros(b.cast("timestamp"))
    return F.timestamp_micros((lo + F.floor((hi - lo) / 2)).cast("long"))
