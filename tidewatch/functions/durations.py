"""Durations as whole nanoseconds."""

from __future__ import annotations

import re
from datetime import timedelta

import numpy as np

# Nanoseconds of a unit, and the names that a unit goes by.
NANOSECONDS = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "min": 60 * 10**9, "h": 3600 * 10**9, "d": 86_400 * 10**9, "w": 604_800 * 10**9}
ALIASES = {
    "ns": ("nanosecond", "nanoseconds"),
    "us": ("µs", "microsecond", "microseconds"),
    "ms": ("millisecond", "milliseconds"),
    "s": ("sec", "secs", "second", "seconds"),
    "min": ("m", "t", "mins", "minute", "minutes"),
    "h": ("hr", "hrs", "hour", "hours"),
    "d": ("day", "days"),
    "w": ("wk", "week", "weeks"),
}
CALENDAR = frozenset("mo mon month months q quarter quarters y yr year years a b bd".split())
UNITS = {name: NANOSECONDS[unit] for unit, names in ALIASES.items() for name in (unit, *names)}
WRITTEN = re.compile(r"\s*([0-9]*\.?[0-9]+)?\s*([a-zA-Zµ]+)\s*")

Window = int | str | timedelta | np.timedelta64


def parse_duration(spec: str | timedelta | np.timedelta64) -> int:
    """Nanoseconds of ``"90s"``, ``"1.5 hours"``, ``"d"``, a timedelta or numpy timedelta.

    One number and one fixed unit; units of varying length (months, quarters, years, business days) are refused, and so
    is anything that is not a positive whole number of nanoseconds.
    """
    if isinstance(spec, timedelta):
        return (spec.days * 86_400 + spec.seconds) * 10**9 + spec.microseconds * 1000
    if isinstance(spec, np.timedelta64):
        if np.datetime_data(spec)[0] in ("Y", "M"):
            raise ValueError(f"{spec!r} has no fixed length")
        return int(spec.astype("timedelta64[ns]").astype(np.int64))
    if not isinstance(spec, str):
        raise TypeError(f"a duration is a string or a timedelta, not {type(spec).__name__}")
    found = WRITTEN.fullmatch(spec)
    if not found:
        raise ValueError(f"not a duration: {spec!r}; write one number and one unit, like '90s'")
    number, unit = found[1] or "1", found[2]
    if unit == "M" or unit.lower() in CALENDAR:
        raise ValueError(f"{spec!r} has no fixed length")
    if unit.lower() not in UNITS:
        raise ValueError(f"unknown unit in {spec!r}")
    value = float(number) * UNITS[unit.lower()] if "." in number else int(number) * UNITS[unit.lower()]
    if value <= 0 or value != int(value):
        raise ValueError(f"{spec!r} is not a positive whole number of nanoseconds")
    return int(value)
