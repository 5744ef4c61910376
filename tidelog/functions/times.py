"""Time formats and relative times, as expressions over wall-clock (zone-less) timestamps."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidelog.plans.errors import SearchError

#: The units of relative times and the ways to write them.
UNITS = {
    "s": ("s", "sec", "secs", "second", "seconds"), "m": ("m", "min", "mins", "minute", "minutes"), "h": ("h", "hr", "hrs", "hour", "hours"), "d": ("d", "day", "days"),
    "w": ("w", "week", "weeks"), "mon": ("mon", "month", "months"), "q": ("q", "qtr", "qtrs", "quarter", "quarters"), "y": ("y", "yr", "yrs", "year", "years"),
}
_BY_NAME = {n: u for u, names in UNITS.items() for n in names}
_OFFSET = r"[+-]\d*[A-Za-z]+"


def parse_relative(spec: str) -> list[tuple]:
    """The steps of a specifier: ("move", count, unit) and ("snap", unit, weekday)."""
    m = re.fullmatch(rf"({_OFFSET})?(?:@([A-Za-z]+)([0-7])?)?({_OFFSET})?", spec.strip())
    if not m or not spec.strip() or (m[4] and not m[2]):
        raise SearchError("SPL_INVALID_RELATIVE_TIME", f"{spec!r} isn't a relative time")

    def move(text: str) -> tuple:
        sign, count, unit = re.fullmatch(r"([+-])(\d*)([A-Za-z]+)", text).groups()
        if unit.lower() not in _BY_NAME:
            raise SearchError("SPL_INVALID_RELATIVE_TIME", f"{unit!r} isn't a unit")
        return ("move", (1 if sign == "+" else -1) * int(count or 1), _BY_NAME[unit.lower()])

    steps = [move(m[1])] if m[1] else []
    if m[2]:
        unit = _BY_NAME.get(m[2].lower())
        if unit is None or (m[3] is not None and unit != "w"):
            raise SearchError("SPL_INVALID_RELATIVE_TIME", f"{m[2]!r} isn't a unit to go back to")
        steps.append(("snap", unit, int(m[3] or 0) % 7))
    if m[4]:
        steps.append(move(m[4]))
    return steps


def relative_local(local: Column, spec: str) -> Column:
    """A wall-clock time moved and snapped."""
    for step in parse_relative(spec):
        if step[0] == "move":
            _, n, unit = step
            if unit in ("mon", "q", "y"):
                months = n * {"mon": 1, "q": 3, "y": 12}[unit]
                local = local + F.make_ym_interval(F.lit(0), F.lit(months))
            else:
                seconds = n * {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 604_800}[unit]
                local = local + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(float(seconds)).cast("decimal(18,6)"))
        else:
            _, unit, weekday = step
            if unit == "w":
                back = F.pmod(F.dayofweek(local) - 1 - F.lit(weekday), F.lit(7))
                local = F.date_trunc("day", local).cast("timestamp_ntz") - F.make_dt_interval(back)
            else:
                local = F.date_trunc({"s": "second", "m": "minute", "h": "hour", "d": "day", "mon": "month", "q": "quarter", "y": "year"}[unit], local).cast("timestamp_ntz")
    return local


def _pad(c: Column, n: int, sign: str = "0") -> Column:
    return F.lpad(c.cast("string"), n, sign)


def strftime(ts: Column, local: Column, fmt: str, zone: str) -> Column:
    """A time in a format of %-directives; ``local`` is the wall clock in ``zone``."""
    micro = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    wall = F.unix_micros(F.convert_timezone(F.lit("UTC"), F.current_timezone(), local).cast("timestamp"))
    offset = F.floor((wall - F.unix_micros(ts)) / F.lit(60_000_000)).cast("bigint")  # minutes east
    hh, mm = _pad(F.floor(F.abs(offset) / 60), 2), _pad(F.abs(offset) % 60, 2)
    sign = F.when(offset < 0, F.lit("-")).otherwise(F.lit("+"))
    hour12 = F.pmod(F.hour(local) - 1, F.lit(12)) + 1
    iso = F.date_trunc("week", local).cast("timestamp_ntz") + F.make_dt_interval(F.lit(3))  # the week's Thursday
    fraction = lambda n: F.substring(_pad(micro, 6), 1, n) if n <= 6 else F.concat(_pad(micro, 6), F.lit("000"))
    parts: dict[str, object] = {
        "%": lambda: F.lit("%"), "Y": lambda: _pad(F.year(local), 4), "y": lambda: F.substring(_pad(F.year(local), 4), 3, 2), "G": lambda: _pad(F.year(iso), 4), "g": lambda: F.substring(_pad(F.year(iso), 4), 3, 2),
        "m": lambda: _pad(F.month(local), 2), "b": lambda: F.date_format(local, "MMM"), "B": lambda: F.date_format(local, "MMMM"), "d": lambda: _pad(F.dayofmonth(local), 2), "e": lambda: _pad(F.dayofmonth(local), 2, " "),
        "j": lambda: _pad(F.dayofyear(local), 3), "V": lambda: _pad(F.weekofyear(local), 2), "w": lambda: (F.dayofweek(local) - 1).cast("string"), "a": lambda: F.date_format(local, "EEE"), "A": lambda: F.date_format(local, "EEEE"),
        "H": lambda: _pad(F.hour(local), 2), "I": lambda: _pad(hour12, 2), "M": lambda: _pad(F.minute(local), 2), "S": lambda: _pad(F.second(local), 2), "p": lambda: F.when(F.hour(local) < 12, F.lit("AM")).otherwise(F.lit("PM")),
        "T": lambda: F.date_format(local, "HH:mm:ss"), "F": lambda: F.date_format(local, "yyyy-MM-dd"), "s": lambda: F.floor(F.unix_micros(ts) / F.lit(1_000_000)).cast("string"),
        "z": lambda: F.concat(sign, hh, mm), ":z": lambda: F.concat(sign, hh, F.lit(":"), mm), "Q": lambda: fraction(3), "3Q": lambda: fraction(3), "6Q": lambda: fraction(6), "9Q": lambda: fraction(9), "N": lambda: fraction(9), "f": lambda: fraction(6),
    }
    out, at = [], 0
    for m in re.finditer(r"%([369]Q|:z|.)", fmt, re.S):
        if m[1] not in parts:
            raise SearchError("SPL_INVALID_TIME_FORMAT", f"%{m[1]} isn't a directive")
        if m.start() > at:
            out.append(F.lit(fmt[at : m.start()]))
        out.append(parts[m[1]]())
        at = m.end()
    if fmt[at:].endswith("%") and "%" in fmt[at:]:
        raise SearchError("SPL_INVALID_TIME_FORMAT", "the format ends in a lone %")
    if at < len(fmt):
        out.append(F.lit(fmt[at:]))
    return F.when(ts.isNotNull(), F.concat(*out) if out else F.lit(""))


#: What each directive reads, and as what part of a time.
_READ = {
    "Y": (r"\d{4}", "Y"), "m": (r"\d{1,2}", "m"), "d": (r"\d{1,2}", "d"), "e": (r" ?\d{1,2}", "d"), "b": (r"[A-Za-z]{3}", "b"), "B": (r"[A-Za-z]+", "b"), "H": (r"\d{1,2}", "H"), "I": (r"\d{1,2}", "I"),
    "M": (r"\d{1,2}", "M"), "S": (r"\d{1,2}", "S"), "p": (r"[AaPp][Mm]", "p"), "z": (r"Z|[+-]\d{2}:?\d{2}", "z"), ":z": (r"Z|[+-]\d{2}:\d{2}", "z"),
    "Q": (r"\d{1,9}", "Q"), "3Q": (r"\d{3}", "Q"), "6Q": (r"\d{6}", "Q"), "9Q": (r"\d{9}", "Q"), "N": (r"\d{1,9}", "Q"), "f": (r"\d{1,9}", "Q"), "a": (r"[A-Za-z]{3}", None), "A": (r"[A-Za-z]+", None), "%": ("%", None),
}


def strptime(text: Column, fmt: str, zone: str) -> Column:
    """Epoch seconds (a double) of a text in a format; null unless the whole text fits. Year, month and day are required."""
    fmt = fmt.replace("%F", "%Y-%m-%d").replace("%T", "%H:%M:%S")
    pattern, parts, at = "", {}, 0
    for m in re.finditer(r"%([369]Q|:z|.)", fmt, re.S):
        if m[1] not in _READ:
            raise SearchError("SPL_INVALID_TIME_FORMAT", f"%{m[1]} can't be read")
        read, part = _READ[m[1]]
        pattern += re.escape(fmt[at : m.start()]) + (f"({read})" if part else f"(?:{read})")
        if part:
            if part in parts:
                raise SearchError("SPL_INVALID_TIME_FORMAT", f"%{m[1]} is given twice")
            parts[part] = len(parts) + 1
        at = m.end()
    pattern = f"^{pattern}{re.escape(fmt[at:])}$"
    if not ({"Y", "d"} <= parts.keys() and ({"m", "b"} & parts.keys())):
        raise SearchError("SPL_INVALID_TIME_FORMAT", "year, month and day are required")
    get = lambda p: F.trim(F.regexp_extract(text, pattern, parts[p]))
    months = "janfebmaraprmayjunjulaugsepoctnovdec"
    month = F.lpad(get("m"), 2, "0") if "m" in parts else F.lpad(F.floor((F.instr(F.lit(months), F.lower(F.substring(get("b"), 1, 3))) + 2) / 3).cast("string"), 2, "0")
    if "I" in parts:
        hour = F.pmod(get("I").try_cast("int"), F.lit(12)) + (F.when(F.upper(get("p")) == "PM", 12).otherwise(0) if "p" in parts else F.lit(0))
        hour = _pad(F.when(get("I").try_cast("int").between(1, 12), hour), 2)
    else:
        hour = F.lpad(get("H"), 2, "0") if "H" in parts else F.lit("00")
    minute, second = (F.lpad(get(p), 2, "0") if p in parts else F.lit("00") for p in ("M", "S"))
    stamp = F.concat(get("Y"), F.lit("-"), month, F.lit("-"), F.lpad(get("d"), 2, "0"), F.lit(" "), hour, F.lit(":"), minute, F.lit(":"), second)
    if "z" in parts:
        off = F.when(get("z") == "Z", F.lit("+0000")).otherwise(F.regexp_replace(get("z"), ":", ""))
        us = F.unix_micros(F.try_to_timestamp(F.concat(stamp, off), F.lit("yyyy-MM-dd HH:mm:ssxx")))
    else:
        wall = F.try_to_timestamp(F.concat(stamp, F.lit("+0000")), F.lit("yyyy-MM-dd HH:mm:ssxx"))
        us = F.unix_micros(F.to_utc_timestamp(F.convert_timezone(F.current_timezone(), F.lit("UTC"), wall.cast("timestamp_ntz")).cast("timestamp"), zone)) if zone != "UTC" else F.unix_micros(wall)
    fraction = F.rpad(F.substring(get("Q"), 1, 6), 6, "0").try_cast("bigint") if "Q" in parts else F.lit(0)
    return F.when(text.rlike(pattern), (us + fraction) / F.lit(1e6))
