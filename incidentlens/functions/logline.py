"""Column expressions for single log lines: head parsing, colours, time stamps and zones."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from incidentlens import constants as C

_GROUP_OPEN = re.compile(r"\\.|\[(?:\\.|[^\]\\])*\]|\((?!\?)|\(\?<([A-Za-z][A-Za-z0-9]*)>")


def group_numbers(pattern: str) -> dict[str, int]:
    """Names of the capture groups of a line pattern and their numbers."""
    numbers, count = {}, 0
    for found in _GROUP_OPEN.finditer(pattern):
        if found.group().startswith("("):
            count += 1
            if found.group(1):
                numbers[found.group(1)] = count
    return numbers


def check_pattern(pattern: str) -> dict[str, int]:
    """Refuse a line pattern that could never yield an event."""
    numbers = group_numbers(pattern)
    missing = {"ts", "level"} - numbers.keys()
    if missing:
        raise ValueError(f"line pattern lacks the named groups {sorted(missing)}")
    return numbers


def _whole(pattern: str) -> str:
    return rf"\A(?:{pattern})\z"


def is_head(line: Column, pattern: str = C.DEFAULT_LINE_PATTERN) -> Column:
    return F.coalesce(line.rlike(_whole(pattern)), F.lit(False))


def head_field(line: Column, name: str, pattern: str = C.DEFAULT_LINE_PATTERN) -> Column:
    """One named field of a head line; null when the pattern has no such group."""
    number = group_numbers(pattern).get(name)
    if number is None:
        return F.lit(None).cast("string")
    value = F.regexp_extract(line, _whole(pattern), number)
    return value if name == "msg" else F.nullif(value, F.lit(""))


def strip_ansi(line: Column) -> Column:
    return F.regexp_replace(line, C.ANSI_ESCAPE, "")


def wallclock_to_utc(ts: Column, zone: str) -> Column:
    """Read a time without offset as wall-clock time of ``zone``; the result is UTC."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), ts.cast("timestamp_ntz"))


def utc_to_wallclock(ts: Column, zone: str) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ts.cast("timestamp_ntz"))


_TIMESTAMP_TEXT = r"\A\d{4}-\d{2}-\d{2}[T ]?\d{2}:\d{2}:\d{2}(?:\.\d{1,3})?(?:Z|[+-]\d{2}:?\d{2})?\z"
_OFFSET = r"([+-])(\d{2}):?(\d{2})\z"


def parse_timestamp(text: Column, zone: str) -> Column:
    """UTC time of a log time stamp; null when it cannot be read.

    A given offset wins, otherwise the text is wall-clock time of ``zone``.
    """
    plain = F.translate(text, ",", ".")
    known = plain.rlike(_TIMESTAMP_TEXT)
    local = F.regexp_replace(plain, r"(?:Z|[+-]\d{2}:?\d{2})\z", "")
    wall = local.try_cast("timestamp_ntz")
    sign = F.regexp_extract(plain, _OFFSET, 1)
    hours = F.regexp_extract(plain, _OFFSET, 2).try_cast("int")
    minutes = F.regexp_extract(plain, _OFFSET, 3).try_cast("int")
    offset = F.make_dt_interval(hours=hours, mins=minutes)
    return F.when(
        known,
        F.when(plain.endswith("Z"), wall)
        .when(sign == "+", wall - offset)
        .when(sign == "-", wall + offset)
        .otherwise(wallclock_to_utc(wall, zone)),
    )
