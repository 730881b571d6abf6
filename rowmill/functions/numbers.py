"""Number expressions: prefix parsing, rates and instants."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rowmill.functions.text import SPACE


def parse_int(c: Column) -> Column:
    """Leading whole number of a text as bigint, null when there is none.

    ``12abc`` is 12 and ``12.7`` is 12; hexadecimal prefixes are not read.
    """
    digits = F.regexp_extract(c, rf"^[{SPACE}]*([+-]?[0-9]+)", 1)
    return digits.try_cast("bigint")


def floor_div(c: Column, n: int) -> Column:
    """Whole-number quotient rounded down, exact for every bigint."""
    return F.call_function("div", c - F.pmod(c, F.lit(n)), F.lit(n)).cast("bigint")


def percent(part: Column, total: Column) -> Column:
    """Share in percent with two decimals, half up; 0 for an empty total."""
    ratio = part.cast("double") / F.nullif(total, F.lit(0)).cast("double")
    rounded = F.floor(ratio * 100 * 100 + F.lit(0.5)) / F.lit(100.0)
    return F.when(total > 0, rounded).otherwise(F.lit(0.0))


def ratio(part: Column, total: Column) -> Column:
    """Plain quotient as double; 0 for an empty total."""
    return F.when(total > 0, part.cast("double") / F.nullif(total, F.lit(0))).otherwise(F.lit(0.0))


def epoch_ms(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, free of the session zone."""
    return floor_div(epoch_us(ts), 1000)


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a timestamp without zone."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    return F.timestamp_diff("MICROSECOND", start, ts)


def try_instant(c: Column) -> Column:
    """ISO-8601 text to a timestamp, null when it is not one."""
    return F.try_to_timestamp(c)
