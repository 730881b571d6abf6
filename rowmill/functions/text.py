"""Text expressions with the cleaning semantics the rules rely on.

White space means the Unicode set (tabs, line ends, no-break and other space
separators, byte order mark), not only the ASCII blank that ``trim`` removes.
Lengths count UTF-16 units, so an astral character counts twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# For use inside a character class of a pattern.
SPACE = r"\s\p{Z}\x{FEFF}"

# The same set as characters.
SPACE_CHARS = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The ranges in front settle ordinary letters and digits with two comparisons.
_ONE_SPACE = rf"[\x00-\x20\x80-\uffff&&[{SPACE}]]"


def strip(c: Column) -> Column:
    """Remove white space of any kind at both ends."""
    return F.btrim(c, F.lit(SPACE_CHARS))


def collapse_space(c: Column) -> Column:
    """Turn every run of white space into one blank."""
    return F.regexp_replace(c, f"{_ONE_SPACE}+", " ")


def unit_length(c: Column) -> Column:
    """Length in UTF-16 units."""
    return F.shiftright(F.octet_length(F.encode(c, "UTF-16BE")), 1)


def longer_than(c: Column, limit: int) -> Column:
    """Whether a text has more than ``limit`` units.

    The byte length is known without decoding and never below the unit length,
    so short values skip the conversion.
    """
    return (F.octet_length(c) > limit) & (unit_length(c) > limit)


def non_empty(c: Column) -> Column:
    """Null for null and for the empty string, else the value."""
    return F.nullif(c, F.lit(""))


def is_blank(c: Column) -> Column:
    """True for null and for the empty string."""
    return c.isNull() | (c == "")


def shorten(c: Column, limit: int) -> Column:
    """First ``limit`` characters and an ellipsis when something was cut."""
    return F.when(longer_than(c, limit), F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def sanitize_name(c: Column) -> Column:
    """Column name reduced to ``[a-z0-9_]`` without doubled or outer underscores."""
    squeezed = F.regexp_replace(
        F.regexp_replace(strip(F.lower(c)), "[^a-z0-9_]", "_"), "_{2,}", "_"
    )
    return F.regexp_replace(squeezed, r"^_|_\z", "")


def email_domain(c: Column) -> Column:
    """Text between the first and the second at sign, else the empty string."""
    return F.coalesce(F.get(F.split(c, "@"), F.lit(1)), F.lit(""))


def display_name(name: Column, email: Column) -> Column:
    """Name, else the local part of the address, else a fixed placeholder."""
    local = F.get(F.split(email, "@"), F.lit(0))
    return F.coalesce(non_empty(name), non_empty(local), F.lit("Unknown Contact"))


def mask_secrets(c: Column, limit: int = 200) -> Column:
    """Hide quoted password and token values, then cut to ``limit`` characters.

    The ellipsis depends on the length before masking, as in the original log line.
    """
    masked = F.regexp_replace(c, rf"(?i)password[{SPACE}]*=[{SPACE}]*'[^']*'", "password='***'")
    masked = F.regexp_replace(masked, rf"(?i)token[{SPACE}]*=[{SPACE}]*'[^']*'", "token='***'")
    tail = F.when(longer_than(c, limit), F.lit("...")).otherwise(F.lit(""))
    return F.concat(F.substring(masked, 1, limit), tail)


def split_list(c: Column) -> Column:
    """``'a, b'`` to an array of stripped items."""
    return F.transform(F.split(c, ","), strip)


def to_flag(c: Column) -> Column:
    """True only for the text ``true``."""
    return F.coalesce(c == "true", F.lit(False))


def has_control_chars(c: Column) -> Column:
    return c.rlike(r"[\x00-\x1F\x7F-\x9F]")


def has_loose_space(c: Column) -> Column:
    """More than a fifth of the value is white space around it."""
    return unit_length(strip(c)) < unit_length(c) * F.lit(0.8)
