"""String expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import named

# Number text accepted by numeric inference (plain decimal or
# scientific notation, optional sign, optional surrounding blanks).
NUMERIC_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INTEGER_TEXT = r"^\s*[+-]?\d+\s*$"

# Datetime layouts accepted by datetime inference, each with the
# text shape it applies to (a failed parse is costly, so only the layout whose
# shape matches is tried).
DATETIME_FORMATS = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}T\d{1,2}:\d{1,2}:\d{1,2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-MM-dd"),
]


# The white-space characters removed by ``strip`` (the characters
# Python's ``str.isspace`` accepts), as one regex class usable by Java and RE2.
WHITESPACE_CLASS = (r"[\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")
STRIP_PATTERN = f"^{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+$"
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


# The same characters as one literal string, for ``btrim``.
WHITESPACE_CHARS = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(chr(c) for c in range(0x2000, 0x200B))
                    + "\u2028\u2029\u202f\u205f\u3000")


def strip(c: Column) -> Column:
    """Remove leading and trailing white space (like ``str.strip``)."""
    return F.btrim(c, F.lit(WHITESPACE_CHARS))


def parse_datetime(c: Column) -> Column:
    """The layout matching the text's shape, as a wall-clock timestamp; NULL otherwise."""
    out = None
    for shape, fmt in DATETIME_FORMATS:
        parsed = F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")
        out = F.when(c.rlike(shape), parsed) if out is None else out.when(c.rlike(shape), parsed)
    return out


def tokens(c: Column) -> Column:
    """Lower-case word tokens (letters and digits), empty strings removed."""
    return F.filter(F.split(F.lower(c), TOKEN_SPLIT), lambda t: F.length(t) > 0)


def short_float(c: Column) -> Column:
    """Text of a value already rounded to <= 4 decimals, as Python prints it
    (``0.12``, ``1.0``, ``0.0001``): fixed 4-decimal text with trailing zeros cut."""
    s = F.regexp_replace(F.format_string("%.4f", c), r"0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


def fits(c: str, i: int) -> list[Column]:
    """Aggregates ``w64_i``, ``w128_i``: values of a text column that fit each integer width."""
    return [F.count(F.trim(named(c)).try_cast(t)).alias(f"{n}_{i}")
            for n, t in (("w64", "bigint"), ("w128", "decimal(38,0)"))]


def integer_type(row, i: int) -> str | None:
    """The narrowest type that holds every value of an all-digits column; None: stays text."""
    n = row[f"n{i}"]
    return "bigint" if row[f"w64_{i}"] == n else "decimal(38,0)" if row[f"w128_{i}"] == n else None
