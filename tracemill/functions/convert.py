"""Text to value conversions as Catalyst expressions; a value that does not parse is null."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


BLANKS = " \t\r\n\f\v"


def clean(col: Column) -> Column:
    """Trimmed text, blank becomes null."""
    return F.nullif(F.trim(col, F.lit(BLANKS)), F.lit(""))


def strict_int(col: Column) -> Column:
    """Decimal integer with optional sign; floats and other text give null."""
    text = F.trim(col, F.lit(BLANKS))
    return F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast("bigint"))


def hex_int(text: Column) -> Column:
    """``0x..`` text to integer."""
    digits = F.lower(F.substring(text, 3, 64))
    return F.when(digits.rlike("^[0-9a-f]{1,15}$"), F.conv(digits, 16, 10).try_cast("bigint"))


def decimal_or_hex(col: Column) -> Column:
    """Decimal text, or hexadecimal text with a ``0x`` start."""
    text = F.trim(col)
    return F.when(text.startswith("0x"), hex_int(text)).otherwise(strict_int(text))


def lookup(table: Mapping, key: Column, value_type: str = "string") -> Column:
    """Value of a small constant table, null for other keys."""
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.create_map(*pairs)[key].cast(value_type)
