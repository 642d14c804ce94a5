"""Text expressions for codes, keys and labels."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ridertide.functions.numeric import to_long


def tidy_name(name: object) -> str:
    """Column-name clean-up: no byte-order mark or outer blanks, upper case, blanks to underscores."""
    words = re.findall(r"[^\s\ufeff]+", str(name))
    return "_".join(words).upper()


def station_key(line: Column, station: Column) -> Column:
    """Key for whole-number codes: both padded to five digits."""
    return F.format_string("ln%05d_st%05d", line.cast("bigint"), station.cast("bigint"))


def code_text(value: Column) -> Column:
    """Code as text: whole numbers without fraction, other text with symbols collapsed, missing as NA."""
    plain = F.regexp_replace(F.regexp_replace(value.cast("string"), r"(?U)\W+", "_"), r"^_+|_+$", "")
    cleaned = F.when(plain == "", "NA").otherwise(plain)
    return F.coalesce(to_long(value).cast("string"), cleaned, F.lit("NA"))


def loose_station_key(line: Column, station: Column) -> Column:
    """Key for codes that need not be numeric; longer codes are kept whole."""

    def pad(code: Column) -> Column:
        return F.when(F.length(code) < 5, F.lpad(code, 5, "0")).otherwise(code)

    return F.concat(F.lit("ln"), pad(code_text(line)), F.lit("_st"), pad(code_text(station)))


def station_label(name: Column, short: Column, line_short: Column, line_name: Column) -> Column:
    return F.concat_ws(" | ", F.trim(F.coalesce(name, short)), F.trim(F.coalesce(line_short, line_name)))


def contains_text(value: Column, needle: str) -> Column:
    """Case-insensitive literal substring test."""
    return F.coalesce(F.lower(value).contains(needle.lower()), F.lit(False))
