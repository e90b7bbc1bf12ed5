"""Native column expressions; everything here stays inside whole-stage codegen."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F

# The words removed from place names, in this order.
DIRECTION_WORDS = ["Center", "South", "North", "East", "West"]

# Runs of two or more letters, digits or underscores, in any script.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"

_BLANKS = " \t\n\r\x0b\x0c"


def month_of(date: Column) -> Column:
    """First day of the month a date or timestamp falls in."""
    return F.trunc(date, "MM")


def parse_month_key(key: Column) -> Column:
    """``YYYY_MM`` text to the first day of that month."""
    return F.to_date(key, "yyyy_MM")


def finite_or_null(value: Column) -> Column:
    """NaN and infinities count as missing, as they do for rolling means and averages."""
    value = value.cast("double")
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def clean_numeric(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    return df.withColumns({c: finite_or_null(F.col(c)) for c in columns})


def round_half_even(value: Column) -> Column:
    return F.rint(value)


def round_to(value: Column, digits: int) -> Column:
    """Scale, round half to even, scale back: the way numpy rounds to decimals."""
    scale = F.lit(float(10**digits))
    return F.rint(value * scale) / scale


def zero_based_class(label: Column) -> Column:
    """Labels 1..5 truncated to integers and shifted to 0..4."""
    return label.cast("int") - 1


def strip_direction_words(name: Column) -> Column:
    """Remove the direction words one after the other, then trim blanks.

    One pass per word, not one alternation: removing a word can join the text
    around it into a later word.
    """
    for word in DIRECTION_WORDS:
        name = F.replace(name, F.lit(word), F.lit(""))
    return F.btrim(name, F.lit(_BLANKS))


def text_key(text: Column) -> Column:
    """Join key for whole texts: a 256-bit digest, so that shuffles carry 64
    characters instead of the article. A missing text gets a key of its own,
    because missing texts match each other."""
    return F.coalesce(F.sha2(text, 256), F.lit("missing"))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def hash_uniform(key: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the key and the seed only, so a split
    survives repartitioning and recomputed tasks."""
    digest = F.md5(F.concat(key, F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / F.lit(float(2**32))
