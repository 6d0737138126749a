"""Column functions that read typed values out of raw strings."""

from pyspark.sql import Column, functions as F

from listingloom import fixed

S = fixed.SPACE
NUMBER = r"[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _found(text: Column, regex: str, group: int = 1) -> Column:
    """A regex group, or null: regexp_extract gives '' without a match, which casts refuse."""
    return F.nullif(F.regexp_extract(text, regex, group), F.lit(""))


def rating(text: Column) -> Column:
    """'4.1/5' as 4.1; anything that is not a score out of five is null."""
    return _found(text, rf"\A{S}*([0-9]+(?:\.[0-9]+)?){S}*/{S}*5{S}*\z").try_cast("double")


def price(text: Column) -> Column:
    """'1,200' as 1200; anything but digits and commas is null."""
    return _found(F.regexp_replace(text, ",", ""), rf"\A{S}*([0-9]+){S}*\z").try_cast("bigint")


def votes(text: Column) -> Column:
    """A count truncated to a whole number, 0 where missing or malformed."""
    number = _found(text, rf"\A{S}*({NUMBER}){S}*\z").try_cast("double")
    return F.coalesce(number.try_cast("bigint"), F.lit(0).cast("bigint"))


def yes(text: Column) -> Column:
    return text.eqNullSafe("Yes")


def clean_number(value: Column) -> Column:
    """A number with NaN and unreadable text as null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def url_path(url: Column) -> Column:
    """A URL without its query string."""
    return F.substring_index(url, "?", 1)


def null_tokens(text: Column) -> Column:
    """Null where the text is one of the spellings of a missing value."""
    return F.when(~text.isin(fixed.NULL_TOKENS), text)
