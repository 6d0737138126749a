"""Column functions on dirty text."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F

from listingloom import fixed

SLICE_CHARS = 1 << 20  # of texts that a worker handles at a time; a longer one is handled alone


def collapse_space(text: Column) -> Column:
    """Turn every run of white space into one blank and trim the ends."""
    # Single blanks, nearly all of the white space, are not matched and so not rewritten. The
    # look-ahead passes over printable ASCII before the long class is tried.
    run = f"(?![!-~])(?:{fixed.SPACE_NOT_BLANK}{fixed.SPACE}*| {fixed.SPACE}+)"
    return F.trim(F.regexp_replace(text, run, " "))


def repair_encoding(text: Column) -> Column:
    """Undo UTF-8 that was read as Latin-1; text that cannot be such a misreading stays."""
    suspicious = F.contains(text, F.lit("Ã")) | F.contains(text, F.lit("â"))
    # encode() raises on characters beyond Latin-1, so the range is tested first.
    latin1_only = text.rlike(r"\A[\x{00}-\x{ff}]*\z")
    repaired = F.try_validate_utf8(F.encode(text, "ISO-8859-1").cast("string"))
    return F.when(suspicious & latin1_only, F.coalesce(repaired, text)).otherwise(text)


def fix_text(text: Column) -> Column:
    """Repair the encoding and white space; missing becomes the empty string."""
    return F.coalesce(collapse_space(repair_encoding(text)), F.lit(""))


def split_list(text: Column) -> Column:
    """Comma-separated text as an array of clean, distinct, non-blank items in source order."""
    items = F.transform(F.split(text, ","), fix_text)
    return F.coalesce(F.array_distinct(F.filter(items, lambda item: item != "")), F.array().cast("array<string>"))


def truncate(text: Column, max_chars: int) -> Column:
    """Cut long text at the last blank inside the limit and mark the cut."""
    cut = F.regexp_replace(F.substring(text, 1, max_chars), r" [^ ]*\z", "")
    return F.when(F.length(text) <= max_chars, text).otherwise(F.concat(cut, F.lit("...")))


def entity_id(name: Column, address: Column) -> Column:
    """Stable 16-digit hexadecimal key of a cleaned name and address."""
    return F.substring(F.md5(F.concat(name, F.lit("|"), address)), 1, 16)


def base_area(area: Column) -> Column:
    """An area's name without a numbered suffix, such as '5th Block'."""
    return F.trim(F.regexp_replace(area, rf"{fixed.SPACE}+[0-9].*$", ""))


def or_default(text: Column, default: str) -> Column:
    """The default where text is missing or empty."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def joined(items: Column) -> Column:
    """Array items separated by a comma and a blank; missing becomes the empty string."""
    return F.coalesce(F.array_join(items, ", "), F.lit(""))


def slices(texts: pd.Series, rows: int | None = None) -> Iterator[tuple[int, int]]:
    """Starts and ends of the slices of a batch that have at most SLICE_CHARS characters, or one text, and at most so many rows."""
    start = chars = 0
    for place, text in enumerate(texts):
        size = len(text) if isinstance(text, str) else 0
        if place > start and (chars + size > SLICE_CHARS or place - start == rows):
            yield start, place
            start, chars = place, 0
        chars += size
    if len(texts):
        yield start, len(texts)
    else:
        yield 0, 0
