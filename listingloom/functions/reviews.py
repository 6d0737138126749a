"""Column functions on the reviews of one listing."""

import ast
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from listingloom import fixed
from listingloom.functions.text import fix_text, slices, truncate


def _pair_texts(cell: str | None) -> list[str]:
    """Second items of a Python literal list of pairs; nothing when the cell is no such literal."""
    if cell is None:
        return []
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")  # odd escapes inside reviews are legal text
            pairs = ast.literal_eval(cell)
    except (ValueError, SyntaxError, TypeError, RecursionError):
        return []
    texts = (str(pair[1]) for pair in pairs if isinstance(pair, (tuple, list)) and len(pair) > 1)
    # Lone surrogates cannot leave Python as UTF-8.
    return [text.encode("utf-8", "replace").decode("utf-8") for text in texts]


@F.pandas_udf(T.ArrayType(T.StringType()))
def _literal_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """A batch leaves the worker in slices, so that it never holds the parsed texts of all its cells."""
    for cells in batches:
        for start, end in slices(cells):
            yield cells.iloc[start:end].map(_pair_texts)


def parse_reviews(cell: Column) -> Column:
    """Clean, distinct reviews of useful length out of a '[(label, text), ...]' literal."""
    literal = F.when(F.startswith(cell, F.lit("[")) & (cell != "[]"), cell)
    return clean_reviews(_literal_texts(literal))


def clean_reviews(texts: Column) -> Column:
    """Drop the RATED prefix, repair the text, keep distinct reviews of useful length."""
    lead = rf"\A{fixed.SPACE}*RATED{fixed.SPACE}*"
    cleaned = F.transform(texts, lambda text: fix_text(F.regexp_replace(text, lead, "")))
    return F.array_distinct(F.filter(cleaned, lambda text: F.length(text) >= fixed.MIN_REVIEW_CHARS))


def on_topic(text: Column) -> Column:
    return text.rlike("(?iu)" + fixed.whole_words("|".join(fixed.REVIEW_TOPICS), "fkcvbapsgdr"))


def excerpts(reviews: Column, limit: int = fixed.MAX_REVIEWS, max_chars: int = fixed.MAX_REVIEW_CHARS) -> Column:
    """The first reviews, those on a common topic before the others, each cut to a short excerpt."""
    placed = F.transform(
        reviews, lambda text, i: F.struct((~on_topic(text)).alias("later"), i.alias("place"), text.alias("text"))
    )
    return F.transform(F.slice(F.array_sort(placed), 1, limit), lambda item: truncate(item["text"], max_chars))


def says_pure_veg(reviews: Column) -> Column:
    strict = "(?iu)" + fixed.whole_words(fixed.PURE_VEG, "p")
    return F.exists(reviews, lambda text: text.rlike(strict))


def is_pure_veg(name: Column, reviews: Column) -> Column:
    """Whether the name says vegetarian without negating it, or a review says purely vegetarian."""
    return named_veg(name) | says_pure_veg(reviews)


def named_veg(name: Column) -> Column:
    negated = name.rlike("(?iu)" + fixed.starting(fixed.NON_VEG, "n"))
    return name.rlike("(?iu)" + fixed.whole_words(fixed.VEG, "v")) & ~negated


def pack(reviews: Column, max_chars: int = fixed.CHUNK_CHARS) -> Column:
    """Pack quoted reviews, in order, into bodies that stay within the limit where they can."""
    quoted = F.transform(reviews, lambda text: F.concat(F.lit('- "'), text, F.lit('"')))
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def step(state: Column, piece: Column) -> Column:
        grown = F.concat(state["open"], F.lit("\n"), piece)
        return (
            F.when(state["open"] == "", F.struct(state["done"].alias("done"), piece.alias("open")))
            .when(F.length(grown) <= max_chars, F.struct(state["done"].alias("done"), grown.alias("open")))
            .otherwise(
                F.struct(F.array_append(state["done"], state["open"]).alias("done"), piece.alias("open"))
            )
        )

    def close(state: Column) -> Column:
        return F.when(state["open"] == "", state["done"]).otherwise(F.array_append(state["done"], state["open"]))

    return F.aggregate(F.coalesce(quoted, F.array().cast("array<string>")), start, step, close)
