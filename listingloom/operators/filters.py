"""Questions to filters, and filters to predicates."""

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from listingloom import fixed
from listingloom.functions import question as q
from listingloom.functions.text import collapse_space
from listingloom.operators.vocabulary import tokens

LISTS = ["tags", "areas"]
SCALARS = ["max_price", "min_rating"]
FLAGS = ["pure_veg", "online_order", "book_table"]



class Number:
    """A limit on a number. Unknown numbers pass none. `best` is the value of a block that passes if any does."""

    def __init__(self, column: str, test, best):
        self.column, self._test, self._best = column, test, best

    def condition(self, value) -> Column:
        return self._test(F.col(self.column), value)

    def mask(self, rows: pa.Table, value) -> np.ndarray:
        numbers = rows[self.column]
        if pa.types.is_integer(numbers.type):
            return self._test(numbers.cast(pa.int64()).fill_null(-1).to_numpy(), value)
        return self._test(numbers.cast(pa.float64()).to_numpy(zero_copy_only=False), value)

    def best(self) -> Column:
        return self._best(F.col(self.column))


class Flag:
    """A flag that has to be set."""

    def __init__(self, column: str):
        self.column = column

    def condition(self, value) -> Column:
        return F.col(self.column)

    def mask(self, rows: pa.Table, value) -> np.ndarray:
        return rows[self.column].combine_chunks().fill_null(False).to_numpy(zero_copy_only=False)

    def best(self) -> Column:
        return F.max(self.column)


class AnyOf:
    """Some of a row's values, or its only one, have to be among those asked for."""

    def __init__(self, column: str, nested: bool):
        self.column, self.nested = column, nested

    def condition(self, values: list) -> Column:
        return F.arrays_overlap(self.column, F.array(*map(F.lit, values))) if self.nested else F.col(self.column).isin(list(values))

    def places(self, rows: pa.Table) -> dict:
        """The rows that hold each value."""
        column = rows[self.column].combine_chunks()
        nested = pa.types.is_list(column.type)  # a block's index holds lists where its rows hold single values
        values = (pc.list_flatten(column) if nested else column).dictionary_encode()
        parents = pc.list_parent_indices(column).to_numpy() if nested else np.arange(len(column))
        codes = values.indices.fill_null(-1).to_numpy()
        order = np.argsort(codes, kind="stable")
        cuts = np.searchsorted(codes[order], np.arange(len(values.dictionary) + 1))
        return {value: parents[order[cuts[i] : cuts[i + 1]]] for i, value in enumerate(values.dictionary.to_pylist())}

    def best(self) -> Column:
        values = F.collect_set(self.column)
        return F.array_distinct(F.flatten(values)) if self.nested else values


# What each filter asks of a row: of columns in a plan, of Arrow rows in a search, and of the best values of a block.
TESTS = {
    "tags": AnyOf("tags", nested=True),
    "areas": AnyOf("area", nested=False),
    "cells": AnyOf("cell", nested=False),
    "max_price": Number("price", lambda price, limit: (price >= 0) & (price <= limit), lambda price: F.min(F.when(price >= 0, price))),
    "min_rating": Number("rating", lambda rating, least: rating >= least, lambda rating: F.max(F.when(~F.isnan(rating), rating))),
    **{name: Flag(name) for name in FLAGS},
}


def is_set(name: str, value) -> bool:
    """Whether a filter asks for anything: a number does if it is known, a list or flag if it is not empty or false."""
    return value is not None if name in SCALARS else bool(value)


@dataclass
class Filters:
    """The filters of one question, for callers that hold them as plain values."""

    tags: list[str] = field(default_factory=list)
    areas: list[str] = field(default_factory=list)
    max_price: int | None = None
    min_rating: float | None = None
    pure_veg: bool = False
    online_order: bool = False
    book_table: bool = False
    sort_by_rating: bool = False


def to_predicate(filters: Filters) -> Column | None:
    """The condition an entity has to meet, or None when nothing is asked for.

    Unknown prices and ratings are null, which no comparison accepts.
    """
    values = {name: getattr(filters, name, None) for name in TESTS}
    conditions = [TESTS[name].condition(value) for name, value in values.items() if is_set(name, value)]
    return reduce(Column.__and__, conditions) if conditions else None


def match_phrases(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """Questions with the tags they name, and the areas they name exactly or by their base name.

    A phrase can only occur where its token is a token of the question. An equi-join on the token
    finds the candidates, so questions never meet the whole vocabulary; the exact test then runs on
    the few that remain. Only (id, token) pairs take part in the join, not the text.
    """
    words = questions.select("question_id", F.explode_outer(tokens(F.lower("text"))).alias("token"))
    candidates = (
        words.join(phrases, "token")
        .groupBy("question_id")
        .agg(F.collect_set(F.struct("kind", "value", "phrase")).alias("candidates"))
    )
    # The one-element array has the text lowered once, not once per candidate.
    found = F.transform(
        F.array(F.lower("text")), lambda text: F.filter("candidates", lambda c: q.has_phrase(text, c["phrase"]))
    )[0]

    def values(kind: str) -> Column:
        return F.array_distinct(F.transform(F.filter("found", lambda c: c["kind"] == kind), lambda c: c["value"]))

    empty = F.array().cast("array<string>")
    by_kind = questions.join(candidates, "question_id", "left").withColumn("found", found).withColumns({
        kind: F.coalesce(values(kind), empty) for kind in ("tag", "area", "base")
    })
    return by_kind.withColumns({
        "tags": q.keep_longest_tags(F.col("tag")),
        "areas": F.when(F.size("area") > 0, q.keep_exact_areas(F.col("area"))).otherwise(F.array_sort("base")),
    }).drop("candidates", "found", "tag", "area", "base")


def parse_questions(questions: DataFrame, phrases: DataFrame) -> DataFrame:
    """Questions (question_id, text, ...) with one column per filter.

    Blank questions get an error text and match nothing.
    """
    lowered = F.col("lowered")  # a column of its own, so that one pass lowers it for all patterns
    blank = F.coalesce(collapse_space(F.col("text")), F.lit("")) == ""
    return match_phrases(questions, phrases).withColumn("lowered", F.lower("text")).withColumns({
        "max_price": q.max_price(lowered),
        "min_rating": q.min_rating(lowered),
        **{name: F.coalesce(getattr(q, name)(lowered), F.lit(False)) for name in (*FLAGS, "sort_by_rating")},
        "error": F.when(blank, fixed.BLANK_QUESTION),
    }).drop("lowered")


def merge_overrides(parsed: DataFrame, overrides: DataFrame) -> DataFrame:
    """Explicit choices win over parsed values; flags add up. At most one override row per question."""
    names = [*LISTS, *SCALARS, *FLAGS, "sort_by_rating"]
    explicit = overrides.select("question_id", *(F.col(c).alias(f"explicit_{c}") for c in names))
    joined = parsed.join(explicit, "question_id", "left")
    merged = {c: F.when(F.size(f"explicit_{c}") > 0, F.col(f"explicit_{c}")).otherwise(F.col(c)) for c in LISTS}
    merged |= {c: F.coalesce(f"explicit_{c}", c) for c in SCALARS}
    merged |= {c: F.coalesce(f"explicit_{c}", F.lit(False)) | F.col(c) for c in (*FLAGS, "sort_by_rating")}
    return joined.withColumns(merged).drop(*(f"explicit_{c}" for c in names))


def slider_overrides(choices: DataFrame) -> DataFrame:
    """Choices as overrides: a slider at zero sets no limit."""
    return choices.withColumns({c: F.nullif(F.col(c), F.lit(0).cast(choices.schema[c].dataType)) for c in SCALARS})


def _in_force() -> dict[str, Column]:
    """Each filter's value, or null where it is switched off. Sorting is no filter."""
    columns = {c: F.when(F.size(c) > 0, F.col(c)) for c in LISTS}
    columns |= {c: F.when(F.col(c) != 0, F.col(c)) for c in SCALARS}
    columns |= {c: F.when(F.col(c), F.col(c)) for c in FLAGS}
    return columns


def is_empty() -> Column:
    return reduce(Column.__and__, (c.isNull() for c in _in_force().values()))


def describe() -> Column:
    """The filters in force as JSON; null where there is none."""
    return F.nullif(F.to_json(F.struct(*(c.alias(name) for name, c in _in_force().items()))), F.lit("{}"))


def caption() -> Column:
    """The filters in force as display text, '**name** = value' separated by commas."""
    parts = []
    for name, c in _in_force().items():
        value = F.to_json(c) if name in LISTS else c.cast("string")
        parts.append(F.concat(F.lit(f"**{name}** = "), value))
    return F.concat_ws(", ", *parts)
