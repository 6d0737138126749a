"""Column functions that render entities and results as text."""

from pyspark.sql import Column, functions as F

from listingloom import fixed
from listingloom.functions.text import joined, or_default


def _yes_no(flag: Column) -> Column:
    return F.when(flag, "yes").otherwise("no")


def header() -> Column:
    return F.concat(
        F.col("name"), F.lit(" ("), or_default(F.col("kind"), fixed.DEFAULT_KIND), F.lit(") in "), F.col("area"),
        F.lit(f", {fixed.CITY_NAME}. Cuisines: "), or_default(joined(F.col("tags")), fixed.NO_TAGS), F.lit("."),
    )


def profile_text() -> Column:
    """The facts of an entity, one per line; concat_ws leaves out the lines that are null."""
    rated = F.concat(
        F.lit("Rating: "), F.col("rating").cast("string"), F.lit("/5 from "), F.col("votes").cast("string"), F.lit(" votes.")
    )
    priced = F.concat(F.lit("Approximate cost for two people: Rs. "), F.col("price").cast("string"), F.lit("."))
    categories = or_default(joined(F.col("categories")), fixed.NO_CATEGORY)
    return F.concat_ws(
        "\n",
        header(),
        F.concat(F.lit("Address: "), F.col("address"), F.lit(".")),
        F.coalesce(rated, F.lit(fixed.NOT_RATED_LINE)),
        F.coalesce(priced, F.lit(fixed.NO_PRICE_LINE)),
        F.concat(F.lit("Listed under: "), categories, F.lit(".")),
        F.concat(
            F.lit("Online ordering: "), _yes_no(F.col("online_order")),
            F.lit(". Table booking: "), _yes_no(F.col("book_table")), F.lit("."),
        ),
        F.when(F.col("pure_veg"), fixed.VEG_LINE),
        F.when(F.size("liked") > 0, F.concat(F.lit("Popular dishes: "), joined(F.col("liked")), F.lit("."))),
    )


def review_text(body: Column) -> Column:
    return F.concat_ws("\n", header(), F.lit(fixed.REVIEWS_LINE), body)


def price_label() -> Column:
    return F.coalesce(
        F.concat(F.lit("Rs. "), F.col("price").cast("string"), F.lit(" for two")), F.lit(fixed.PRICE_UNKNOWN)
    )


def rating_label() -> Column:
    return F.coalesce(
        F.concat(F.col("rating").cast("string"), F.lit("/5 ("), F.col("votes").cast("string"), F.lit(" votes)")),
        F.lit(fixed.RATING_UNKNOWN),
    )


def record(rank: Column, profile: Column, evidence: Column) -> Column:
    """One numbered record: the profile and its evidence, blanks left out."""
    parts = F.filter(F.concat(F.array(profile), evidence), lambda part: part != "")
    return F.concat(
        F.lit('<record number="'), rank.cast("string"), F.lit('">\n'), F.array_join(parts, "\n"),
        F.lit("\n" + fixed.RECORD_CLOSE),
    )


def answer_line(rank: Column) -> Column:
    facts = [
        F.concat(F.col("kind"), F.lit(" in "), F.col("area")), joined(F.col("tags")), price_label(), rating_label(),
    ]
    return F.concat(
        F.lit("- **"), F.col("name"), F.lit("** ["), rank.cast("string"), F.lit("]: "),
        F.concat_ws(fixed.ANSWER_SEPARATOR, *facts),
    )
