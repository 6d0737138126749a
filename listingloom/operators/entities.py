"""Listings to one cleaned record per entity."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F, types as T

from listingloom.functions import parse
from listingloom.functions.reviews import excerpts, named_veg, parse_reviews, says_pure_veg
from listingloom.functions.text import entity_id, fix_text, split_list
from listingloom.sources.shared import PACKED, written

ENTITY_COLUMNS = [
    "entity_id", "name", "address", "area", "city", "kind", "tags", "liked", "rating", "votes", "price",
    "online_order", "book_table", "categories", "pure_veg", "reviews", "url",
]

#: Row groups of stored listings, in bytes before they are packed, so that a small file is still several splits.
FINE = {"parquet.block.size": 16 << 20}


def placed(listings: DataFrame, path: str | None = None) -> DataFrame:
    """Listings stored with a number per row, `place`, that tells equal ones apart; as they are where they have it."""
    if "place" in listings.columns:
        return listings
    numbered = listings.withColumn("place", F.monotonically_increasing_id())
    if path is None:
        return written(numbered, "listings")
    numbered.write.options(**PACKED, **FINE).parquet(path)
    return listings.sparkSession.read.schema(numbered.schema).parquet(path)


def _payload(stored: DataFrame) -> list[str]:
    return [c for c in stored.columns if c not in ("name", "address", "votes", "url", "category", "place")]


def winners(stored: DataFrame) -> DataFrame:
    """The place of the best listing per (name, address), its order and the categories of all, settled on a narrow key."""
    payload = _payload(stored)
    # Nulls leave such a hash as it is, so each field goes with whether it is null.
    digest = F.xxhash64(*(x for c in payload for x in (F.col(c), F.col(c).isNull()))) if payload else F.lit(0)
    keyed = stored.select(
        fix_text(F.col("name")).alias("name"),
        fix_text(F.col("address")).alias("address"),
        parse.votes(F.col("votes")).alias("votes"),
        F.length(F.coalesce("reviews", F.lit(""))).alias("review_chars"),
        "url", "category", digest.alias("digest"), "place",
    )
    order = F.struct((-F.col("votes")).alias("fewer_votes"), (-F.col("review_chars")).alias("shorter"), "url", "category", "digest", "place")
    # Blank keys are told by an aggregate: a test on the keys themselves would be pushed down, and clean every name twice.
    best = keyed.groupBy("name", "address").agg(
        F.min(order).alias("best"), F.array_sort(F.collect_set("category")).alias("categories"),
        F.min(F.least(F.octet_length("name"), F.octet_length("address"))).alias("shortest"),
    ).where("shortest > 0")
    return best.select(
        "name", "address", "categories",
        (-F.col("best.fewer_votes")).alias("votes"), (-F.col("best.shorter")).alias("review_chars"), "best.url", "best.place",
    )


def of_winners(stored: DataFrame, best: DataFrame) -> DataFrame:
    """The stored listings at the places of the winners.

    The places travel as one bit per listing, in rows of 32,768, and not as rows: Spark can broadcast them for tables some
    hundred times larger, so that no task has to shuffle the text of listings that won nothing.
    """
    bit = F.bitmap_bit_position("place")
    marks = best.groupBy(F.bitmap_bucket_number("place").alias("bucket")).agg(F.bitmap_construct_agg(bit).alias("bits"))
    byte = F.conv(F.hex(F.substr("bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    passed = F.floor(byte / F.pow(F.lit(2), bit % 8)) % 2 == 1
    listed = stored.withColumn("bucket", F.bitmap_bucket_number("place"))
    return listed.join(written(marks, "winner-places"), "bucket").where(passed).drop("bucket", "bits")


def best_listings(listings: DataFrame, read: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The most informative listing per (name, address), with the categories of all of them.

    Most votes win, then the longest review text. The reference order of ties is the order of
    the input, which a distributed table does not have: ties fall to the URL, then the category,
    then a hash of the other fields; rows equal in all of them are one listing. Winners are settled on a narrow key in
    one aggregation. It combines on the map side, so an entity with very many listings reaches its reducer as one row
    per task. They are stored, then review text and the other fields are fetched for them by their place in the stored
    listings: text of other listings never leaves its task, however many winners there are.

    `read`, if given, makes what is needed of the winners' texts where they are read, before any shuffle.
    """
    stored = placed(listings)
    best = written(winners(stored), "winners")
    texts = of_winners(stored.select("place", *_payload(stored)), best)
    if stored.rdd.getNumPartitions() < stored.sparkSession.sparkContext.defaultParallelism:
        texts = texts.repartition("place")  # a small table, and what follows is heavy per row
    return best.join(texts if read is None else read(texts), "place").drop("place")


def read_reviews(rows: DataFrame) -> DataFrame:
    """Listings with what their review text says in its stead: excerpts, and whether one says purely vegetarian."""
    # The parsed reviews feed two fields: a column of their own keeps it to one pass in Python.
    parsed = rows.withColumn("all_reviews", parse_reviews(F.col("reviews"))).drop("reviews")
    said = F.struct(excerpts(F.col("all_reviews")).alias("excerpts"), says_pure_veg(F.col("all_reviews")).alias("pure_veg"))
    return parsed.withColumn("reviews", said).drop("all_reviews")


def normalise(best: DataFrame) -> DataFrame:
    """Typed and cleaned fields of the winning listings."""
    city = fix_text(F.col("city"))
    said = best if isinstance(best.schema["reviews"].dataType, T.StructType) else read_reviews(best)
    return said.select(
        entity_id(F.col("name"), F.col("address")).alias("entity_id"),
        "name",
        "address",
        F.coalesce(F.nullif(fix_text(F.col("area")), F.lit("")), city).alias("area"),
        city.alias("city"),
        fix_text(F.col("kind")).alias("kind"),
        split_list(F.col("tags")).alias("tags"),
        split_list(F.col("liked")).alias("liked"),
        parse.rating(F.col("rate")).alias("rating"),
        "votes",
        parse.price(F.col("cost")).alias("price"),
        parse.yes(F.col("online_order")).alias("online_order"),
        parse.yes(F.col("book_table")).alias("book_table"),
        "categories",
        (named_veg(F.col("name")) | F.col("reviews.pure_veg")).alias("pure_veg"),
        F.col("reviews.excerpts").alias("reviews"),
        parse.url_path(F.col("url")).alias("url"),
    )


def output_order() -> list[Column]:
    """Most votes first, then longest review text."""
    return [F.desc("votes"), F.desc("review_chars"), F.col("name"), F.col("address")]


def top_listings(best: DataFrame, limit: int) -> DataFrame:
    """The first entities in the order most votes, then longest review text.

    The order is settled on keys and counts alone, a top-n per task and of those; the rest of a listing is fetched for the
    chosen ones only. The winners are stored first, so that they are not picked twice.
    """
    stored = written(best, "best-listings")
    keys = stored.select("votes", "review_chars", "name", "address").orderBy(*output_order()).limit(limit)
    return stored.join(keys.select("name", "address"), ["name", "address"], "left_semi")


def clean(listings: DataFrame, limit: int | None = None, ordered: bool = False) -> DataFrame:
    """Cleaned entities; with a limit, only the first ones by votes and review text; ordered, in that order."""
    best = top_listings(best_listings(listings), limit) if limit else best_listings(listings, read_reviews)
    return normalise(best.orderBy(*output_order()) if ordered else best)
