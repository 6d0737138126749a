"""Entities to searchable text chunks."""

from pyspark.sql import DataFrame, functions as F

from listingloom import fixed
from listingloom.functions.parse import clean_number
from listingloom.functions.render import profile_text, review_text
from listingloom.functions.reviews import pack
from listingloom.functions.text import joined, or_default

METADATA_COLUMNS = [
    "entity_id", "name", "address", "area", "city", "kind", "tags", "rating", "votes", "price",
    "online_order", "book_table", "pure_veg", "categories", "url",
]


def build_chunks(entities: DataFrame, max_chars: int = fixed.CHUNK_CHARS) -> DataFrame:
    """One profile chunk and any number of review chunks per entity, in one pass without a shuffle.

    explode_outer, here and elsewhere, because explode has Spark compute the array twice: once
    more for a filter on its size.
    """
    profile = F.struct(
        F.concat("entity_id", F.lit("-profile")).alias("chunk_id"),
        F.lit("profile").alias("chunk_type"),
        profile_text().alias("text"),
    )
    reviews = F.transform(
        pack(F.col("reviews"), max_chars),
        lambda body, i: F.struct(
            F.concat(F.col("entity_id"), F.lit("-reviews-"), i.cast("string")).alias("chunk_id"),
            F.lit("reviews").alias("chunk_type"),
            review_text(body).alias("text"),
        ),
    )
    chunks = entities.select(*METADATA_COLUMNS, F.explode_outer(F.concat(F.array(profile), reviews)).alias("chunk"))
    return chunks.select("chunk.chunk_id", "chunk.chunk_type", "chunk.text", *METADATA_COLUMNS)


def metadata(rows: DataFrame, *keep: str) -> DataFrame:
    """The flat metadata record, with -1 and '' for missing values; tags are null when there are none."""
    rating = clean_number(F.col("rating"))
    price = clean_number(F.col("price"))
    return rows.select(
        *keep, "entity_id", "name", "address", "area",
        or_default(F.col("city"), "").alias("city"),
        or_default(F.col("kind"), "").alias("kind"),
        joined(F.col("tags")).alias("tags_text"),
        F.coalesce(rating, F.lit(fixed.UNKNOWN_RATING)).alias("rating"),
        F.coalesce("votes", F.lit(0)).cast("bigint").alias("votes"),
        F.coalesce(price.cast("bigint"), F.lit(fixed.UNKNOWN_PRICE)).alias("price"),
        *(F.coalesce(c, F.lit(False)).alias(c) for c in ("online_order", "book_table", "pure_veg")),
        joined(F.col("categories")).alias("categories_text"),
        or_default(F.col("url"), "").alias("url"),
        F.when(F.size("tags") > 0, F.col("tags")).alias("tags"),
    )
