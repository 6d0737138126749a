"""The tags and areas that occur in the data, and the phrases that name them in a question."""

from pyspark.sql import Column, DataFrame, functions as F

from listingloom import fixed
from listingloom.functions.text import base_area

TOKEN = r"[a-z0-9]+|[^a-z0-9 ]"
PHRASE_SCHEMA = "kind string, value string, phrase string, token string"


def tag_vocabulary(entities: DataFrame) -> DataFrame:
    return entities.select(F.explode("tags").alias("value")).distinct()


def area_vocabulary(entities: DataFrame) -> DataFrame:
    return entities.select(F.col("area").alias("value")).where(F.col("value") != "").distinct()


def vocabulary(entities: DataFrame) -> DataFrame:
    """Distinct (kind, value) pairs, kind being 'tag' or 'area', in one pass over the entities."""
    tags = F.transform("tags", lambda tag: F.struct(F.lit("tag").alias("kind"), tag.alias("value")))
    area = F.array(F.struct(F.lit("area").alias("kind"), F.col("area").alias("value")))
    pairs = entities.select(F.explode(F.concat(tags, area)).alias("pair"))
    return pairs.select("pair.kind", "pair.value").where(F.col("value") != "").distinct()


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, and every other character, of lower-cased text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)))


def phrases(pairs: DataFrame) -> DataFrame:
    """(kind, value, phrase, token): what names each value, and the token to find it by.

    A tag is named by itself or its plural, an area by itself ('area') or its base name ('base').
    The token is the phrase's rarest one among all phrases, so that a word many names share, such
    as 'block', does not make each of them a candidate wherever the word turns up.
    """
    lowered, base = F.lower("value"), F.lower(base_area(F.col("value")))

    def named(kind: str, phrase: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), phrase.alias("phrase"))

    of_tag = F.array(named("tag", lowered), named("tag", F.concat(lowered, F.lit("s"))))
    of_area = F.array(named("area", lowered), named("base", base))
    named_by = pairs.select("value", F.explode(F.when(F.col("kind") == "tag", of_tag).otherwise(of_area)).alias("named"))
    rows = named_by.select("named.kind", "value", "named.phrase").where(
        (F.col("kind") != "base") | (F.length("phrase") >= fixed.MIN_BASE_CHARS)
    )
    parts = rows.withColumn("token", F.explode_outer(tokens(F.col("phrase"))))
    counts = parts.groupBy("token").count()
    rarest = F.min_by("token", F.struct("count", -F.length("token"), "token")).alias("token")
    return parts.join(counts, "token").groupBy("kind", "value", "phrase").agg(rarest)
