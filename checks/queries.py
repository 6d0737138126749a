"""The queries. Each reads the whole test tables or what Spark derives from them."""

import uuid

from pyspark.sql import Column, DataFrame, functions as F

from checks import inputs
from checks.inputs import ENCODER, table
from listingloom.functions import parse, question as q
from listingloom.functions.reviews import clean_reviews, excerpts, pack, parse_reviews
from listingloom.functions.text import entity_id, fix_text, split_list
from listingloom.functions.vectors import embed, l2_normalise
from listingloom.operators import answers, filters
from listingloom.operators.chunks import build_chunks, metadata
from listingloom.operators.entities import best_listings, clean
from listingloom.operators.filters import Filters, to_predicate
from listingloom.operators.cells import approximate_top_hits, build_cell_table
from listingloom.operators.nearest import top_hits
from listingloom.operators.search import CARRIED, group_hits, rank_entities
from listingloom.operators.vocabulary import area_vocabulary, phrases, tag_vocabulary, vocabulary
from listingloom.sources.listings import read_listings
from listingloom.sources.shared import shared_dir
from listingloom.sources.tables import export_entities_csv, load_entities_csv

QUERIES = {}


def query(function):
    QUERIES[function.__name__] = function
    return function


def piped(column: str) -> Column:
    return F.array_join(column, "|").alias(column)


# --- Fields ------------------------------------------------------------------------------------

@query
def parse_fields(spark, sf):
    return inputs.listings(spark, sf).select(
        "address", "category",
        parse.rating(F.col("rate")).alias("rating"),
        parse.price(F.col("cost")).alias("price"),
        parse.votes(F.col("votes")).alias("votes"),
        parse.yes(F.col("online_order")).alias("online_order"),
        parse.yes(F.col("book_table")).alias("book_table"),
    )


@query
def clean_text(spark, sf):
    text = fix_text(F.col("text"))
    return inputs.documents(spark, sf).select("doc_id", F.length(text).alias("chars"), F.md5(text).alias("digest"))


@query
def repair_text(spark, sf):
    """Documents misread as Latin-1, and repaired."""
    misread = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    rows = inputs.documents(spark, sf).select("doc_id", misread.alias("misread"))
    return rows.select("doc_id", F.md5(fix_text(F.col("misread"))).alias("digest"))


@query
def url_paths(spark, sf):
    return table(spark, sf, "pages").select("page_id", parse.url_path(F.col("url")).alias("path"))


@query
def split_tags(spark, sf):
    rows = inputs.listings(spark, sf)
    return rows.select("address", "category", split_list(F.col("tags")).alias("tags")).withColumn("tags", piped("tags"))


@query
def entity_keys(spark, sf):
    name, address = fix_text(F.col("name")), fix_text(F.col("address"))
    return inputs.listings(spark, sf).select("address", "category", entity_id(name, address).alias("entity_id"))


# --- Entities ----------------------------------------------------------------------------------

@query
def best_listing(spark, sf):
    best = best_listings(inputs.listings(spark, sf))
    return best.select("name", "address", "votes", "url", piped("categories"), "review_chars")


@query
def best_document(spark, sf):
    """Copies of a text as listings of one entity: the longest, lowest URL wins."""
    copies = inputs.documents(spark, sf).select(
        F.md5("text").alias("name"), "lang", F.col("lang").alias("address"), F.col("n_chars").cast("string").alias("votes"),
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("url"), F.col("source").alias("category"), F.lit("").alias("reviews"),
    )
    return best_listings(copies).select("name", "lang", "votes", "url", piped("categories"))


@query
def clean_entities(spark, sf):
    lists = ["tags", "liked", "categories", "reviews"]
    rows = inputs.entities(spark, sf)
    return rows.select(*(piped(c) if c in lists else c for c in rows.columns))


@query
def top_entities(spark, sf):
    rows = clean(inputs.listings(spark, sf), limit=100)
    return rows.select("entity_id", "name", "votes", "url", piped("reviews"))


@query
def flag_entities(spark, sf):
    return inputs.entities(spark, sf).select("entity_id", "name", "pure_veg")


@query
def tag_vocab(spark, sf):
    return tag_vocabulary(inputs.entities(spark, sf))


@query
def area_vocab(spark, sf):
    return area_vocabulary(inputs.entities(spark, sf))


@query
def csv_scan(spark, sf):
    """The listings through raw CSV files with two orders of columns, and back."""
    path = f"{shared_dir(spark)}/raw-{uuid.uuid4().hex}"
    rows = inputs.raw_listings(spark, sf)
    for half, columns in enumerate((rows.columns, rows.columns[::-1])):
        rows.where(F.pmod(F.xxhash64("url"), F.lit(2)) == half).select(columns).write.mode("append").options(
            header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
    rows = read_listings(spark, path)
    return rows.select(*(F.md5("reviews").alias(c) if c == "reviews" else c for c in rows.columns))


@query
def entities_csv(spark, sf):
    """The cleaned entities through a CSV export and back."""
    path = f"{shared_dir(spark)}/entities-{uuid.uuid4().hex}"
    export_entities_csv(inputs.entities(spark, sf), path)
    rows = load_entities_csv(spark, path)
    lists = ["tags", "liked", "categories", "reviews"]
    return rows.select(*(piped(c) if c in lists else c for c in rows.columns))


# --- Reviews and chunks ------------------------------------------------------------------------

def _lines(spark, sf) -> DataFrame:
    return inputs.documents(spark, sf).select("doc_id", clean_reviews(F.split("text", "\n")).alias("lines"))


@query
def literal_reviews(spark, sf):
    cells = inputs.documents(spark, sf).select("doc_id", inputs.literal(F.col("text")).alias("cell"))
    rows = cells.select("doc_id", F.posexplode_outer(parse_reviews(F.col("cell"))).alias("position", "review"))
    return rows.where("position is not null").select("doc_id", "position", F.md5("review").alias("digest"))


@query
def review_excerpts(spark, sf):
    rows = _lines(spark, sf).select("doc_id", F.posexplode_outer(excerpts(F.col("lines"))).alias("position", "excerpt"))
    return rows.where("position is not null")


@query
def packed_lines(spark, sf):
    rows = _lines(spark, sf).select("doc_id", F.posexplode_outer(pack(F.col("lines"))).alias("position", "body"))
    return rows.where("position is not null").select("doc_id", "position", F.length("body").alias("chars"), F.md5("body").alias("digest"))


@query
def entity_chunks(spark, sf):
    return build_chunks(inputs.entities(spark, sf)).select("chunk_id", "chunk_type", "entity_id", "text")


@query
def metadata_records(spark, sf):
    chunks = metadata(build_chunks(inputs.entities(spark, sf)), "chunk_id")
    return chunks.withColumn("tags", piped("tags"))


@query
def hashed_embed(spark, sf):
    rows = inputs.documents(spark, sf).select("doc_id", embed(F.col("text"), ENCODER).alias("vector"))
    values = rows.select("doc_id", F.posexplode_outer("vector").alias("slot", "weight"))
    return values.select("doc_id", "slot", F.round(F.col("weight").cast("double"), 6).alias("weight"))


@query
def l2_normalised(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", l2_normalise(F.transform("embedding", lambda x: x.cast("double") * 3)).alias("v"))
    return rows.select("vec_id", F.posexplode_outer("v").alias("slot", "value")).withColumn("value", F.round("value", 6))


# --- Questions to filters ----------------------------------------------------------------------

@query
def filter_single(spark, sf):
    wanted = Filters(tags=["red", "small bolt", "ring"], areas=["ASIA", "AFRICA 0th Block", "EUROPE 3th Block", "ASIA 2th Block"],
                     max_price=1200, min_rating=3.2, book_table=True)
    rows = inputs.entities(spark, sf).where(to_predicate(wanted))
    return rows.select("entity_id", "name", "area", "price", "rating")


def _scalars(rows: DataFrame, key: str) -> DataFrame:
    text = F.col("lowered")
    names = ["max_price", "min_rating", "sort_by_rating", "pure_veg", "online_order", "book_table"]
    return rows.withColumn("lowered", F.lower("text")).select(key, *(getattr(q, name)(text).alias(name) for name in names))


@query
def question_scalars(spark, sf):
    return _scalars(inputs.questions(spark, sf), "question_id")


@query
def document_scalars(spark, sf):
    """The same rules over long texts: each document is read as a question."""
    return _scalars(inputs.documents(spark, sf), "doc_id")


def _matched(spark, sf) -> DataFrame:
    return filters.match_phrases(inputs.questions(spark, sf), inputs.catalogue(spark, sf).phrases)


@query
def question_tags(spark, sf):
    return _matched(spark, sf).select("question_id", piped("tags"))


@query
def question_areas(spark, sf):
    return _matched(spark, sf).select("question_id", piped("areas"))


@query
def document_words(spark, sf):
    """Every name of a document source or language that a document's text mentions."""
    documents = inputs.documents(spark, sf)
    names = documents.select(F.lit("tag").alias("kind"), F.explode(F.array("lang", "source")).alias("value")).distinct()
    rows = documents.select(F.col("doc_id").alias("question_id"), "text")
    return filters.match_phrases(rows, phrases(names)).select("question_id", piped("tags"))


def _filters(rows: DataFrame) -> DataFrame:
    columns = ["max_price", "min_rating", *filters.FLAGS, "sort_by_rating"]
    return rows.select("question_id", piped("tags"), piped("areas"), *columns, "error")


def _parsed(spark, sf) -> DataFrame:
    return filters.parse_questions(inputs.questions(spark, sf), inputs.catalogue(spark, sf).phrases)


@query
def parsed_questions(spark, sf):
    return _filters(_parsed(spark, sf))


def _merged(spark, sf) -> DataFrame:
    return filters.merge_overrides(_parsed(spark, sf), filters.slider_overrides(inputs.overrides(spark, sf)))


@query
def merged_filters(spark, sf):
    return _filters(_merged(spark, sf))


@query
def filter_captions(spark, sf):
    return _merged(spark, sf).select(
        "question_id", filters.is_empty().alias("is_empty"), filters.describe().alias("description"),
        filters.caption().alias("caption"))


# --- Search ------------------------------------------------------------------------------------

@query
def vector_topk(spark, sf):
    """The five nearest vectors of every vector."""
    rows = table(spark, sf, "embeddings")
    asked = rows.select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"), F.lit(5).alias("pool"))
    return top_hits(asked, rows.select(F.col("vec_id").alias("chunk_id"), "embedding"))


def _prepared(spark, sf) -> DataFrame:
    explicit = filters.slider_overrides(inputs.overrides(spark, sf))
    return inputs.catalogue(spark, sf).prepare(inputs.questions(spark, sf), explicit)


def _hits(prepared, spark, sf) -> DataFrame:
    return top_hits(prepared, inputs.catalogue(spark, sf).vectors, carry=CARRIED, keep=("sort_by_rating",))


@query
def filtered_topk(spark, sf):
    return _hits(_prepared(spark, sf), spark, sf).select("question_id", "position", "chunk_id", "similarity")


@query
def grouped_hits(spark, sf):
    rows = group_hits(_hits(_prepared(spark, sf), spark, sf), together=True)
    chunk_ids = F.transform("hits", lambda hit: hit["chunk_id"])
    return rows.select("question_id", "entity_id", "first_position", "similarity", F.array_join(chunk_ids, "|").alias("hits"))


@query
def ranked_entities(spark, sf):
    prepared = _prepared(spark, sf)
    ranked = rank_entities(group_hits(_hits(prepared, spark, sf), together=True), prepared, together=True)
    return ranked.select("question_id", "rank", "entity_id", "similarity")


def _results(spark, sf) -> tuple[DataFrame, DataFrame]:
    prepared = _prepared(spark, sf)
    return prepared, inputs.catalogue(spark, sf).search(prepared)


@query
def retrieve(spark, sf):
    results = _results(spark, sf)[1]
    return results.select(
        "question_id", "rank", "entity_id", "similarity", F.md5("profile").alias("profile"),
        F.size("evidence").alias("evidence_count"), F.md5(F.array_join("evidence", "\n")).alias("evidence"),
        "name", "area", piped("tags"), "rating", "votes", "price")


@query
def source_table(spark, sf):
    return answers.source_table(_results(spark, sf)[1])


@query
def prompt_contexts(spark, sf):
    contexts = answers.contexts(*_results(spark, sf))
    return contexts.select("question_id", F.length("context").alias("chars"), F.md5("context").alias("digest"))


@query
def prompts(spark, sf):
    rows = answers.prompts(*_results(spark, sf))
    return rows.select("question_id", F.length("prompt").alias("chars"), F.md5("prompt").alias("digest"))


@query
def list_answers(spark, sf):
    return answers.list_answers(*_results(spark, sf))


@query
def lsh_topk(spark, sf):
    """The five nearest vectors of every vector among those in the 49 of 128 cells whose centres are nearest to it."""
    rows = table(spark, sf, "embeddings").withColumnsRenamed({"vec_id": "chunk_id"})
    cells, centres = build_cell_table(rows, f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}", cells=128)
    asked = rows.select(F.col("chunk_id").alias("question_id"), F.col("embedding").alias("vector"), F.lit(5).alias("pool"))
    return approximate_top_hits(asked, cells, centres, probes=49)


@query
def phrase_tokens(spark, sf):
    """The phrases of all tags and areas, and how many phrases share each one's token."""
    return phrases(vocabulary(inputs.entities(spark, sf))).select("kind", "value", "phrase", "token")


@query
def ingest_counts(spark, sf):
    counts = inputs.ingested(spark, sf)[1]
    return spark.createDataFrame([counts], "raw_rows bigint, entities bigint, chunks bigint, stored bigint")
