"""Inputs derived from the test tables. The SQL here is plain enough for Spark and DuckDB alike."""

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from listingloom import fixed
from listingloom.functions.vectors import HashedTokens
from listingloom.operators.entities import clean
from listingloom.plans.ingest import ingest
from listingloom.plans.retrieve import Catalogue
from listingloom.sources.shared import shared_dir, spread, written

ENCODER = HashedTokens(64)

# One raw listing per part and return flag. Names and prices are as untidy as a scraped file.
LISTING = """
select
  case when l.flag = 'R' then '  ' || replace(p.full_name, ' ', '  ') else p.full_name end as name,
  'Unit ' || cast(p.p_partkey as string) as address,
  case when p.p_partkey % 13 <> 0 then r_name || ' ' || cast(n_nationkey as string) || 'th Block' end as area,
  r_name as city,
  case when p.p_partkey % 31 = 0 then 'N/A' else p.p_type end as kind,
  p.p_name || ', ' || p.adjective || ' ,' || p.noun || ', ' || p.p_name as tags,
  case when p.p_partkey % 7 <> 0 then p.p_brand || ', ' || p.noun || ' set' end as liked,
  case when p.p_partkey % 9 = 0 then 'NEW' when p.p_partkey % 9 = 1 then '-' when p.p_partkey % 9 <> 2 then
    substr(cast(30 + p.p_size % 20 as string), 1, 1) || '.' || substr(cast(30 + p.p_size % 20 as string), 2, 1)
    || case when p.p_partkey % 2 = 0 then '/5' else ' /5' end end as rate,
  cast(l.listings as string) as votes,
  case when p.p_partkey % 11 <> 0 then case when p.p_size >= 34
    then '1,' || substr(cast(p.p_size * 30 as string), 2) else cast(p.p_size * 30 as string) end end as cost,
  case when p.p_type in ('PROMO', 'SMALL') then 'Yes' else 'No' end as online_order,
  case when p.p_size > 25 then 'Yes' else 'No' end as book_table,
  l.flag as category,
  case when p.p_partkey % 3 <> 0 or l.flag <> 'N' then
    case when p.p_partkey % 23 = 0 then d.text || chr(10) || 'We found a Pure-Veg kitchen here and a friendly service.'
    else d.text end end as lines,
  'http://x.example/' || cast(p.p_partkey as string) || '?f=' || l.flag as url
from (
  select l_partkey, l_returnflag as flag, count(*) as listings from {lineitem} group by l_partkey, l_returnflag
) l
join (
  select *, substr(p_name, 1, instr(p_name, ' ') - 1) as adjective, substr(p_name, instr(p_name, ' ') + 1) as noun,
    p_name || case when p_partkey % 17 = 0 then ' Pure Veg' when p_partkey % 19 = 0 then ' non-veg veg' else '' end as full_name
  from {part}
) p on p.p_partkey = l.l_partkey
join {nation} on n_nationkey = p.p_partkey % 25
join {region} on r_regionkey = n_regionkey
left join {documents} d on d.doc_id = p.p_partkey
"""

def _cases(key: str, forms: list[str]) -> str:
    """One of the forms by the remainder of a key, which runs over more values than there are forms: else nothing."""
    return f"case {key} " + " ".join(f"when {i} then {form}" for i, form in enumerate(forms)) + " else '' end"


_AMOUNT = "case c_custkey % 4 when 1 then 'rs. ' when 2 then '₹' when 3 then 'inr ' else '' end || price"
_PRICES = [
    *(f"'{word} ' || {_AMOUNT}" for word in fixed.PRICE_BEFORE), *(f"price || ' {word}'" for word in fixed.PRICE_AFTER),
    *(f"'{word}'" for word in fixed.CHEAP_FRAGMENTS), "'budget ' || price", "'max ' || small", "small || ' or less, upto ' || price",
]
_RATINGS = ["'rated ' || small", "small || ' stars'", "'rating 3.' || digit", "'stars of over 3.' || digit", "'rated 4' || digit", "'top'", "'well-rated'", "'bestow'"]
_FLAGS = ["'veg'", "'non-veg'", "'pure-vegetarian'", "'delivers'", "'delivered'", "'reserve'", "'book a table, home delivery'"]
_TAGS = ["p_name || 's'", "p_name", "noun", "adjective || ' ' || noun || 's'", "adjective || noun"]
_AREAS = ["region", "region || ' ' || place || 'th block'", "region || ' or america 1th block'", "'in' || region"]

# One question per customer: a part of each kind or none, by remainders of its key, in three orders; every 19th is blank.
QUESTION = f"""
select c_custkey as question_id, case when c_custkey % 19 = 0 then '  ' else case c_custkey % 3
  when 0 then 'q ' || tag || ' ' || area || ' ' || cost || ' ' || stars || ' ' || flag
  when 1 then cost || ', ' || flag || ' q, ' || tag || ', ' || stars || ', ' || area
  else stars || ' q ' || area || ' - ' || tag || ' - ' || flag || ' ' || cost end end as text
from (
  select c_custkey, {_cases("c_custkey % 7", _TAGS)} as tag, {_cases("c_custkey % 11", _AREAS)} as area, {_cases(f"c_custkey % {len(_PRICES) + 8}", _PRICES)} as cost,
    {_cases("c_custkey % 23", _RATINGS)} as stars, {_cases("c_custkey % 29", _FLAGS)} as flag
  from (
    select c_custkey, p_name, substr(p_name, 1, instr(p_name, ' ') - 1) as adjective, substr(p_name, instr(p_name, ' ') + 1) as noun,
      lower(r_name) as region, cast(n_nationkey as string) as place, cast(c_custkey % 10 as string) as digit, cast(c_custkey % 61 as string) as small,
      case when c_custkey % 211 = 0 then '5000000000000000000' when c_custkey % 13 = 0 then '1,' || substr(cast(1000 + c_custkey % 900 as string), 2)
        else cast(100 + (c_custkey % 31) * 50 as string) end as price
    from {{customer}}
    join {{part}} on p_partkey = c_custkey
    join {{nation}} on n_nationkey = c_nationkey
    join {{region}} on r_regionkey = n_regionkey
  ) k
) q
"""

# Explicit choices for every fourth customer: values, nulls, empty lists and zeros.
OVERRIDE = """
select c_custkey as question_id,
  case when c_custkey % 8 = 0 then split('red,small', ',') when c_custkey % 12 = 0 then {empty} end as tags,
  case when c_custkey % 20 = 0 then split('ASIA 2th Block,EUROPE 3th Block', ',') end as areas,
  case when c_custkey % 3 = 0 then cast((c_custkey % 7) * 200 as bigint) end as max_price,
  case when c_custkey % 16 = 4 then cast(3.5 as double) when c_custkey % 16 = 8 then cast(0 as double) end as min_rating,
  c_custkey % 44 = 0 as pure_veg,
  c_custkey % 28 = 0 as online_order,
  c_custkey % 36 = 0 as book_table,
  c_custkey % 24 = 0 as sort_by_rating
from {customer} where c_custkey % 4 = 0
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents"))


def _run(spark: SparkSession, sf_dir: str, sql: str, *names: str, **tables: DataFrame) -> DataFrame:
    return spark.sql(sql, **{name: table(spark, sf_dir, name) for name in names}, **tables)


def literal(lines):
    """Lines of text as the literal list of pairs that scraped files hold, with two items that are no pairs."""
    escaped = F.transform(F.split(lines, "\n"), lambda line: F.concat(
        F.lit("('Rated 4.0', 'RATED\\n  "),
        F.replace(F.replace(F.replace(line, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\r"), F.lit("\\r")),
        F.lit("')"),
    ))
    return F.concat(F.lit("["), F.array_join(escaped, ", "), F.lit(", ('alone',), 7]"))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _run(spark, sf_dir, LISTING, "lineitem", "part", "nation", "region", "documents")
    return rows.withColumn("reviews", F.coalesce(literal(F.col("lines")), F.lit("[]"))).drop("lines")


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings under the headers of a raw file."""
    return listings(spark, sf_dir).select(*(F.col(new).alias(old) for old, new in fixed.RAW_COLUMNS.items()))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(listings(spark, sf_dir))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Spread, as millions of narrow rows are one split, and all that reads the questions would be one task.
    customers = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"))
    return written(_run(spark, sf_dir, QUESTION, "part", "nation", "region", customer=customers), "asked")  # else every rule repeats the making of the text


def overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, OVERRIDE.replace("{empty}", "cast(array() as array<string>)"), "customer")


_stored: dict[tuple[str, str], tuple[str, dict]] = {}


def ingested(spark: SparkSession, sf_dir: str) -> tuple[str, dict]:
    """Folder and counts of an ingestion of the listings, done once per session and scale."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        folder = f"{shared_dir(spark)}/catalogue-{uuid.uuid4().hex}"
        _stored[key] = folder, ingest(listings(spark, sf_dir), folder, encoder=ENCODER)
    return _stored[key]


def catalogue(spark: SparkSession, sf_dir: str) -> Catalogue:
    return Catalogue.open(spark, ingested(spark, sf_dir)[0], ENCODER)
