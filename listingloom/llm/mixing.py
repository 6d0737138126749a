"""Mixing sources to target weights: a temperature found by bisection, and passes over each source in permuted order.

Only DataFrame functions are used.
"""

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from listingloom.sources.shared import written

#: A word is a run without white space; words stand for tokens.
WORD = r"[^\x20\x09-\x0D]+"

#: Places in a permutation have LEVELS digits of DIGIT_BITS bits.
LEVELS, DIGIT_BITS = 3, 12
DIGIT = 1 << DIGIT_BITS
PLACES = 1 << (LEVELS * DIGIT_BITS)

#: Halvings of the exponent's range [0, 1], and how many of them one look at the sources settles.
HALVINGS, AT_ONCE = 30, 5

_BILLION = 1_000_000_000


@dataclass(frozen=True)
class Target:
    """What the weights p^x / sum(p^x) of sources with token shares p must meet; x is the least exponent that does.

    entropy: at most this share of the highest entropy, ln(number of sources).
    repeats: no source is passed more often than this.
    budget: tokens of the mix, as a share of all tokens.
    seed: of the permutations.
    """

    entropy: float = 0.95
    repeats: float = 2.0
    budget: float = 1.0
    seed: int = 17


def _place(seed: int, epoch: F.Column) -> F.Column:
    name = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.col("name"))
    return F.conv(F.substring(F.md5(name.cast("binary")), 1, LEVELS * DIGIT_BITS // 4), 16, 10).cast("long")


def _named(df: DataFrame, source: str, key: str, text: str) -> DataFrame:
    """The rows in one column `row`, with their source as `part`, tokens as `n`, and what their places are drawn from."""
    value = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    return df.select(
        F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"),
        F.coalesce(F.concat(F.lit("="), F.col(f"`{source}`").cast("string")), F.lit("")).alias("part"),
        F.regexp_count(value, F.lit(WORD)).cast("long").alias("n"),
        F.concat_ws(":", F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")), F.md5(value.cast("binary"))).alias("name"),
    )


def _exponent(shares: DataFrame, target: Target, total: int, budget: int) -> float:
    """The least exponent in [0, 1] whose weights meet the target, or 1 if none does."""
    sources = shares.count()
    low, high, left = 0.0, 1.0, HALVINGS
    while left:
        depth = min(AT_ONCE, left)
        points = [low + (high - low) * k / 2**depth for k in range(1, 2**depth)]
        sums = []
        for k, x in enumerate(points):
            power = F.pow("p", F.lit(x))
            sums += [F.sum(power).alias(f"z{k}"), F.sum(power * F.log("p")).alias(f"s{k}"), F.max(F.pow("p", F.lit(x - 1))).alias(f"m{k}")]
        one = shares.select((F.col("n") / F.lit(total)).alias("p")).agg(*sums)
        met = one.select(*(
            ((F.log(f"z{k}") - F.lit(x) * F.col(f"s{k}") / F.col(f"z{k}") <= F.lit(target.entropy) * F.log(F.lit(float(sources))))
             & (F.lit(budget / total) * F.col(f"m{k}") / F.col(f"z{k}") <= F.lit(target.repeats))).alias(f"k{k}")
            for k, x in enumerate(points)
        )).first()
        a, b = 0, 2**depth
        while b - a > 1:
            middle = (a + b) // 2
            a, b = (a, middle) if met[middle - 1] else (middle, b)
        low, high, left = low + (high - low) * a / 2**depth, low + (high - low) * b / 2**depth, left - depth
    return high


def _plan(rows: DataFrame, target: Target) -> DataFrame:
    """Per source: whole passes, and the place up to which one more pass goes. rows: part, n, name."""
    shares = written(rows.groupBy("part").agg(F.sum("n").alias("n")), "mixing-shares")
    some = shares.filter("n > 0")
    total = some.agg(F.sum("n")).first()[0] or 0
    budget = int(total * target.budget)
    exponent = _exponent(some, target, total, budget) if total else 1.0
    power = F.pow(F.col("n") / F.lit(max(total, 1)), F.lit(exponent))
    norm = some.agg(F.sum(power).alias("z")).first()["z"] or 1.0
    billionths = F.floor(power / F.lit(norm) * _BILLION)
    tokens = F.expr(f"(cast(w as decimal(10,0)) * cast({budget} as decimal(19,0))) div cast({_BILLION} as decimal(10,0))")
    goals = shares.withColumn("w", F.when(F.col("n") > 0, billionths).otherwise(0)).withColumn("goal", tokens)
    return goals.select(
        "part", F.when(F.col("n") > 0, F.expr("goal div n")).otherwise(0).alias("passes"),
        F.when(F.col("n") > 0, F.col("goal") % F.col("n")).otherwise(0).alias("rest"),
    )


def _limits(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Per source: passes, and `limit`: rows whose place in the last, partial pass is below it are in that pass.

    The places are a permutation's blocks. Digit by digit, the tokens of at most DIGIT blocks per source are summed up,
    and the block in which the budget ends is looked at more closely. The last one, of a single place, stays out.
    """
    state = written(plan.select("part", "passes", "rest", F.lit(0).cast("long").alias("limit")), "mixing-plan")
    placed = rows.join(state.select("part", "passes"), "part").select("part", "n", _place(seed, F.col("passes")).alias("place"))
    placed = written(placed, "mixing-places")
    for level in range(LEVELS):
        shift = (LEVELS - 1 - level) * DIGIT_BITS
        inside = placed.join(state, "part").filter(F.shiftright("place", shift + DIGIT_BITS) == F.col("limit"))
        digit = F.shiftright("place", shift).bitwiseAND(DIGIT - 1)
        blocks = inside.groupBy("part", digit.alias("digit"), "rest").agg(F.sum("n").alias("n"))
        upto = F.sum("n").over(Window.partitionBy("part").orderBy("digit"))
        sums = blocks.select("part", "digit", "rest", upto.alias("upto"))
        found = sums.groupBy("part").agg(
            F.min(F.when(F.col("upto") > F.col("rest"), F.col("digit"))).alias("digit"),
            F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))).alias("used"),
        )
        # A source whose blocks all fit takes the place after the last one, which holds nothing further down.
        after = F.col("limit") * DIGIT + F.coalesce("digit", F.when(F.col("found"), F.lit(DIGIT)).otherwise(0))
        state = written(
            state.join(found.withColumn("found", F.lit(True)), "part", "left").select(
                "part", "passes", (F.col("rest") - F.coalesce("used", F.lit(0))).alias("rest"), after.alias("limit")
            ),
            "mixing-state",
        )
    return state.select("part", "passes", "limit")


def mixed(
    df: DataFrame, target: Target = Target(), source: str = "source", key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The mix: rows of `df` in one column `row`, as often as their source's weight asks, with n_tokens (words), epoch
    (0 for the first pass over the source) and place (the row's place in that epoch's permutation).

    A source with goal tokens g and t tokens is passed g div t times whole, and once more in the order of place, up to
    the last block that fits into what is left of g. Rows with equal key and text share their places, so a block holds
    them all. A null source is a source of its own; a null text has no tokens. Rows of a source without any tokens come
    once. Goals are floored, so the mix never exceeds the budget. An empty table gives an empty mix.
    Sorting by (epoch, place) gives each source's training order. Only sums per source, and per source and block, are
    shuffled, after partial sums; the sources' goals meet the rows by a join that Spark broadcasts when they are small
    and splits by size otherwise. Intermediate tables are written to the shared folder.
    """
    rows = _named(df, source, key, text)
    narrow = written(rows.select("part", "n", "name"), "mixing-rows")
    limits = _limits(narrow, _plan(narrow, target), target.seed)
    copies = F.col("passes") + (_place(target.seed, F.col("passes")) < F.col("limit")).cast("long")
    often = rows.join(limits, "part").withColumn("copies", copies).filter("copies > 0")
    epochs = often.select("row", "n", "name", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("epoch"))
    return epochs.select("row", F.col("n").alias("n_tokens"), F.col("epoch").cast("int").alias("epoch"), _place(target.seed, F.col("epoch")).alias("place"))


def oracle(target: Target = Target()) -> str:
    """DuckDB SQL for the mix of table documents: doc_id, source, n_tokens, epoch, place."""
    digits = LEVELS * DIGIT_BITS // 4
    place = "('0x' || substr(md5(concat_ws(':', '{seed}', {epoch}::VARCHAR, name)), 1, {digits}))::BIGINT"
    return f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce('=' || source, '') AS part,
         len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS n,
         concat_ws(':', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, ''))) AS name
  FROM documents
), s AS (SELECT part, sum(n)::BIGINT AS n FROM d GROUP BY part),
t AS (SELECT sum(n)::BIGINT AS total, floor(sum(n) * {target.budget!r}::DOUBLE)::BIGINT AS budget, count(*) AS sources FROM s WHERE n > 0),
p AS (SELECT part, n, n / total::DOUBLE AS p FROM s, t WHERE n > 0),
b AS (
  SELECT 0 AS step, 0.0::DOUBLE AS low, 1.0::DOUBLE AS high
  UNION ALL
  SELECT step + 1, CASE WHEN met THEN low ELSE (low + high) / 2 END, CASE WHEN met THEN (low + high) / 2 ELSE high END
  FROM (
    SELECT step, low, high,
      ln(sum(pow(p, (low + high) / 2))) - (low + high) / 2 * sum(pow(p, (low + high) / 2) * ln(p)) / sum(pow(p, (low + high) / 2))
        <= {target.entropy!r}::DOUBLE * ln(max(sources))
      AND max(budget) / max(total)::DOUBLE * max(pow(p, (low + high) / 2 - 1)) / sum(pow(p, (low + high) / 2)) <= {target.repeats!r}::DOUBLE AS met
    FROM b, p, t WHERE step < {HALVINGS} GROUP BY step, low, high
  )
), x AS (SELECT high FROM b WHERE step = {HALVINGS}),
z AS (SELECT sum(pow(p, high)) AS z FROM p, x),
g AS (
  SELECT part, p.n, (floor(pow(p, high) / z * {_BILLION})::HUGEINT * budget // {_BILLION})::BIGINT AS goal FROM p, x, z, t
  UNION ALL SELECT part, 0, 0 FROM s WHERE n = 0
), q AS (SELECT part, CASE WHEN n > 0 THEN goal // n ELSE 0 END AS passes, CASE WHEN n > 0 THEN goal % n ELSE 0 END AS rest FROM g),
l AS (SELECT d.*, passes, rest, {place.format(seed=target.seed, epoch='passes', digits=digits)} AS last FROM d JOIN q USING (part)),
c AS (
  SELECT *, passes + CASE WHEN sum(n) OVER (PARTITION BY part ORDER BY last RANGE UNBOUNDED PRECEDING) <= rest THEN 1 ELSE 0 END AS copies FROM l
), e AS (SELECT *, unnest(range(copies::BIGINT)) AS epoch FROM c)
SELECT doc_id, source, n AS n_tokens, epoch::INTEGER AS epoch, {place.format(seed=target.seed, epoch='epoch', digits=digits)} AS place FROM e
"""
