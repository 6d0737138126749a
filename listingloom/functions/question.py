"""Column functions that read filters out of a question. All take lower-cased text.

Each pattern is tried only on text that holds one of the fragments it cannot match without. A
fragment test is a plain byte search, far cheaper than a regular expression on long text.
"""

from pyspark.sql import Column, functions as F

from listingloom import fixed

PRICE_PATTERNS = {
    fixed.starting(f"(?:{'|'.join(fixed.PRICE_BEFORE)})SPACE*" + fixed.PRICE_NUMBER, "ublwmca"): fixed.PRICE_BEFORE,
    fixed.starting(fixed.PRICE_BUDGET + "SPACE*" + fixed.PRICE_NUMBER, "b"): ["budget"],
    # What may lead the number is optional, so here the pattern can begin at the digits.
    fixed.pattern(f"{fixed.DIGITS}SPACE*(?:{'|'.join(fixed.PRICE_AFTER)})") + fixed.WORD_END: fixed.PRICE_AFTER,
}
LARGEST_PRICE = 2**63 - 1
RATING_PATTERN = (
    fixed.starting(fixed.RATING_WORD_FIRST, "rs") + "|" + fixed.whole_words(fixed.RATING_NUMBER_FIRST, "0-9")
)


def _mentions(text: Column, fragments: list[str]) -> Column:
    return F.greatest(*(F.contains(text, F.lit(fragment)) for fragment in [*fragments, *fragments[:1]]))


def _matches(text: Column, words: str, fragments: list[str]) -> Column:
    initials = "".join(sorted({fragment[0] for fragment in fragments}))
    return _mentions(text, fragments) & text.rlike(fixed.whole_words(words, initials))


def _first_where(value: Column, accept) -> Column:
    """The value if accepted, else null, without computing it twice."""
    return F.get(F.filter(F.array(value), accept), F.lit(0))


def _amount(digits: Column) -> Column:
    # What does not fit is above every price that can be stored, as the largest number is above or equal to all of them.
    bare = F.nullif(F.regexp_replace(digits, ",|^[0,]+", ""), F.lit(""))
    return F.when(bare.isNotNull(), F.coalesce(bare.try_cast("bigint"), F.lit(LARGEST_PRICE)))


def max_price(question: Column) -> Column:
    """The amount of the first pattern whose leftmost match is a plausible price, else the cheap default."""
    digits = [
        F.when(_mentions(question, fragments), F.regexp_extract(question, regex, 1))
        for regex, fragments in PRICE_PATTERNS.items()
    ]
    amounts = F.filter(F.transform(F.array(*digits), _amount), lambda amount: amount >= fixed.MIN_PRICE_MENTION)
    cheap = F.when(
        _matches(question, fixed.CHEAP_WORDS, fixed.CHEAP_FRAGMENTS), F.lit(fixed.CHEAP_PRICE).cast("bigint")
    )
    return F.coalesce(F.get(amounts, F.lit(0)), cheap)


def sort_by_rating(question: Column) -> Column:
    return _matches(question, fixed.HIGH_RATING_WORDS, fixed.HIGH_RATING_FRAGMENTS)


def min_rating(question: Column) -> Column:
    # Neither alternative has a digit before its number, so the number is the first one in the match.
    match = F.when(_mentions(question, fixed.RATING_FRAGMENTS), F.regexp_extract(question, RATING_PATTERN, 0))
    value = F.nullif(F.regexp_extract(match, r"[0-9](?:\.[0-9])?", 0), F.lit("")).try_cast("double")
    named = _first_where(value, lambda v: (v > 0) & (v <= 5))
    return F.coalesce(named, F.when(sort_by_rating(question), F.lit(fixed.HIGH_RATING)))


def pure_veg(question: Column) -> Column:
    negated = F.contains(question, F.lit("non")) & question.rlike(fixed.starting(fixed.NON_VEG, "n"))
    asked = F.contains(question, F.lit("veg")) & question.rlike(fixed.whole_words(fixed.QUESTION_VEG, "pv"))
    return asked & ~negated


def online_order(question: Column) -> Column:
    return _matches(question, fixed.DELIVERY_WORDS, fixed.DELIVERY_FRAGMENTS)


def book_table(question: Column) -> Column:
    return _matches(question, fixed.BOOKING_WORDS, fixed.BOOKING_FRAGMENTS)


def has_phrase(question: Column, phrase: Column) -> Column:
    """Whether the literal phrase occurs with no ASCII letter or digit directly beside it."""
    literal = F.concat(F.lit(r"(?<![a-z0-9])\Q"), F.replace(phrase, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-z0-9])"))
    return F.rlike(question, literal)


def keep_longest_tags(tags: Column) -> Column:
    """Longest tag first; a tag contained in an earlier one goes."""
    ranked = F.transform(
        F.array_sort(F.transform(tags, lambda tag: F.struct((-F.length(tag)).alias("size"), tag.alias("tag")))),
        lambda item: item["tag"],
    )
    return F.filter(
        ranked,
        lambda tag, i: ~F.exists(F.slice(ranked, 1, i), lambda kept: F.contains(F.lower(kept), F.lower(tag))),
    )


def keep_exact_areas(areas: Column) -> Column:
    """The longest area and those not contained in it, sorted."""
    ranked = F.array_sort(F.transform(areas, lambda area: F.struct((-F.length(area)).alias("size"), area.alias("area"))))
    longest = F.get(ranked, F.lit(0))["area"]
    kept = F.filter(areas, lambda area: (area == longest) | ~F.contains(F.lower(longest), F.lower(area)))
    return F.array_sort(kept)
