"""Fixed values that results depend on: headers, word lists, formats and limits."""

# --- Fixed values: raw header -> column name used here ----------------------------------------
RAW_COLUMNS = {
    "name": "name",
    "address": "address",
    "location": "area",
    "listed_in(city)": "city",
    "rest_type": "kind",
    "cuisines": "tags",
    "dish_liked": "liked",
    "rate": "rate",
    "votes": "votes",
    "approx_cost(for two people)": "cost",
    "online_order": "online_order",
    "book_table": "book_table",
    "listed_in(type)": "category",
    "reviews_list": "reviews",
    "url": "url",
}

# --- Fixed values: text read as missing (the defaults of pandas.read_csv) ---------------------
NULL_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# --- Fixed values: limits ---------------------------------------------------------------------
MIN_REVIEW_CHARS = 30
MAX_REVIEW_CHARS = 350
MAX_REVIEWS = 6
CHUNK_CHARS = 700
TOP_K = 5
POOL_FACTOR = 6
RATING_SORT_FACTOR = 2
EMBED_BATCH = 64
MIN_PRICE_MENTION = 50
CHEAP_PRICE = 500
HIGH_RATING = 4.0
MIN_BASE_CHARS = 3

# --- Fixed values: characters -----------------------------------------------------------------
# The 29 code points that Unicode-aware regular expressions treat as white space.
SPACE = r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SPACE_NOT_BLANK = SPACE.replace(r"\x{20}", r"\x{1f}")
WORD_START = r"(?<![\p{L}\p{N}_])"
WORD_END = r"(?![\p{L}\p{N}_])"

# --- Fixed values: words in reviews and names -------------------------------------------------
REVIEW_TOPICS = [
    "family", "families", "kids", "children", "veg", "vegetarian", "budget", "cheap", "affordable",
    "pocket", "ambience", "service", "value", "group", "friends", "date", "romantic", "buffet",
]
VEG = r"veg(?:etarian)?"
PURE_VEG = r"pure(?:-|SPACE)*veg(?:etarian)?"
NON_VEG = r"non(?:-|SPACE)*veg"

# --- Fixed values: words in questions ---------------------------------------------------------
DIGITS = r"([0-9][0-9,]*)"
PRICE_NUMBER = r"(?:rs\.?|inr|₹)?SPACE*" + DIGITS
PRICE_BEFORE = [
    "under", "below", "less than", "within", "upto", "up to", "max", "maximum", "cheaper than", "at most",
]
PRICE_BUDGET = r"budget(?: of| is)?"
PRICE_AFTER = ["or less", "and below", "max"]
CHEAP_WORDS = r"cheap|budget|affordable|inexpensive|pocket[- ]friendly|low[- ]cost"
RATING_WORD_FIRST = (
    r"(?:rat(?:ed|ing)|stars?)SPACE*(?:ofSPACE*)?"
    r"(?:above|over|at least|more than|>=?|\+)?SPACE*([0-9](?:\.[0-9])?)"
)
RATING_NUMBER_FIRST = r"([0-9](?:\.[0-9])?)SPACE*\+?SPACE*(?:stars?|rating|rated)"
HIGH_RATING_WORDS = r"(?:highly|high|top|best|well|good)[- ]?(?:rated|rating|reviewed)|best|top"
QUESTION_VEG = r"(?:pure(?:-|SPACE)*)?veg(?:etarian|gie)?"
DELIVERY_WORDS = r"deliver(?:y|s)?|order online|online order(?:ing)?|home delivery"
BOOKING_WORDS = r"book(?:ing)? a table|table booking|reserv(?:e|ation)|book table"

# Every match of the words above begins with one of these; a rating merely contains one.
CHEAP_FRAGMENTS = ["cheap", "budget", "affordable", "inexpensive", "pocket", "low"]
RATING_FRAGMENTS = ["rat", "star"]
HIGH_RATING_FRAGMENTS = ["high", "top", "best", "well", "good"]
DELIVERY_FRAGMENTS = ["deliver", "order online", "online order", "home delivery"]
BOOKING_FRAGMENTS = ["book", "table booking", "reserv"]

# --- Fixed values: rendered text --------------------------------------------------------------
CITY_NAME = "Bangalore"
DEFAULT_KIND = "Restaurant"
NO_TAGS = "unknown cuisine"
NOT_RATED_LINE = "Rating: not yet rated (new restaurant)."
NO_PRICE_LINE = "Approximate cost for two: not listed."
NO_CATEGORY = "n/a"
VEG_LINE = "Described as a pure vegetarian restaurant."
REVIEWS_LINE = "Customer reviews:"
CONTEXT_OPEN = "<restaurants>"
CONTEXT_CLOSE = "</restaurants>"
RECORD_CLOSE = "</record>"
FILTER_NOTE = "Filters already applied to the search: "
NO_MATCH_ANSWER = "I couldn't find any restaurants in the dataset matching that request."
ANSWER_INTRO = "Here are the best matches from the dataset:\n"
PRICE_UNKNOWN = "cost not listed"
RATING_UNKNOWN = "not yet rated"
ANSWER_SEPARATOR = " · "
UNKNOWN_RATING = -1.0
UNKNOWN_PRICE = -1
BLANK_QUESTION = "Query must not be empty."


def pattern(text: str) -> str:
    """Spell out SPACE in one of the patterns above."""
    return text.replace("SPACE", SPACE)


def starting(text: str, initials: str) -> str:
    """The pattern after the start of a word. The initials rule out most positions at little cost."""
    return f"(?=[{initials}]){WORD_START}(?:{pattern(text)})"


def whole_words(text: str, initials: str) -> str:
    """The pattern, with no letter, digit or underscore directly before or after it."""
    return starting(text, initials) + WORD_END
