"""Batches of texts as byte arrays, and their words and hashes, for whole columns at a time."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from listingloom.llm.worker import kept, released

#: Texts handled at once, in bytes; a longer text is handled alone.
SLICE_BYTES = 4 << 20

_RANDOM = np.random.default_rng(20240229)
_BYTE_CODES = _RANDOM.integers(1, 2**63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)

#: The white space that ends a word: blank, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = np.zeros(256, dtype=bool)
BLANKS[[32, 9, 10, 11, 12, 13]] = True


def bounded(spark: SparkSession) -> None:
    """Batches that workers are sent have 8 MB at most from now on in this session, or one row, unless it was started with
    a bound of its own: 10,000 long texts would be a batch otherwise."""
    bound = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark.sparkContext.getConf().contains(bound):
        spark.conf.set(bound, str(8 << 20))


def packed(df: DataFrame, text: str) -> DataFrame:
    """rest (a struct of the other columns, by position), known, text: what a worker is sent, each text once."""
    rest = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns) if c != text]
    return df.select(F.struct(F.lit(0).alias("none"), *rest).alias("rest"), F.col(f"`{text}`").isNotNull().alias("known"), F.col(f"`{text}`").alias("text"))


def unpacked(df: DataFrame, text: str) -> F.Column:
    """The struct `row` with the columns of `df`, from what packed() made of them."""
    place = {c: f"c{i}" for i, c in enumerate(df.columns)}
    whole = F.when(F.col("known"), F.col("text"))
    return F.struct(*((whole if c == text else F.col("rest")[place[c]]).alias(c) for c in df.columns)).alias("row")


def packed_schema(df: DataFrame, text: str) -> str:
    sent = packed(df, text).schema
    return f"rest {sent['rest'].dataType.simpleString()}, known boolean, text {sent['text'].dataType.simpleString()}"


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, keeps: tuple[str, ...] = ()) -> Iterator[pa.RecordBatch]:
    """The rows in pieces whose texts have about `limit` bytes at most, in order; a null text becomes an empty one.

    The worker first gives up what earlier stages kept in it, apart from `keeps`.
    """
    released("powers", "letters", *keeps)
    for batch in batches:
        at = batch.schema.get_field_index(column)
        texts = batch.column(at)
        if texts.null_count:
            batch = batch.set_column(at, column, pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) else ""))
        ends = np.cumsum(pc.binary_length(batch.column(at)).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, before + limit, side="right")), first + 1)
            yield batch.slice(first, last - first)
            first = last


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts in one array, and where each text starts, with the end of the last."""
    wide = texts.type in (pa.large_string(), pa.large_binary())
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    starts = starts.astype(np.int64)
    if data is None:
        return np.zeros(0, dtype=np.uint8), starts - starts[0]
    return np.frombuffer(data, dtype=np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def mix(keys: np.ndarray) -> np.ndarray:
    """Spreads 64-bit keys evenly (the finaliser of splitmix64); different keys stay different."""
    mixed = keys ^ (keys >> np.uint64(30))
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(27)
    mixed *= np.uint64(0x94D049BB133111EB)
    mixed ^= mixed >> np.uint64(31)
    return mixed


#: Powers of a base up to this one are kept by a worker.
_KEPT_POWERS = 1 << 20


def _powers(base: int, n: int) -> np.ndarray:
    def make(upto: int) -> np.ndarray:
        return np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(upto, base, dtype=np.uint64))))

    return kept(("powers", base), lambda: make(_KEPT_POWERS))[: n + 1] if n <= _KEPT_POWERS else make(n)


class Spans:
    """Hashes of any stretches of a byte array, from running sums of a polynomial modulo 2^64."""

    def __init__(self, data: np.ndarray, kind: int = 0):
        base = _BASES[kind]
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        codes = _BYTE_CODES[kind].take(data)
        codes *= _powers(base, len(data))[:-1]
        np.cumsum(codes, out=self.sums[1:])
        self.shifts = _powers(pow(base, -1, 1 << 64), len(data))

    def keys(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.shifts[starts] + (ends - starts).astype(np.uint64))


class Words:
    """The words of texts: maximal runs without white space (blank, \\t, \\n, \\v, \\f, \\r).

    starts, ends: places in the byte array; doc: the text that each word is in; first: each text's first word,
    with the number of all words at the end; keys: 64-bit hashes of the words.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.inside = ~BLANKS[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate(([False], self.inside[:-1])) & ~edge[:-1]
        self.starts = np.flatnonzero(self.inside & ~before)
        after = np.concatenate((self.inside[1:], [False])) & ~edge[1:]
        self.ends = np.flatnonzero(self.inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.keys = Spans(data).keys(self.starts, self.ends)

    def shingles(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash and text of every window of `size` words within one text, in order, and the window's first word."""
        n = max(0, len(self.keys) - size + 1)
        windows = np.zeros(n, dtype=np.uint64)
        for i in range(size):
            windows = windows * np.uint64(0x9FB21C651E98DF25) + self.keys[i : i + n]
        places = np.flatnonzero(self.doc[:n] == self.doc[size - 1 : size - 1 + n]) if n else np.zeros(0, dtype=np.int64)
        return mix(windows[places]), places


def per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many flags are set within each text."""
    return np.diff(np.concatenate(([0], np.cumsum(flags, dtype=np.int64)))[offsets])


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of every stretch, one after another."""
    ends = np.cumsum(lengths)
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    return np.arange(ends[-1]) + np.repeat(starts - (ends - lengths), lengths)
