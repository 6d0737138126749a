"""Quality rules: word and line counts of a text, and bands for how well it compresses."""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm import texts as t

#: The characters that count as symbols.
SYMBOLS = b"#*$%&|<>"

#: (bytes of the text from, lowest and highest compressed share that is kept). Short texts compress badly and cannot
#: repeat much, so their bands are wide or absent; the longer a text, the lower the share of ordinary prose.
#: The upper limits lie between prose and noise in base64 or printable ASCII, whose share is about 0.735 + 45 / bytes at
#: least. Hexadecimal, decimal or lower-case noise is no denser than short prose and stays inside.
DOCUMENT_BANDS = (
    (0, 0.0, 9.9), (256, 0.30, 0.87), (320, 0.30, 0.84), (384, 0.30, 0.81), (512, 0.30, 0.78), (768, 0.30, 0.75),
    (1024, 0.27, 0.72), (2048, 0.27, 0.70), (4096, 0.25, 0.68), (16384, 0.20, 0.66),
)
#: The same for texts of which most bytes belong to characters of several bytes: Chinese prose lies higher than Latin.
WIDE_BANDS = (
    (0, 0.0, 9.9), (256, 0.30, 0.91), (288, 0.30, 0.89), (320, 0.30, 0.87), (384, 0.30, 0.86), (416, 0.30, 0.848),
    (448, 0.30, 0.83), (512, 0.30, 0.808), (640, 0.30, 0.78), (768, 0.30, 0.76), (1024, 0.27, 0.74), (2048, 0.27, 0.72),
    (4096, 0.25, 0.70), (16384, 0.20, 0.68),
)


@dataclass(frozen=True)
class Bands:
    """Limits of the compressed share (compressed bytes / bytes), by zstandard at `level`.

    document: as DOCUMENT_BANDS, for whole texts. A text of at least two chunks is also cut into chunks of
    `chunk_bytes` (a rest of under half a chunk joins none); it is rejected when more than `bad_chunks` of them
    lie outside `chunk`. wide_document and wide_chunk hold for texts and chunks with more than half of their bytes in
    characters of several bytes.
    """

    document: tuple[tuple[int, float, float], ...] = DOCUMENT_BANDS
    wide_document: tuple[tuple[int, float, float], ...] = WIDE_BANDS
    chunk: tuple[float, float] = (0.25, 0.70)
    wide_chunk: tuple[float, float] = (0.25, 0.72)
    chunk_bytes: int = 2048
    bad_chunks: float = 0.5
    level: int = 3


_MEASURES = (
    "n_bytes long, n_wide_bytes long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "whole_share double, n_chunks long, n_bad_chunks long"
)


def _counts(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offsets) - 1
    words = t.Words(data, offsets)
    symbols = np.zeros(256, dtype=bool)
    symbols[list(SYMBOLS)] = True
    first_bytes = (data & 0xC0) != 0x80

    breaks = np.zeros(len(data) + 1, dtype=bool)
    breaks[1:] = np.concatenate((data == 10,))
    breaks[offsets] = True
    starts = np.flatnonzero(breaks)
    line_starts, line_ends = starts[:-1], starts[1:]
    has_word = np.diff(np.searchsorted(words.starts, starts)) > 0
    line_starts, line_ends = line_starts[has_word], line_ends[has_word]
    line_doc = np.searchsorted(offsets, line_starts, side="right") - 1
    line_ends = line_ends - (data[line_ends - 1] == 10)
    lines = t.mix(t.Spans(data, 1).keys(line_starts, line_ends) ^ t.mix(line_doc.astype(np.uint64)))
    kinds, at = np.unique(lines, return_index=True)
    n_lines = np.bincount(line_doc, minlength=n)
    n_dup_lines = n_lines - np.bincount(line_doc[at], minlength=n)

    shingles, places = words.shingles(3)
    keyed = shingles ^ t.mix(words.doc[places].astype(np.uint64))
    order = np.argsort(keyed)
    same = keyed[order[1:]] == keyed[order[:-1]]
    twice = np.zeros(len(keyed), dtype=bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    repeated = np.zeros(len(words.keys) + 2, dtype=bool)
    for i in range(3):
        repeated[places[twice] + i] = True
    n_repeat = np.bincount(words.doc, weights=repeated[: len(words.doc)], minlength=n).astype(np.int64)

    return {
        "n_bytes": np.diff(offsets),
        "n_wide_bytes": t.per_text(data >= 0x80, offsets),
        "n_words": np.diff(words.first),
        "word_chars": t.per_text(first_bytes & words.inside, offsets),
        "n_symbols": t.per_text(symbols[data], offsets),
        "n_dup_lines": n_dup_lines,
        "n_repeat_words": n_repeat,
    }


def _shares(data: np.ndarray, offsets: np.ndarray, bands: Bands) -> dict[str, np.ndarray]:
    packer, size = zstandard.ZstdCompressor(level=bands.level), bands.chunk_bytes
    n = len(offsets) - 1
    whole, chunks, bad = np.full(n, np.nan), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    view = memoryview(np.ascontiguousarray(data))
    for i in range(n):
        text = view[offsets[i] : offsets[i + 1]]
        if not len(text):
            continue
        whole[i] = len(packer.compress(text)) / len(text)
        cuts = list(range(0, len(text) - size // 2 + 1, size)) if len(text) >= 2 * size else []
        for at in cuts:
            chunk = text[at : at + size]
            wide = 2 * np.count_nonzero(np.frombuffer(chunk, dtype=np.uint8) >= 0x80) > len(chunk)
            low, high = bands.wide_chunk if wide else bands.chunk
            bad[i] += not low <= len(packer.compress(chunk)) / len(chunk) <= high
        chunks[i] = len(cuts)
    return {"whole_share": whole, "n_chunks": chunks, "n_bad_chunks": bad}


def measured(df: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """Every row of `df` in one column `row` (a struct), with the counts of its text:

    n_bytes (UTF-8), n_wide_bytes (those of characters of several bytes), n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word that are
    equal to an earlier line), n_repeat_words (words in windows of three words that the text holds twice or more),
    whole_share (compressed bytes / bytes; null without bytes), n_chunks, n_bad_chunks (those outside the chunk band).

    A null text counts as an empty one: all counts 0. No row is lost or merged; equal rows give equal results; other
    columns pass through whatever their names. Words, lines and windows are compared by 64-bit hashes per text.
    Runs without a shuffle; a task holds about 4 MB of texts, or a single longer text.
    """
    schema = f"{t.packed_schema(df, text)}, {_MEASURES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.slices(batches, "text"):
            data, offsets = t.as_bytes(part.column("text"))
            found = _counts(data, offsets) | _shares(data, offsets, bands)
            share = pa.array(found.pop("whole_share"), from_pandas=True)
            columns = {k: pa.array(v, pa.int64()) for k, v in found.items()} | {"whole_share": share}
            names = [c.split()[0] for c in _MEASURES.split(", ")]
            yield pa.record_batch([*(part.column(c) for c in ("rest", "known", "text")), *(columns[c] for c in names)], names=["rest", "known", "text", *names])

    measures = [c.split()[0] for c in _MEASURES.split(", ")]
    return t.packed(df, text).mapInArrow(run, schema).select(t.unpacked(df, text), *measures)


def in_bands(bands: Bands = Bands()) -> F.Column:
    """Whether a measured row lies inside the bands."""
    share = F.col("whole_share")

    def within(document: tuple[tuple[int, float, float], ...]) -> F.Column:
        low = high = F.lit(None).cast("double")
        for least, lowest, highest in document:
            low = F.when(F.col("n_bytes") >= least, lowest).otherwise(low)
            high = F.when(F.col("n_bytes") >= least, highest).otherwise(high)
        return (share >= low) & (share <= high)

    wide = 2 * F.col("n_wide_bytes") > F.col("n_bytes")
    return F.coalesce(F.when(wide, within(bands.wide_document)).otherwise(within(bands.document)), F.lit(True)) & (
        F.col("n_bad_chunks") <= bands.bad_chunks * F.col("n_chunks")
    )


def base_failed(least_words: int = 50, most_repeated: int = 50) -> F.Column:
    """Whether a measured row has too few words, or more than `most_repeated` percent of them in repeated windows."""
    return (F.col("n_words") < least_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))


def accepted(df: DataFrame, text: str = "text", bands: Bands = Bands()) -> DataFrame:
    """The rows of `df`, with its columns, that pass the base rules and the compression bands."""
    return measured(df, text, bands).filter(~base_failed() & in_bands(bands)).select("row.*")
