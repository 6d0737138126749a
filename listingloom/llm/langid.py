"""Language identification: scripts narrow the candidates of a word, n-grams score it, Viterbi labels spans of words."""

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm import texts as t
from listingloom.llm.worker import kept

#: Scripts by ranges of code points (first, last); a letter outside all ranges belongs to script 0.
SCRIPTS = {
    "latin": ((0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFB00, 0xFB06), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF),),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "indic": ((0x900, 0xDFF),),
    "thai": ((0xE00, 0xEFF),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)),
    "ethiopic": ((0x1200, 0x139F),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "han": ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF)),
}

#: N-grams of these many code points, with the word's edges, are counted in so many bins.
ORDERS, BINS = (2, 3, 4), 1 << 16
#: Words of so many bytes are labelled at once.
SLICE_BYTES = 16 << 20
#: A language is a candidate for words of a script that has this share of its letters.
LEAST_SHARE = 0.01
_COUNT_PARTS = 16


def _letters() -> np.ndarray:
    """The script of every code point that is a letter, from 1 on; 0 for what is no letter."""
    table = np.zeros(0x110000, dtype=np.uint8)
    for c in range(0x30000):
        if unicodedata.category(chr(c))[0] == "L":
            table[c] = 1
    table[0x30000:0x3FFFE] = 1
    for k, ranges in enumerate(SCRIPTS.values(), 2):
        for first, last in ranges:
            part = table[first : last + 1]
            part[part > 0] = k
    return table


def letter_scripts() -> np.ndarray:
    return kept("letters", _letters)


class _Words:
    """Distinct lower-cased words of texts: their script and n-grams, and where they stand."""

    def __init__(self, column: pa.Array):
        split = pc.utf8_split_whitespace(pc.utf8_lower(column))
        first = split.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(split.values)
        self.at = coded.indices.to_numpy()[first[0] : first[-1]]
        self.first = first - first[0]
        words = coded.dictionary
        lengths = pc.utf8_length(words).to_numpy().astype(np.int64)
        codes = np.frombuffer((" " + " ".join(words.to_pylist()) + " ").encode("utf-32-le", "surrogatepass"), dtype="<u4")
        self.starts = 1 + np.concatenate(([0], np.cumsum(lengths + 1)))[:-1]
        self.ends = self.starts + lengths
        self.scripts = letter_scripts()[np.minimum(codes, 0x10FFFF)]
        self.codes = np.where(self.scripts > 0, codes, 32).astype(np.uint64)
        places = np.where(self.scripts > 0, np.arange(len(codes)), len(codes))
        lead = np.minimum.reduceat(places, self.starts) if len(words) else places[:0]
        lead = np.where(lead < self.ends, lead, 0)
        #: Script of each distinct word's first letter, 0 without letters.
        self.script = self.scripts[lead] if len(words) else np.zeros(0, dtype=np.uint8)

    def grams(self) -> tuple[np.ndarray, np.ndarray]:
        """Bin and word of every n-gram of words with letters."""
        bins, owners = [], []
        chosen = np.flatnonzero(self.script > 0)
        for n in ORDERS:
            count = np.maximum(self.ends[chosen] - self.starts[chosen] + 3 - n, 0)
            at = t.ragged(self.starts[chosen] - 1, count)
            key = np.full(len(at), n, dtype=np.uint64)
            for k in range(n):
                key = key * np.uint64(0x9E3779B97F4A7C15) + self.codes[at + k]
            bins.append((t.mix(key) & np.uint64(BINS - 1)).astype(np.int64))
            owners.append(np.repeat(chosen, count))
        return np.concatenate(bins), np.concatenate(owners)


@dataclass
class Model:
    """langs, sorted; scores: (bins, langs) log-probabilities; candidates: (scripts, langs) whether a word may be of the language."""

    langs: list[str]
    scores: np.ndarray
    candidates: np.ndarray
    penalty: float
    weight: float


def learn(df: DataFrame, lang: str = "lang", text: str = "text", rows_per_lang: int = 5000, penalty: float = 8.0, weight: float = 0.5) -> Model:
    """A model from rows with a language and a text.

    Of each language at most about `rows_per_lang` rows are used, those whose hash of the text is smallest as a share
    of all its rows; equal texts are used together. Counts are summed per language and part of the bins. `weight`
    scales a word's score, as its n-grams overlap; `penalty` is what a switch between languages costs in labelling.
    Rows with a null language or text, and texts without letters, teach nothing. Without any rows the model is empty.
    """
    rows = df.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], np.zeros((BINS, 0), dtype=np.float32), np.zeros((len(SCRIPTS) + 2, 0), dtype=bool), penalty, weight)
    share = F.lit(0.0)
    for name in langs:
        share = F.when(F.col("lang") == name, min(1.0, rows_per_lang / sizes[name])).otherwise(share)
    drawn = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < share * (1 << 30))
    number = {name: k for k, name in enumerate(langs)}
    n_scripts = len(SCRIPTS) + 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, scripts = np.zeros((len(langs), BINS), dtype=np.int64), np.zeros((len(langs), n_scripts), dtype=np.int64)
        for part in t.slices(batches, "text"):
            words = _Words(part.column("text"))
            spoken = np.array([number[x] for x in part.column("lang").to_pylist()])
            of_word = np.repeat(spoken, np.diff(words.first))
            seen = np.bincount(words.at * len(langs) + of_word, minlength=len(words.script) * len(langs)).reshape(-1, len(langs))
            bins, owners = words.grams()
            letters = np.zeros((len(words.script), n_scripts), dtype=np.int64)
            owner = np.repeat(np.arange(len(words.starts)), words.ends - words.starts)
            place = t.ragged(words.starts, words.ends - words.starts)
            np.add.at(letters, (owner, words.scripts[place]), 1)
            for k in np.unique(spoken):
                grams[k] += np.bincount(bins, weights=seen[owners, k], minlength=BINS).astype(np.int64)
                scripts[k] += seen[:, k] @ letters
        for k, name in enumerate(langs):
            if grams[k].any():
                parts = [*np.split(grams[k], _COUNT_PARTS), scripts[k]]
                yield pa.record_batch([
                    pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array([x.tobytes() for x in parts], pa.binary()),
                ], names=["lang", "part", "counts"])

    def total(group: pa.Table) -> pa.Table:
        sums = np.sum([np.frombuffer(x, dtype=np.int64) for x in group.column("counts").to_pylist()], axis=0)
        return pa.table({"lang": group.column("lang")[:1], "part": group.column("part")[:1], "counts": pa.array([sums.tobytes()], pa.binary())})

    kinds = "lang string, part int, counts binary"
    tasks = max(1, min(32, math.ceil(sum(min(n, rows_per_lang) for n in sizes.values()) / 500)))
    sums = drawn.repartition(tasks).mapInArrow(count, kinds).groupBy("lang", "part").applyInArrow(total, kinds).collect()
    grams, scripts = np.zeros((len(langs), BINS)), np.zeros((len(langs), n_scripts))
    for r in sums:
        values = np.frombuffer(r["counts"], dtype=np.int64)
        if r["part"] == _COUNT_PARTS:
            scripts[number[r["lang"]]] = values
        else:
            grams[number[r["lang"]], r["part"] * (BINS // _COUNT_PARTS) :][: len(values)] = values
    smooth = 0.5
    scores = np.log((grams + smooth) / (grams.sum(axis=1, keepdims=True) + smooth * BINS)).T
    scripts[:, 0] = 0
    candidates = (scripts >= LEAST_SHARE * np.maximum(scripts.sum(axis=1, keepdims=True), 1)).T & (scripts > 0).T
    candidates[~candidates.any(axis=1)] = True
    return Model(langs, np.ascontiguousarray(scores, dtype=np.float32), candidates, penalty, weight)


def _scores(words: _Words, model: Model) -> np.ndarray:
    """Of each distinct word and language; 0 for words without letters, far below for languages that are no candidate."""
    bins, owners = words.grams()
    found = np.zeros((len(words.script), len(model.langs)), dtype=np.float32)
    for k in range(len(model.langs)):
        found[:, k] = np.bincount(owners, weights=model.scores[bins, k], minlength=len(found))
    found *= model.weight
    lettered = words.script > 0
    found[lettered] -= np.max(found[lettered], axis=1, initial=-np.inf, keepdims=True)
    found[lettered] += np.where(model.candidates[words.script[lettered]], 0, -1e6).astype(np.float32)
    return found


def _best_paths(scores: np.ndarray, at: np.ndarray, first: np.ndarray, penalty: float) -> np.ndarray:
    """The language of every word: the path with the highest sum of scores, less a penalty for every switch.

    All texts go forward together, word by word, the longest first, so that those not yet ended lead.
    """
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    begin, lengths = first[:-1][order], lengths[order]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")
    stays = np.zeros((len(at), scores.shape[1]), dtype=bool)
    leaders = np.zeros(len(at), dtype=np.int16)
    path = np.zeros(len(at), dtype=np.int16)
    value = np.zeros((len(order), scores.shape[1]), dtype=np.float32)
    final = np.zeros(len(order), dtype=np.int16)
    for step in range(steps):
        n = alive[step]
        places = begin[:n] + step
        now = value[:n]
        if step:
            leader = now.argmax(axis=1)
            leaders[places] = leader
            now = now - now[np.arange(n), leader][:, None]
            stays[places] = now >= -penalty
            now = np.maximum(now, -penalty)
        value[:n] = now + scores[at[places]]
    final[:] = value.argmax(axis=1)
    for step in range(steps - 1, -1, -1):
        n = alive[step]
        places = begin[:n] + step
        state = final[:n]
        path[places] = state
        if step:
            final[:n] = np.where(stays[places, state], state, leaders[places])
    return path


def _labels(column: pa.Array, model: Model) -> tuple[_Words, np.ndarray, np.ndarray]:
    words = _Words(column)
    path = _best_paths(_scores(words, model), words.at, words.first, model.penalty)
    return words, path, words.script[words.at] > 0


def identified(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of `df` in one column `row` (a struct), with:

    spans: array of (lang, first word, words), maximal runs of words in one language, words numbered from 0 by white space;
    words without letters belong to the run around them. lang_pred: the language of most words with letters, ties to the
    first in order; score: its share of them. Null texts and texts without letters have no spans, `und` and 0.0, and so
    has every text where the model is empty.

    Runs without a shuffle over whole texts; a task holds about 16 MB of texts, or a single longer text.
    """
    sent = ["rest", "known", "text"]
    span = pa.struct([("lang", pa.string()), ("first", pa.int32()), ("words", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(model.langs, pa.string())
        for part in t.slices(batches, "text", SLICE_BYTES):
            n = part.num_rows
            if not model.langs:
                none = pa.array([[]] * n, pa.list_(span))
                yield pa.record_batch([*(part.column(c) for c in sent), none, pa.array(["und"] * n), pa.array([0.0] * n)], names=[*sent, "spans", "lang_pred", "score"])
                continue
            words, path, lettered = _labels(part.column("text"), model)
            doc = np.repeat(np.arange(n), np.diff(words.first))
            votes = np.bincount(doc[lettered] * len(model.langs) + path[lettered], minlength=n * len(model.langs)).reshape(n, -1)
            total = votes.sum(axis=1)
            chosen = votes.argmax(axis=1)
            share = votes[np.arange(n), chosen] / np.maximum(total, 1)
            new = np.ones(len(path), dtype=bool)
            new[1:] = (path[1:] != path[:-1]) | (doc[1:] != doc[:-1])
            new &= total[doc] > 0
            starts = np.flatnonzero(new)
            span_doc = doc[starts]
            upto = np.append(starts[1:], len(path))
            length = np.minimum(upto, words.first[span_doc + 1]) - starts
            values = pa.StructArray.from_arrays(
                [names.take(pa.array(path[starts])), pa.array(starts - words.first[span_doc], pa.int32()), pa.array(length, pa.int32())], fields=list(span)
            )
            offsets = np.searchsorted(span_doc, np.arange(n + 1)).astype(np.int32)
            lang = pc.if_else(pa.array(total > 0), names.take(pa.array(chosen)), "und")
            yield pa.record_batch([
                *(part.column(c) for c in sent), pa.ListArray.from_arrays(pa.array(offsets), values), lang, pa.array(share, pa.float64()),
            ], names=[*sent, "spans", "lang_pred", "score"])

    found = t.packed(df, text).mapInArrow(run, f"{t.packed_schema(df, text)}, spans array<struct<lang:string,first:int,words:int>>, lang_pred string, score double")
    return found.select(t.unpacked(df, text), "spans", "lang_pred", "score")
