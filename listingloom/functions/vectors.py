"""Embedding and vector functions."""

import hashlib
import re
import sys
from collections.abc import Callable, Iterator
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from listingloom import fixed
from listingloom.functions.text import slices

Encoder = Callable[[list[str]], np.ndarray]


class HashedTokens:
    """Default encoder: counts of words, each hashed to one of the dimensions. Needs no model."""

    def __init__(self, dims: int = 256):
        self.dims = dims
        self.batch_size = max(fixed.EMBED_BATCH, (1 << 19) // dims)  # a table of 4 MB of counts, so that words are looked up once for many texts

    def __call__(self) -> Encoder:
        """What a worker calls once before it encodes its batches."""
        tokens = re.compile(r"[^\W_]+|\0")  # words, and the mark between two texts
        slots: dict[str, int] = {}

        def slot(word: str) -> int:
            if word not in slots:
                if len(slots) >= 200_000:
                    slots.clear()  # a memo only; the vocabulary has no bound
                slots[word] = int(hashlib.md5(word.lower().encode()).hexdigest()[:8], 16) % self.dims
            return slots[word]

        def encode(texts: list[str]) -> np.ndarray:
            whole = "\0".join(texts)
            if whole.count("\0") >= max(len(texts), 1):
                whole = "\0".join(text.replace("\0", " ") for text in texts)
            codes, distinct = pd.factorize(np.array(tokens.findall(whole), dtype=object))
            marks = np.array([word == "\0" for word in distinct], dtype=bool)
            places = np.array([0 if word == "\0" else slot(word) for word in distinct], dtype=np.int64)
            is_mark = marks[codes]
            cells = np.cumsum(is_mark) * self.dims + places[codes]
            counts = np.bincount(cells[~is_mark], minlength=len(texts) * self.dims)
            return counts.reshape(len(texts), self.dims).astype(float)

        return encode


def once_per_worker(name: str, make: Callable):
    """What make() returned first in this worker process, which Spark reuses for many tasks.

    Worker code arrives anew with every task, module globals included, so the values are kept in a
    module that only exists in the worker.
    """
    kept = vars(sys.modules.setdefault("listingloom_worker", ModuleType("listingloom_worker")))
    if name not in kept:
        kept[name] = make()
    return kept[name]


class SentenceEncoder:
    """A sentence-transformers model, where the workers have that package and the model."""

    def __init__(self, model: str = "sentence-transformers/all-MiniLM-L6-v2"):
        self.model = model

    def __call__(self) -> Encoder:
        def load():
            from sentence_transformers import SentenceTransformer

            return SentenceTransformer(self.model, device="cpu")

        return once_per_worker(f"sentence encoder {self.model}", load).encode


def embed(text: Column, encoder: Callable[[], Encoder] = HashedTokens(), batch_size: int | None = None) -> Column:
    """Unit-length vectors of text. The encoder is set up once per task and fed batches of bounded rows and text, by default as many
    rows as its batch_size says, if it has one."""
    batch_size = batch_size or getattr(encoder, "batch_size", fixed.EMBED_BATCH)

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for texts in batches:
            for start, end in slices(texts, batch_size):
                rows = np.asarray(encode(texts.iloc[start:end].fillna("").tolist())) if end > start else np.zeros((0, 0))
                norms = np.sqrt((rows * rows).sum(axis=1, keepdims=True))
                unit = np.divide(rows, norms, out=np.zeros_like(rows, dtype=float), where=norms > 0)
                yield pd.Series(list(unit.astype(np.float32)))

    return vectors(text)


def l2_normalise(vector: Column) -> Column:
    """The vector at unit length; a zero vector stays."""
    square = F.aggregate(vector, F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    norm = F.sqrt(square)
    return F.when(norm > 0, F.transform(vector, lambda x: x.cast("double") / norm)).otherwise(
        vector.cast("array<double>")
    )
