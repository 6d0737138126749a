"""Byte-pair encoding without merging: one look-up per prefix, and decoding."""

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm import texts as t
from listingloom.llm.pieces import Encoder, Layout, byte_letters
from listingloom.llm.worker import Memo, kept

#: Pairs of tokens whose test a worker remembers.
REMEMBERED_PAIRS = 150_000


class Suffixes:
    """A suffix automaton of many strings: for each prefix of a text, the longest of its suffixes that occurs in one.

    A state stands for the substrings that end at the same places. `longest` is the length of its longest one, `link`
    the state of the longest suffix that ends in more places.
    """

    def __init__(self, strings: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.longest = [-1], [0]
        for string in strings:
            at = 0
            for symbol in string:
                at = self._extend(at, symbol)

    def _state(self, longest: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.longest.append(longest)
        return len(self.next) - 1

    def _clone(self, at: int, symbol: int, whole: int) -> int:
        """Splits off the shorter substrings of a state, those that also end where `at` goes on with the symbol."""
        part = self._state(self.longest[at] + 1, dict(self.next[whole]), self.link[whole])
        self.link[whole] = part
        while at != -1 and self.next[at].get(symbol) == whole:
            self.next[at][symbol] = part
            at = self.link[at]
        return part

    def _extend(self, at: int, symbol: int) -> int:
        there = self.next[at].get(symbol)
        if there is not None:
            return there if self.longest[there] == self.longest[at] + 1 else self._clone(at, symbol, there)
        new = self._state(self.longest[at] + 1, {}, 0)
        while at != -1 and symbol not in self.next[at]:
            self.next[at][symbol] = new
            at = self.link[at]
        if at != -1:
            there = self.next[at][symbol]
            self.link[new] = there if self.longest[there] == self.longest[at] + 1 else self._clone(at, symbol, there)
        return new

    def find(self, string: tuple[int, ...]) -> int:
        at = 0
        for symbol in string:
            at = self.next[at][symbol]
        return at


class Merges:
    """The merges of a vocabulary, with tokens numbered by the time they arise: first symbols, then merges in order.

    A symbol is a byte, or a byte that ends a piece where the vocabulary marks word ends.
    """

    def __init__(self, layout: Layout):
        model = layout.file["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("ignore_merges"):
            raise ValueError("Only a plain BPE vocabulary can be encoded by prefixes.")
        ids, end = model["vocab"], model.get("end_of_word_suffix") or ""
        letters = byte_letters()
        names = letters + [x + end for x in letters] if end else letters
        number = {name: k for k, name in enumerate(names)}
        self.symbols, self.ends = len(names), bool(end)
        self.parts: list[tuple[int, int] | None] = [None] * len(names)
        self.strings: list[tuple[int, ...]] = [(k,) for k in range(len(names))]
        self.pairs: dict[tuple[int, int], int] = {}
        for merge in model["merges"]:
            left, right = (number[x] for x in (merge.split(" ") if isinstance(merge, str) else merge))
            name = names[left] + names[right]
            if name in number:
                raise ValueError(f"Two merges make the token {name!r}.")
            self.pairs[left, right] = number[name] = len(names)
            names.append(name)
            self.parts.append((left, right))
            self.strings.append(self.strings[left] + self.strings[right])
        self.ids = np.array([ids[name] for name in names], dtype=np.uint32)

        self.automaton = Suffixes(self.strings)
        states = [self.automaton.find(s) for s in self.strings]
        self.here: list[list[tuple[int, int]]] = [[] for _ in self.automaton.next]
        for token, state in enumerate(states):
            self.here[state].append((len(self.strings[token]), token))
        for tokens in self.here:
            tokens.sort(reverse=True)
        #: The longest token that is a suffix of a state's substrings, by state, from short to long ones.
        self.below = [-1] * len(self.here)
        for state in sorted(range(1, len(self.here)), key=self.automaton.longest.__getitem__):
            self.below[state] = self.here[state][0][1] if self.here[state] else self.below[self.automaton.link[state]]
        #: The longest token that is a shorter suffix of each token.
        self.shorter = [
            next((x for n, x in self.here[state] if n < len(self.strings[token])), self._beneath(state))
            for token, state in enumerate(states)
        ]
        self.lengths = [len(s) for s in self.strings]
        self.tested = Memo(REMEMBERED_PAIRS)

    def _beneath(self, state: int) -> int:
        link = self.automaton.link[state]
        return self.below[link] if link > 0 else -1

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging keeps the two tokens apart when they stand side by side.

        Looks back in time: while the token that arose last is taken apart, the parts that touch must never have had a
        merge that came before the ones that bound them otherwise. On equal terms the pair further left goes first.
        """
        left_until = right_until = len(self.parts)
        while True:
            merged = self.pairs.get((left, right))
            if merged is not None and merged < left_until and merged <= right_until:
                return False
            if left > right:
                if self.parts[left] is None:
                    return True
                left_until, left = left, self.parts[left][1]
            else:
                if self.parts[right] is None:
                    return True
                right_until, right = right, self.parts[right][0]

    def encode(self, piece: str) -> np.ndarray:
        """The ids of a piece: for every prefix its one possible last token, then back from the end."""
        symbols = list(piece.encode())
        if not symbols:
            return self.ids[:0]
        if self.ends:
            symbols[-1] += 256
        moves, links, longest = self.automaton.next, self.automaton.link, self.automaton.longest
        here, below, shorter, lengths, tested = self.here, self.below, self.shorter, self.lengths, self.tested
        last = [-1] * (len(symbols) + 1)
        state = matched = 0
        for end, symbol in enumerate(symbols, 1):
            there = moves[state].get(symbol)
            while there is None:
                state = links[state]
                matched = longest[state]
                there = moves[state].get(symbol)
            state, matched = there, matched + 1
            for n, token in here[state]:
                if n <= matched:
                    break
            else:
                token = below[links[state]]
            while True:
                start = end - lengths[token]
                if start == 0:
                    break
                before = last[start]
                key = before << 24 | token
                fits = tested.get(key)
                if fits is None:
                    fits = tested.add(key, self.compatible(before, token))
                if fits:
                    break
                token = shorter[token]
            last[end] = token
        tokens, end = [], len(symbols)
        while end:
            tokens.append(last[end])
            end -= lengths[last[end]]
        return self.ids[tokens[::-1]]


class Vocabulary:
    """Encoder and decoder of one tokenizer file, built once per worker."""

    def __init__(self, path: str):
        layout = Layout(path)
        if not layout.wordwise:
            raise ValueError(f"{path}: pieces that may hold white space are not supported.")
        if layout.file.get("decoder") is not None:
            raise ValueError(f"{path}: decoders are not supported.")
        self.encoder = Encoder(layout, Merges(layout).encode)
        named = {i: x for x, i in layout.file["model"]["vocab"].items()} | {i: x for x, i in layout.special.items()}
        self.names = pa.array([named.get(i) for i in range(max(named) + 1)], pa.string())

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The texts of ids: names of tokens with a blank between them. Unknown ids are left out."""
        known = pa.array(np.where(ids < len(self.names), ids, 0).astype(np.int64), mask=ids >= len(self.names))
        names = self.names.take(known)
        offsets = np.concatenate(([0], np.cumsum(counts)))
        if names.null_count:
            there = ~names.is_null().to_numpy(zero_copy_only=False)
            names, offsets = names.drop_null(), np.concatenate(([0], np.cumsum(there)))[offsets]
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), names), " ")


def vocabulary(path: str) -> Vocabulary:
    return kept(("bpe", path), lambda: Vocabulary(path))


def encoded(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Every row of `df` in one column `row` (a struct), with `ids`, the token ids of its text (array of int).

    The ids are those that the tokenizer file gives without added special tokens; special tokens that stand in a text
    get their own id. A null or empty text has no ids. Other columns pass through whatever their names; equal rows
    give equal rows. Runs without a shuffle over whole texts; a worker remembers a bounded number of words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = vocabulary(path).encoder
        for part in t.slices(batches, "text", keeps=("bpe",)):
            ids, counts = encoder.ids(part.column("text"))
            lists = pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(counts))).astype(np.int32), pa.array(ids.astype(np.int32)))
            yield pa.record_batch([*(part.column(c) for c in ("rest", "known", "text")), lists], names=["rest", "known", "text", "ids"])

    return t.packed(df, text).mapInArrow(run, f"{t.packed_schema(df, text)}, ids array<int>").select(t.unpacked(df, text), "ids")


def decoded(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Every row of `df` in one column `row`, with `decoded`, the text of its ids; null ids give an empty text."""
    fields = ",".join(f"`{f.name}`:{f.dataType.simpleString()}" for f in df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = vocabulary(path).decode
        for batch in batches:
            lists = pc.fill_null(batch.column("ids"), [])
            first = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[first[0] : first[-1]].astype(np.int64)
            names = decode(flat, np.diff(first))
            yield pa.record_batch([batch.column("row"), names.cast(pa.string())], names=["row", "decoded"])

    packed = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(f"`{ids}`").alias("ids"))
    return packed.mapInArrow(run, f"row struct<{fields}>, decoded string")


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes every text in one pass and returns per row: the key, n_tokens, ids_sha256 (over the ids as
    little-endian unsigned 32-bit integers) and decoded_sha256 (over the decoded text in UTF-8), both lowercase hex."""
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for part in t.slices(batches, "text", keeps=("bpe",)):
            ids, counts = words.encoder.ids(part.column("text"))
            raw, ends = memoryview(np.ascontiguousarray(ids).tobytes()), 4 * np.cumsum(counts)
            names, starts = t.as_bytes(words.decode(ids, counts))
            spelt = memoryview(names)
            yield pa.record_batch([
                part.column("key"),
                pa.array(counts, pa.int64()),
                pa.array([sha256(raw[e - 4 * n : e]).hexdigest() for e, n in zip(ends, counts, strict=True)]),
                pa.array([sha256(spelt[a:b]).hexdigest() for a, b in zip(starts[:-1], starts[1:], strict=True)]),
            ], names=[key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).mapInArrow(run, schema)
