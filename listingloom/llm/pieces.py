"""Texts to token ids piece by piece: tokenizers whose pieces never cross white space give a word the same ids everywhere."""

import json
import sys
import unicodedata
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from listingloom.llm import texts as t
from listingloom.llm.worker import Generations

#: Pieces in each of the two generations whose ids a worker remembers.
REMEMBERED = 300_000

#: Signs in texts that need a whole look: a special token may begin, or lower case or white space depend on more than one
#: character.
_ODD = ("<|", "Σ", "İ", "\x85", "\u180e")
#: Signs that end most words that are not of letters alone.
_STOPS = frozenset(".,;:!?")
_NATIVE = sys.byteorder == "little" and array("I").itemsize == 4


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Layout:
    """What a tokenizer file says about cutting a text into pieces.

    `wordwise`: texts are composed (NFC), lower-cased and cut by a pattern that drops white space, so that pieces lie
    within words. Only such files can be handled piece by piece.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            self.file = json.load(file)
        steps = (self.file.get("normalizer") or {}).get("normalizers", [])
        cuts = (self.file.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.wordwise = (
            [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"]
            and steps[1]["pattern"] == {"Regex": r"\s+"} and steps[1]["content"] == " "
            and [c["type"] for c in cuts] == ["Split", "ByteLevel"]
            and cuts[0]["behavior"] == "Removed" and cuts[0]["invert"]
            and not cuts[1]["add_prefix_space"] and not cuts[1]["use_regex"]
        )
        if self.wordwise:
            self.cut = regex.compile(cuts[0]["pattern"]["Regex"].replace(r"[^\s", r"[^\p{White_Space}"))
        self.special = {a["content"]: a["id"] for a in self.file.get("added_tokens", [])}
        self.marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")

    def pieces(self, text: str) -> list[str | int]:
        """The pieces of any text, lower-cased, and the ids of special tokens among them."""
        found, at = [], 0
        for mark in [*self.marks.finditer(text), None]:
            part = unicodedata.normalize("NFC", text[at : mark.start() if mark else len(text)])
            found += self.cut.findall("".join(c.lower() for c in part))
            if mark:
                found.append(self.special[mark[0]])
                at = mark.end()
        return found


def _four_bytes(ids: list[int]) -> bytes:
    """Ids as little-endian u4."""
    if _NATIVE and isinstance(ids, list):
        return array("I", ids).tobytes()
    return np.array(ids, dtype="<u4").tobytes()


class Encoder:
    """Ids of whole batches of texts, from a function that gives the ids of one piece."""

    def __init__(self, layout: Layout, encode: Callable[[str], list[int]]):
        self.layout, self.encode = layout, encode
        self.pieces = Generations(REMEMBERED)

    def made(self, piece: str) -> bytes:
        return _four_bytes(self.encode(piece))

    def piece(self, piece: str | int) -> bytes:
        if isinstance(piece, int):
            return np.uint32(piece).tobytes()
        ids = self.pieces.get(piece)
        return ids if ids is not None else self.pieces.add(piece, self.made)

    def word(self, word: str) -> bytes:
        """The ids of a lower-cased word without white space."""
        if word.isalpha():
            return self.piece(word)
        stem = word[:-1]
        if word[-1:] in _STOPS and stem.isalpha():
            ids = self.pieces.get(stem)
            return (self.pieces.add(stem, self.made) if ids is None else ids) + self.piece(word[-1])
        return b"".join(map(self.piece, self.layout.cut.findall(word)))

    def odd(self, texts: pa.Array) -> np.ndarray:
        """Which texts are not plain words between white space."""
        data, _ = t.as_bytes(texts)
        raw, whole = memoryview(data), texts.to_pylist()
        seen = bytes(raw)
        if any(o.encode() in seen for o in _ODD) or ((data >= 0x1C) & (data <= 0x1F)).any():
            signs = regex.compile("<\\||[Σİ\x85\u180e\x1c-\x1f]")
            odd = [bool(signs.search(x)) for x in whole]
        else:
            odd = [False] * len(whole)
        return np.array([o or not unicodedata.is_normalized("NFC", x) for o, x in zip(odd, whole, strict=True)], dtype=bool)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls), one text after another, and how many each text has."""
        odd = self.odd(texts)
        words = pc.utf8_split_whitespace(pc.utf8_lower(pc.if_else(pa.array(odd), "", texts)))
        first = words.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(words.values)
        known, encoded, last = self.pieces, [], {}
        for word in coded.dictionary.to_pylist():
            ids = known.get(word)
            if ids is None:
                stem, stop = word[:-1], word[-1:]
                if stop in _STOPS and stem.isalpha() and (ids := known.get(stem)) is not None:
                    ids += last[stop] if stop in last else last.setdefault(stop, self.piece(stop))
                else:
                    ids = self.word(word)
            encoded.append(ids)
        at = coded.indices.to_numpy()[first[0] : first[-1]]
        first -= first[0]
        rare = np.flatnonzero(odd)
        if len(rare):  # each odd text becomes one more "word" of its own
            for i in rare:
                encoded.append(b"".join(map(self.piece, self.layout.pieces(texts[int(i)].as_py()))))
            at = np.insert(at[: first[-1]], first[rare], np.arange(len(encoded) - len(rare), len(encoded)))
            first = first + np.concatenate(([0], np.cumsum(odd)))
        lengths = np.array([len(x) for x in encoded], dtype=np.int64) // 4
        flat = np.frombuffer(b"".join(encoded), dtype="<u4")
        starts = np.concatenate(([0], np.cumsum(lengths)))
        chosen = lengths[at]
        counts = np.diff(np.concatenate(([0], np.cumsum(chosen)))[first])
        return flat[t.ragged(starts[at], chosen)], counts
