"""Counting quotient filters: sorted fingerprints with counts, in slots of few bits.

A fingerprint of `bits` bits is a quotient, its high bits, and a remainder. A bitmap marks the quotients that occur. The
remainders of one quotient are a run of slots in ascending order, at the quotient's own slot or as soon after it as
earlier runs end; a second bitmap marks the last slot of each run. So the k-th marked quotient owns the k-th run, and a
fingerprint can be read back whole: filters of any sizes merge without loss.

A count takes slots of the run too: once x; twice x, x; more often x, digits, x, where the first digit is below x and no
digit is 0 or x (a leading 0 comes before a first digit above x). For x = 0: 0, digits, 0, 0 without digits of 0, and
0, 0, 0 for three. As remainders ascend, a slot that does not tells a count from the next remainder.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = "<BBQQ"
#: Remainders have so many bits at least, as digits need values besides 0 and x.
LEAST_REMAINDER = 3


def _digits(value: int, base: int) -> list[int]:
    out = [value % base]
    while value := value // base:
        out.append(value % base)
    return out[::-1]


def _value(digits: list[int], base: int) -> int:
    value = 0
    for d in digits:
        value = value * base + d
    return value


def _counted(x: int, count: int, width: int) -> list[int]:
    """The slots of a remainder that occurs three times or more."""
    if x == 0:
        return [0, 0, 0] if count == 3 else [0, *(d + 1 for d in _digits(count - 4, (1 << width) - 1)), 0, 0]
    digits = [d + 1 if d + 1 < x else d + 2 for d in _digits(count - 3, (1 << width) - 2)]
    return [x, *([0] if digits[0] > x else []), *digits, x]


def _uncounted(run: list[int], width: int) -> list[tuple[int, int]]:
    """Remainders and counts of a run of slots."""
    found, i, n = [], 0, len(run)
    while i < n:
        x, j, count = run[i], i + 1, 1
        if x == 0 and j < n:
            k = j
            while k < n and run[k]:
                k += 1
            if k + 1 < n and not run[k + 1]:  # two zeros end a count of 0
                count = 3 if k == j else _value([d - 1 for d in run[j:k]], (1 << width) - 1) + 4
                j = k + 2
            elif k == j:
                count, j = 2, j + 1
        elif j < n and run[j] == x:
            count, j = 2, j + 1
        elif j < n and run[j] < x:
            j += run[j] == 0
            k = run.index(x, j)
            count = _value([d - 1 if d < x else d - 2 for d in run[j:k]], (1 << width) - 2) + 3
            j = k + 1
        found.append((x, count))
        i = j
    return found


def _pack(values: np.ndarray, width: int) -> bytes:
    shifts = np.arange(width - 1, -1, -1, dtype=np.uint64)
    return np.packbits(((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).reshape(-1)).tobytes()


def _unpack(data: bytes, n: int, width: int) -> np.ndarray:
    flags = np.unpackbits(np.frombuffer(data, dtype=np.uint8), count=n * width).reshape(n, width)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        out = (out << np.uint64(1)) | flags[:, k]
    return out


def built(keys: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """The filter of ascending, distinct fingerprints below 2^bits (uint64) and how often each occurs."""
    high = min(max(1, int(np.ceil(np.log2(max(len(keys), 1) / 0.9)))), bits - LEAST_REMAINDER)
    width = bits - high
    homes = (keys >> np.uint64(width)).astype(np.int64)
    rest = keys & np.uint64((1 << width) - 1)
    sizes = np.minimum(counts, 2).astype(np.int64)
    many = np.flatnonzero(counts > 2)
    counted = [_counted(int(rest[i]), int(counts[i]), width) for i in many]
    sizes[many] = [len(c) for c in counted]
    filled = np.repeat(rest, sizes)
    at = np.cumsum(sizes) - sizes
    for i, slots in zip(many, counted):
        filled[at[i] : at[i] + len(slots)] = slots
    quotients, first = np.unique(homes, return_index=True)
    lengths = np.add.reduceat(sizes, first) if len(first) else np.zeros(0, dtype=np.int64)
    before = np.cumsum(lengths) - lengths
    starts = before + np.maximum.accumulate(quotients - before) if len(first) else lengths
    n_slots = max(1 << high, int(starts[-1] + lengths[-1]) if len(first) else 0)
    slots = np.zeros(n_slots, dtype=np.uint64)
    slots[np.repeat(starts - before, lengths) + np.arange(len(filled))] = filled
    occupied, ends = np.zeros(1 << high, dtype=np.uint8), np.zeros(n_slots, dtype=np.uint8)
    occupied[quotients] = 1
    ends[starts + lengths - 1] = 1
    return struct.pack(_HEAD, bits, high, n_slots, len(keys)) + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + _pack(slots, width)


def read(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The ascending fingerprints of a filter, and their counts."""
    bits, high, n_slots, _ = struct.unpack_from(_HEAD, data)
    width, at = bits - high, struct.calcsize(_HEAD)
    cut = at + ((1 << high) + 7) // 8
    quotients = np.flatnonzero(np.unpackbits(np.frombuffer(data[at:cut], dtype=np.uint8), count=1 << high))
    at, cut = cut, cut + (n_slots + 7) // 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(data[at:cut], dtype=np.uint8), count=n_slots))
    slots = _unpack(data[cut:], n_slots, width)
    starts = np.maximum(quotients, np.concatenate(([0], ends[:-1] + 1))) if len(ends) else ends
    lengths = ends + 1 - starts
    run = np.repeat(np.arange(len(starts)), lengths)
    values = slots[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(run))]
    counts = np.ones(len(values), dtype=np.int64)
    plain = np.ones(len(starts), dtype=bool)
    plain[run[1:][(run[1:] == run[:-1]) & (values[1:] <= values[:-1])]] = False
    keep = plain[run]
    edges = np.cumsum(lengths)
    for r in np.flatnonzero(~plain):
        first = edges[r] - lengths[r]
        found = _uncounted(values[first : edges[r]].tolist(), width)
        put = slice(first, first + len(found))
        values[put], counts[put], keep[put] = [x for x, _ in found], [c for _, c in found], True
    keys = (quotients[run].astype(np.uint64) << np.uint64(width)) | values
    return keys[keep], counts[keep]


def merged(filters: list[bytes], bits: int) -> bytes:
    """One filter with the sums of the counts."""
    parts = [read(f) for f in filters]
    keys = np.concatenate([k for k, _ in parts]) if parts else np.zeros(0, dtype=np.uint64)
    counts = np.concatenate([c for _, c in parts]) if parts else np.zeros(0, dtype=np.int64)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else order
    return built(keys[first], np.add.reduceat(counts, first) if len(first) else counts, bits)
