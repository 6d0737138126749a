"""Secret scans: patterns for the usual forms, and candidates that are reported only once their structure is confirmed."""

import base64
import binascii
import bisect
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingloom.llm import texts as t

#: Kinds of spans, in the order in which spans with one start are listed. The first three are patterns, the others confirmed.
KINDS = ("assign", "access", "hex", "pem", "token", "key", "hexkey", "wrapped")
BASE_KINDS = KINDS[:3]

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
_ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]{16,}")

_PEM = re.compile("-----BEGIN ([A-Z0-9 ]*)PRIVATE KEY-----([^-]+)-----END \\1PRIVATE KEY-----")
_ESCAPE = re.compile(r"(?<!\\)\\+u([0-9A-Fa-f]{4})")
#: Ends of string literals with what joins them, and line ends, tabs and continuations as source code writes them.
_JOINED = re.compile(r"""["'`]\s*(?:[+.,&|]\s*)?["'`]""")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]+){2,}")

#: What may stand between two lines of one value: line ends, real or escaped, with blanks and the quotes of literals.
_BREAK = r"""(?:["'`]?[\x20\t]*(?:[+.,&|][\x20\t]*)?(?:\r?\n|(?:\\+[rn])+)[\x20\t]*(?:["'`]\s*(?:[+.,&|]\s*)?)?["'`]?)"""
#: Lines of base64 of either alphabet and of hex; a line of dashes is none. JSON may escape a slash.
_LINES = tuple(
    (re.compile(f"{one}+(?:{_BREAK}{stop}{one}+)*"), re.compile(one))
    for one, stop in ((r"(?:[A-Za-z0-9+]|\\*/)", ""), ("[A-Za-z0-9_-]", "(?!--)"), ("[0-9A-Fa-f]", ""))
)
_STANDARD, _URL, _HEX_LINES = _LINES

_C, _S = r"(?:[A-Za-z0-9+_-]|\\*/)", "[AEIMQUYcgkosw048]"
#: How a private key in DER begins in base64: a sequence with a length of up to five bytes, and its version 0 or 1.
_DER_START = re.compile(
    f"M(?:[A-H]{_S}CAQ[A-H]|I[E-H]{_C}AgE[AB]|I[I-L]{_C}{{2}}[AQgw]IBA|I[M-P]{_C}{{3}}{_S}CAQ[A-H]|I[Q-T]{_C}{{5}}AgE[AB])"
)
_DER_HINTS = ("CAQ", "AgE", "IBA")
_HEX_START = re.compile("30(?:[0-7].|81..|82.{4}|83.{6}|84.{8})02010[01]|6f70656e7373682d6b65792d763100", re.IGNORECASE)
_HEX_HINTS = ("02010", "6f70656e7373")
_OPENSSH = b"openssh-key-v1\x00"
#: After the last character of a key: padding, the rest of its run, or a character that shows the key does not end here.
_PADS, _REST, _GOES_ON = re.compile("={0,2}"), re.compile("[A-Za-z0-9+/_-]*={0,2}"), re.compile("[A-Za-z0-9]")
_HEX_GOES_ON = re.compile("[0-9A-Fa-f]{2}")
#: How a JSON object begins in base64: a brace, then a quote or white space.
_OBJECT_START = re.compile("e(?:y[A-DI-L]|w[k-r0-3])")
_OPENSSH_START = re.compile(f"{_BREAK}?".join("b3BlbnNzaC1rZXktdjE"))
#: How a PEM header begins in base64 after a multiple of three bytes, one more and two more; what to put before.
_WRAPPED_STARTS = tuple(
    (re.compile(f"{_BREAK}?".join(marker)), before)
    for marker, before in (("LS0tLS1CRUdJTi", ""), ("0tLS0tQkVHSU4g", "AC"), ("tLS0tLUJFR0lOI", "AAA"))
)


def _decoded(text: str) -> bytes:
    """The bytes behind base64 of either alphabet; none if it is not base64."""
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return b""


def _fields(data: bytes, depth: int = 0) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the DER values that fill `data` exactly; none if a length does not fit."""
    fields, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length >= 0x80:
            n = length & 0x7F
            length = int.from_bytes(data[at : at + n], "big")
            if not 1 <= n <= 4 or at + n > len(data) or length < 0x80:
                return None
            at += n
        if at + length > len(data):
            return None
        content = data[at : at + length]
        if tag & 0x20 and (depth > 8 or _fields(content, depth + 1) is None):
            return None
        fields.append((tag, content))
        at += length
    return fields


def _is_der_key(data: bytes) -> bool:
    """A private key as PKCS#8, RSA, DSA or SEC 1 encode it."""
    outer = _fields(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return False
    inner = _fields(outer[0][1]) or []
    tags = [tag for tag, _ in inner]
    if len(inner) < 2 or tags[0] != 0x02 or inner[0][1] not in (b"\x00", b"\x01"):
        return False
    if tags[:3] == [0x02, 0x30, 0x04]:
        return (_fields(inner[1][1]) or [(0, b"")])[0][0] == 0x06
    if inner[0][1] == b"\x01" and tags[1] == 0x04:
        return len(inner[1][1]) >= 16 and all(tag in (0xA0, 0xA1) for tag in tags[2:])
    return tags in ([0x02] * 9, [0x02] * 6)


def _openssh_size(data: bytes) -> int:
    """The bytes of the OpenSSH private key that `data` begins with: counted strings; 0 if there is none."""
    if not data.startswith(_OPENSSH):
        return 0
    at, strings, keys = len(_OPENSSH), 0, 1
    while strings < 5 + keys:
        if strings == 3:
            keys = int.from_bytes(data[at : at + 4], "big")
            at += 4
            strings += 1
            if not 1 <= keys <= 64:
                return 0
            continue
        if at + 4 > len(data):
            return 0
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        strings += 1
    return at if at <= len(data) else 0


def _is_openssh_key(data: bytes) -> bool:
    """An OpenSSH private key: counted strings that fill the data exactly."""
    return _openssh_size(data) == len(data) > 0


def _der_size(head: bytes) -> int:
    """The bytes of the DER value that begins with `head`."""
    if len(head) < 2 or head[1] < 0x80:
        return 2 + head[1] if len(head) > 1 else 0
    n = head[1] & 0x7F
    return 2 + n + int.from_bytes(head[2 : 2 + n], "big")


def _is_key(data: bytes) -> bool:
    return _is_der_key(data) or _is_openssh_key(data)


def _pems(text: str) -> list[tuple[int, int]]:
    """(start, end) of the private keys in PEM, also inside string literals: line ends, slashes and other characters
    may be escaped, and the lines may be literals of their own."""
    found = []
    for m in _PEM.finditer(text):
        body = m[2]
        if "\\" in body:
            body = _ESCAPE.sub(lambda e: chr(int(e[1], 16)), body)
            body = re.sub(r"\\+", "", re.sub(r"(?<!\\)\\+[nrt]", " ", body))
        body = re.sub(r"""[\s"'`]+""", "", _JOINED.sub("", body))
        if _is_key(_decoded(body)):
            found.append((m.start(), m.end()))
    return found


class _Lines:
    """The characters of a value that goes on over lines, from a start, and their places in the text."""

    def __init__(self, text: str, kind: tuple[re.Pattern, re.Pattern]):
        self.text, self.kind, self.first, self.last = text, kind, -1, -1

    def move(self, at: int) -> int:
        """The number in `chars` of the character at a place; -1 if there is none of this kind."""
        if not self.first <= at < self.last:
            lines, one = self.kind
            found = lines.match(self.text, at)
            if not found:
                return -1
            self.first, self.last, self.places = at, found.end(), []
            parts = []
            for part in re.finditer(f"{one.pattern}+|{_BREAK}", found[0]):
                if one.match(part[0]):
                    for c in one.finditer(part[0]):
                        parts.append(c[0][-1])
                        self.places.append(at + part.start() + c.start())
            self.chars = "".join(parts)
        number = bisect.bisect_left(self.places, at)
        return number if number < len(self.places) and self.places[number] == at else -1

    def end(self, number: int) -> int:
        """The place after the first `number` characters."""
        return self.kind[1].match(self.text, self.places[number - 1]).end()


def _base64_keys(text: str, pems: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Keys and wrapped keys in base64, on one line or on several, wherever in a run they begin."""
    starts = []
    if any(hint in text for hint in _DER_HINTS):
        starts += [(m.start(), 0, "") for m in _DER_START.finditer(text)]
    starts += [(m.start(), 1, "") for m in _OPENSSH_START.finditer(text)]
    for pattern, before in _WRAPPED_STARTS:
        starts += [(m.start(), 2, before) for m in pattern.finditer(text)]
    found, after, readers = [], 0, (_Lines(text, _STANDARD), _Lines(text, _URL))
    for at, form, before in sorted(starts):
        if at < after or any(a <= at < b for a, b in pems):
            continue
        for reader in readers:
            number = reader.move(at)
            if number < 0:
                continue
            if form == 0:
                size = _der_size(_decoded(reader.chars[number : number + 8]))
                kind, n = 5, -(-size * 4 // 3)
                if number + n > len(reader.chars) or not _is_der_key(_decoded(reader.chars[number : number + n])):
                    continue
            else:
                rest = before + reader.chars[number:]
                data = _decoded(rest[: len(rest) - (len(rest) % 4 == 1)])
                if form == 1:
                    size, kind = _openssh_size(data), 5
                else:
                    size, kind = max((b for _, b in _pems(data.decode("latin-1"))), default=0), 7
                n = -(-size * 4 // 3) - len(before)
                if not size:
                    continue
            end = reader.end(number + n)
            if kind == 7:
                end = _REST.match(text, end).end()
            elif _GOES_ON.match(text, end):
                continue
            else:
                end = _PADS.match(text, end).end()
            found.append((at, end, kind))
            after = end
            break
    return found


def _hex_keys(text: str) -> list[tuple[int, int, int]]:
    """Keys in hex, on one line or on several, wherever in a run they begin."""
    found, after, reader = [], 0, _Lines(text, _HEX_LINES)
    for m in _HEX_START.finditer(text):
        if m.start() < after or (number := reader.move(m.start())) < 0:
            continue
        rest = reader.chars[number:]
        if m[0][0] == "3":
            size = _der_size(bytes.fromhex(rest[:12])) if len(rest) >= 12 else 0
        else:
            size = _openssh_size(bytes.fromhex(rest[: len(rest) // 2 * 2]))
        if not 0 < 2 * size <= len(rest) or not _is_key(bytes.fromhex(rest[: 2 * size])):
            continue
        end = reader.end(number + 2 * size)
        if not _HEX_GOES_ON.match(text, end):
            found.append((m.start(), end, 6))
            after = end
    return found


def _object(part: str) -> dict:
    try:
        value = json.loads(_decoded(part))
    except (ValueError, RecursionError):
        return {}
    return value if isinstance(value, dict) else {}


def _header(part: str) -> int:
    """Where in a part the header of a token begins, an object that names an algorithm and ends with the part; or -1."""
    if isinstance(_object(part).get("alg"), str):
        return 0
    read: dict[int, str] = {}
    decoder = json.JSONDecoder()
    for m in _OBJECT_START.finditer(part):
        shift = m.start() % 4
        if shift not in read:
            read[shift] = _decoded(part[shift:]).decode("latin-1")
        at = (m.start() - shift) // 4 * 3
        try:
            value, end = decoder.raw_decode(read[shift], at)
        except (ValueError, RecursionError):
            continue
        if isinstance(value, dict) and isinstance(value.get("alg"), str) and not read[shift][end:].strip():
            return m.start()
    return -1


def _tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of the signed tokens: of three dotted parts, the first ends with a header that names an algorithm,
    the second is an object of claims, the third a signature."""
    found = []
    for m in _DOTTED.finditer(text):
        parts, at, skip = m[0].split("."), m.start(), 0
        for i, part in enumerate(parts):
            if i >= skip and i + 2 < len(parts) and len(part) >= 12 and _object(parts[i + 1]) and _decoded(parts[i + 2]):
                begin = _header(part)
                if begin >= 0:
                    found.append((at + begin, at + len(part) + len(parts[i + 1]) + len(parts[i + 2]) + 2))
                    skip = i + 3
            at += len(part) + 1
    return found


def spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, number of the kind) of every secret, by start, then kind; code points, end exclusive."""
    found = []
    low = text.lower()
    if any(word in low for word in _ASSIGN_WORDS):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    pems = _pems(text) if "-----BEGIN " in text else []
    found += [(a, b, 3) for a, b in pems]
    if "." in text:
        found += [(a, b, 4) for a, b in _tokens(text)]
    found += _base64_keys(text, pems)
    if any(hint in low for hint in _HEX_HINTS):
        found += _hex_keys(text)
    return sorted(found, key=lambda s: (s[0], s[2]))


def covered(text: str, found: list[tuple[int, int, int]], mark: str) -> str:
    """The text with every stretch of overlapping spans replaced by one mark."""
    parts, at = [], 0
    for start, end, _ in found:
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def scanned(df: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """Every row of `df` in one column `row` (a struct), the spans of secrets in its text, and `redacted`.

    spans: array of (kind, start, end) by start, then kind as in KINDS; code points, end exclusive. Spans of different
    kinds may overlap. assign, access and hex are patterns. The others are confirmed by structure first:
    pem: a private key between its lines, whose body is a key, also with the escapes and quotes of string literals;
    token: a signed token whose header and claims decode; key, hexkey: base64 or hex that decodes to a private key,
    lengths fitting exactly (DER: PKCS#8, RSA, DSA, SEC 1; OpenSSH); wrapped: base64 of text that holds a pem. Base64 and
    hex may go on over lines, and may begin anywhere in a run; a key inside a pem is not listed again. Public keys,
    certificates and keys under a passphrase are not reported.
    redacted: the text with each stretch of overlapping spans replaced by `mark`; null if the text is null.

    A null text has no spans. No row is lost or merged; other columns pass through whatever their names.
    Runs without a shuffle over whole texts.
    """
    schema = f"{t.packed_schema(df, text)}, spans array<struct<kind:string,start:int,end:int>>, redacted string"
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in t.slices(batches, "text"):
            whole = part.column("text").to_pylist()
            found = [spans(x) for x in whole]
            hidden = [covered(x, s, mark) if s else None for x, s in zip(whole, found, strict=True)]
            listed = [[{"kind": KINDS[k], "start": a, "end": b} for a, b, k in s] for s in found]
            yield pa.record_batch(
                [*(part.column(c) for c in ("rest", "known", "text")), pa.array(listed, span_type), pa.array(hidden, pa.string())],
                names=["rest", "known", "text", "spans", "redacted"],
            )

    found = t.packed(df, text).mapInArrow(run, schema)
    return found.select(t.unpacked(df, text), "spans", F.when(F.col("known"), F.coalesce("redacted", "text")).alias("redacted"))


def of_kinds(spans_column: F.Column, *kinds: str) -> F.Column:
    """The spans of these kinds."""
    return F.filter(spans_column, lambda s: s["kind"].isin(*kinds))


def listed(spans_column: F.Column) -> F.Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans_column, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
