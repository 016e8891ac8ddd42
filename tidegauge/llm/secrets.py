"""Secrets in texts: values after telling names, access keys and hex runs, and what decodes to a key or a signed token.

A candidate of the second sort is reported only if its bytes parse: nested lengths of a key encoding that fill it exactly, or
a token whose header names its algorithm. A key may be wrapped over lines or quoted strings, and its line ends may be escaped.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.words import sliced

KINDS = ("assign", "access", "hex", "signed_token", "private_key")
BASE_KINDS = KINDS[:3]
Span = tuple[str, int, int]


def _either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*(_either(w) for w in ("password", "passwd", "secret", "token")), f"{_either('api')}_?{_either('key')}"])
# fixed patterns; the text matched is the secret's place, the figure its least length
ASSIGN = re.compile(rf"({_NAMES})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 18
HEX = re.compile(r"[0-9a-f]{16,}")  # a run is matched whole, so shorter ones can be left out at once

# an opened brace, then a quote, a blank or a line end
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])e[yw][A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?)-----")
_ESCAPED_CODE = re.compile(r"\\+(?:u00|x)([0-7][0-9A-Fa-f])")
_ESCAPED_END = re.compile(r"\\+[nrt]")
_JOINT = re.compile(r"""["'`][\s\\]*[+.&,]?[\s\\]*["'`]?""")  # between the strings that a text is put together from
_LEAD = re.compile(r"^(?:[#*>;]+|//+(?=\s))")
_HEADER = re.compile(r"[A-Za-z][A-Za-z-]*:(?:\s|$)")
_BEGUN = re.compile(r"(?:M[A-P]|b3BlbnNzaC1rZXkt)[A-Za-z0-9+/_-]{14,}")  # how the encodings of a sequence and of _OPENSSH begin
_RUN = re.compile(r"[A-Za-z0-9+/_-]+")
_BETWEEN = re.compile(r"""(?:\\+(?:[nrt]|(?=/))|["'`]\s*[+.&,]\s*(?=["'`])|["'`,\s])+|\\\s+""")
_BASE64_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")
# the schemes by which a key is encrypted: PKCS #5 and #12
_ENCRYPTION = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
_HEX_ANY = re.compile(r"[0-9A-Fa-f]{64,}")
_HEX_BEGUN = re.compile(r"(?<![0-9A-Fa-f])30[0-9A-Fa-f]{14,}(?=[\x20\t\r]*(?:\n|\\n))")  # a sequence, on several lines
_HEX_LINE = re.compile(r"[\x20\t\r]*(?:\n|\\n)[\x20\t]*([0-9A-Fa-f]+)")
_PEM = "LS0tLS1CRUdJTi"  # how the encoding of a mark begins
_OPENSSH = b"openssh-key-v1\0"


def _decoded(text: str) -> bytes | None:
    """The bytes of a base64 text of either alphabet, with or without padding."""
    text = re.sub(r"\s", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _elements(data: bytes) -> list[tuple[int, bytes]] | None:
    """Tags and contents of the encoded elements that fill ``data`` exactly, or nothing."""
    out, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, length, at = data[at], data[at + 1], at + 2
        if length & 0x80:
            size = length & 0x7F
            if not 1 <= size <= 4 or at + size > len(data):
                return None
            length, at = int.from_bytes(data[at : at + size], "big"), at + size
        if at + length > len(data):
            return None
        out.append((tag, data[at : at + length]))
        at += length
    return out


def _is_der_key(data: bytes) -> bool:
    """A private key as a sequence of version and numbers, of algorithm and key, of an elliptic curve, or encrypted."""
    if len(data) < 32 or data[0] != 0x30:
        return False
    outer = _elements(data)
    if not outer or len(outer) != 1:
        return False
    inner = _elements(outer[0][1])
    if not inner or len(inner) < 2:
        return False
    if [tag for tag, _ in inner] == [0x30, 0x04]:
        scheme = _elements(inner[0][1])
        return bool(scheme) and scheme[0][0] == 0x06 and scheme[0][1].startswith(_ENCRYPTION) and len(inner[1][1]) >= 16
    if inner[0][0] != 0x02 or inner[0][1] not in (b"\0", b"\1"):
        return False
    tags = [tag for tag, _ in inner]
    if len(tags) >= 6 and set(tags) == {0x02}:
        return True
    if tags[1] == 0x04 and set(tags[2:]) <= {0xA0, 0xA1}:
        return 16 <= len(inner[1][1]) <= 66
    if len(tags) >= 3 and tags[1:3] == [0x30, 0x04]:
        algorithm = _elements(inner[1][1])
        return bool(algorithm) and algorithm[0][0] == 0x06
    return False


def _is_openssh_key(data: bytes) -> bool:
    """Three strings, a number of keys, then a public and a private part, each with its length, to the end."""
    if not data.startswith(_OPENSSH):
        return False
    at, parts = len(_OPENSSH), 0
    while at < len(data):
        if parts == 3:
            at += 4
        if at + 4 > len(data):
            return False
        at += 4 + int.from_bytes(data[at : at + 4], "big")
        parts += 1
    return at == len(data) and parts >= 5


def _is_key(data: bytes | None) -> bool:
    return data is not None and (_is_der_key(data) or _is_openssh_key(data))


def _is_pgp_key(data: bytes) -> bool:
    """Packets that fill the data exactly, the first of them a secret key of a known version."""
    at, first = 0, True
    while at < len(data):
        kind, at = data[at], at + 1
        if not kind & 0x80 or at >= len(data):
            return False
        if kind & 0x40:
            tag, size = kind & 0x3F, data[at]
            at += 1
            if size == 255:
                size, at = int.from_bytes(data[at : at + 4], "big"), at + 4
            elif size >= 224:
                return False
            elif size >= 192:
                if at >= len(data):
                    return False
                size, at = ((size - 192) << 8) + data[at] + 192, at + 1
        else:
            tag, width = (kind >> 2) & 0x0F, 1 << (kind & 3)
            size, at = (len(data) - at, at) if width == 8 else (int.from_bytes(data[at : at + width], "big"), at + width)
        if first and (tag not in (5, 7) or size < 8 or at >= len(data) or not 2 <= data[at] <= 6):
            return False
        first, at = False, at + size
    return at == len(data) and not first


def _is_armoured_key(label: str, body: str) -> bool:
    """Whether what stands between two marks is a key: header lines, and base64 lines whose ends may be escaped."""
    body = _ESCAPED_CODE.sub(lambda m: chr(int(m[1], 16)), body)
    body = _JOINT.sub("\n", _ESCAPED_END.sub("\n", body)).replace("\\", "")
    lines = [_LEAD.sub("", line.strip()).strip() for line in body.split("\n")]
    headers = [line for line in lines if _HEADER.match(line)]
    encoded = [line for line in lines if line and not _HEADER.match(line)]
    if label.endswith("BLOCK"):
        # the last line is a checksum
        data = _decoded("".join(line for line in encoded if not (line[0] == "=" and len(line) == 5)))
        return data is not None and _is_pgp_key(data)
    data = _decoded("".join(encoded))
    if any(line.startswith("DEK-Info:") for line in headers):
        # encrypted as a whole, in blocks of a cipher
        return data is not None and len(data) >= 32 and len(data) % 8 == 0
    return _is_key(data)


def _armoured(text: str) -> list[tuple[int, int]]:
    out, begun = [], None
    for m in _MARK.finditer(text):
        if m[1] == "BEGIN":
            begun = m
        elif begun and begun[2] == m[2] and _is_armoured_key(m[2], text[begun.end() : m.start()]):
            out.append((begun.start(), m.end()))
            begun = None
    return out


def _gathered(text: str, at: int, size: int) -> tuple[bytes, int, bool] | None:
    """The ``size`` bytes whose base64 begins at ``at``, over line ends; where it ends, and whether a run ends there too."""
    left, parts = (4 * size + 2) // 3, []
    while True:
        run = _RUN.match(text, at)
        if not run:
            return None
        parts.append(run[0][:left])
        if len(run[0]) >= left:
            data = _decoded("".join(parts))
            return None if data is None else (data, at + left, len(run[0]) == left)
        left -= len(run[0])
        between = _BETWEEN.match(text, run.end())
        if not between:
            return None
        at = between.end()


def _whole(text: str, at: int) -> tuple[bytes, int] | None:
    """The bytes of what may be a key that begins at ``at``, as long as it says itself, and where it ends."""
    if text[at] == "M":
        head = _gathered(text, at, 6)
        width = head[0][1] & 0x7F if head and head[0][1] & 0x80 else 0
        if not head or width > 4:
            return None
        size = 2 + width + (int.from_bytes(head[0][2 : 2 + width], "big") if width else head[0][1])
    else:
        size = len(_OPENSSH)
        parts, most = 0, 4
        while parts <= most:
            # after three strings stands the number of keys
            head = _gathered(text, at, size + 4)
            if not head or not head[0].startswith(_OPENSSH):
                return None
            value = int.from_bytes(head[0][size : size + 4], "big")
            size += 4 if parts == 3 else 4 + value
            most = 4 + value if parts == 3 else most
            parts += 1
    found = _gathered(text, at, size) if size >= 32 else None
    if not found or not found[2]:
        return None
    end = found[1]
    return found[0], end + len(text[end : end + 2]) - len(text[end : end + 2].lstrip("="))


def _inside(text: str, at: int) -> bool:
    """Whether a run of base64 goes on at ``at``; the letter of an escape and the end of a mark begin no run."""
    if not at or text[at - 1] not in _BASE64_BYTES:
        return False
    return not (at > 1 and text[at - 2] == "\\" and text[at - 1] in "nrt" or text.endswith("-----", 0, at))


def _bare(text: str) -> list[tuple[int, int]]:
    """Places of keys in base64 without marks, on one line or wrapped."""
    out, upto = [], 0
    for m in _BEGUN.finditer(text):
        at = m.start()
        if at < upto or _inside(text, at):
            continue
        found = _whole(text, at)
        if found and _is_key(found[0]):
            upto = found[1]
            out.append((at, upto))
    return out


def _encoded_blocks(text: str) -> list[tuple[int, int]]:
    """Places of armoured keys that were encoded once more as a whole, on one line or wrapped."""
    out, at = [], text.find(_PEM)
    while at >= 0:
        runs, then = [], at
        while (run := _RUN.match(text, then)) and not (runs and run[0].startswith(_PEM)):
            runs.append(run)
            between = _BETWEEN.match(text, run.end())
            if not between:
                break
            then = between.end()
        encoded = "".join(run[0] for run in runs)
        block = (_decoded(encoded[: len(encoded) - (len(encoded) % 4 == 1)]) or b"").decode("latin-1")
        upto = at + 1
        if not _inside(text, at) and (keys := _armoured(block)):
            end = keys[-1][1]
            end += len(block[end : end + 2]) - len(block[end : end + 2].lstrip("\r\n"))
            left = -(-4 * end // 3)
            for run in runs:
                upto = run.start() + min(left, len(run[0]))
                left -= len(run[0])
                if left <= 0:
                    break
            upto += len(text[upto : upto + 2]) - len(text[upto : upto + 2].lstrip("="))
            out.append((at, upto))
        at = text.find(_PEM, upto)
    return out


def _hex_lines(text: str) -> list[tuple[int, int]]:
    """Places of keys in hex over several lines, as long as they say themselves."""
    out, upto = [], 0
    for m in _HEX_BEGUN.finditer(text):
        if m.start() < upto:
            continue
        head = bytes.fromhex(m[0][:12])
        width = head[1] & 0x7F if head[1] & 0x80 else 0
        if width > 4:
            continue
        left = 2 * (2 + width + (int.from_bytes(head[2 : 2 + width], "big") if width else head[1]))
        parts, part, start = [], m[0], m.start()
        if left > len(text) - start:
            continue
        while True:
            parts.append(part[:left])
            left -= len(parts[-1])
            end = start + len(parts[-1])
            line = _HEX_LINE.match(text, end) if left else None
            if not line:
                break
            part, start = line[1], line.start(1)
        # a key ends where its line does
        if not left and len(parts[-1]) == len(part) and _is_key(bytes.fromhex("".join(parts))):
            out.append((m.start(), end))
            upto = end
    return out


def _is_token(text: str) -> bool:
    """Whether header and payload are JSON objects and the header names an algorithm."""
    header, payload, _ = text.split(".")
    try:
        first, second = (json.loads(_decoded(x) or b"") for x in (header, payload))
    except (ValueError, RecursionError):
        return False
    return isinstance(first, dict) and isinstance(first.get("alg"), str) and isinstance(second, dict)


def base_spans(text: str) -> list[Span]:
    """The spans of the plain patterns: leftmost and not overlapping within a kind, matches too short left out."""
    found = [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    return found + [("hex", m.start(), m.end()) for m in HEX.finditer(text)]


def confirmed_spans(text: str) -> list[Span]:
    """The spans of candidates whose decoded bytes parse as a signed token or a private key."""
    keys: list[tuple[int, int]] = []
    found = [("signed_token", m.start(), m.end()) for m in _TOKEN.finditer(text) if _is_token(m[0])]
    if "PRIVATE KEY" in text:
        keys = _armoured(text)
    keys += _encoded_blocks(text) + _bare(text) + _hex_lines(text)
    keys += [m.span() for m in _HEX_ANY.finditer(text) if not len(m[0]) % 2 and _is_key(bytes.fromhex(m[0]))]
    taken: list[Span] = []
    for begin, upto in keys:
        if not any(start < upto and begin < end for _, start, end in taken):
            taken.append(("private_key", begin, upto))
    return found + taken


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def found(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of the plain kinds, a digest of their spans and all ``spans``, for every row of ``docs``.

    Spans are in code points, by start and then kind. Null text is empty; a text without secrets has the digest of the empty
    string and no spans. Null ids and repeated rows stay rows of their own. Other columns are not read.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            rows: list[list] = [[] for _ in range(5)]
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = in_order(base_spans(text))
                kinds = [s[0] for s in base]
                values = [kinds.count(k) for k in BASE_KINDS]
                values += [hashlib.sha256(joined(base).encode()).hexdigest(), joined(in_order(base + confirmed_spans(text)))]
                for column, value in zip(rows, values, strict=True):
                    column.append(value)
            arrays = [pa.array(r, pa.int64() if i < 3 else pa.string()) for i, r in enumerate(rows)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *arrays], ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, FOUND)


def redacted_text(text: str) -> str:
    """The text with each stretch of secrets replaced by the kind of its first span in angle brackets."""
    out, upto, shown = [], 0, 0
    for kind, start, end in in_order(base_spans(text) + confirmed_spans(text)):
        if start >= upto:
            out += [text[shown:start], f"<{kind}>"]
        upto = max(upto, end)
        shown = upto
    return "".join(out) + text[shown:]


def redacted(docs: DataFrame) -> DataFrame:
    """All rows and columns of ``docs``, without the secrets in ``text``; ``n_chars`` of changed texts follows the new text.

    Null text stays null; texts without secrets stay as they are.
    """
    schema = docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            old = batch.column("text").to_pylist()
            new = [x and redacted_text(x) for x in old]
            out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(new, batch.schema.field("text").type))
            at = batch.schema.get_field_index("n_chars")
            if at >= 0:
                sizes = [n if a == b else len(b) for n, a, b in zip(batch.column(at).to_pylist(), old, new, strict=True)]
                out = out.set_column(at, "n_chars", pa.array(sizes, batch.schema.field(at).type))
            yield out

    return docs.mapInArrow(scan, schema)
