"""Secrets in texts: plain patterns, and candidates confirmed by their structure.

Three patterns give spans as they match.  Beyond them a candidate is only
reported when it decodes to what it claims to be: an armored or bare base64 run,
or a hex run, whose bytes parse as a private key with lengths that nest and add
up (in DER: PKCS#8, PKCS#1, DSA or SEC1; or an OpenSSH key), and a dotted token
whose header is a JSON object that names an algorithm.  Signatures, certificates
and public keys are DER too, but have other parts and are not reported.

Rows: a null text is empty.  Spans are in code points, end exclusive, by start and
then by kind.  Patterns are found leftmost and non-overlapping per kind, whatever
other kinds find.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatelens.llm.common import with_struct

BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "token", "key")
FIELDS = "kinds array<string>, starts array<int>, ends array<int>"
MASK = "[secret]"


def _either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


_ASSIGN = re.compile(
    "(?:" + "|".join(map(_either_case, ("password", "passwd", "secret", "token")))
    + "|" + _either_case("api") + "_?" + _either_case("key") + r")[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+(?:\.[A-Za-z0-9_-]*)?")
_ARMOR = re.compile(r"-----BEGIN ([A-Z0-9 ]*PRIVATE KEY)-----([A-Za-z0-9+/=\s\\]+)-----END \1-----")
_BASE64 = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{40,}={0,2}")
_HEX_KEY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-fA-F]{2}){32,}(?![0-9A-Za-z])")
_OPENSSH = b"openssh-key-v1\0"
_SEAL = 16  # bytes that some ciphers add behind the private part
_DEPTH = 16
_INTEGER, _OCTETS, _OID, _SEQUENCE = 0x02, 0x04, 0x06, 0x30
#: Object identifiers of password-based encryption: PKCS#5 and PKCS#12.
_PASSWORD_BASED = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))


def _bytes_of(run: str) -> bytes | None:
    """A base64 run in either alphabet, with or without padding."""
    plain = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except binascii.Error:
        return None


def _der_end(data: bytes, at: int, stop: int, depth: int = 0) -> int | None:
    """Where the DER value at ``at`` ends, if its nested lengths all add up by ``stop``."""
    if depth > _DEPTH or at + 2 > stop:
        return None
    tag, size, at = data[at], data[at + 1], at + 2
    if size & 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or at + n > stop:
            return None
        size = int.from_bytes(data[at : at + n], "big")
        if size < 0x80 or data[at] == 0:  # not the shortest form
            return None
        at += n
    if at + size > stop:
        return None
    if tag & 0x20:
        inner = at
        while inner < at + size:
            inner = _der_end(data, inner, at + size, depth + 1)
            if inner is None:
                return None
    return at + size


def _content(data: bytes, at: int) -> int:
    """Where the content of the DER value at ``at`` begins."""
    return at + 2 + (data[at + 1] & 0x7F if data[at + 1] & 0x80 else 0)


def _parts(data: bytes, at: int, stop: int) -> list[tuple[int, bytes]]:
    """(tag, content) of the values that fill the bytes; their lengths are known to add up."""
    found = []
    while at < stop:
        end = _der_end(data, at, stop)
        found.append((data[at], data[_content(data, at) : end]))
        at = end
    return found


def is_der_key(data: bytes) -> bool:
    """A private key in DER over all the bytes: PKCS#8, also encrypted, PKCS#1, DSA or SEC1."""
    if len(data) < 24 or data[0] != _SEQUENCE or _der_end(data, 0, len(data)) != len(data):
        return False
    parts = _parts(data, _content(data, 0), len(data))
    tags, first = [tag for tag, _ in parts], parts[0][1]
    if tags == [_SEQUENCE, _OCTETS]:
        return _algorithm(first).startswith(_PASSWORD_BASED)
    if tags[:3] == [_INTEGER, _SEQUENCE, _OCTETS]:  # attributes and a public key may follow
        return first in (b"\0", b"\1") and bool(_algorithm(parts[1][1])) and set(tags[3:]) <= {0xA0, 0xA1, 0x81}
    if tags[:2] == [_INTEGER, _OCTETS]:  # a curve and a public key may follow
        return first == b"\1" and tags[2:] in ([], [0xA0], [0xA1], [0xA0, 0xA1])
    if first == b"\1":  # more than two primes, in a list behind
        return tags == [_INTEGER] * 9 + [_SEQUENCE]
    return first == b"\0" and tags in ([_INTEGER] * 9, [_INTEGER] * 6)


def _algorithm(content: bytes) -> bytes:
    """The object identifier that an algorithm begins with, or nothing."""
    parts = _parts(content, 0, len(content))
    return parts[0][1] if parts and parts[0][0] == _OID else b""


def is_openssh_key(data: bytes) -> bool:
    """The magic word, cipher, kdf and options, the public keys, and the private part, which ends the bytes."""
    if not data.startswith(_OPENSSH):
        return False
    at = len(_OPENSSH)
    number = lambda: int.from_bytes(data[at : at + 4], "big")
    for _ in range(3):
        at += 4 + number()
    keys, at = number(), at + 4
    if keys < 1 or 4 * keys > len(data):
        return False
    for _ in range(keys + 1):
        if at + 4 > len(data) or not number():
            return False
        at += 4 + number()
    return len(data) - at in (0, _SEAL)


def is_key(data: bytes | None) -> bool:
    return data is not None and (is_der_key(data) or is_openssh_key(data))


def is_signed_token(token: str) -> bool:
    """The first part is a JSON object with an algorithm, the second decodes too."""
    header, body = (_bytes_of(part) for part in token.split(".")[:2])
    if header is None or body is None:
        return False
    try:
        found = json.loads(header)
    except ValueError:  # also what is not UTF-8
        return False
    except RecursionError:
        return False
    return isinstance(found, dict) and isinstance(found.get("alg"), str)


def base_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """(start, rank of the kind, end) of the three patterns."""
    for m in _ASSIGN.finditer(text):
        if m.end(1) - m.start(1) >= 12:
            yield m.start(), 0, m.end()
    for m in _ACCESS.finditer(text):
        yield m.start(), 1, m.end()
    for m in _HEX.finditer(text):
        yield m.start(), 2, m.end()


def confirmed_spans(text: str) -> Iterator[tuple[int, int, int]]:
    """Signed tokens and keys whose structure holds."""
    for m in _TOKEN.finditer(text):
        if is_signed_token(m[0]):
            yield m.start(), 3, m.end()
    if "-----BEGIN " in text:
        for m in _ARMOR.finditer(text):
            body = re.sub(r"\s|\\[nr]", "", m[2])
            if is_key(_bytes_of(body)):
                yield m.start(), 4, m.end()
    for m in _BASE64.finditer(text):
        if is_key(_bytes_of(m[0])):
            yield m.start(), 4, m.end()
    for m in _HEX_KEY.finditer(text):
        if is_key(bytes.fromhex(m[0])):
            yield m.start(), 4, m.end()


def spans_of(text: str | None) -> list[tuple[int, int, int]]:
    """All spans of a text, in order and without repeats."""
    return sorted({*base_spans(text or ""), *confirmed_spans(text or "")})


def secrets(docs: DataFrame, result: str = "secrets") -> DataFrame:
    """All documents with a struct ``result``: kinds, starts and ends of the spans."""

    def run(batch: pa.RecordBatch) -> list:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        found = [spans_of(t) for t in texts]
        return [
            [[KINDS[k] for _, k, _ in own] for own in found],
            [[a for a, _, _ in own] for own in found],
            [[b for _, _, b in own] for own in found],
        ]

    return with_struct(docs, result, FIELDS, run)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str = MASK) -> str:
    """The text with every stretch covered by spans replaced by ``mask``."""
    parts, done, until = [], 0, 0
    for start, _, end in sorted(spans):
        if start >= until:
            parts += [text[done:start], mask]
        done = until = max(until, end)
    return "".join([*parts, text[done:]])


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """The same documents with secrets masked in ``text``; a null text stays null."""

    def run(batch: pa.RecordBatch) -> list:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        return [[None if t is None else masked(t, spans_of(t), mask) for t in texts]]

    clean = with_struct(docs, "__clean", "text string", run)
    return clean.withColumn("text", F.col("__clean.text")).select(*docs.columns)
