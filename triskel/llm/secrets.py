"""Secret scans with structural confirmation.

Fixed patterns give the base findings. On top of them come strings that *are* keys by
their structure: base64 or hex runs are decoded and reported only if the bytes parse as
a key encoding (nested DER lengths that add up, an OpenSSH container, a PEM block around
either, its line breaks also written as \\n, or with headers around whole cipher blocks) or if the first part of a dotted token is a JSON header that names an algorithm.

Defined results: a null or empty text has no finding; positions are code points, end
exclusive; rows, also repeated ones, are scanned one by one; other columns pass through
untouched whatever their names.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triskel.llm.text import slices

# The base patterns and their least lengths.
BASE = (
    ("assign", re.compile(r"((?ai:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")),
    ("access", re.compile(r"AKIA[A-Z0-9]+")),
    ("hex", re.compile(r"[0-9a-f]+")),
)
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "private_key", "public_key", "signed_token")
MASK = "[SECRET]"

# A text without a match of these cannot have a finding of that kind. They run in linear
# time over a whole Arrow column and spare most texts the slower scan for positions.
_NEEDS = {
    "assign": r"(?i)password|passwd|secret|token|api_?key",
    "access": "AKIA",
    "hex": r"[0-9a-f]{24}",
    "pem": "-----BEGIN ",
    "token": r"[A-Za-z0-9_-]{16}\.[A-Za-z0-9_-]{2}",
    "run": r"[A-Za-z0-9+/]{48}|[A-Za-z0-9_-]{48}|[0-9A-Fa-f]{64}",
}
# A body may hold '-' (in headers), but no other BEGIN or END.
_PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40}KEY)-----((?:[^-]++|-(?!----(?:BEGIN|END) ))*+)-----END \1-----")
_ESCAPED_BREAK = re.compile(r"\\+[rn]")
_PEM_HEADER = re.compile(r"(?m)^[ \t]*[A-Za-z-]+:.*$")
# Password-based encryption: the arcs of PKCS #5 and PKCS #12.
_ENCRYPTIONS = (b"\x2a\x86\x48\x86\xf7\x0d\x01\x05", b"\x2a\x86\x48\x86\xf7\x0d\x01\x0c\x01")
_TOKEN = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{16,}+)\.([A-Za-z0-9_-]{2,}+)\.([A-Za-z0-9_-]*+)(?![A-Za-z0-9_-])")
_RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{48,}+={0,2}")
_HEX = re.compile(r"(?<![0-9A-Fa-f])[0-9A-Fa-f]{64,}+")


def _decode64(text: str) -> bytes | None:
    text = re.sub(r"\s+", "", text).rstrip("=").replace("-", "+").replace("_", "/")
    if len(text) % 4 == 1:
        return None
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def _header(data: bytes, at: int) -> tuple[int, int, int] | None:
    """Tag, start and end of the DER element at ``at``, if its length fits."""
    if at + 2 > len(data):
        return None
    tag, size, start = data[at], data[at + 1], at + 2
    if size >= 0x80:
        n = size & 0x7F
        if not 1 <= n <= 4 or start + n > len(data):
            return None
        size, start = int.from_bytes(data[start : start + n], "big"), start + n
    return (tag, start, start + size) if start + size <= len(data) else None


def _children(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """The elements that fill ``start:end`` exactly, or None."""
    out = []
    while start < end:
        element = _header(data, start)
        if element is None or element[2] > end:
            return None
        out.append(element)
        start = element[2]
    return out


def _der_key(data: bytes) -> str | None:
    outer = _header(data, 0)
    if outer is None or outer[0] != 0x30 or outer[2] != len(data):
        return None
    inner = _children(data, outer[1], outer[2])
    if not inner:
        return None
    tags = [t for t, _, _ in inner]
    if tags[0] == 0x02 and inner[0][2] - inner[0][1] == 1 and data[inner[0][1]] <= 1:
        if len(tags) >= 9 and all(t == 0x02 for t in tags[:9]):
            return "private_key"  # version, modulus, exponents, primes
        if len(tags) in (5, 6) and all(t == 0x02 for t in tags):
            return "private_key"  # version, p, q, g, public, private
        if len(tags) >= 2 and tags[1] == 0x04 and data[inner[0][1]] == 1 and inner[1][2] - inner[1][1] >= 16:
            return "private_key"  # elliptic curve
        if len(tags) >= 3 and tags[1] == 0x30 and tags[2] == 0x04:
            algorithm = _children(data, inner[1][1], inner[1][2])
            return "private_key" if algorithm and algorithm[0][0] == 0x06 else None
    if tags == [0x30, 0x03]:
        algorithm = _children(data, inner[0][1], inner[0][2])
        return "public_key" if algorithm and algorithm[0][0] == 0x06 else None
    if tags == [0x30, 0x04]:
        algorithm = _children(data, inner[0][1], inner[0][2])
        known = algorithm and algorithm[0][0] == 0x06 and data[algorithm[0][1] : algorithm[0][2]].startswith(_ENCRYPTIONS)
        return "private_key" if known else None  # encrypted PKCS #8; a digest has the same form
    return None


def _ssh_strings(data: bytes, at: int, count: int) -> list[bytes] | None:
    """The next ``count`` length-prefixed strings, or None if a length does not fit."""
    out = []
    for _ in range(count):
        if at + 4 > len(data):
            return None
        size = int.from_bytes(data[at : at + 4], "big")
        at += 4
        if at + size > len(data):
            return None
        out.append(data[at : at + size])
        at += size
    return out


def key_kind(data: bytes) -> str | None:
    """The kind of key that ``data`` encodes, or None."""
    magic = b"openssh-key-v1\x00"
    if data.startswith(magic):
        return "private_key" if _ssh_strings(data, len(magic), 3) is not None else None
    if data[:3] == b"\x00\x00\x00":
        parts = _ssh_strings(data, 0, 2)
        known = parts and re.fullmatch(rb"(ssh|ecdsa|sk-ssh)-[a-z0-9@.-]+", parts[0])
        return "public_key" if known else None
    return _der_key(data)


def _is_signed_token(first: str, second: str) -> bool:
    header, payload = _decode64(first), _decode64(second)
    if header is None or payload is None or header[:1] != b"{":
        return False
    try:
        parsed = json.loads(header)
    except (ValueError, RecursionError):
        return False
    return isinstance(parsed, dict) and isinstance(parsed.get("alg"), str)


def base_findings(text: str, needs: dict[str, bool] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the base patterns."""
    out = []
    for kind, pattern in BASE:
        if needs is None or needs[kind]:
            group = 2 if kind == "assign" else 0
            out += [(*m.span(), kind) for m in pattern.finditer(text) if len(m[group]) >= LEAST[kind]]
    return out


def confirmed_findings(text: str, needs: dict[str, bool] | None = None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of what parses as a key or a signed token."""
    out = []
    if needs is None or needs["pem"]:
        for m in _PEM.finditer(text):
            whole = re.sub(r"\\+/", "/", _ESCAPED_BREAK.sub("\n", m[2]))  # as in JSON and .env files
            body = _PEM_HEADER.sub("", whole)
            data = _decode64(body)
            kind = key_kind(data) if data else None
            if kind is None and data and "PRIVATE" in m[1] and whole != body and len(data) % 8 == 0:
                kind = "private_key"  # encrypted: headers, then whole cipher blocks
            if kind:
                out.append((*m.span(), kind))
    if needs is None or needs["token"]:
        out += [(*m.span(), "signed_token") for m in _TOKEN.finditer(text) if _is_signed_token(m[1], m[2])]
    if needs is None or needs["run"]:
        for pattern, decode in ((_RUN, _decode64), (_HEX, lambda t: bytes.fromhex(t) if len(t) % 2 == 0 else None)):
            for m in pattern.finditer(text):
                data = decode(m[0])
                kind = key_kind(data) if data else None
                if kind:
                    out.append((*m.span(), kind))
    return out


def _sorted(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    return sorted(set(found), key=lambda f: (f[0], KINDS.index(f[2]), f[1]))


def findings(text: str | None) -> list[tuple[int, int, str]]:
    """All findings of one text, by start, then kind."""
    return _sorted(base_findings(text) + confirmed_findings(text)) if text else []


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _column_findings(texts: pa.Array) -> list[list[tuple[int, int, str]]]:
    texts = pc.fill_null(texts, "")
    needs = {k: pc.match_substring_regex(texts, p).to_numpy(zero_copy_only=False) for k, p in _NEEDS.items()}
    out: list[list[tuple[int, int, str]]] = [[]] * len(texts)
    some = sum(needs.values())
    for i in some.nonzero()[0]:
        own, text = {k: bool(v[i]) for k, v in needs.items()}, texts[i].as_py()
        out[i] = _sorted(base_findings(text, own) + confirmed_findings(text, own))
    return out


def scan_secrets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col`` and ``findings`` (array of kind, start, end) of every row, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                found = _column_findings(part.column("text"))
                spans = [[{"kind": k, "start": s, "end": e} for s, e, k in f] for f in found]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(spans, SPANS)], ["id", "findings"])

    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, findings array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def _masked(text: str, found: list[tuple[int, int, str]]) -> str:
    parts, at = [], 0
    for start, end, _ in found:
        if start >= at:
            parts += [text[at:start], MASK]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def mask_secrets(df: DataFrame, text_col: str, length_col: str | None = None) -> DataFrame:
    """All columns of ``df``, with each finding (overlapping ones as one) replaced by a mark.

    A null text stays null. ``length_col``, if named, gets the new number of code points.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text_col):
                texts = part.column(text_col)
                found = _column_findings(texts)
                if any(found):
                    new = [_masked(t, f) if f else t for t, f in zip(texts.to_pylist(), found, strict=True)]
                    part = part.set_column(part.schema.get_field_index(text_col), part.schema.field(text_col), pa.array(new, texts.type))
                yield part

    out = df.mapInArrow(run, df.schema)
    return out.withColumn(length_col, F.char_length(text_col).cast(df.schema[length_col].dataType)) if length_col else out
