"""Secret scan with structural confirmation.

Three pattern kinds are reported as they match: assignments, access-key ids and hex
runs.  Beyond them, base64 and hex candidates are decoded and reported only when what
they hold parses as a secret: DER key encodings whose nested lengths fill their
parents exactly, OpenSSH key files whose length-prefixed fields end where the data
ends, PEM blocks around either, and signed tokens whose header and payload are JSON
objects and whose signature has the length that the header's algorithm gives.
A decoded text is looked into again, up to ``DEPTH`` layers.

Each text is scanned whole and on its own (no shuffle).  NULL text counts as empty;
repeated rows repeat; spans are in code points, end exclusive.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import text_or_empty

#: Kinds in the order in which spans that start together are listed.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem", "token", "key")
DEPTH = 3

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # runs are maximal, so shorter ones need not be matched first

PEM_LINE = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*PRIVATE KEY)-----")
PEM_BODY = re.compile(r"^(?:[ \t]*[A-Za-z-]+:[^\n]*\n)*\s*([A-Za-z0-9+/=\s\\nr]+)$")
SEGMENT = re.compile(r"[A-Za-z0-9_-]+")
TAIL = re.compile(r"\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]*")
# Base64 of a brace and what may follow it in JSON: a quote, a blank, a line break, a tab.
OBJECT = re.compile(r"e(?:y[JA]|w[o0k])")
# Where a key may begin behind a border: a DER sequence or an OpenSSH key.
KEY_START = re.compile(r"(?<=[-_/+])(?:M|b3Blbn)")
BASE64 = re.compile(r"[A-Za-z0-9+/_-]{24,}={0,2}")
ANY_HEX = re.compile(r"[0-9A-Fa-f]{48,}")

# Signature bytes of the registered token algorithms (None: at least 128).
SIGNATURE_BYTES = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64,
                   "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None}


def decode_base64(run: str) -> bytes | None:
    """Bytes of a base64 or base64url run, with or without padding; None if it isn't one."""
    run = run.rstrip("=")
    if len(run) % 4 == 1 or ("-" in run or "_" in run) and ("+" in run or "/" in run):
        return None
    try:
        return base64.b64decode(run.replace("-", "+").replace("_", "/") + "=" * (-len(run) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def decode_hex(run: str) -> bytes | None:
    return bytes.fromhex(run) if len(run) % 2 == 0 else None


def der_items(data: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of DER values that fill ``data`` exactly, or None."""
    items, at = [], 0
    while at < len(data):
        if at + 2 > len(data):
            return None
        tag, size = data[at], data[at + 1]
        at += 2
        if size >= 0x80:
            count = size & 0x7F
            if not 1 <= count <= 4 or at + count > len(data):
                return None
            size = int.from_bytes(data[at: at + count], "big")
            if size < 0x80 or data[at] == 0:  # DER lengths are as short as they can be
                return None
            at += count
        if at + size > len(data):
            return None
        items.append((tag, data[at: at + size]))
        at += size
    return items


def der_key(data: bytes) -> str | None:
    """Kind of private key that a DER encoding holds, by its nested structure."""
    outer = der_items(data) if data[:1] == b"\x30" else None
    if not outer or len(outer) != 1:
        return None
    items = der_items(outer[0][1])
    if not items:
        return None
    tags = [t for t, _ in items]
    if tags[:9] == [2] * 9 and items[0][1] in (b"\0", b"\1"):
        return "rsa"
    if tags[:6] == [2] * 6 and len(tags) == 6 and items[0][1] == b"\0":
        return "dsa"
    if tags[:3] == [2, 0x30, 4] and items[0][1] in (b"\0", b"\1") and set(tags[3:]) <= {0xA0, 0x81, 0xA1}:
        algorithm = der_items(items[1][1])
        return "pkcs8" if algorithm and algorithm[0][0] == 6 and items[2][1] else None
    if tags[:2] == [2, 4] and items[0][1] == b"\1" and len(items[1][1]) >= 16 and set(tags[2:]) <= {0xA0, 0xA1}:
        return "ec"
    if tags == [0x30, 4]:
        algorithm = der_items(items[0][1])
        return "pkcs8-encrypted" if algorithm and algorithm[0][0] == 6 and len(items[1][1]) >= 16 else None
    return None


def openssh_key(data: bytes) -> str | None:
    """'openssh' if the length-prefixed fields of an OpenSSH private key fill ``data``."""
    magic = b"openssh-key-v1\0"
    if not data.startswith(magic):
        return None
    at, fields = len(magic), []

    def field() -> bytes | None:
        nonlocal at
        size = int.from_bytes(data[at: at + 4], "big")
        if at + 4 + size > len(data):
            return None
        at += 4 + size
        return data[at - size: at]

    for _ in range(3):
        fields.append(field())
    count = int.from_bytes(data[at: at + 4], "big")
    at += 4
    if None in fields or not 1 <= count <= 16:
        return None
    fields += [field() for _ in range(count + 1)]
    return "openssh" if None not in fields and fields[-1] and not data[at:].strip(b"\0") else None


def signed_token(run: str) -> str | None:
    """Algorithm of a signed token, or None if its parts don't hold together."""
    head, body, signature = (decode_base64(p) if p else b"" for p in run.split("."))
    if not head or not body or not signature:
        return None
    try:
        header, payload = json.loads(head), json.loads(body)
    except (ValueError, RecursionError):
        return None
    if not isinstance(header, dict) or not isinstance(payload, dict):
        return None
    algorithm = header.get("alg")
    if not isinstance(algorithm, str) or algorithm not in SIGNATURE_BYTES:
        return None
    size = SIGNATURE_BYTES[algorithm]
    return algorithm if (len(signature) == size if size else len(signature) >= 128) else None


def may_be_object(text: str, start: int, end: int) -> bool:
    """False where the base64 from start to end cannot be a JSON object; looks at a bounded part."""
    if (end - start) % 4 == 1:
        return False
    part = decode_base64(text[start:min(end, start + 400)])
    if part is None or end - start <= 400:
        return part is not None
    try:
        json.loads(part.decode("utf-8", "ignore"))
    except json.JSONDecodeError as e:
        return e.pos >= 290 or e.msg.startswith("Unterminated")  # cut off, not wrong
    except RecursionError:
        return False
    return False


def pem_key(label: str, body: str) -> str | None:
    """Kind of key in a PEM block; encrypted traditional blocks by their headers."""
    m = PEM_BODY.match(body.replace("\\n", "\n").replace("\\r", "").strip() + "\n")
    data = decode_base64("".join(m[1].split())) if m else None
    if not data:
        return None
    if "ENCRYPTED" in body and "DEK-Info:" in body:
        return f"{label.lower()} encrypted" if len(data) % 8 == 0 else None
    return der_key(data) or openssh_key(data)


def confirm(data: bytes | None, depth: int = DEPTH) -> str | None:
    """What secret the decoded bytes hold, if any."""
    if not data or depth <= 0:
        return None
    found = der_key(data) or openssh_key(data)
    if found:
        return found
    try:
        inner = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    for _, _, kind, detail in confirmed(inner, depth - 1):
        return f"{kind} {detail}"
    return None


class Spans:
    """Spans that don't overlap, in order."""

    def __init__(self):
        self.starts: list[int] = []
        self.spans: list[tuple[int, int, str, str]] = []

    def free(self, start: int, end: int) -> bool:
        at = bisect_left(self.starts, end)  # the last span that starts before the end
        return at == 0 or self.spans[at - 1][1] <= start

    def add(self, *span) -> None:
        at = bisect_left(self.starts, span[0])
        self.starts.insert(at, span[0])
        self.spans.insert(at, span)


def _pem_blocks(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(start, end, label, body): every foot with the nearest head before it of the same label."""
    heads: dict[str, re.Match] = {}
    for m in PEM_LINE.finditer(text):
        if m[1] == "BEGIN":
            heads[m[2]] = m
        elif head := heads.pop(m[2], None):
            yield head.start(), m.end(), m[2], text[head.end():m.start()]


def confirmed(text: str, depth: int = DEPTH) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, detail) of structurally confirmed secrets, none inside another.

    A token or key may be glued to what stands before it: a token is tried from every place where a JSON
    object can begin, a key also behind every border inside its run.
    """
    held = Spans()
    if "-----BEGIN" in text:
        for start, end, label, body in _pem_blocks(text):
            if held.free(start, end) and (detail := pem_key(label, body)):
                held.add(start, end, "pem", detail)
    end, tail = -1, None
    for o in OBJECT.finditer(text) if "." in text else ():
        if o.start() >= end:    # the first candidate of a segment: where it ends, and what follows
            end = SEGMENT.match(text, o.start()).end()
            tail = TAIL.match(text, end)
        if tail and end - o.start() >= 10 and may_be_object(text, o.start(), end) and held.free(o.start(), tail.end()) and (
                detail := signed_token(text[o.start():tail.end()])):
            held.add(o.start(), tail.end(), "token", detail)
    for pattern, decode in ((BASE64, decode_base64), (ANY_HEX, decode_hex)):
        for m in pattern.finditer(text):
            if not held.free(m.start(), m.end()):
                continue
            if detail := confirm(decode(m[0]), depth):
                held.add(m.start(), m.end(), "key", detail)
            elif pattern is BASE64:
                for k in KEY_START.finditer(text, m.start(), m.end() - 23):
                    if detail := confirm(decode_base64(text[k.start():m.end()]), depth):
                        held.add(k.start(), m.end(), "key", detail)
                        break
    return held.spans


def scan(text: str) -> list[tuple[int, int, str, str]]:
    """All spans of a text: base kinds as matched, then confirmed ones."""
    out = []
    if ":" in text or "=" in text:  # an assignment holds one of them
        out += [(m.start(), m.end(), "assign", m[1].lower()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), m.end(), "access", "") for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    out += [(m.start(), m.end(), "hex", "") for m in HEX.finditer(text)]
    out += confirmed(text)
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


SPANS = "array<struct<kind:string,start:int,end:int,detail:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("detail", pa.string())]))


def _spans(texts: pa.Array) -> pa.Array:
    return pa.array([[{"kind": k, "start": a, "end": b, "detail": d} for a, b, k, d in scan(t.as_py())]
                     for t in texts], _ARROW)


def find_secrets(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, spans (kind, start, end, detail) of every row; an empty array where nothing is found."""
    return docs.select(key, F.arrow_udf(_spans, SPANS)(text_or_empty(text)).alias("spans"))


def joined(spans: Column) -> Column:
    """'kind:start:end' of each span, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def digests(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the digest of base spans, and all spans as text."""
    def of(*kinds):
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    return found.select(
        key, *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(joined(of(*BASE_KINDS)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        F.size(of(*KINDS[3:])).cast("long").alias("n_confirmed"))
