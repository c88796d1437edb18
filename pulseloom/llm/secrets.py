"""Secret scans: patterns give candidates; base64 and hex candidates are reported once their structure is confirmed.

Confirmed structures: signed tokens (a JSON header that names an algorithm, a JSON payload, a signature of the
algorithm's size), DER keys (nested tag-length-value that fills its parent exactly, in the shape of a key),
OpenSSH wire keys (length-prefixed fields that begin with a known algorithm) and PEM armour around either.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulseloom.llm.common import byte_slices, small_batches, tidy

SLICE = 8 << 20
#: Kinds in the order in which spans of one start are listed.
KINDS = ("assign", "access", "hex", "jwt", "pem", "key_b64", "key_hex")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_NAMES = re.compile(r"passw|secret|token|api_?key", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
#: What a brace and a quote, blank, tab or line break encode to; runs of three parts or more with dots between them.
_BRACE = re.compile(r"ey[JA]|ew[k0o]")
_DOTTED = re.compile(r"(?<![A-Za-z0-9_-])[A-Za-z0-9_-]++(?:\.[A-Za-z0-9_-]*+){2,}+")
#: Marks of PEM armour, what may stand between them, and the header of an encrypted key with its initialisation vector.
_MARK = re.compile(r"-----(BEGIN|END) ([A-Z0-9 ]*KEY)-----")
_INSIDE = re.compile(r"[A-Za-z0-9+/=\s:,-]*+")
_DEK = re.compile(r"DEK-Info:[ \t]*(?:DES-CBC|DES-EDE3-CBC|AES-(?:128|192|256)-CBC),([0-9A-Fa-f]{16}|[0-9A-Fa-f]{32})\s")
#: Letters of base64, over line breaks; what a DER sequence, an OpenSSH field of 7 to 43 bytes and the OpenSSH magic begin with.
_B64 = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*\r?\n[ \t]*[A-Za-z0-9+/_-]+)*={0,2}")
_BREAK = re.compile(r"[ \t]*\r?\n[ \t]*")
_START64 = re.compile(r"M[A-I]|(?=AAAA[B-K])|b3BlbnNz")
_ANYHEX = re.compile(r"[0-9A-Fa-f]{48,}")
_START_HEX = re.compile(r"(?=30[0-8]|000000[0-2]|6[fF]70656[eE])")
#: OpenSSH key algorithms; sizes in bytes of signatures of signed tokens (None: any that is not empty).
_SSH = (b"ssh-rsa", b"ssh-dss", b"ssh-ed25519", b"ecdsa-sha2-nistp256", b"ecdsa-sha2-nistp384", b"ecdsa-sha2-nistp521", b"sk-ssh-ed25519@openssh.com", b"sk-ecdsa-sha2-nistp256@openssh.com")
_SIGNED = {"HS256": 32, "HS384": 48, "HS512": 64, "ES256": 64, "ES384": 96, "ES512": 132, "EdDSA": 64, "RS256": None, "RS384": None, "RS512": None, "PS256": None, "PS384": None, "PS512": None}
_OPENSSH = b"openssh-key-v1\x00"
#: Tags of the values that a DER key consists of (fixed values); the most that one has (RSA: 9, and other primes or attributes).
_INNER, MOST_PARTS = frozenset((0x02, 0x03, 0x04, 0x30, 0x31, 0xA0, 0xA1)), 64
#: Fields of the wire form of each algorithm's public key.
_FIELDS = dict(zip(_SSH, (3, 5, 2, 3, 3, 3, 3, 4)))


def _decode64(text: str) -> bytes | None:
    text = text.rstrip("=").replace("-", "+").replace("_", "/")
    try:
        return base64.b64decode(text + "=" * (-len(text) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_values(raw: bytes) -> list[tuple[int, bytes]] | None:
    """(tag, content) of the values that fill ``raw`` exactly, or None. Definite lengths in their shortest form only."""
    out, at = [], 0
    while at < len(raw):
        if at + 2 > len(raw):
            return None
        tag, n = raw[at], raw[at + 1]
        at += 2
        if n & 0x80:
            size = n & 0x7F
            if not 1 <= size <= 4 or at + size > len(raw):
                return None
            n = int.from_bytes(raw[at : at + size], "big")
            if n < 0x80 or n >> 8 * (size - 1) == 0:
                return None
            at += size
        if at + n > len(raw):
            return None
        out.append((tag, raw[at : at + n]))
        at += n
    return out


def is_der_key(raw: bytes) -> bool:
    """A PKCS#1, SEC1 or DSA private key, a PKCS#8 key (plain or encrypted), or a public key with its algorithm."""
    outer = der_values(raw)
    if not outer or len(outer) != 1 or outer[0][0] != 0x30 or not (inner := der_values(outer[0][1])):
        return False
    tags = [t for t, _ in inner]
    whole = all(v for _, v in inner)
    if tags[0] == 0x02:
        if len(tags) >= 6 and set(tags) == {0x02}:
            return whole and len(inner[0][1]) == 1
        if tags[1:2] == [0x04]:
            return whole and inner[0][1] == b"\x01" and 16 <= len(inner[1][1]) <= 66
        if tags[1:3] == [0x30, 0x04]:
            return bool((names := der_values(inner[1][1])) and names[0][0] == 0x06 and inner[2][1])
        return tags == [0x02, 0x02] and len(inner[0][1]) >= 64 and 1 <= len(inner[1][1]) <= 8
    names = der_values(inner[0][1]) if tags[0] == 0x30 else None
    return bool(names and names[0][0] == 0x06 and names[0][1] and tags in ([0x30, 0x03], [0x30, 0x04]) and len(inner[1][1]) >= 16)


def _ssh_fields(raw: bytes) -> list[bytes] | None:
    out, at = [], 0
    while at < len(raw):
        n = int.from_bytes(raw[at : at + 4], "big")
        if at + 4 > len(raw) or at + 4 + n > len(raw):
            return None
        out.append(raw[at + 4 : at + 4 + n])
        at += 4 + n
    return out


def is_ssh_key(raw: bytes) -> bool:
    """An OpenSSH private key file's content or a public key's wire form."""
    if raw.startswith(_OPENSSH):
        at, fields = len(_OPENSSH), []
        for _ in range(3):
            n = int.from_bytes(raw[at : at + 4], "big")
            if at + 4 + n > len(raw):
                return False
            fields.append(raw[at + 4 : at + 4 + n])
            at += 4 + n
        return bool(fields[0]) and bool(fields[1]) and int.from_bytes(raw[at : at + 4], "big") >= 1
    fields = _ssh_fields(raw) if raw[:3] == b"\x00\x00\x00" else None
    return bool(fields and len(fields) >= 2 and fields[0] in _SSH)


def is_key(raw: bytes | None) -> bool:
    return bool(raw) and len(raw) >= 24 and (is_ssh_key(raw) or is_der_key(raw))


def _der_size(peek) -> int:
    """The bytes of the DER key that begins so, 0 if none does: the lengths of its parts, which are read alone, must add up to its own."""

    def head(at: int) -> tuple[int, int, int]:
        """(tag, where the content begins, where it ends) of the value at a byte."""
        raw = peek(at, 6)
        if len(raw) < 2:
            return 0, 0, 0
        n, begin = raw[1], at + 2
        if n & 0x80:
            begin += n & 0x7F
            n = int.from_bytes(raw[2 : begin - at], "big") if 3 <= begin - at <= 6 else 0
        return raw[0], begin, begin + n

    tag, at, size = head(0)
    parts = 0
    while 0 < at < size:
        tag, _, end = head(at)
        parts += 1
        if tag not in _INNER or parts > MOST_PARTS or not at < end <= size:
            return 0
        at = end
    return size if parts > 1 else 0


def _ssh_size(peek, limit: int) -> int:
    """The bytes of the OpenSSH key that begins so, 0 if there is none; of a private key that is cut short, all of the ``limit`` there are."""

    def after(at: int) -> int:
        raw = peek(at, 4)
        return at + 4 + int.from_bytes(raw, "big") if len(raw) == 4 else limit + 1

    if peek(0, len(_OPENSSH)) == _OPENSSH:
        at = len(_OPENSSH)
        for _ in range(3):
            at = after(at)
            if at > limit:
                return 0
        keys, at = int.from_bytes(peek(at, 4), "big"), at + 4
        for _ in range(keys + 1 if keys <= MOST_PARTS else 0):
            at = after(at)
            if at > limit:
                return limit
        return at if keys else 0
    at = after(0)
    fields = _FIELDS.get(peek(4, at - 4), 0) if 4 < at <= 64 else 0
    for _ in range(fields - 1):
        at = after(at)
        if at > limit:
            return 0
    return at if fields else 0


def _keys(code: str, starts, reader) -> list[tuple[int, int]]:
    """(start, end) of the keys in a run of letters of one code. What a key says of its size tells where it ends, and only keys whose
    lengths add up are decoded as a whole."""
    out, end = [], 0
    for a in starts:
        if a < end:
            continue
        peek, limit, letters = reader(code, a)
        head = peek(0, 12)
        size = _der_size(peek) if head[:1] == b"\x30" else _ssh_size(peek, limit) if head[4:7] in (b"ssh", b"ecd", b"sk-") or _OPENSSH.startswith(head) else 0
        if 24 <= size <= limit and is_key(peek(0, size)):
            end = min(len(code), a + letters(size))
            out.append((a, end))
    return out


def _reader64(code: str, a: int):
    """(bytes of a part, how many there are, letters of so many) of base64 from letter a on."""

    def peek(at: int, n: int) -> bytes:
        first = a + 4 * (at // 3)
        return (_decode64(code[first : a + 4 * -(-(at + n) // 3)]) or b"")[at % 3 : at % 3 + n]

    return peek, (len(code) - a) * 3 // 4, lambda n: -(-4 * n // 3)


def _reader_hex(code: str, a: int):
    def peek(at: int, n: int) -> bytes:
        part = code[a + 2 * at : a + 2 * (at + n)]
        return bytes.fromhex(part[: len(part) & ~1])

    return peek, (len(code) - a) // 2, lambda n: 2 * n


def _keys64(block: str) -> list[tuple[int, int]]:
    """(start, end) of the keys in base64 of a block that may be wrapped over lines."""
    joined = _BREAK.sub("", block) if "\n" in block else block
    code = joined.rstrip("=")
    found = _keys(code, (m.start() for m in _START64.finditer(code)), _reader64)
    if not found:
        return []
    place = [i for i in range(len(block)) if block[i] not in " \t\r\n"] if joined is not block else range(len(block))
    return [(place[a], len(block) if b == len(code) else place[b - 1] + 1) for a, b in found if b - a >= 40]


_JSON = json.JSONDecoder()


def _object(raw: bytes | None) -> dict | None:
    try:
        found = json.loads(raw or b"")
    except (ValueError, RecursionError):
        return None
    return found if isinstance(found, dict) else None


def _header(head: str) -> tuple[int, str] | None:
    """(letter at which it begins, algorithm) of a signed token's header that ends a run: the first place from which the rest is one object."""
    decoded: dict[int, tuple[int, str]] = {}
    for m in _BRACE.finditer(head):
        phase = (len(head) - m.start()) % 4
        if phase == 1:
            continue
        if phase not in decoded:  # starts of one phase share a decoding
            raw = _decode64(head[m.start() :])
            decoded[phase] = (m.start(), (raw or b"").decode("latin-1"))
        first, text = decoded[phase]
        at = (m.start() - first) // 4 * 3
        try:
            _, end = _JSON.raw_decode(text, at)
        except (ValueError, RecursionError):
            continue
        if end == len(text.rstrip()) and (found := _object(text[at:].encode("latin-1"))) and found.get("alg") in _SIGNED:
            return m.start(), found["alg"]
    return None


def signed_tokens(text: str) -> list[tuple[int, int]]:
    """(start, end) of signed tokens: a header that names an algorithm, a payload and a signature of the algorithm's size."""
    out = []
    for m in _DOTTED.finditer(text):
        parts, at, skip = m[0].split("."), m.start(), 0
        for i, (head, body, sign) in enumerate(zip(parts, parts[1:], parts[2:])):
            if i >= skip and body and sign and _BRACE.search(head) and (found := _header(head)) and _object(_decode64(body)) is not None:
                size, signature = _SIGNED[found[1]], _decode64(sign) or b""
                if size is None and len(signature) >= 64 or len(signature) == size:
                    out.append((at + found[0], at + len(head) + len(body) + len(sign) + 2))
                    skip = i + 3
            at += len(head) + 1
    return out


def armoured_keys(text: str) -> list[tuple[int, int]]:
    """(start, end) of PEM blocks that hold a key. An END mark closes the BEGIN mark right before it if both name the same kind."""
    out, opened = [], None
    for m in _MARK.finditer(text) if "-----BEGIN " in text else ():
        if m[1] == "END" and opened and opened[2] == m[2]:
            body = text[opened[1] : m.start()]
            raw = _decode64("".join("".join(x for x in body.split("\n") if ":" not in x).split()))
            iv = _DEK.search(body) if "ENCRYPTED" in body else None
            if raw and _INSIDE.fullmatch(body) and (is_key(raw) or iv and len(raw) % (len(iv[1]) // 2) == 0):
                out.append((opened[0], m.end()))
        opened = (m.start(), m.end(), m[2]) if m[1] == "BEGIN" else None
    return out


def find_secrets(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, end exclusive, sorted by start and then kind as listed in KINDS."""
    found = []
    if _NAMES.search(text):
        found += [(m.start(), m.end(), 0) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    found += [(m.start(), m.end(), 1) for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in _HEX.finditer(text)]
    found += [(a, b, 3) for a, b in signed_tokens(text)]
    armour = [(a, b, 4) for a, b in armoured_keys(text)]
    found += armour
    taken = lambda a, b: (i := bisect_right(armour, (a, len(text) + 1))) > 0 and b <= armour[i - 1][1]
    for m in _B64.finditer(text):
        found += [(m.start() + a, m.start() + b, 5) for a, b in _keys64(m[0]) if not taken(m.start() + a, m.start() + b)]
    for m in _ANYHEX.finditer(text):
        found += [(m.start() + a, m.start() + b, 6) for a, b in _keys(m[0], (x.start() for x in _START_HEX.finditer(m[0])), _reader_hex)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(found, key=lambda x: (x[0], x[2], x[1]))]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans array<struct<start, end, kind>>) of each row, in code points, by start and then kind.

    Null and empty texts have no spans; repeated rows and null ids each give a row; other columns are not
    read; an empty table gives an empty result. Spans of different kinds may overlap.
    """
    small_batches(docs.sparkSession)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))

    def run(batches):
        for batch in batches:
            texts = batch.column(1)
            for a, b in byte_slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), SLICE):
                spans = [[{"start": x, "end": y, "kind": k} for x, y, k in find_secrets(t or "")] for t in texts.slice(a, b - a).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, spans array<struct<start:long,end:long,kind:string>>")


def redact_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with each run of overlapping spans in ``text_col`` replaced by <kind> of its first span.

    Nulls stay null, all other columns come through as they are, an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def cut(text: str | None) -> str | None:
        if not text or not (spans := find_secrets(text)):
            return text
        out, end = [], 0
        for i, (a, b, kind) in enumerate(spans):
            if i and a < end:
                end = max(end, b)
                continue
            out += [text[end:a], f"<{kind}>"]
            end = b
        return "".join([*out, text[end:]])

    def run(batches):
        for batch in batches:
            texts = batch.column(at)
            for a, b in byte_slices(pa.compute.fill_null(pa.compute.binary_length(texts), 0).to_pylist(), SLICE):
                columns = batch.slice(a, b - a).columns
                columns[at] = pa.array([cut(t) for t in texts.slice(a, b - a).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(tidy(run), docs.withColumn(text_col, F.col(text_col).cast("string")).schema)
