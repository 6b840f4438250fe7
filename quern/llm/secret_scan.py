"""Secret scans: three base patterns, and structural confirmation of encoded keys and signed tokens.

Base kinds, leftmost non-overlapping each: ``assign`` (a name such as password, a separator, a value of 6 characters or
more), ``access`` (AKIA identifiers of 20 or more), ``hex`` (runs of 24 or more). The method adds kinds that are
reported only after their bytes were decoded and their structure parsed to the end:

* ``jwt``: a signed token, three base64url parts, whose header is a JSON object with an algorithm and whose payload is JSON;
* ``der``: base64 (on one line or wrapped over several), PEM or hex data that are one ASN.1 sequence in which all nested
  lengths fit, down to the last element, and that reads as a private key: PKCS#1 (RSA), SEC1 (EC), DSA, PKCS#8 with one of
  these or a bare key inside its octets, or PKCS#8 encrypted by a password scheme;
* ``ssh``: the same for data with the OpenSSH key magic and nested length-prefixed strings that fit.

How long the data are, their own lengths tell; a candidate must end there, at the end of a line or run. Bodies, labels
and counts may be of any length.

Defined cases. A null text is empty: no spans, and the digest of the empty string. Spans are in code points of the
whole text, end exclusive. Repeated rows and ids are scanned row by row. Other columns of the caller, whatever their
names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import binascii
import hashlib
import json
import re
from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame

from ._common import map_text

#: The base patterns. Letters of the names match in either case.
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # [0-9a-f]+ of 24 or more: a run that long is always found whole
KINDS = ("assign", "access", "hex", "jwt", "der", "ssh")

NAMES = ("passw", "secret", "token", "api_key", "apikey")
JWT = re.compile(r"(?<![A-Za-z0-9_.-])([A-Za-z0-9_-]{8,})\.([A-Za-z0-9_-]{2,})\.([A-Za-z0-9_-]*)(?![A-Za-z0-9_.-])")
LINE_END = r"(?:[ \t]*(?:\r?\n|\\r\\n|\\n)[ \t]*)"
#: Base64 on one line or wrapped over several, and where in it a key can start: a SEQUENCE's first byte is M and A to P in
#: base64, the rest is OpenSSH's magic; "=", "-", an escaped line end and the like may stand before it.
RUN = re.compile(rf"[A-Za-z0-9+/_-]{{40,}}(?:{LINE_END}[A-Za-z0-9+/_-]+)*={{0,2}}")
START = re.compile(r"(?:(?<![A-Za-z0-9])|(?<=\\n))(?=M[A-P]|b3BlbnNzaC1rZXkt)")
NOT_DATA = re.compile(r"\\[nr]|[^A-Za-z0-9+/_-]+")
LONG_HEX = re.compile(r"(?<![0-9A-Fa-f])(?:[0-9A-Fa-f]{2}){30,}(?![0-9A-Fa-f])")
#: A body may have escaped line ends (in JSON) and, before its data, header lines such as Proc-Type and DEK-Info.
PEM = re.compile(r"-----BEGIN ([A-Z0-9 ]*+)-----((?:(?:\s|\\[nrt])*+[A-Za-z][A-Za-z0-9-]*+:(?:[^\n\\-]|\\[^nr]|-(?!----))*+)*+)((?:[A-Za-z0-9+/=\s]|\\[nrt/])++)-----END \1-----")
ESCAPES = re.compile(r"\\[nrt]|\s+")
SSH_MAGIC = b"openssh-key-v1\x00"


def from_base64(text: str) -> bytes | None:
    plain = text.rstrip("=").replace("-", "+").replace("_", "/")
    if len(plain) % 4 == 1:
        return None
    try:
        return base64.b64decode(plain + "=" * (-len(plain) % 4), validate=True)
    except (binascii.Error, ValueError):
        return None


def der_items(data: bytes, start: int, end: int) -> list[tuple[int, int, int]] | None:
    """(tag, start, end) of the elements that fill data[start:end] exactly; None where a length doesn't fit."""
    items = []
    while start < end:
        if end - start < 2:
            return None
        tag, n, at = data[start], data[start + 1], start + 2
        if n & 0x80:
            k = n & 0x7F
            if not 1 <= k <= 4 or end - at < k:
                return None
            n, at = int.from_bytes(data[at : at + k], "big"), at + k
            if n < 0x80:
                return None
        if n > end - at:
            return None
        items.append((tag, at, at + n))
        start = at + n
    return items


def well_formed(data: bytes, items: list[tuple[int, int, int]]) -> bool:
    """Whether the lengths of all constructed elements within these fit, at every depth."""
    left = [i for i in items if i[0] & 0x20]
    while left:
        _, start, end = left.pop()
        inner = der_items(data, start, end)
        if inner is None:
            return False
        left += [i for i in inner if i[0] & 0x20]
    return True


#: Object identifiers under which password-based encryption schemes stand (PKCS#5, PKCS#12).
PASSWORD_SCHEMES = (bytes.fromhex("2a864886f70d0105"), bytes.fromhex("2a864886f70d010c01"))
INTEGER, OCTETS, OBJECT, SEQUENCE = 0x02, 0x04, 0x06, 0x30


def plain_key(data: bytes, items: list[tuple[int, int, int]]) -> bool:
    """Whether the elements of a sequence are those of a PKCS#1, SEC1 or DSA key."""
    tags = [t for t, _, _ in items]
    if len(items) < 2 or tags[0] != INTEGER or items[0][2] - items[0][1] != 1 or any(t == INTEGER and a == b for t, a, b in items):
        return False
    version = data[items[0][1]]
    if tags[:9] == [INTEGER] * 9:  # PKCS#1: version and eight numbers, then other primes if there are any
        return version <= 1 and tags[9:] in ([], [SEQUENCE])
    if tags == [INTEGER] * 6:  # DSA: version and five numbers
        return version == 0
    return version == 1 and tags[1] == OCTETS and items[1][2] - items[1][1] >= 16 and set(tags[2:]) <= {0xA0, 0xA1}  # SEC1


def is_der_key(data: bytes) -> bool:
    """One SEQUENCE over all bytes, with nested lengths that all fit, that holds what a private key does."""
    outer = der_items(data, 0, len(data))
    if not outer or len(outer) != 1 or outer[0][0] != SEQUENCE or not well_formed(data, outer):
        return False
    items = der_items(data, outer[0][1], outer[0][2])
    if plain_key(data, items):
        return True
    tags = [t for t, _, _ in items]
    if tags[:2] == [SEQUENCE, OCTETS] and len(tags) == 2:  # encrypted PKCS#8: the scheme, then the encrypted key
        scheme = der_items(data, items[0][1], items[0][2])
        return bool(scheme) and scheme[0][0] == OBJECT and data[scheme[0][1] : scheme[0][2]].startswith(PASSWORD_SCHEMES) and items[1][2] > items[1][1]
    if tags[:3] == [INTEGER, SEQUENCE, OCTETS] and items[0][2] - items[0][1] == 1 and data[items[0][1]] <= 1:  # PKCS#8: an algorithm, then the key
        algorithm = der_items(data, items[1][1], items[1][2])
        inner = der_items(data, items[2][1], items[2][2])
        if not algorithm or algorithm[0][0] != OBJECT or not inner or len(inner) != 1 or not well_formed(data, inner):
            return False
        tag, a, b = inner[0]
        return b > a if tag in (INTEGER, OCTETS) else tag == SEQUENCE and plain_key(data, der_items(data, a, b))
    return False


def strings(data: bytes, at: int, end: int, most: int = -1) -> tuple[list[tuple[int, int]], int] | None:
    """Length-prefixed strings from ``at`` on, ``most`` of them or up to ``end``, and where they end; None where one doesn't fit."""
    out: list[tuple[int, int]] = []
    while at < end if most < 0 else len(out) < most:
        n = int.from_bytes(data[at : at + 4], "big")
        if at + 4 > end or at + 4 + n > end:
            return None
        out.append((at + 4, at + 4 + n))
        at += 4 + n
    return out, at


def ssh_end(data: bytes) -> int | None:
    """Where an OpenSSH private key that begins the data ends: magic, cipher, kdf and options, a count of keys, their public
    parts (each made of strings that fill it), and the private part (unencrypted: two equal check numbers first)."""
    if not data.startswith(SSH_MAGIC):
        return None
    head = strings(data, len(SSH_MAGIC), len(data), 3)
    if head is None:
        return None
    keys, at = int.from_bytes(data[head[1] : head[1] + 4], "big"), head[1] + 4
    if not 1 <= keys <= len(data):
        return None
    body = strings(data, at, len(data), keys + 1)
    if body is None or any(a == b or not strings(data, a, b) for a, b in body[0][:-1]):
        return None
    a, b = body[0][-1]
    plain = data[slice(*head[0][0])] == b"none"
    return body[1] if b - a >= 8 and (not plain or data[a : a + 4] == data[a + 4 : a + 8]) else None


def is_ssh_key(data: bytes) -> bool:
    return ssh_end(data) == len(data)


def der_end(data: bytes) -> int | None:
    """Where the SEQUENCE that begins the data ends, by its own length."""
    n, at = data[1], 2
    if n & 0x80:
        k = n & 0x7F
        if not 1 <= k <= 4:
            return None
        n, at = int.from_bytes(data[2 : 2 + k], "big"), 2 + k
    return at + n


def base64_keys(text: str) -> list[tuple[int, int, str]]:
    """Spans of keys in base64, on one line or wrapped over several."""
    out, done = [], 0
    for m in RUN.finditer(text):
        if not START.search(text, m.start(), m.end()):
            continue
        # stretches of data between line ends: where each begins in the text, and in all the data
        places, counts, said, at = [], [], [], m.start()
        for gap in [*NOT_DATA.finditer(text, m.start(), m.end()), None]:
            end = gap.start() if gap else m.end()
            places.append(at)
            counts.append(sum(map(len, said[-1:])) + (counts[-1] if counts else 0))
            said.append(text[at:end])
            at = gap.end() if gap else end
        data = "".join(said)
        for start in START.finditer(text, m.start(), m.end()):
            if start.start() < done:
                continue
            k = bisect_right(places, start.start()) - 1
            begin = counts[k] + start.start() - places[k]
            size = der_end(from_base64(data[begin : begin + 8])) if data[begin] == "M" and len(data) >= begin + 8 else ssh_end(from_base64(data[begin : len(data) - ((len(data) - begin) % 4 == 1)]) or b"")
            stop = begin + -(-(size or 0) * 4 // 3)  # what holds so many bytes
            if not size or size < 30 or stop > len(data) or not (kind := key_kind(from_base64(data[begin:stop]))):
                continue
            k = bisect_left(counts, stop) - 1  # what follows may be a line end, but not more data
            end = places[k] + stop - counts[k]
            if end < m.end() and re.match(r"[A-Za-z0-9+/_-]", text[end]):
                continue
            done = end + len(re.match(r"={0,2}", text[end : end + 2])[0])
            out.append((start.start(), done, kind))
    return out


def is_signed_token(head: str, body: str) -> bool:
    try:
        header, payload = (json.loads(from_base64(x) or b"-") for x in (head, body))
    except (ValueError, UnicodeDecodeError):
        return False
    return isinstance(header, dict) and isinstance(header.get("alg"), str) and isinstance(payload, dict)


def key_kind(data: bytes | None) -> str | None:
    return None if not data else "ssh" if is_ssh_key(data) else "der" if is_der_key(data) else None


def base_spans(text: str, long_words: bool = True) -> list[tuple[int, int, str]]:
    """``long_words``: whether the text has a word of 20 characters, without which access and hex can't match (they hold no white space)."""
    out = []
    low = text.lower()
    if any(n in low for n in NAMES) or not text.isascii():
        out += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if long_words:
        if "AKIA" in text:
            out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        out += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return out


def confirmed_spans(text: str, long_words: bool = True) -> list[tuple[int, int, str]]:
    """Spans whose decoded structure is that of a key or a signed token."""
    out = []
    if "-----BEGIN " in text:
        for m in PEM.finditer(text):
            if kind := key_kind(from_base64(ESCAPES.sub("", m[3]).replace("\\/", "/"))):
                out.append((m.start(), m.end(), kind))
    if long_words:
        pem = [*out]
        if "ey" in text or "ew" in text:  # how "{" begins in base64
            out += [(m.start(), m.end(), "jwt") for m in JWT.finditer(text) if is_signed_token(m[1], m[2])]
        out += [s for s in base64_keys(text) if not any(a <= s[0] < b for a, b, _ in pem)]
        for m in LONG_HEX.finditer(text):
            if kind := key_kind(bytes.fromhex(m[0])):
                out.append((m.start(), m.end(), kind))
    return out


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(set(spans), key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(texts: list[str]) -> dict:
    out = {k: [] for k in ("n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_confirmed")}
    for t in texts:
        long_words = max(map(len, t.split()), default=0) >= 20
        base, more = base_spans(t, long_words), confirmed_spans(t, long_words)
        for kind in KINDS[:3]:
            out[f"n_{kind}"].append(sum(k == kind for _, _, k in base))
        out["base_sha256"].append(hashlib.sha256(joined(base).encode()).hexdigest())
        out["spans"].append(joined(base + more))
        out["n_confirmed"].append(len(more))
    return out


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_assign, n_access, n_hex, base_sha256, spans, n_confirmed (spans that the structure confirmed)."""
    return map_text(docs, text_col, [id_col], scan, "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_confirmed long")
