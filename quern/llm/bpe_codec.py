"""Byte-level BPE encoding and raw-byte decoding with the tiktoken library and a local rank file.

A long text is cut at safe boundaries into stretches of about ``STRETCH`` characters, which bounds what one call of the
library works on; the ids of a text are the ids of its stretches in order. No pre-token holds white space after anything
else, so every place where white space begins is safe. A stretch that stays long has no such place (a very long run of
white space, letters or marks): the library's pattern search overflows its stack on those, so they are cut into pre-tokens
here and each is given to the library's byte-pair merging alone. Decoding joins the bytes of the ids, whether or not they
are valid UTF-8.

Defined cases. A null text is empty: no ids, and the digest of no bytes. Strings that look like special tokens are
ordinary text. Repeated rows and ids are encoded row by row. Other columns of the caller, whatever their names, are not
read. An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import regex
from pyspark.sql import DataFrame

from ._common import map_text
from .token_counts import PATTERN

#: Characters after which the next safe boundary ends a stretch, and from which a stretch is cut into pre-tokens here.
STRETCH, LONG = 20_000, 100_000
#: Where white space begins: no pre-token crosses. (Marks that some call white space and others don't are no such place.)
SAFE = regex.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \t\r\n])")
PRE_TOKEN = regex.compile(PATTERN)


def open_ranks(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("local", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


_OPEN: dict = {}


def stretches(text: str, most: int = STRETCH) -> list[str]:
    """The text in pieces that are encoded on their own; more than ``most`` characters only where no safe boundary comes."""
    out, start = [], 0
    while len(text) - start > most and (cut := SAFE.search(text, start + most)):
        out.append(text[start : cut.start()])
        start = cut.start()
    return [*out, text[start:]]


class Codec:
    """Ids of whole texts, and the bytes that the ids decode to."""

    def __init__(self, path: str, texts_too: bool = False):
        self.path, self.texts_too = path, texts_too

    @property
    def encoding(self):
        if self.path not in _OPEN:
            _OPEN[self.path] = open_ranks(self.path), [str(i) for i in range(65_536)]
        return _OPEN[self.path]

    def encode(self, text: str) -> list[int]:
        own = self.encoding[0]
        if len(text) <= STRETCH:
            return own.encode_ordinary(text)
        ids: list[int] = []
        for s in stretches(text):
            if len(s) <= LONG:
                ids += own.encode_ordinary(s)
            else:
                for m in PRE_TOKEN.finditer(s):
                    ids += own._encode_single_piece(m[0])
        return ids

    def decode(self, ids: list[int]) -> bytes:
        return self.encoding[0].decode_bytes(ids)

    def __call__(self, texts: list[str]) -> dict:
        out = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []} | ({"ids": [], "decoded": []} if self.texts_too else {})
        encoding, decimal = self.encoding
        if encoding.n_vocab > len(decimal):
            decimal.extend(map(str, range(len(decimal), encoding.n_vocab)))
        for t in texts:
            ids = self.encode(t)
            said = ",".join(map(decimal.__getitem__, ids))
            back = self.decode(ids)
            out["n_tokens"].append(len(ids))
            out["ids_sha256"].append(hashlib.sha256(said.encode()).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
            if self.texts_too:
                out["ids"].append(ids)
                out["decoded"].append(back)
        return out


def encode_decode(docs: DataFrame, ranks: str, ids_too: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, n_tokens, ids_sha256, decoded_sha256; with ``ids_too`` also ids and the decoded bytes."""
    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded binary" if ids_too else "")
    return map_text(docs, text_col, [id_col], Codec(ranks, ids_too), made)
