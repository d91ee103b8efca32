"""Byte-level BPE encoding and decoding with a sentencepiece model made from the vocabulary.

The ranks of a ``.tiktoken`` file become a sentencepiece BPE model, written field by field: each token is the
string of its bytes, every byte mapped to a printable character, scored by the negative rank; normalisation is
the identity. A text is cut by the public pattern, each pre-token is encoded on its own, and ids are decoded
through the inverse of the byte mapping. The ids are those of the ``tiktoken`` library without special tokens.

Null texts count as empty: no ids, empty bytes. Null or repeated keys stay as they are, one row out per row in.
Long texts are handled whole, a text at a time; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch, only, texts_of
from .units import Encoder, Memo
from .vocab import pattern, ranks_of

UNKNOWN = "⁇"


def byte_characters() -> list[str]:
    """A printable character for each byte: itself where it is printable Latin-1, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b if b in set(shown) else next(spare)) for b in range(256)]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n >= 0x80:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol-buffer field: an int as varint, a float as fixed 32, bytes by length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def model_bytes(ranks: dict[bytes, int]) -> bytes:
    """The serialised sentencepiece model; the piece of rank r has id r + 1, id 0 is the unknown piece."""
    chars = byte_characters()
    by_rank = sorted(ranks.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must run from 0 without gaps")
    pieces = [_field(1, _field(1, UNKNOWN.encode()) + _field(2, 0.0) + _field(3, 2))]
    for token, rank in by_rank:
        text = "".join(chars[b] for b in token)
        pieces.append(_field(1, _field(1, text.encode()) + _field(2, float(-rank)) + _field(3, 1)))
    bpe, whole = 2, len(by_rank) + 1
    trainer = _field(3, bpe) + _field(4, whole) + _field(40, 0) + _field(45, UNKNOWN.encode())
    normal = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(pieces) + _field(2, trainer) + _field(3, normal)


class Codec:
    """Encodes and decodes by the model of one vocabulary file."""

    def __init__(self, path: str):
        import regex
        import sentencepiece

        self.ranks = ranks_of(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(self.ranks))
        chars = byte_characters()
        self.shown = {b: c for b, c in enumerate(chars)}
        back = {c: b for b, c in enumerate(chars)}
        self.tokens = [bytes(back[c] for c in self.model.id_to_piece(r + 1)) for r in range(len(self.ranks))]
        self.cut = regex.compile(pattern()).findall
        self.pieces = Memo(self._pieces, keep=400_000)
        self.encode_units = Encoder(self._units, keep=400_000)

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Ids of pre-tokens, packed. A pre-token that is a token is that token, whatever the merges say."""
        out = [self.ranks.get(p.encode(), -1) for p in pieces]
        rest = [k for k, r in enumerate(out) if r < 0]
        merged = self.model.encode([pieces[k].encode().decode("latin-1").translate(self.shown) for k in rest], out_type=int, num_threads=1) if rest else []
        packed = [r.to_bytes(4, "little") if r >= 0 else b"" for r in out]
        for k, ids in zip(rest, merged):
            packed[k] = struct.pack(f"<{len(ids)}I", *[i - 1 for i in ids])
        return packed

    def _units(self, units: list[str]) -> list[bytes]:
        cut = [self.cut(u) for u in units]
        self.pieces.turn()
        self.pieces.learn({p for ps in cut for p in ps})
        return [b"".join(map(self.pieces.__getitem__, ps)) for ps in cut]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.encode_units(text))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and ``ids``: packed little-endian unsigned 32-bit ids of each text."""

    def run(batch: pa.RecordBatch) -> dict:
        texts = texts_of(batch.column(1))
        codec(path).encode_units.learn(texts)
        return {key: batch.column(0), "ids": [codec(path).encode(t) for t in texts]}

    return by_batch(only(docs, key, text), run, f"`{key}` {dict(docs.dtypes)[key]}, ids binary")


def decode(tokens: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``content``: the bytes that packed ids stand for; null ids give no bytes."""

    def run(batch: pa.RecordBatch) -> dict:
        return {key: batch.column(0), "content": [codec(path).decode(x or b"") for x in batch.column(1).to_pylist()]}

    return by_batch(only(tokens, key, ids), run, f"`{key}` {dict(tokens.dtypes)[key]}, content binary")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Encodes each text, decodes the ids, and returns digests of both: one pass, nothing shuffled."""

    def run(batch: pa.RecordBatch) -> dict:
        c, texts = codec(path), texts_of(batch.column(1))
        c.encode_units.learn(texts)
        out = {"doc_id": batch.column(0), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for t in texts:
            ids = c.encode(t)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(c.decode(ids)).hexdigest())
        return out

    return by_batch(only(docs, "doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
