"""Byte-level BPE by a sentencepiece model that is serialised directly from a rank file.

Each byte maps to one printable character; a token is the string of its bytes' characters, scored by its negative rank, and the
normaliser is the identity. Pre-tokens are encoded one by one; decoding is the inverse mapping.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

# Pre-tokens whose ids a task remembers at most.
REMEMBERED = 400_000


def byte_characters() -> list[str]:
    """One character per byte: its own where it is printable and no space, else one from U+0100 on."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return [chr(b if b in own else next(rest)) for b in range(256)]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value) -> bytes:
    """One protocol-buffer field: an int as a varint, a float as four bytes, bytes with their length."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def serialise(ranks: dict[bytes, int]) -> bytes:
    """The model: pieces in rank order, whose ids are the ranks, and the unknown piece, which no text reaches, last."""
    if sorted(ranks.values()) != list(range(len(ranks))):
        raise ValueError("ranks must be 0, 1, 2, ...")
    letters = byte_characters()
    out = []
    for token in sorted(ranks, key=ranks.__getitem__):
        piece = "".join(letters[b] for b in token).encode()
        out.append(_field(1, _field(1, piece) + _field(2, float(-ranks[token])) + _field(3, 1)))
    out.append(_field(1, _field(1, b"<unknown piece>") + _field(2, float(-len(ranks))) + _field(3, 2)))
    trainer = _field(3, 2) + _field(4, len(ranks) + 1)  # model type BPE, vocabulary size
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)  # no dummy prefix, no white space changes
    return b"".join(out) + _field(2, trainer) + _field(3, normaliser)


class Codec:
    """Encodes and decodes in one process."""

    def __init__(self, path: str, pattern: str):
        import sentencepiece
        self.ranks = read_ranks(path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(self.ranks))
        self.find = regex.compile(pattern).findall
        self.letters = dict(enumerate(byte_characters()))
        self.bytes_of = [token for token, _ in sorted(self.ranks.items(), key=lambda x: x[1])]
        self.digits = [str(k) for k in range(len(self.bytes_of))]
        self.known: dict[str, tuple[int, ...]] = {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        data = piece.encode()
        whole = self.ranks.get(data)  # a pre-token that is a token needs no merging
        if whole is not None:
            return (whole,)
        return tuple(self.model.encode(data.decode("latin-1").translate(self.letters)))

    def encode(self, text: str) -> list[int]:
        pieces, known = self.find(text), self.known
        new = {p for p in pieces if p not in known}
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = set(pieces)
        for p in new:
            known[p] = self._piece(p)
        return list(chain.from_iterable(map(known.__getitem__, pieces)))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def _encode(path: str, pattern: str):
    def run(batches):
        codec = Codec(path, pattern)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([codec.encode(t or "") for t in batch.column(1).to_pylist()], pa.list_(pa.int32()))],
                                             ["id", "ids"])
    return run


def _decode(path: str):
    def run(batches):
        tokens = [t for t, _ in sorted(read_ranks(path).items(), key=lambda x: x[1])]
        for batch in batches:
            out = [b"".join(map(tokens.__getitem__, ids)) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["id", "data"])
    return run


def _digests(path: str, pattern: str):
    def run(batches):
        codec = Codec(path, pattern)
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                ids = codec.encode(text or "")
                joined = ",".join(map(codec.digits.__getitem__, ids))
                rows.append((len(ids), hashlib.sha256(joined.encode()).hexdigest(), hashlib.sha256(codec.decode(ids)).hexdigest()))
            n, a, b = (list(x) for x in zip(*rows)) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                                             ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def _rows(docs: DataFrame, ident: str, value: str) -> DataFrame:
    return docs.select(F.col(ident).cast("long").alias("id"), F.col(value).alias("value"))


def encode(docs: DataFrame, ranks: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, `ids`) of every whole text; a null or empty text has none. `ranks` is a file every executor can read. Ids of rows may
    be null or repeat; further columns are ignored; an empty table gives an empty result."""
    return _rows(docs, ident, text).mapInArrow(_encode(ranks, pattern), "id long, ids array<int>").withColumnRenamed("id", ident)


def decode(rows: DataFrame, ranks: str, ident: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, `data`): the bytes that `ids` stand for; null or empty ids give no bytes."""
    got = _rows(rows, ident, ids).withColumn("value", F.coalesce("value", F.array().cast("array<int>")))
    return got.mapInArrow(_decode(ranks), "id long, data binary").withColumnRenamed("id", ident)


def digest_round_trip(docs: DataFrame, ranks: str, pattern: str, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: id, `n_tokens`, `ids_sha256` (of the decimal ids joined by commas) and `decoded_sha256` (of the bytes decoded from
    the ids), in one pass; null counts as empty."""
    out = _rows(docs, ident, text).mapInArrow(_digests(ranks, pattern), "id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", ident)
