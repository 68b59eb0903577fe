"""Bounded-space online packing of token sequences.

Each partition tokenises its documents and keeps a fixed number of open windows. A piece goes to the window it fits best; if it
fits none, the fullest is emitted, topped up with the head of the piece. What is open at the end is merged over groups of
partitions.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .bytebpe import byte_characters
from .shared import kept

WIDTH = 4  # bytes of an id
# Strings whose ids a task remembers at most, but for those of one text.
REMEMBERED = 500_000
GROUP = 256  # partitions whose leftovers are merged by one task
MERGED = 1 << 62
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
_FIELDS = pa.schema([*[(c, pa.int64()) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary())])


class WordEncoder:
    """Ids of a tokenizer as little-endian unsigned 32-bit numbers.

    A tokenizer that normalises to NFC, drops white space, folds case and cuts text by a pattern encodes each string between
    white space on its own; such strings and their pre-tokens are remembered, up to a bound. Any other tokenizer, and a text with
    one of the separators \\x1c-\\x1f (white space to Python but not to the tokenizer), is encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        steps = [(x["type"], x.get("pattern"), x.get("content")) for x in (made["normalizer"] or {}).get("normalizers", [])]
        cut = (made["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = (steps == [("NFC", None, None), ("Replace", {"Regex": "\\s+"}, " "), ("Lowercase", None, None)]
                        and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["behavior"] == "Removed" and cut[0]["invert"]
                        and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"] and "[\\p{L}]+" in cut[0]["pattern"]["Regex"])
        self.tokenize = self.tokenizer.model.tokenize
        if self.by_word:
            self.find = regex.compile(cut[0]["pattern"]["Regex"]).findall
        self.letters = dict(enumerate(byte_characters()))
        self.number = [k.to_bytes(WIDTH, "little") for k in range(self.tokenizer.get_vocab_size(with_added_tokens=True))]
        self.known: dict[str, bytes] = {}  # a pre-token alone has the ids of its string

    def _whole(self, text: str) -> bytes:
        return b"".join(map(self.number.__getitem__, self.tokenizer.encode(text, add_special_tokens=False).ids))

    def _part(self, part: str) -> bytes:
        ids = self.known.get(part)
        if ids is None:
            word = part if part.isascii() and part.isprintable() else part.encode().decode("latin-1").translate(self.letters)
            ids = self.known[part] = b"".join([self.number[t.id] for t in self.tokenize(word)])
        return ids

    def _word(self, word: str) -> bytes:
        if not word.isascii() and any(unicodedata.category(c) == "Cn" for c in word):  # what it is depends on the Unicode version
            return self._whole(word)
        if word.isalpha():
            return self._part(word)
        if word[:-1].isalpha():
            ids = self._part(word[:-1]) + self._part(word[-1])
        else:
            ids = b"".join(map(self._part, self.find(word)))
        self.known[word] = ids
        return ids

    def __call__(self, text: str) -> bytes:
        if not self.by_word or any(c in text for c in "\x1c\x1d\x1e\x1f"):
            return self._whole(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        # The tokenizer folds characters one by one; only the sigma looks at its neighbours here.
        items = ("".join(map(str.lower, text)) if "\u03a3" in text else text.lower()).split()
        found = list(map(self.known.get, items))
        if None in found:
            found = [self._word(w) if ids is None else ids for w, ids in zip(items, found)]
            if len(self.known) > REMEMBERED:
                self.known.clear()
        return b"".join(found)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    """One per worker process, so that later tasks find it filled."""
    return WordEncoder(path)


class Packer:
    """The open windows of one task. `place` yields (window, offset, begin, end) for the parts of a piece, and `closed` windows."""

    def __init__(self, size: int, windows: int, slack: int):
        self.size, self.windows, self.slack = size, windows, slack
        self.free: list[tuple[int, int]] = []  # (room, window), ascending
        self.opened = 0

    def place(self, length: int):
        at, out = 0, []
        while at < length:
            rest = length - at
            if rest >= self.size:
                room, window = self.size, self._open()
            else:
                k = bisect_left(self.free, (rest, -1))
                if k < len(self.free):
                    room, window = self.free.pop(k)
                elif len(self.free) < self.windows:
                    room, window = self.size, self._open()
                else:
                    room, window = self.free.pop(0)  # the fullest
                    if room <= self.slack:
                        continue
            used = min(room, rest)
            out.append((window, self.size - room, at, at + used))
            at += used
            if room > used:
                insort(self.free, (room - used, window))
        return out

    def _open(self) -> int:
        self.opened += 1
        return self.opened - 1


def _pack(path: str, end_id: int, size: int, windows: int, slack: int, with_ids: bool):
    def run(batches):
        encode, packer = encoder(path), Packer(size, windows, slack)
        base = TaskContext.get().partitionId() << 32
        waiting: dict[int, list] = {}  # pieces of the open windows
        end = end_id.to_bytes(WIDTH, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // WIDTH
                for window, offset, a, b in packer.place(total):
                    part = ids[a * WIDTH:b * WIDTH]
                    waiting.setdefault(window, []).append((doc, a, b - a, zlib.crc32(part), total, base + window, offset, part))
                still = {w for _, w in packer.free}
                for w in [w for w in waiting if w not in still]:
                    rows += [r if with_ids else (*r[:-1], None) for r in waiting.pop(w)]
            yield _rows(rows)
        # Leftovers carry their ids and a negative sequence.
        yield _rows([(*r[:5], -1 - r[5], *r[6:]) for rows in waiting.values() for r in rows])
    return run


def _rows(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in _FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)


def _merge(size: int, with_ids: bool):
    """Leftover pieces in order, cut at window ends; what remains of a group goes to sequences whose lengths are powers of two."""
    def run(batches):
        group, rows, fill, serial = None, [], 0, 0

        def finish():
            # One group's tail is under one window: cut it at the powers of two of its length.
            nonlocal rows, fill, serial
            out, lengths = [], [1 << k for k in range(size.bit_length(), -1, -1) if fill >> k & 1]
            k, offset = 0, 0
            for r in rows:
                doc, start, n, _, total, _, _, ids = r
                at = 0
                while at < n:
                    take = min(n - at, lengths[k] - offset)
                    part = ids[at * WIDTH:(at + take) * WIDTH]
                    out.append((doc, start + at, take, zlib.crc32(part), total, MERGED + (group << 32) + serial, offset, part if with_ids else None))
                    at, offset = at + take, offset + take
                    if offset == lengths[k]:
                        k, offset, serial = k + 1, 0, serial + 1
            rows, fill = [], 0
            return out

        for batch in batches:
            out = []
            for r in zip(*[batch.column(k).to_pylist() for k in range(9)]):
                if r[8] != group:
                    out += finish()
                    group, serial = r[8], 0
                doc, start, n, _, total, _, _, ids, _ = r
                at = 0
                while at < n:
                    take = min(n - at, size - fill)
                    rows.append((doc, start + at, take, None, total, None, None, ids[at * WIDTH:(at + take) * WIDTH]))
                    at, fill = at + take, fill + take
                    if fill == size:
                        out += finish()
            yield _rows(out)
        yield _rows(finish())
    return run


def pack(docs: DataFrame, tokenizer: str, ident: str = "doc_id", text: str = "text", size: int = 4096, end_id: int = 2,
         windows: int = 16, slack: int = 16, with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start (its document's ids before it), length, ids_crc32, doc_tokens, sequence_id, offset and,
    with `with_ids`, the ids as little-endian unsigned 32-bit numbers.

    `tokenizer` is a tokenizer file whose path every executor can read; `end_id` follows each document. A window of a partition
    closes full or at most `slack` ids short; merged leftovers have full or power-of-two lengths. Null and empty texts are one
    end id; rows that repeat an id or have none are packed each on their own; further columns are ignored; an empty table
    gives no piece.
    """
    if size & (size - 1):
        raise ValueError("size must be a power of two")
    rows = docs.select(F.col(ident).cast("long").alias("doc_id"), F.col(text).alias("text"))
    pieces = kept(rows.mapInArrow(_pack(tokenizer, end_id, size, windows, slack, with_ids), _PIECE), "pieces")
    open_ = pieces.filter("sequence_id < 0").withColumn("group", F.expr(f"(-1 - sequence_id) div {GROUP << 32}"))
    merged = open_.repartition("group").sortWithinPartitions("group", F.desc("sequence_id"), "offset").mapInArrow(_merge(size, with_ids), _PIECE)
    out = pieces.filter("sequence_id >= 0").unionByName(merged)
    return (out if with_ids else out.drop("ids")).withColumnRenamed("doc_id", ident)
