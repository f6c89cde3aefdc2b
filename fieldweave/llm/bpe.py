"""Byte-level BPE over Arrow batches, with offsets, and its exact inverse.

Ranks (``base64 rank`` lines) become a ``tokenizers`` BPE model: the vocabulary in
the printable byte alphabet, and every split of a token into two tokens as a merge of
that token's rank.  Each match of the split pattern is encoded separately.  Matches
seen before in the task are looked up (the table is emptied when it is full); new
ones go to the model.  Ids map back to bytes through the reversed byte table; a
character that is split over tokens is whole again once the bytes are joined.

Defined results: a null text counts as empty and has no ids; repeated rows are
encoded alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Matches whose ids one task remembers, and their length at most.
CACHE, LONGEST = 200_000, 64


@functools.lru_cache(1)
def alphabet() -> list[str]:
    """The printable character that stands for each byte: itself where it is one, else the next from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Codec:
    """Encoder and decoder for one rank file and split pattern."""

    def __init__(self, path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        shown = alphabet()
        spell = lambda token: "".join(shown[c] for c in token)
        vocab = {spell(token): rank for token, rank in ranks.items()}
        merges = [
            (spell(token[:k]), spell(token[k:]))
            for token in sorted(ranks, key=ranks.get)
            for k in range(1, len(token))
            if token[:k] in ranks and token[k:] in ranks
        ]
        self.model = Tokenizer(models.BPE(vocab=vocab, merges=merges))
        self.model.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.split = regex.compile(pattern).findall
        byte_of = {c: b for b, c in enumerate(shown)}
        self.bytes_of = {rank: bytes(byte_of[c] for c in token) for token, rank in vocab.items()}
        self.length = np.zeros(max(self.bytes_of) + 1, np.int64)
        for rank, token in self.bytes_of.items():
            self.length[rank] = len(token)
        self.known: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        found = self.split(text)
        known = self.known
        new = [x for x in dict.fromkeys(found) if x not in known]
        if new:
            if len(known) > CACHE:
                known.clear()
                new = list(dict.fromkeys(found))
            for at in range(0, len(new), 4096):
                part = new[at : at + 4096]
                known.update((x, array("I", e.ids).tobytes()) for x, e in zip(part, self.model.encode_batch_fast(part, add_special_tokens=False), strict=True))
        ids = np.frombuffer(b"".join(map(known.__getitem__, found)), np.uint32)
        for x in new:
            if len(x) > LONGEST:
                del known[x]
        return ids

    def offsets(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of each token in characters; a split character belongs to all its tokens."""
        ends = np.cumsum(self.length[ids])
        starts = ends - self.length[ids]
        return self.characters(text, starts, ends)

    @staticmethod
    def characters(text: str, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if text.isascii():
            return starts, ends
        lead = (np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80
        number = np.concatenate([np.cumsum(lead) - 1, [len(text)]])
        return number[starts], np.where(ends > starts, number[np.maximum(ends - 1, 0)] + 1, number[starts])

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@functools.lru_cache(4)
def codec(path: str, pattern: str) -> Codec:
    """One codec per worker process."""
    return Codec(path, pattern)


def _rows(batches: Iterator[pa.RecordBatch], path: str, pattern: str) -> Iterator[tuple[object, str, np.ndarray]]:
    c = codec(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            part = batch.slice(at, 64)
            for key, text in zip(part.column(0), part.column(1), strict=True):
                yield key.as_py(), (t := text.as_py() or ""), c.encode(t)


def encode(docs: DataFrame, path: str, pattern: str, offsets: bool = False) -> DataFrame:
    """``doc_id, ids`` of each document; with ``offsets`` also each token's span of characters."""
    names = ["doc_id", "ids", *(["starts", "ends"] if offsets else [])]

    def run(batches):
        held, size = [], 0
        for key, text, ids in _rows(batches, path, pattern):
            held.append((key, ids.astype(np.int32), *(codec(path, pattern).offsets(text, ids) if offsets else ())))
            size += len(ids)
            if size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=False)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=False)], names=names)

    types = [pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.list_(pa.int64())]
    schema = "doc_id long, ids array<int>" + ", starts array<long>, ends array<long>" * offsets
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, data``: the bytes that each list of ids stands for (null: empty)."""

    def run(batches):
        c = codec(path, pattern)
        for batch in batches:
            data = [c.decode(ids.values.to_numpy() if ids.is_valid else ()) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Per document ``n_tokens`` and digests of its ids, of what they decode to, and of the tokens' spans, in one pass.

    ``offsets_sha256`` is of all starts, then all ends, in characters, as little-endian unsigned 32-bit integers.
    """
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "offsets_sha256"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches):
        held = []
        c = codec(path, pattern)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for key, text, ids in _rows(batches, path, pattern):
            spans = np.concatenate(c.offsets(text, ids)).astype("<u4")
            held.append((key, len(ids), sha(ids.astype("<u4").tobytes()), sha(c.decode(ids.tolist())), sha(spans.tobytes())))
            if len(held) == 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, offsets_sha256 string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def tokenise(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` and ``exact``: do the ids decode to the text's bytes?"""

    def run(batches):
        c, held, size = codec(path, pattern), [], 0
        names, types = ["doc_id", "n_tokens", "ids", "exact"], [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.bool_()]
        for key, text, ids in _rows(batches, path, pattern):
            held.append((key, len(ids), ids.astype(np.int32), c.decode(ids.tolist()) == text.encode()))
            size += len(ids)
            if size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>, exact boolean")
