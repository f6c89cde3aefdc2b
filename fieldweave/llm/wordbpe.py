"""BPE with word ends by an index of pairs: a partition's new words are merged together, rank by rank.

The words that a block of texts brings and the task hasn't seen are laid out as one array
of symbols.  An index maps every rank to all places of its pair in the array; ranks
that have places are active.  The least active rank is taken, its pair is merged at all its
places from left to right, and the lists of the pairs that this makes are extended.  As a
merge comes after those that make its two sides (checked when the file is read), no
later merge brings back a lower rank, so the order is that of a word taken alone.

A text is cut at spaces, tabs and line ends, which no rule of the file joins: pieces
are normalised and split by the file's own rules once and looked up after that (the table is
emptied when it is full).  Special tokens in a text are found before it is normalised, as the file says.

Defined results: a null text counts as empty and has no ids; repeated rows are encoded alike;
an empty table gives an empty result; other columns are not read; very long texts are
taken whole, in parts.  A file whose merges lack that order, or whose added tokens
strip or need word borders, is an error.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import shared
from fieldweave.llm.bpe import alphabet

#: Pieces, and words, whose ids one task remembers, and their length at most.
CACHE, LONGEST = 300_000, 64
#: Places from which a rank is applied as arrays.
MANY = 48
#: Characters of new words that are merged together; a longer word is alone.
BLOCK = 1 << 20
#: Characters of a text that are cut up at once.
PIECE = 1 << 21
_GAP = re.compile(r"[ \t\n\r]")
#: Latin letters without I with a dot (two characters in lower case), then signs other than ' and <.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u012F\u0131-\u017F]+)?([!\"#$%&()*+,\-./:;=?@\[\\\]^_`{|}~]+)?").fullmatch
_PIECES = re.compile(r"[^ \t\n\r]+").findall


class PairIndex:
    """Merges of many words at once; ``vocab`` has every single character, with and without the suffix."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        self.sides = [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges]
        made = {c: rank for rank, (_, _, c) in enumerate(self.sides)}
        if len(made) < len(self.sides) or any(made.get(x, -1) >= rank for rank, (a, b, _) in enumerate(self.sides) for x in (a, b)):
            raise ValueError("a merge must come after those that make its sides, and make a token of its own")
        self.rank_of = {(a << 32) | b: rank for rank, (a, b, _) in enumerate(self.sides)}
        keys = np.array(list(self.rank_of), np.int64)
        self.rank_at = np.argsort(keys)
        self.keys = keys[self.rank_at]
        letters = {ord(t): i for t, i in vocab.items() if len(t) == 1}
        self.inner = np.full(max(letters) + 1, -1, np.int64)
        self.inner[list(letters)] = list(letters.values())
        self.last = np.full(len(self.inner), -1, np.int64)
        for t in letters:
            self.last[t] = vocab.get(chr(t) + suffix, -1)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of symbols, -1 where there is no such merge."""
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.rank_at[at], -1)

    def encode(self, words: list[str]) -> list[bytes]:
        """Ids of each word as unsigned 32-bit integers."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        n = int(ends[-1]) if len(ends) else 0
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        kept = self.inner[chars]
        kept[ends - 1] = self.last[chars[ends - 1]]
        if n and kept.min() < 0:
            raise ValueError("a character that the vocabulary lacks")
        before, after = np.arange(-1, n - 1), np.arange(1, n + 1)
        after[ends - 1] = -1
        before[np.concatenate([[0], ends[:-1]])[: len(ends)]] = -1
        symbols, left, right = (array("q", x.tobytes()) for x in (kept, before, after))  # quick one by one
        kept, before, after = (np.frombuffer(x, np.int64) for x in (symbols, left, right))  # and the same memory as a whole

        places: dict[int, list[int]] = {}
        active: list[int] = []
        rank_of = self.rank_of

        def listed(at: np.ndarray) -> None:
            """Put the pairs that start at ``at`` in the lists of their ranks."""
            rank = self._ranks(kept[at], kept[after[at]])
            at, rank = at[rank >= 0], rank[rank >= 0]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            every = at.tolist()
            for r, s, e in zip(rank[np.concatenate([[0], cut])].tolist() if len(rank) else (), [0, *cut.tolist()], [*cut.tolist(), len(rank)], strict=False):
                if r in places:
                    places[r] += every[s:e]
                else:
                    places[r] = every[s:e]
                    heapq.heappush(active, r)

        listed(np.flatnonzero(after >= 0))
        while active:
            rank = heapq.heappop(active)
            a, b, c = self.sides[rank]
            found = places.pop(rank)
            if a != b and len(found) >= MANY:  # no two of these places overlap
                at = np.unique(np.array(found, np.int64))
                at = at[(kept[at] == a) & (after[at] >= 0)]
                at = at[kept[after[at]] == b]
                gone = after[at]
                beyond = after[gone]
                kept[at], kept[gone], after[gone], after[at] = c, -1, -1, beyond
                before[beyond[beyond >= 0]] = at[beyond >= 0]
                previous = before[at]
                listed(np.concatenate([at[beyond >= 0], previous[previous >= 0]]))
                continue
            found.sort()
            for at in found:
                gone = right[at]
                if gone < 0 or symbols[at] != a or symbols[gone] != b:
                    continue  # merged away since it was listed
                symbols[at], symbols[gone] = c, -1
                beyond = right[at] = right[gone]
                right[gone] = -1
                if beyond >= 0:
                    left[beyond] = at
                    if (r := rank_of.get((c << 32) | symbols[beyond])) is not None:
                        if r in places:
                            places[r].append(at)
                        else:
                            places[r] = [at]
                            heapq.heappush(active, r)
                if (previous := left[at]) >= 0 and (r := rank_of.get((symbols[previous] << 32) | c)) is not None:
                    if r in places:
                        places[r].append(previous)
                    else:
                        places[r] = [previous]
                        heapq.heappush(active, r)
        whole = kept >= 0
        ids, stops = kept[whole].astype("<u4").tobytes(), (np.cumsum(whole)[ends - 1] * 4).tolist()
        return [ids[s:e] for s, e in zip([0, *stops], stops, strict=False)]


class Seen:
    """What a task remembers, in two generations of ``CACHE`` entries: what is asked for stays, the rest goes with the older one."""

    def __init__(self, fixed: dict[str, bytes] | None = None):
        self.young, self.old = dict(fixed or {}), {}

    def unknown(self, keys) -> list[str]:
        """The distinct keys that aren't remembered; all others are in ``young`` then."""
        young, old, out = self.young, self.old, []
        for k in dict.fromkeys(keys):
            if k not in young:
                if (v := old.get(k)) is None:
                    out.append(k)
                else:
                    young[k] = v
        return out

    def settle(self, new: list[str], fixed: dict[str, bytes] | None = None) -> None:
        """Forget long new keys, and the older generation if the younger is full."""
        for k in new:
            if len(k) > LONGEST:
                del self.young[k]
        if len(self.young) > CACHE:
            self.young, self.old = dict(fixed or {}), self.young


class Codec:
    """Encoder and decoder for one tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec["added_tokens"]
        if model["type"] != "BPE" or model["continuing_subword_prefix"] or model["byte_fallback"] or model["dropout"] or model["ignore_merges"]:
            raise ValueError("only plain BPE with a word-end suffix is supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens must be found as they stand")
        if spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError("tokens are joined by spaces: a decoder or post-processor isn't supported")
        rules = Tokenizer.from_file(path)
        self.normalise, self.split = rules.normalizer.normalize_str, rules.pre_tokenizer.pre_tokenize_str
        self.index = PairIndex(model["vocab"], [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]], model["end_of_word_suffix"] or "")
        self.special = {t["content"]: array("I", [t["id"]]).tobytes() for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if added else None
        self.token = {i: t for t, i in model["vocab"].items()} | {t["id"]: t["content"] for t in added}
        self.spelt = {c: "".join(map(alphabet().__getitem__, chr(c).encode())) for c in range(0xC0, 0x180)}
        self.known, self.known_words = Seen(), Seen(self.special)

    def words(self, piece: str) -> list[str]:
        """The piece's words in the byte alphabet, and its special tokens as they stand."""
        if plain := _PLAIN(piece):  # what the file's rules do to it is known: lower case, letters apart from signs
            letters, signs = plain.groups()
            return [w for w in (letters.lower().translate(self.spelt) if letters else "", signs) if w]
        out = []
        for part in self.cut(piece) if any(t in piece for t in self.special) else (piece,):
            if part in self.special:
                out.append(part)
            elif part:
                out += [w for w, _ in self.split(self.normalise(part))]
        return out

    def learn(self, pieces: list[str]) -> None:
        """Merge the unknown words of new pieces together."""
        made = [self.words(p) for p in pieces]
        every = self.known_words.unknown(w for words in made for w in words)
        known = self.known_words.young
        i = 0
        while i < len(every):
            j, size = i, 0
            while j < len(every) and (j == i or size + len(every[j]) <= BLOCK):
                size += len(every[j])
                j += 1
            known.update(zip(every[i:j], self.index.encode(every[i:j]), strict=True))
            i = j
        self.known.young.update((p, b"".join(map(known.__getitem__, words))) for p, words in zip(pieces, made, strict=True))
        self.known_words.settle(every, self.special)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what is new in any of them is merged together."""
        found = [_PIECES(t) for t in texts]
        new = self.known.unknown(p for pieces in found for p in pieces)
        if new:
            self.learn(new)
        known = self.known.young
        out = [np.frombuffer(b"".join(map(known.__getitem__, pieces)), np.uint32) for pieces in found]
        self.known.settle(new)
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens, special ones too, joined by spaces."""
        return " ".join(map(self.token.__getitem__, ids))


@functools.lru_cache(2)
def codec(path: str) -> Codec:
    """One codec for each worker process."""
    return Codec(path)


def _rows(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[object, np.ndarray]]:
    """Keys and ids; texts are taken together up to ``PIECE`` characters, longer ones in pieces."""
    c = codec(path)
    for batch in batches:
        keys, held, size = [], [], 0
        for key, value in zip(batch.column(0), batch.column(1), strict=True):
            text = value.as_py() or ""
            if size + len(text) > PIECE and held:
                yield from zip(keys, c.encode(held), strict=True)
                keys, held, size = [], [], 0
            if len(text) > PIECE:
                yield key.as_py(), np.concatenate([c.encode([p])[0] for p in shared.pieces(text, PIECE, _GAP)])
                continue
            keys.append(key.as_py())
            held.append(text)
            size += len(text)
        if held:
            yield from zip(keys, c.encode(held), strict=True)


def _sent(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], size: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Record batches of rows whose first value is the row's weight."""
    held, total = [], 0
    for n, *row in rows:
        held.append(row)
        total += n
        if total > size:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, total = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, ids`` of each document."""

    def run(batches):
        rows = ((len(ids), key, ids.astype(np.int32)) for key, ids in _rows(batches, path))
        yield from _sent(rows, ["doc_id", "ids"], [pa.int64(), pa.list_(pa.int32())])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """``doc_id, text``: what each list of ids stands for (null: empty)."""

    def run(batches):
        c = codec(path)
        for batch in batches:
            texts = [c.decode(ids.as_py() or []) for ids in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Per document ``n_tokens`` and digests of its ids and of what they decode to, in one pass."""

    def run(batches):
        c = codec(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        rows = ((500, key, len(ids), sha(ids.astype("<u4").tobytes()), sha(c.decode(ids.tolist()).encode())) for key, ids in _rows(batches, path))
        yield from _sent(rows, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
