"""Benchmark decontamination: item-sized windows found by CGK embedding and bit sampling.

An item is found in a document if some passage lies within ``DISTANCE`` word edits per
item word of it (lower case, words between white space).

1. Items are cut into parts of at most ``PART`` words; of a passage within the allowed
   distance at least one part is within it too.
2. A part of m words with at most d edits shares at least m - 2 - 3 d word trigrams with
   its place (the q-gram lemma), so only stretches with that many trigrams of parts of
   such a size are looked at.  This loses nothing.
3. There the window at every word, and the part, are embedded by the random walk of
   Chakraborty, Goldenberg and Koucky (at each step a symbol is written, and a bit drawn
   from step and symbol tells whether to advance), which maps edit distance to Hamming
   distance.  ``REPEATS`` walks, each with ``SAMPLED`` sampled places, give hash keys; a
   shared key makes a candidate.
4. Candidates are verified by the exact edit distance of the whole item to its nearest
   passage there.

The benchmark is taken in blocks of about ``BLOCK_BYTES`` of text, each held by every task and
run against all documents; its size is summed first, so a broadcast is bounded whatever the
items' lengths (blocks are dealt by hash: a longer item makes its block longer).

Defined results: null or empty texts and items match nothing; items of fewer than
``LEAST`` words don't identify a passage and match nothing, those of five words match
exactly; repeated rows are searched alike; items with equal texts are all reported; an
empty table on either side gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import shared

DISTANCE, LEAST, PART = 0.2, 5, 64
REPEATS, SAMPLED = 32, 2
#: Bytes of benchmark text that a task holds at once, and that are broadcast.
BLOCK_BYTES = 1 << 24
#: Sizes (words) at which classes of parts begin.
CLASSES = [5, 6, 8, 10, 13, 15, 18, 20, 25, 30, 40, 50]
_SEEDS = shared.mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(shared.BASE))


def allowed(m: int) -> int:
    """Word edits allowed for an item or part of ``m`` words."""
    return int(DISTANCE * m + 1e-9) if m > 5 else 0


def words_of(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int]]:
    for b in shared.blocks(pc.utf8_lower(column)):
        s, e, doc = b.words()
        yield b.first, shared.names(b.buf, s, e), doc, b.n


def walk(h: np.ndarray, end: np.ndarray, start: np.ndarray, steps: int, sampled: np.ndarray) -> np.ndarray:
    """Keys (REPEATS x windows) of the windows at ``start``; symbols from ``end`` on are 0.

    The coin of a symbol at a step is a bit of their hash, so every step tosses anew and work
    arrays are as large as the windows asked for, whatever the length of the text.
    """
    place = np.tile(start, (REPEATS, 1))
    keys = np.tile(_SEEDS[:, None] + np.uint64(steps), (1, len(start)))
    wanted = [np.flatnonzero((sampled == j).any(1)) for j in range(steps)]
    last = int(sampled.max())
    for j in range(last + 1):  # later steps aren't looked at
        inside = place < end
        symbol = np.where(inside, h[np.where(inside, place, 0)], np.uint64(0)) if len(h) else np.zeros(place.shape, np.uint64)
        if len(wanted[j]):
            r = wanted[j]
            keys[r] = shared.mix(keys[r] * np.uint64(shared.BASE) + symbol[r])
        if j < last:
            # multiply and take the top bit: the words' hashes are mixed already
            coin = ((symbol ^ _SEEDS[:, None]) * _STEPS[j]) >> np.uint64(63)
            place = place + (coin.astype(np.int64) | ~inside)
    return keys


#: An odd multiplier for each step.
_STEPS = shared.mix(np.arange(1, 2 * PART + 2, dtype=np.uint64)) | np.uint64(1)


def nearest(item: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edit distance of ``item`` to the nearest passage of each row of ``texts``, and that passage's end (the first)."""
    n, width = texts.shape
    across = np.arange(width + 1)
    cost = np.zeros((n, width + 1), np.int64)
    for word in item:
        new = np.empty_like(cost)
        new[:, 0] = cost[:, 0] + 1
        new[:, 1:] = np.minimum(cost[:, :-1] + (texts != word), cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - across, axis=1) + across
    return cost.min(1), cost.argmin(1)


class Index:
    """Benchmark items prepared for the search."""

    def __init__(self, ids: list[int], texts: list[str | None]):
        self.ids, self.items = [], []
        for first, h, doc, n in words_of(pa.array(texts, pa.string())):
            for i in range(n):
                own = h[doc == i]
                if len(own) >= LEAST:
                    self.ids.append(ids[first + i])
                    self.items.append(own)
        parts = []  # item, offset, words
        for i, h in enumerate(self.items):
            cuts = np.linspace(0, len(h), -(-len(h) // PART) + 1).astype(int)
            parts += [(i, int(a), h[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        size = np.array([len(p[2]) for p in parts], np.int64)
        kind = np.searchsorted(CLASSES, size, side="right") - 1
        grams, masks, self.classes = [], [], []
        for c in np.unique(kind):
            own = np.flatnonzero(kind == c)
            bit = len(self.classes)
            for p in own:
                g, _ = shared.windows(parts[p][2], np.zeros(size[p], np.int64), 3)
                grams.append(g)
                masks.append(np.full(len(g), 1 << bit, np.uint16))
            steps = 2 * int(size[own].min())
            sampled = np.stack([np.sort(np.random.default_rng([steps, r]).choice(steps, SAMPLED, replace=False)) for r in range(REPEATS)])
            # whole parts one after another
            flat, begin = np.concatenate([parts[p][2] for p in own]), np.concatenate([[0], np.cumsum(size[own])])
            keys = walk(flat, begin[1:], begin[:-1], steps, sampled)
            order = np.argsort(keys, axis=1, kind="stable")
            self.classes.append({
                "steps": steps, "sampled": sampled, "keys": np.take_along_axis(keys, order, 1), "part": own[order],
                "hits": min(int(m) - 2 - 3 * allowed(int(m)) for m in size[own]), "span": max(int(m) + allowed(int(m)) for m in size[own]),
            })
        self.part_item, self.part_offset = np.array([p[0] for p in parts], np.int64), np.array([p[1] for p in parts], np.int64)
        gram = np.concatenate(grams) if grams else np.empty(0, np.uint64)
        self.gram, inverse = np.unique(gram, return_inverse=True)
        self.mask = np.zeros(len(self.gram), np.uint16)
        if len(gram):
            np.bitwise_or.at(self.mask, inverse, np.concatenate(masks))
        self.seen = np.zeros(1 << 22, bool)
        self.seen[(self.gram >> np.uint64(42)).astype(np.int64)] = True

    # ------------------------------------------------------------ search
    def stretches(self, h: np.ndarray, doc: np.ndarray) -> list[np.ndarray]:
        """For each class the words at which a window may start."""
        gram, at = shared.windows(h, doc, 3)
        maybe = np.flatnonzero(self.seen[(gram >> np.uint64(42)).astype(np.int64)])
        if not len(maybe) or not len(self.gram):
            return [np.empty(0, np.int64) for _ in self.classes]
        slot = np.minimum(np.searchsorted(self.gram, gram[maybe]), len(self.gram) - 1)
        true = self.gram[slot] == gram[maybe]
        place, mask = at[maybe[true]], self.mask[slot[true]]
        out = []
        for bit, c in enumerate(self.classes):
            own = place[(mask >> bit) & 1 == 1]
            k = max(c["hits"], 1) - 1
            first, last = own[: max(len(own) - k, 0)], own[k:]
            near = (last - first <= c["span"]) & (doc[first] == doc[last])
            change = np.zeros(len(h) + 1, np.int64)
            begin = np.searchsorted(doc, doc[first[near]])
            np.add.at(change, np.maximum(last[near] - c["span"], begin), 1)
            np.add.at(change, first[near] + 1, -1)
            out.append(np.flatnonzero(np.cumsum(change[:-1]) > 0))
        return out

    def candidates(self, h: np.ndarray, doc: np.ndarray, starts: list[np.ndarray]) -> np.ndarray:
        """Rows (item, document, start of the item there) that share a key."""
        end = np.searchsorted(doc, doc, side="right")
        found = [np.empty((0, 3), np.int64)]
        for c, start in zip(self.classes, starts, strict=True):
            for some in np.array_split(start, -(-len(start) // 20_000)) if len(start) else ():
                keys = walk(h, end[some], some, c["steps"], c["sampled"])
                for r in range(REPEATS):
                    left = np.searchsorted(c["keys"][r], keys[r], side="left")
                    count = np.searchsorted(c["keys"][r], keys[r], side="right") - left
                    hit = np.flatnonzero(count)
                    if not len(hit):
                        continue
                    n = count[hit]
                    slot = np.repeat(left[hit], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    part = c["part"][r][slot]
                    place = np.repeat(some[hit], n)
                    found.append(np.unique(np.stack([self.part_item[part], doc[place], place - self.part_offset[part]], 1), axis=0))
        return np.unique(np.concatenate(found), axis=0)

    def search(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int, int, int, int, int]]:
        """(document, item id, item words, distance, first word, end word) of every item in every document, the nearest place of each."""
        found = self.candidates(h, doc, self.stretches(h, doc))
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for i in np.unique(found[:, 0]):
            item = self.items[i]
            m, d = len(item), allowed(len(item))
            rows = found[found[:, 0] == i]
            begin, end = np.searchsorted(doc, rows[:, 1]), np.searchsorted(doc, rows[:, 1], side="right")
            spot = np.unique(np.stack([rows[:, 1], (rows[:, 2] - begin) // m, begin, end], 1), axis=0)
            width = 2 * m + 6 * d
            for some in np.array_split(spot, -(-len(spot) * width // 2_000_000)):
                low = some[:, 2] + some[:, 1] * m - 3 * d
                at = low[:, None] + np.arange(width)
                inside = (at >= some[:, 2:3]) & (at < some[:, 3:4])
                texts = np.where(inside, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
                distance, stop = nearest(item, texts)
                ok = np.flatnonzero(distance <= d)
                if not len(ok):
                    continue
                for x in ok:
                    back, length = nearest(item[::-1], texts[x, : stop[x]][::-1][None, :])
                    key, first = (int(some[x, 0]), int(i)), int(low[x] + stop[x] - length[0] - some[x, 2])
                    got = (int(distance[x]), first, int(low[x] + stop[x] - some[x, 2]))
                    best[key] = min(best.get(key, got), got)
        return [(doc_, self.ids[i], len(self.items[i]), *v) for (doc_, i), v in best.items()]


NAMES = ["doc_id", "item_id", "item_words", "distance", "first_word", "end_word"]
SCHEMA = "doc_id long, item_id long, item_words long, distance long, first_word long, end_word long"


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in blocks of about BLOCK_BYTES, one after another."""
    items = benchmark.select(F.col("item_id").cast("long"), "text").distinct()
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    n = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // BLOCK_BYTES))
    for k in range(n):
        rows = sorted((r[0] if r[0] is not None else -1, r[1] or "", r[0]) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).collect())
        yield Index([r[2] for r in rows], [r[1] for r in rows])


def find(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each item found in each document: its nearest place there, in words."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    out = None
    for index in indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def look(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                ids, found = batch.column("doc_id").to_pylist(), []
                for at, h, doc in _promising(held.value, batch.column("text")):
                    found += [(ids[int(at[r[0]])], *r[1:]) for r in held.value.search(h, doc)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 6, names=NAMES)

        part = docs.mapInArrow(look, SCHEMA)
        out = part if out is None else out.unionAll(part)
    return out


def _promising(index: Index, column: pa.Array, most: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Words of the documents that have a stretch, some at a time: row numbers in the batch, words, document numbers."""
    rows, hs, docs, n, size = [], [], [], 0, 0
    for first, h, doc, _ in words_of(column):
        starts = np.concatenate([*index.stretches(h, doc), np.empty(0, np.int64)])
        own = np.unique(doc[starts])
        if not len(own):
            continue
        keep = np.isin(doc, own)
        rows.append(own + first)
        hs.append(h[keep])
        docs.append(np.searchsorted(own, doc[keep]) + n)
        n += len(own)
        size += len(hs[-1])
        if size > most:
            yield np.concatenate(rows), np.concatenate(hs), np.concatenate(docs)
            rows, hs, docs, n, size = [], [], [], 0, 0
    if rows:
        yield np.concatenate(rows), np.concatenate(hs), np.concatenate(docs)


def keep_clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` in which no item is found, with all their columns."""
    out = docs
    for index in indexes(benchmark):
        held = docs.sparkSession.sparkContext.broadcast(index)

        def only(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                for at, h, doc in _promising(held.value, batch.column("text")):
                    clean[[int(at[r[0]]) for r in held.value.search(h, doc)]] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(only, docs.schema)
    return out
