"""Exact repeated-substring removal by prefix-free parsing, distributed over triggers.

A byte is removed if a string of ``LENGTH`` bytes that covers it also starts earlier
(smaller doc_id, or same document and earlier start).

*Parse.*  A rolling hash is taken of each ``GRAM``-byte string.  The trigger of a window
of LENGTH bytes is its gram of least hash (the leftmost on ties), so equal windows have
equal triggers at equal offsets.  Consecutive window starts with one trigger form a
phrase; its string is all that these windows can cover, from LENGTH - GRAM bytes before
the trigger to LENGTH bytes after its start, cut at the document's borders.

*Dictionary.*  A first pass counts the phrases of each trigger (:func:`count_triggers`).  Those of an
ordinary trigger are dealt by it; those of a hot one, which would make up a good part of
a bucket, are dealt by the phrase, so no trigger gathers in one task.  Of equal phrases (128
bits of two hashes of the whole phrase, beside the trigger's 64) all but the earliest
repeat whole.  This is done within each map task first, so that copies meet as one row per
task.  A trigger with one distinct phrase is settled.  Only where several distinct phrases
share a trigger are their bytes fetched.

*Suffix arrays.*  The distinct phrases of an ordinary trigger are sorted twice: by what
follows the trigger's start, and by what precedes it read backwards.  With the common-prefix
lengths of neighbours, the window that begins k bytes before the trigger has a class in
each order for every k; both classes equal means equal windows.  Within a pair of classes
the corpus order of the parse (doc_id, start) tells the earliest; the others repeat.  The
suffixes of a hot trigger's phrases are dealt by their first LENGTH bytes, whatever their
trigger, and sorted with the corpus order behind them: neighbours that share LENGTH bytes are
equal windows, the first of them the earliest.  Each map task sends the earliest of its
equal windows only, so neither the trigger nor a very common window gathers.

Rows travel as packed binary blobs (one per task and bucket).  The number of buckets
follows from the bytes of all texts (``BUCKET_BYTES``), so a task's memory doesn't grow with them.

Defined results: a null or empty text has no bytes and removes nothing; rows that repeat
doc_id and text are one document (each gets the same result); rows with one doc_id and
different texts are ordered by a hash of the text; a null doc_id comes first; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import shared

LENGTH, GRAM = 100, 32
REACH = LENGTH - GRAM
#: Bytes of a document parsed at once, and rows a map task holds before it sends them.
PIECE, HELD = 1 << 22, 1 << 20
NULL_ID = -(1 << 63)
#: Bytes of text for each bucket, and the least number of a hot trigger's phrases.
BUCKET_BYTES, HOT = 1 << 25, 1_000
#: Triggers with more than one part in this many of a bucket's phrases are hot.
HOT_SHARE = 4
_LOW = np.uint64((1 << 24) - 1)
SCHEMA = "bucket int, kind int, data binary"
PHRASES, HOT_PHRASES, REQUESTS, HOT_REQUESTS, RANGES, TEXTS, CONTEXTS, WINDOWS = range(8)
LAYOUT = {
    PHRASES: {"g": "<u8", "f": "<u8", "f2": "<u8", "doc": "<i8", "t": "<u8", "at": "<u4", "lo": "u1", "hi": "u1"},
    HOT_PHRASES: {"g": "<u8", "f": "<u8", "f2": "<u8", "doc": "<i8", "t": "<u8", "at": "<u4", "lo": "u1", "hi": "u1"},
    REQUESTS: {"g": "<u8", "doc": "<i8", "t": "<u8", "at": "<u4", "lo": "u1", "hi": "u1"},
    HOT_REQUESTS: {"g": "<u8", "doc": "<i8", "t": "<u8", "at": "<u4", "lo": "u1", "hi": "u1"},
    RANGES: {"doc": "<i8", "t": "<u8", "start": "<u4", "stop": "<u4"},
}


# ---------------------------------------------------------------- parse
def triggers(buf: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """Place of the trigger of the window that starts at each byte."""
    n = len(buf) - GRAM + 1
    at = np.arange(n, dtype=np.uint64)
    least = (shared.slices(sums, np.arange(n), np.arange(GRAM, n + GRAM)) & ~_LOW) | at
    step, width = 1, REACH + 1
    while 2 * step <= width:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    return (np.minimum(least[: len(least) - (width - step)], least[width - step :]) & _LOW).astype(np.int64)


def phrases(buf: np.ndarray, offs: np.ndarray, both: bool = True) -> dict[str, np.ndarray]:
    """Phrases of the documents ``buf[offs[i]:offs[i + 1]]`` (under 16 MB together); one of the two hashes unless ``both``."""
    empty = {k: np.empty(0, np.uint64 if k in ("g", "f", "f2") else np.int64) for k in ("row", "trigger", "first", "last", "g", "f", "f2")}
    if len(buf) < LENGTH:
        return empty
    sums = shared.prefix(buf)
    place = triggers(buf, sums)
    change = np.zeros(len(buf) + 2, np.int64)
    long = np.diff(offs) >= LENGTH
    np.add.at(change, offs[:-1][long], 1)
    np.add.at(change, offs[1:][long] - LENGTH + 1, -1)
    valid = np.flatnonzero(np.cumsum(change[: len(place)]))
    if not len(valid):
        return empty
    own = place[valid]
    begins = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    trigger, first = own[begins], valid[begins]
    last = valid[np.append(begins[1:], len(valid)) - 1]
    row = np.searchsorted(offs, first, side="right") - 1
    left, right = np.maximum(offs[row], trigger - REACH), np.minimum(offs[row + 1], trigger + LENGTH)
    return {
        "row": row, "trigger": trigger, "first": first, "last": last,
        "g": shared.slices(sums, trigger, trigger + GRAM),
        "f": shared.mix(shared.slices(sums, left, right) + (trigger - left).astype(np.uint64)),
        "f2": shared.slices(shared.prefix_of_fours(buf), left, right - 3) if both else np.zeros(len(row), np.uint64),
    }


def parse(buf: np.ndarray, offs: np.ndarray, both: bool = True) -> Iterator[dict[str, np.ndarray]]:
    """Phrases with trigger, first and last counted from the document's first byte."""
    if len(buf) <= PIECE:
        p = phrases(buf, offs, both)
        yield p | {k: p[k] - offs[p["row"]] for k in ("trigger", "first", "last")}
        return
    # one long document: pieces that end with a whole phrase, with what their phrases can cover around them
    start, n = 0, len(buf)
    while n - start >= LENGTH:
        low, high = max(0, start - REACH), min(n, start + PIECE + 2 * LENGTH)
        p = phrases(buf[low:high], np.array([0, high - low]), both)
        p |= {k: p[k] + low for k in ("trigger", "first", "last")}
        mine = p["last"] >= start
        if high < n:  # the last phrases may go on, or their strings be cut
            mine &= (p["trigger"] + LENGTH <= high) & (p["last"] < high - LENGTH)
        p = {k: v[mine] for k, v in p.items()}
        p["first"] = np.maximum(p["first"], start)
        yield p
        start = int(p["last"].max()) + 1 if high < n else n


# ---------------------------------------------------------------- blobs
def pack(kind: int, cols: dict[str, np.ndarray]) -> bytes:
    return b"".join(np.ascontiguousarray(cols[k], dtype=v).tobytes() for k, v in LAYOUT[kind].items())


def unpack(kind: int, data: bytes) -> dict[str, np.ndarray]:
    layout = {k: np.dtype(v) for k, v in LAYOUT[kind].items()}
    n, at, out = len(data) // sum(d.itemsize for d in layout.values()), 0, {}
    for k, d in layout.items():
        out[k] = np.frombuffer(data, d, n, at)
        at += n * d.itemsize
    return out


def join(found: list[dict[str, np.ndarray]], kind: int) -> dict[str, np.ndarray]:
    return {k: np.concatenate([x[k] for x in found]) if found else np.empty(0, v) for k, v in LAYOUT[kind].items()}


def _owner(doc: np.ndarray, t: np.ndarray, n: int) -> np.ndarray:
    return (shared.mix(doc.astype(np.int64).view(np.uint64) ^ shared.mix(t.astype(np.uint64))) % np.uint64(n)).astype(np.int64)


def dealt(kind: int, cols: dict[str, np.ndarray], to: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """One blob for each bucket in ``to``."""
    order = np.argsort(to, kind="stable")
    edges = np.flatnonzero(np.diff(to[order])) + 1
    for part in np.split(order, edges) if len(order) else ():
        yield int(to[part[0]]), kind, pack(kind, {k: v[part] for k, v in cols.items()})


def _sent(rows: Iterator[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[2])
        if size > 1 << 23:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "data"])


def _received(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        kinds = batch.column(1).to_pylist()
        for i, kind in enumerate(kinds):
            yield kind, batch.column(2)[i].as_py()


def texts(batch: pa.RecordBatch) -> Iterator[tuple[shared.Block, np.ndarray, np.ndarray]]:
    """Blocks of the batch with ids and text hashes of their documents."""
    ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy()
    for b in shared.blocks(batch.column("text")):
        yield b, ids[b.first : b.first + b.n], shared.names(b.buf, b.offs[:-1], b.offs[1:])


# ---------------------------------------------------------------- steps
def settle(p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the phrases by trigger, phrase and place; which are the earliest of their kind; which repeat."""
    order = np.lexsort((p["at"], p["t"], p["doc"], p["f2"], p["f"], p["g"]))
    g, f, f2, doc, t, at = (p[k][order] for k in ("g", "f", "f2", "doc", "t", "at"))
    same = np.zeros(len(g), bool)
    same[1:] = (g[1:] == g[:-1]) & (f[1:] == f[:-1]) & (f2[1:] == f2[:-1])
    again = same.copy()  # a row met twice is not a repeat of itself
    again[1:] &= (doc[1:] == doc[:-1]) & (t[1:] == t[:-1]) & (at[1:] == at[:-1])
    begin = np.maximum.accumulate(np.where(~same, np.arange(len(g)), 0))
    itself = same & (doc == doc[begin]) & (t == t[begin]) & (at == at[begin])
    return order, ~same, same & ~itself & ~again


def as_ranges(p: dict[str, np.ndarray], which: np.ndarray) -> dict[str, np.ndarray]:
    """Window starts of phrases, half open."""
    at = p["at"][which].astype(np.int64)
    return {"doc": p["doc"][which], "t": p["t"][which], "start": at - p["hi"][which], "stop": at - p["lo"][which] + 1}


def count_triggers(docs: DataFrame, parts: int, limit: int | None = None) -> tuple[int, np.ndarray]:
    """The number of buckets, and the hot triggers.

    A map task counts the distinct phrases of each trigger in every HELD phrases and tells
    of triggers with two or more.  So sums fall short of a trigger's phrases by one for each
    HELD phrases of the corpus at most.  A hot trigger has more than its share of a bucket,
    so there are less than HOT_SHARE for each bucket: what reaches the driver grows with
    the number of buckets only.  Another ``limit`` than that share may be given.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, n_bytes, total = [], 0, 0, 0

        def several() -> pa.RecordBatch:
            both = np.unique(np.concatenate(held)) if held else np.empty(0, _PAIR)
            g, n = np.unique(both["g"], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(shared.signed(g[n > 1])), pa.array(n[n > 1])], names=["g", "n"])

        for batch in batches:
            for b, _, _ in texts(batch):
                n_bytes += len(b.buf)
                for p in parse(b.buf, b.offs, both=False):
                    own = np.empty(len(p["g"]), _PAIR)
                    own["g"], own["f"] = p["g"], p["f"]
                    held.append(own)
                    size += len(own)
                if size > HELD:
                    yield several()
                    held, size, total = [], 0, total + size
        yield several()
        yield pa.RecordBatch.from_arrays([pa.array([None, None], pa.int64()), pa.array([n_bytes, -total - size])], names=["g", "n"])

    rows = shared.materialize(docs.mapInArrow(count, "g long, n long"))
    whole = rows.where("g is null").agg(F.sum(F.greatest("n", F.lit(0))).alias("bytes"), F.sum(-F.least("n", F.lit(0))).alias("phrases")).first()
    n = max(parts, -(-(whole["bytes"] or 0) // BUCKET_BYTES))
    limit = max(HOT, (whole["phrases"] or 0) // (HOT_SHARE * n)) if limit is None else limit
    hot = rows.where("g is not null").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") > limit).select("g").toPandas()["g"].to_numpy(np.int64)
    shared.discard(rows)
    return n, np.sort(hot.view(np.uint64))


_PAIR = np.dtype([("g", "<u8"), ("f", "<u8")])


def _parse_step(batches: Iterator[pa.RecordBatch], n: int, hot: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    held, size = [], 0

    def send():
        p = join(held, PHRASES)
        order, first, repeat = settle(p)
        own = {k: v[order[first]] for k, v in p.items()}
        salted = np.isin(own["g"], hot)
        for kind, which, by in ((PHRASES, ~salted, "g"), (HOT_PHRASES, salted, "f")):
            some = {k: v[which] for k, v in own.items()}
            yield from dealt(kind, some, (some[by] % np.uint64(n)).astype(np.int64))
        r = as_ranges(p, order[repeat])
        yield from dealt(RANGES, r, _owner(r["doc"], r["t"], n))

    for batch in batches:
        for b, ids, t in texts(batch):
            for p in parse(b.buf, b.offs):
                row = p["row"]
                held.append({
                    "g": p["g"].astype("<u8"), "f": p["f"].astype("<u8"), "f2": p["f2"].astype("<u8"), "doc": ids[row], "t": t[row], "at": p["trigger"].astype("<u4"),
                    "lo": (p["trigger"] - p["last"]).astype("u1"), "hi": (p["trigger"] - p["first"]).astype("u1"),
                })
                size += len(row)
            if size > HELD:
                yield from send()
                held, size = [], 0
    if held:
        yield from send()


def _dictionary_step(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, bytes]]:
    found = {PHRASES: [], HOT_PHRASES: []}
    for kind, data in _received(batches):
        if kind == RANGES:  # on their way to the documents
            r = unpack(RANGES, data)
            yield from dealt(RANGES, r, _owner(r["doc"], r["t"], n))
        else:
            found[kind].append(unpack(kind, data))
    for kind, ask in ((PHRASES, REQUESTS), (HOT_PHRASES, HOT_REQUESTS)):
        p = join(found.pop(kind), kind)
        order, first, repeat = settle(p)
        r = as_ranges(p, order[repeat])
        yield from dealt(RANGES, r, _owner(r["doc"], r["t"], n))
        rep = order[first]
        if kind == PHRASES:  # others of the trigger are in this bucket too
            g = p["g"][rep]
            several = np.zeros(len(g), bool)
            if len(g) > 1:
                several[1:] = g[1:] == g[:-1]
                several[:-1] |= several[1:]
            rep = rep[several]
        own = {k: p[k][rep] for k in LAYOUT[ask]}
        yield from dealt(ask, own, _owner(own["doc"], own["t"], n))


def _text_step(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, bytes]]:
    """Documents as compressed blobs, dealt by owner."""
    held: dict[int, list] = {}
    size, squeeze = 0, zstandard.ZstdCompressor(level=1).compress

    def send():
        for bucket, docs in held.items():
            lengths = np.array([len(x[2]) for x in docs], "<i8")
            head = np.array([len(docs)], "<i8").tobytes() + np.array([x[0] for x in docs], "<i8").tobytes() + np.array([x[1] for x in docs], "<u8").tobytes() + lengths.tobytes()
            yield bucket, TEXTS, squeeze(head + b"".join(x[2] for x in docs))
        held.clear()

    for batch in batches:
        for b, ids, t in texts(batch):
            to = _owner(ids, t, n)
            data = b.buf.tobytes()
            for i in range(b.n):
                held.setdefault(int(to[i]), []).append((int(ids[i]), int(t[i]), data[b.offs[i] : b.offs[i + 1]]))
            size += len(data)
            if size > 1 << 24:
                yield from send()
                size = 0
    yield from send()


def _opened(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    data = zstandard.ZstdDecompressor().decompress(data)
    m = int(np.frombuffer(data, "<i8", 1)[0])
    ids, t, lengths = np.frombuffer(data, "<i8", m, 8), np.frombuffer(data, "<u8", m, 8 + 8 * m), np.frombuffer(data, "<i8", m, 8 + 16 * m)
    at = 8 + 24 * m
    for i in range(m):
        yield int(ids[i]), int(t[i]), data[at : at + int(lengths[i])]
        at += int(lengths[i])


class _ByDocument:
    """Columns grouped by (doc, t)."""

    def __init__(self, cols: dict[str, np.ndarray]):
        order = np.lexsort((cols["t"], cols["doc"]))
        self.cols = {k: v[order] for k, v in cols.items()}
        doc, t = self.cols["doc"], self.cols["t"]
        begin = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (t[1:] != t[:-1])])) if len(doc) else np.empty(0, np.int64)
        end = np.append(begin[1:], len(doc))[: len(begin)]
        self.at = {(int(doc[i]), int(t[i])): (int(i), int(j)) for i, j in zip(begin, end, strict=True)}

    def of(self, doc: int, t: int) -> slice | None:
        span = self.at.get((doc, t))
        return slice(*span) if span else None


def windows_of(text: bytes, asked: dict[str, np.ndarray]) -> np.ndarray:
    """The windows of the asked phrases of one document: bytes, then doc, text hash and start, so that they sort by bytes and corpus order."""
    count = asked["hi"].astype(np.int64) - asked["lo"] + 1
    row = np.repeat(np.arange(len(count)), count)
    k = asked["lo"].astype(np.int64)[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    start = asked["at"].astype(np.int64)[row] - k
    out = np.empty((len(row), LENGTH + 20), np.uint8)
    out[:, :LENGTH] = np.frombuffer(text, np.uint8)[start[:, None] + np.arange(LENGTH)]
    place = ((asked["doc"][row].astype(np.int64).view(np.uint64) ^ _SIGN, ">u8", LENGTH), (asked["t"][row], ">u8", LENGTH + 8), (start, ">u4", LENGTH + 16))
    for value, kind, at in place:
        size = np.dtype(kind).itemsize
        out[:, at : at + size] = value.astype(kind).view(np.uint8).reshape(-1, size)
    return out


_SIGN = np.uint64(1 << 63)


def neighbours(rows: np.ndarray) -> np.ndarray:
    """Which of the ordered windows share LENGTH bytes with the one before."""
    same = np.zeros(len(rows), bool)
    same[1:] = (rows[1:, :LENGTH] == rows[:-1, :LENGTH]).all(1)
    return same


def in_order(rows: np.ndarray) -> np.ndarray:
    """Windows in order of their bytes and of the corpus."""
    return rows[np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")]


def _repeated(rows: np.ndarray, n: int) -> Iterator[tuple[int, int, bytes]]:
    """Ranges of windows."""
    column = lambda at, kind: np.ascontiguousarray(rows[:, at : at + np.dtype(kind).itemsize]).view(kind).ravel()
    start = column(LENGTH + 16, ">u4").astype(np.int64)
    doc = (column(LENGTH, ">u8").astype(np.uint64) ^ _SIGN).view(np.int64)
    r = {"doc": doc, "t": column(LENGTH + 8, ">u8").astype(np.uint64), "start": start, "stop": start + 1}
    yield from dealt(RANGES, r, _owner(r["doc"], r["t"], n))


def _by_window(rows: np.ndarray, n: int) -> np.ndarray:
    """A bucket for each window, from its LENGTH bytes."""
    words = np.zeros((len(rows), -(-LENGTH // 8) * 8), np.uint8)
    words[:, :LENGTH] = rows[:, :LENGTH]
    h = np.zeros(len(rows), np.uint64)
    for column in words.view("<u8").T:
        h = shared.mix(h * np.uint64(shared.BASE) + column)
    return (h % np.uint64(n)).astype(np.int64)


def _context_step(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, bytes]]:
    """Bytes around the triggers that were asked for, windows of hot ones; requests come before texts."""
    asked, by, done = {REQUESTS: [], HOT_REQUESTS: []}, None, set()
    held, size, hot, hot_size = [], 0, [], 0

    def send():
        cols = {k: np.concatenate([x[0][k] for x in held]) for k in LAYOUT[REQUESTS]}
        around = np.concatenate([x[1] for x in held])
        to = (cols["g"] % np.uint64(n)).astype(np.int64)
        for bucket in np.unique(to):
            part = np.flatnonzero(to == bucket)
            body = pack(REQUESTS, {k: v[part] for k, v in cols.items()})
            yield int(bucket), CONTEXTS, np.array([len(part)], "<i8").tobytes() + body + around[part].tobytes()

    def send_windows():
        w = in_order(np.concatenate(hot))
        again = neighbours(w)
        own = w[~again]
        to = _by_window(own, n)
        order = np.argsort(to, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(to[order])) + 1):
            yield int(to[part[0]]), WINDOWS, own[part].tobytes()
        yield from _repeated(w[again], n)

    for kind, data in _received(batches):
        if kind in asked:
            asked[kind].append(unpack(kind, data))
            continue
        if by is None:
            by = {k: _ByDocument(join(v, k)) for k, v in asked.items()}
        for doc, t, text in _opened(data):
            spans = {k: v.of(doc, t) for k, v in by.items()}
            if not any(spans.values()) or (doc, t) in done:
                continue
            done.add((doc, t))
            own = {k: {c: v[spans[k]] for c, v in by[k].cols.items()} for k in by if spans[k]}
            if HOT_REQUESTS in own:
                hot.append(windows_of(text, own[HOT_REQUESTS]))
                hot_size += len(hot[-1])
            if REQUESTS in own:
                # bytes plus one, zero where the document has none
                wide = np.zeros(len(text) + REACH + LENGTH, np.uint8)
                wide[REACH : REACH + len(text)] = np.frombuffer(text, np.uint8) + np.uint8(1)
                held.append((own[REQUESTS], wide[own[REQUESTS]["at"].astype(np.int64)[:, None] + np.arange(REACH + LENGTH)]))
                size += len(held[-1][1])
            if size > 1 << 16:
                yield from send()
                held, size = [], 0
            if hot_size > HELD // 8:
                yield from send_windows()
                hot, hot_size = [], 0
    if held:
        yield from send()
    if hot:
        yield from send_windows()


def _sorted_classes(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of equally long byte rows, and how much each shares with the one before."""
    text = np.ascontiguousarray(rows)
    order = np.argsort(text.view(f"S{rows.shape[1]}").ravel(), kind="stable")
    ordered = text[order]
    differs = ordered[1:] != ordered[:-1]
    shared_len = np.where(differs.any(1), differs.argmax(1), rows.shape[1])
    return order, np.concatenate([[-1], shared_len])


def repeated_windows(cols: dict[str, np.ndarray], around: np.ndarray) -> np.ndarray:
    """For each phrase and each k: does the window k bytes before the trigger start earlier elsewhere too?"""
    n = len(around)
    right_order, right_lcp = _sorted_classes(around[:, REACH:])
    left_order, left_lcp = _sorted_classes(around[:, :REACH][:, ::-1]) if REACH else (np.arange(n), np.full(n, REACH))
    place = np.lexsort((cols["at"], cols["t"], cols["doc"]))
    corpus = np.empty(n, np.int64)
    corpus[place] = np.arange(n)
    out = np.zeros((n, REACH + 1), bool)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for k in range(REACH + 1):
        own = np.flatnonzero((cols["lo"] <= k) & (k <= cols["hi"]))
        if len(own) < 2:
            continue
        left_class[left_order] = np.cumsum(left_lcp < k)
        right_class[right_order] = np.cumsum(right_lcp < LENGTH - k)
        key = left_class[own] * (n + 1) + right_class[own]
        order = np.lexsort((corpus[own], key))
        same = key[order][1:] == key[order][:-1]
        out[own[order[1:][same]], k] = True
    return out


def _suffix_step(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[int, int, bytes]]:
    cols, around, windows = [], [], []
    for kind, data in _received(batches):
        if kind == RANGES:  # on their way to the documents
            r = unpack(RANGES, data)
            yield from dealt(RANGES, r, _owner(r["doc"], r["t"], n))
            continue
        if kind == WINDOWS:
            windows.append(np.frombuffer(data, np.uint8).reshape(-1, LENGTH + 20))
            continue
        m = int(np.frombuffer(data, "<i8", 1)[0])
        body = len(data) - 8 - m * (REACH + LENGTH)
        cols.append(unpack(REQUESTS, data[8 : 8 + body]))
        around.append(np.frombuffer(data, np.uint8, offset=8 + body).reshape(m, REACH + LENGTH))
    if windows:
        w = in_order(np.concatenate(windows))
        yield from _repeated(w[neighbours(w)], n)
    if not cols:
        return
    cols = join(cols, REQUESTS)
    found = repeated_windows(cols, np.concatenate(around))
    i, k = np.nonzero(found)
    at = cols["at"].astype(np.int64)[i] - k
    r = {"doc": cols["doc"][i], "t": cols["t"][i], "start": at, "stop": at + 1}
    # neighbouring windows of a phrase as one range: k falls as the start rises
    joins = np.zeros(len(i), bool)
    joins[1:] = (i[1:] == i[:-1]) & (k[1:] == k[:-1] + 1)
    begin = np.flatnonzero(~joins)
    end = np.append(begin[1:], len(i)) - 1
    if len(i):
        r = {"doc": r["doc"][begin], "t": r["t"][begin], "start": r["start"][end], "stop": r["stop"][begin]}
    yield from dealt(RANGES, r, _owner(r["doc"], r["t"], n))


def removed(length: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Bytes covered by a window that starts in one of the ranges."""
    change = np.zeros(length + 1, np.int64)
    np.add.at(change, start.astype(np.int64), 1)
    np.add.at(change, stop.astype(np.int64) + LENGTH - 1, -1)
    return np.cumsum(change[:-1]) > 0


def _removal_step(batches: Iterator[pa.RecordBatch], each) -> Iterator:
    """Calls ``each(doc_id, bytes, mask of removed bytes)`` for every document; ranges come before texts."""
    ranges, by = [], None
    for kind, data in _received(batches):
        if kind == RANGES:
            ranges.append(unpack(RANGES, data))
            continue
        if by is None:
            by = _ByDocument(join(ranges, RANGES))
            ranges.clear()
        for doc, t, text in _opened(data):
            span = by.of(doc, t)
            gone = np.zeros(len(text), bool) if span is None else removed(len(text), by.cols["start"][span], by.cols["stop"][span])
            yield each(None if doc == NULL_ID else doc, text, gone)


# ---------------------------------------------------------------- operator
def _run(df: DataFrame, step, n: int) -> DataFrame:
    return df.mapInArrow(lambda it: _sent(step(it, n)), SCHEMA)


def _deal(df: DataFrame, n: int) -> DataFrame:
    return df.repartitionById(n, F.col("bucket"))


def _with_removals(docs: DataFrame, each, names: list[str], types: list[pa.DataType], schema: str, hot: int | None = None) -> DataFrame:
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    n, triggers_ = count_triggers(docs, shared.parts(docs), hot)
    phrases_ = _run(docs, functools.partial(_parse_step, hot=triggers_), n)
    settled = shared.materialize(_run(_deal(phrases_, n), _dictionary_step, n))
    packed = _run(docs, _text_step, n)
    asked = _deal(settled.where(F.col("kind").isin(REQUESTS, HOT_REQUESTS)).unionAll(packed), n).sortWithinPartitions("kind")
    sorted_ = _run(_deal(_run(asked, _context_step, n), n), _suffix_step, n)
    all_ranges = settled.where(F.col("kind") == RANGES).unionAll(sorted_).unionAll(packed)

    def finish(batches):
        held = []
        for row in _removal_step(batches, each):
            held.append(row)
            if len(held) == 500:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held = []
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    return _deal(all_ranges, n).sortWithinPartitions("kind").mapInArrow(finish, schema)


def spans_of(gone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of removed bytes."""
    edge = np.diff(np.concatenate([[0], gone.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """``doc_id, starts, ends``: the maximal runs of repeated bytes of every document."""

    def each(doc, text, gone):
        return (doc, *spans_of(gone))

    types = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())]
    return shared.finished(lambda: _with_removals(docs, each, ["doc_id", "starts", "ends"], types, "doc_id long, starts array<long>, ends array<long>"))


def digests(docs: DataFrame, hot: int | None = None) -> DataFrame:
    """Per document what was removed, and a digest of the bytes that remain."""

    def each(doc, text, gone):
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        return doc, len(text), int(gone.sum()), len(spans_of(gone)[0]), hashlib.sha256(kept).hexdigest()

    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    return shared.finished(lambda: _with_removals(docs, each, names, types, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", hot))
