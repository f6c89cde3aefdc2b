"""What the operators share: intermediate tables, and numpy views of Arrow text.

Texts of an Arrow batch are looked at as one array of UTF-8 bytes with document
offsets, so that word and window hashes of many documents cost a few numpy
passes and no Python loop.  Work arrays are bounded: documents are taken in
blocks of about ``BLOCK`` bytes (a longer document is a block of its own).
"""

from __future__ import annotations

import contextvars
import hashlib
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = 1 << 20
#: Bytes from which a slice is hashed by BLAKE2.
LONG = 256


# ---------------------------------------------------------------- tables
def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def spread(df: DataFrame) -> DataFrame:
    """Deal a table of fewer splits than half the cores (one small file) to more tasks; others stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(min(cores, 32)) if 2 * df.rdd.getNumPartitions() <= cores else df


def scratch(spark: SparkSession) -> str:
    """A fresh folder below the cluster's shared ``spark.checkpoint.dir``.

    The setting is read from the session; only where it is unset in a local
    session, as in tests, a temporary folder is set for it.  On a cluster that is an error,
    as other machines wouldn't see the folder.
    """
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="fieldweave-"))
        base = context.getCheckpointDir()
    return f"{base.rstrip('/')}/fieldweave-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    Cuts the lineage and survives lost executors, as the copy is a file.
    """
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    for made in _open.get():
        made.append(path)
    return out


#: Paths written since a call of :func:`finished` began, for each call around this place; other threads have their own.
_open: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("open", default=())


def finished(make: Callable[[], DataFrame]) -> DataFrame:
    """The DataFrame that ``make`` returns as a table; all tables made on the way are deleted, after an error too."""
    made: list[str] = []
    before = _open.set((*_open.get(), made))
    kept = None
    try:
        out = materialize(make())
        kept = out._scratch_path
    finally:
        _open.reset(before)
        for path in made:
            if path != kept:
                delete(SparkSession.active(), path)
    return out


def discard(df: DataFrame) -> None:
    """Delete a table made by :func:`materialize` once nothing reads it any more."""
    path = getattr(df, "_scratch_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parts(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


# ---------------------------------------------------------------- hashes
_RNG = np.random.default_rng(20240229)
#: A random odd 64-bit value for each byte, and an odd base; fixed by the seed.
BYTE = _RNG.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
_powers = {BASE: np.ones(1, np.uint64), INVERSE: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers[base]
    while len(have) < n:
        have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
    if len(have) <= 8 * BLOCK:  # those of a very long text aren't kept
        _powers[base] = have
    return have[:n]


def prefix(buf: np.ndarray) -> np.ndarray:
    """Prefix sums that give the polynomial hash of any slice; one longer than ``buf``."""
    return _prefix(BYTE[buf])


def _prefix(values: np.ndarray) -> np.ndarray:
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * _power(BASE, len(values)), out=out[1:])
    return out


def prefix_of_fours(buf: np.ndarray) -> np.ndarray:
    """As :func:`prefix`, of what a finaliser makes of each four bytes: not a polynomial in the bytes.  A slice ends three earlier."""
    fours = np.zeros(len(buf), np.uint64)
    for k in range(4):
        fours[: len(buf) - 3] |= buf[k : len(buf) - 3 + k].astype(np.uint64) << np.uint64(8 * k)
    return _prefix(mix(fours + np.uint64(INVERSE)))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public-domain constants of MurmurHash3)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each slice ``[start, end)``: equal bytes, equal hash, wherever they stand."""
    inv = _power(INVERSE, len(sums))
    return mix((sums[end] - sums[start]) * inv[start] + (end - start).astype(np.uint64))


def names(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of slices that don't overlap much, such as words or texts.

    Short ones by :func:`slices`; a polynomial modulo 2^64 has families of equal strings of a
    thousand bytes and more (whatever its base), so those of ``LONG`` bytes are hashed by BLAKE2.
    """
    out = slices(prefix(buf), start, end)
    for i in np.flatnonzero(end - start >= LONG):
        out[i] = int.from_bytes(hashlib.blake2b(buf[start[i] : end[i]], digest_size=8).digest(), "little")
    return out


def classes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A number for each slice, the same for two slices exactly if their bytes are the same.

    Slices are sorted by their hash, and neighbours of one hash are compared byte by byte;
    where a hash has slices of different bytes, those are told apart one by one.
    """
    h = names(buf, start, end)
    order = np.argsort(h, kind="stable")
    same = h[order[1:]] == h[order[:-1]]
    a, b = order[:-1][same], order[1:][same]
    differ = end[a] - start[a] != end[b] - start[b]
    at, size = 0, np.minimum(end[a] - start[a], end[b] - start[b])
    upto = np.concatenate([[0], np.cumsum(size)])
    while at < len(a):  # a bounded number of bytes at once
        stop = max(at + 1, int(np.searchsorted(upto, upto[at] + BLOCK, side="right")) - 1)
        n = size[at:stop]
        place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        wrong = buf[np.repeat(start[a[at:stop]], n) + place] != buf[np.repeat(start[b[at:stop]], n) + place]
        differ[at:stop] |= np.bincount(np.repeat(np.arange(stop - at), n)[wrong], minlength=stop - at) > 0
        at = stop
    number = np.concatenate([np.zeros(min(len(h), 1), np.int64), np.cumsum(~same)])
    out = np.empty(len(h), np.int64)
    out[order] = number
    for clash in np.unique(h[b[differ]]):
        known: dict[bytes, int] = {}
        for i in np.flatnonzero(h == clash):
            out[i] = known.setdefault(buf[start[i] : end[i]].tobytes(), len(h) + int(i))
    return out


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)


# ---------------------------------------------------------------- texts
WHITE = np.zeros(256, bool)
WHITE[[32, 9, 10, 11, 12, 13]] = True


class Block:
    """Some documents as one byte array: ``buf``, with ``offs[i]:offs[i + 1]`` the i-th."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, first: int):
        self.buf, self.offs, self.first = buf, offs, first
        self.n = len(offs) - 1

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and document numbers of the words ``[^\\x20\\x09-\\x0D]+``."""
        inside = ~WHITE[self.buf]
        cut = np.zeros(len(self.buf) + 1, bool)
        cut[self.offs] = True
        if not len(self.buf):
            return (np.empty(0, np.int64),) * 3
        starts = inside.copy()
        starts[1:] &= ~inside[:-1] | cut[1:-1]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | cut[1:-1]
        s = np.flatnonzero(starts)
        return s, np.flatnonzero(ends) + 1, np.searchsorted(self.offs, s, side="right") - 1

    def each(self, flags: np.ndarray) -> np.ndarray:
        """Sum of per-byte flags for each document."""
        total = np.zeros(len(self.buf) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offs[1:]] - total[self.offs[:-1]]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column (null: empty)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[offs[0] : offs[-1]] if data is not None else np.empty(0, np.uint8)
    return buf, offs - offs[0]


def blocks(column: pa.Array, size: int = BLOCK) -> Iterator[Block]:
    buf, offs = flat(column)
    i, n = 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + size, side="right")) - 1)
        yield Block(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], i)
        i = j


def pieces(text: str, size: int, gap) -> Iterator[str]:
    """A text in parts of about ``size`` characters, each cut behind a match of ``gap``; where none follows, the rest is one part."""
    at = 0
    while len(text) - at > size and (found := gap.search(text, at + size - 1)):
        yield text[at : found.end()]
        at = found.end()
    yield text[at:] if at else text


def windows(h: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of ``n`` words within one document, and the run's first word."""
    m = len(h) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = out * np.uint64(BASE) + h[k : k + m]
    at = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return mix(out[at]), at
