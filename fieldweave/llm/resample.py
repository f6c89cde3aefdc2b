"""Resampling towards a target: hashed word features, gains by bucket, a seeded weighted draw.

Words come from an untrained ``tokenizers`` pre-tokeniser, a ``Split`` by pattern over the
text with A-Z lowered, as words with offsets.  Windows over the offset pairs give the
features, whose crc32 names a bucket; they are written once, two bytes a feature.  One pass over them counts
the buckets of both corpora (tasks add up their own counts first, so ``buckets`` rows a task are
shuffled), a second sums the gains of each document.  The draw adds Gumbel noise made from the document's id, so it is a
weighted sample without replacement; ranks come from a range-partitioned sort, of which
only the number of rows in each partition is gathered.

Defined results: a null or empty text has no features, weight 0; repeated rows count, are
scored and are drawn each on its own; an empty table gives an empty result; an empty target
has T = 0 and t = 0; a null ``doc_id`` is hashed as an empty one and comes first among ties;
other columns are not read.
"""

from __future__ import annotations

import functools
import itertools
import math
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import shared

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_GAP = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
#: Features whose bucket one task remembers.
CACHE = 300_000
#: Characters of a text taken at once; a longer one is cut behind a character that no word holds.
PIECE = 1 << 19
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


class Featuriser:
    """Buckets of a text's features: all runs of ``least`` to ``most`` consecutive words."""

    def __init__(self, least: int, most: int, buckets: int):
        from tokenizers import Regex, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.least, self.most, self.buckets = least, most, buckets
        self.words = pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str
        self.known: dict[str, int] = {}

    def _new(self, feature: str) -> int:
        if len(self.known) >= CACHE:
            self.known.clear()
        out = self.known[feature] = zlib.crc32(feature.encode()) % self.buckets
        return out

    @staticmethod
    def _windows(words: list[str], first: int, size: int) -> list[str]:
        """Runs of ``size`` words from the word ``first`` on, by offset pairs: from the start of one word to the end of another."""
        joined, ends = " ".join(words), list(itertools.accumulate(map(len, words), lambda end, n: end + 1 + n))
        return [joined[s:e] for s, e in zip([0, *(x + 1 for x in ends)][first:], ends[first + size - 1 :], strict=False)]

    def of(self, text: str) -> tuple[int, np.ndarray]:
        """Number of words, and the bucket of each feature, repeats counted."""
        low = text.encode().translate(_LOWER).decode()
        known, n, held, found = self.known, 0, [], []
        for piece in shared.pieces(low, PIECE, _GAP):
            own = [w for w, _ in self.words(piece)]
            words = held + own  # windows may begin in the piece before
            for size in range(self.least, self.most + 1):
                features = own if size == 1 else self._windows(words, max(0, len(held) - size + 1), size)
                hits = [*map(known.get, features)]
                if None in hits:
                    hits = [self._new(f) if known.get(f) is None else known[f] for f in features]
                found += hits
            n += len(own)
            held = words[max(0, len(words) - self.most + 1) :]
        return n, np.array(found, np.int64)


@functools.lru_cache(4)
def featuriser(least: int, most: int, buckets: int) -> Featuriser:
    """One for each worker process."""
    return Featuriser(least, most, buckets)


def features(docs: DataFrame, least: int = 1, most: int = 1, buckets: int = 10_000) -> DataFrame:
    """``doc_id, n_words, n_features, buckets`` of each document; ``buckets`` are unsigned little-endian integers of 2 or 4 bytes."""
    names, kind = ["doc_id", "n_words", "n_features", "buckets"], _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = featuriser(least, most, buckets)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [f.of(text.as_py() or "") for text in part.column(1)]
                columns = [pa.array([n for n, _ in found], pa.int64()), pa.array([len(x) for _, x in found], pa.int64()), pa.array([x.astype(kind).tobytes() for _, x in found], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_features long, buckets binary")


def _kind(buckets: int) -> str:
    return "<u2" if buckets <= 1 << 16 else "<u4"


def histogram(featured: DataFrame, buckets: int = 10_000) -> np.ndarray:
    """How many features of all texts fall in each bucket; at most ``buckets`` rows are gathered."""
    kind = _kind(buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for data in batch.column(0):
                total += np.bincount(np.frombuffer(data.as_buffer(), kind), minlength=buckets)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled), pa.array(total[filled])], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in featured.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in the target and the source."""
    n, s_all, t_all = len(source), float(source.sum()), float(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weights(featured: DataFrame, gain: np.ndarray) -> DataFrame:
    """``doc_id, n_words, n_features, weight``: the sum of gains over each document's features."""
    names, kind = ["doc_id", "n_words", "n_features", "weight"], _kind(len(gain))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [int(gain[np.frombuffer(data.as_buffer(), kind)].sum()) for data in batch.column(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.int64())], names=names)

    return featured.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, least_words: int = 20, seed: int = 2024, least: int = 1, most: int = 1, buckets: int = 10_000
) -> DataFrame:
    """One row per document: ``doc_id, n_features, weight, score, rank`` (null: not drawn), ``n_words``.

    Of the N documents with ``least_words`` words, the floor(percent * N / 100) of the highest score are drawn.
    """
    own = shared.materialize(features(docs, least, most, buckets))  # texts are cut into words once
    wanted = features(target.select(F.lit(None).cast("long").alias("doc_id"), "text"), least, most, buckets)
    gain = gains(histogram(own, buckets), histogram(wanted, buckets))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h + F.lit(0.5)) / F.lit(4294967296.0))))
    scored = weights(own, gain).withColumn("score", F.col("weight") + noise.cast("long"))
    order = [F.expr(f"n_words >= {least_words}").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("weight"), F.col("n_features")]
    # monotonically_increasing_id is (partition << 33) + place, and partitions are in the order of their ranges
    placed = shared.materialize(
        shared.materialize(scored).repartitionByRange(shared.parts(docs), *order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    )
    split = F.shiftright("at", 33)
    sizes = placed.where(f"n_words >= {least_words}").groupBy(split.alias("part")).count().orderBy("part").collect()  # a row for each partition
    before, total = [], 0
    for r in sizes:
        before.append((r["part"], total))
        total += r["count"]
    offsets = F.broadcast(docs.sparkSession.createDataFrame(before, "part long, before long"))  # as many rows as partitions
    rank = F.expr(f"CASE WHEN n_words >= {least_words} AND before + (at & 8589934591) + 1 <= {percent * total // 100} THEN before + (at & 8589934591) + 1 END").cast("long")
    return placed.withColumn("part", split).join(offsets, "part", "left").select("doc_id", "n_features", "weight", "score", rank.alias("rank"), "n_words")
