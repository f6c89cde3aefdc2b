"""Quality rules: boosted trees over document statistics, scored as numpy node arrays.

:func:`statistics` is one pass over whole texts.  :func:`fit` boosts depth-limited
trees on logistic loss with monotonic constraints on chosen statistics;
:class:`Trees` holds them flattened (feature, threshold, left, right, value), so a
batch is scored by a few gathers for all rows and trees at once.

Defined results: a null text counts as empty (no words, ``base_failed``); repeated
rows are judged alike, each on its own; an empty table gives an empty result; extra
columns are ignored by :func:`judge` and kept by :func:`keep_good`.  Without labels of
both classes no model is fitted and the verdict is that of the base rules.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import shared

#: Rows that the model is fitted on at most; a bound of the classifier's training only.
MAX_TRAINING_ROWS = 20_000
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Statistic -> constraint on the probability of good quality (-1: may only lower it).
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbol_ratio": -1, "dup_line_ratio": -1, "repeat_ratio": -1, "distinct_ratio": 0,
    "upper_ratio": 0, "digit_ratio": 0, "exclaim_ratio": -1, "stop_ratio": 0, "words_per_line": 0, "same_next_ratio": -1,
}
_SYMBOL, _UPPER, _DIGIT, _STOP, _MARK = (np.zeros(256, bool) for _ in range(5))
_SYMBOL[list(SYMBOLS)] = True
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[list(b".,;:?")] = True
_MARK[33] = True


def _pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number below 2^32 for each pair of such numbers, the same for the same pair."""
    return np.unique((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64), return_inverse=True)[1]


def _repeats(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the same (document, key) stands at another place too; keys and documents below 2^32."""
    both = (doc.astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64)
    order = np.argsort(both, kind="stable")
    same = both[order][1:] == both[order][:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def _later(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True where the same (document, key) stands at an earlier place."""
    both = (doc.astype(np.uint64) << np.uint64(32)) | key.astype(np.uint64)
    order = np.argsort(both, kind="stable")
    out = np.zeros(len(key), bool)
    out[order[1:][both[order][1:] == both[order][:-1]]] = True
    return out


def block_statistics(b: shared.Block) -> tuple[np.ndarray, np.ndarray]:
    """Counts (documents x COUNTS) and features (documents x FEATURES)."""
    s, e, doc = b.words()
    per = lambda x, where: np.bincount(where[x] if x.dtype == bool else where, minlength=b.n)
    n_words = np.bincount(doc, minlength=b.n)
    lead = (b.buf & 0xC0) != 0x80
    chars = b.each(lead)
    word_chars = chars - b.each(shared.WHITE[b.buf])
    n_symbols = b.each(_SYMBOL[b.buf])
    h = shared.classes(b.buf, s, e)  # equal where the bytes are

    at = np.flatnonzero(doc[2:] == doc[:-2])
    again = at[_repeats(_pairs(_pairs(h[at], h[at + 1]), h[at + 2]), doc[at])]
    covered = np.zeros(len(h) + 3, bool)
    for k in range(3):
        covered[again + k] = True
    n_repeat = per(covered[: len(h)], doc)

    # lines: cut at \n and at document borders; those with a word count
    cut = np.flatnonzero(b.buf == 10)
    ls = np.union1d(b.offs[:-1][b.offs[1:] > b.offs[:-1]], cut + 1)
    ls = ls[ls < len(b.buf)]
    le = np.append(ls[1:], len(b.buf))
    ldoc = np.searchsorted(b.offs, ls, side="right") - 1
    stop = np.where((le > ls) & (b.buf[np.maximum(le - 1, 0)] == 10), le - 1, le) if len(ls) else le[:0]
    filled = np.searchsorted(s, stop) > np.searchsorted(s, ls) if len(ls) else np.empty(0, bool)
    ls, stop, ldoc = ls[filled], stop[filled], ldoc[filled]
    dup = _later(shared.classes(b.buf, ls, stop), ldoc)
    n_dup, n_lines = per(dup, ldoc), np.bincount(ldoc, minlength=b.n)

    first = ~_later(h, doc)
    same_next = np.zeros(len(h), bool)
    same_next[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    counts = np.stack([n_words, word_chars, n_symbols, n_dup, n_repeat], 1).astype(np.int64)
    words, letters = np.maximum(n_words, 1), np.maximum(word_chars, 1)
    features = np.stack(
        [np.log1p(n_words), word_chars / words, n_symbols / letters, n_dup / np.maximum(n_lines, 1), n_repeat / words, per(first, doc) / words,
         b.each(_UPPER[b.buf]) / letters, b.each(_DIGIT[b.buf]) / letters, b.each(_MARK[b.buf]) / words, b.each(_STOP[b.buf]) / words,
         n_words / np.maximum(n_lines, 1), per(same_next, doc) / words], 1)
    return counts, features


def _batches(batches: Iterator[pa.RecordBatch], key: str, each) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in shared.blocks(batch.column("text")):
            yield each(batch.column(key).slice(b.first, b.n), *block_statistics(b))


# ---------------------------------------------------------------- model
@dataclass
class Trees:
    """Boosted trees as node arrays of shape (trees, nodes); a leaf points to itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row of ``x``."""
        t = np.arange(self.feature.shape[0])[None, :]
        node = np.zeros((len(x), self.feature.shape[0]), np.int64)
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[t, node]] <= self.threshold[t, node], self.left[t, node], self.right[t, node])
        return 1 / (1 + np.exp(-(self.base + self.value[t, node].sum(1))))


def fit(x: np.ndarray, y: np.ndarray, monotone: list[int], trees: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 64, least: int = 10, l2: float = 1.0) -> Trees | None:
    """Second-order boosting on binned features; None without both classes.

    A split on a constrained feature must order its leaf values the right way, and
    what lies below keeps to the middle of the two, which makes the sum monotone.
    A leaf holds ``least`` rows, or a quarter of all where that is less.
    """
    if not len(y) or y.min() == y.max():
        return None
    n, m = x.shape
    least = max(1, min(least, n // 4))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(m)]
    binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], 1)
    base = float(np.log(y.mean() / (1 - y.mean())))
    raw, size = np.full(n, base), 2 ** (depth + 1) - 1
    shape = (trees, size)
    out = Trees(np.zeros(shape, np.int64), np.full(shape, np.inf), np.tile(np.arange(size), (trees, 1)), np.tile(np.arange(size), (trees, 1)), np.zeros(shape), base, depth)
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-9)
        open_nodes = [(0, np.arange(n), -np.inf, np.inf, 0)]
        while open_nodes:
            k, rows, low, high, level = open_nodes.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            best = (1e-6, None)
            for j in range(m if level < depth and len(rows) >= 2 * least else 0):
                width = len(edges[j]) + 1
                if width < 2:
                    continue
                code = binned[rows, j]
                gl, hl, nl = (np.bincount(code, w, width).cumsum()[:-1] for w in (grad[rows], hess[rows], None))
                gr, hr, nr = g - gl, h - hl, len(rows) - nl
                vl, vr = np.clip(-gl / (hl + l2), low, high), np.clip(-gr / (hr + l2), low, high)
                gain = -(gl * vl + 0.5 * (hl + l2) * vl**2) - (gr * vr + 0.5 * (hr + l2) * vr**2)
                v = np.clip(-g / (h + l2), low, high)
                gain += g * v + 0.5 * (h + l2) * v**2
                ok = (nl >= least) & (nr >= least) & ((vr - vl) * monotone[j] >= 0 if monotone[j] else True)
                gain = np.where(ok, gain, -np.inf)
                if len(gain) and gain.max() > best[0]:
                    i = int(gain.argmax())
                    best = (float(gain[i]), (j, i, float(vl[i]), float(vr[i])))
            if best[1] is None:
                out.value[t, k] = rate * np.clip(-g / (h + l2), low, high)
                raw[rows] += out.value[t, k]
                continue
            j, i, vl, vr = best[1]
            goes, mid = binned[rows, j] <= i, (vl + vr) / 2
            lows, highs = (low, low), (high, high)
            if monotone[j]:
                lows, highs = ((low, mid), (mid, high)) if monotone[j] > 0 else ((mid, low), (high, mid))
            out.feature[t, k], out.threshold[t, k], out.left[t, k], out.right[t, k] = j, edges[j][i], 2 * k + 1, 2 * k + 2
            open_nodes += [(2 * k + 1, rows[goes], lows[0], highs[0], level + 1), (2 * k + 2, rows[~goes], lows[1], highs[1], level + 1)]
    return out


def sample_features(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, features and qualities of at most ``max_rows`` labelled documents, by hash order of the id."""
    chosen = (
        labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    names = list(FEATURES)

    def each(ids, counts, features):
        return pa.RecordBatch.from_arrays([ids, *(pa.array(features[:, j]) for j in range(len(names)))], names=["doc_id", *names])

    # at most max_rows ids are broadcast
    own = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_semi")
    rows = own.mapInArrow(lambda it: _batches(it, "doc_id", each), "doc_id long, " + ", ".join(f"{x} double" for x in names))
    got = rows.join(F.broadcast(chosen), "doc_id").toPandas().sort_values(["doc_id", *names], kind="stable")
    return got["doc_id"].to_numpy(), got[names].to_numpy(float), got["quality"].to_numpy(float)


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_TRAINING_ROWS) -> Trees | None:
    _, x, y = sample_features(docs, labels, max_rows)
    return fit(x, y, list(FEATURES.values()))


def base_failed(counts: np.ndarray) -> np.ndarray:
    return (counts[:, 0] < 50) | (100 * counts[:, 4] > 50 * counts[:, 0])


def judge(docs: DataFrame, model: Trees | None, threshold: float = 0.5) -> DataFrame:
    """One row per document: its counts, ``base_failed``, the model's ``score`` and ``kept``."""

    def each(ids, counts, features):
        failed = base_failed(counts)
        score = model.score(features) if model is not None else np.ones(len(counts))
        kept = ~failed & (score >= threshold)
        return pa.RecordBatch.from_arrays(
            [ids, *(pa.array(counts[:, j]) for j in range(5)), pa.array(failed), pa.array(kept), pa.array(score)],
            names=["doc_id", *COUNTS, "base_failed", "kept", "score"],
        )

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lambda it: _batches(it, "doc_id", each), schema)


def keep_good(docs: DataFrame, model: Trees | None, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that the rules and the model keep, with all their columns."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.blocks(batch.column("text")):
                counts, features = block_statistics(b)
                kept = ~base_failed(counts)
                if model is not None:
                    kept &= model.score(features) >= threshold
                yield batch.slice(b.first, b.n).filter(pa.array(kept))

    return docs.mapInArrow(only, docs.schema)
