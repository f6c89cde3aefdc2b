"""Near copies by consistent weighted sampling over TF-IDF shingles.

A document is the weighted set of its five-word shingles (lower case, words between
white space; a shorter text is one shingle).  The weight of a shingle is how often it
occurs times the inverse document frequency of its rarest word, scaled to 1..2.
Document frequencies are counted exactly, word by word, over all documents.  Words that
less than one in ``RARE`` documents holds (or one document alone) all have the largest
weight, so only the others are looked up: their number is at most RARE times the mean number of distinct words of
a document, whatever the number of documents, and weights follow shares of the corpus,
not its size.

Improved consistent weighted sampling draws ``BANDS * ROWS`` samples of each document:
two documents agree in a sample with the probability of their weighted Jaccard
similarity.  Documents that agree in a whole band are candidates; every candidate is
verified on its exact weighted sets at ``THRESHOLD``; links make classes.

Texts with equal word sequences are one node from the start.  The members of a band's
bucket are verified together, as one unit, without making pairs of rows; a unit is
compared from one member to all others at once, and only across what isn't linked yet,
which finds exactly the components of all pairs.  A bucket of more than ``UNIT`` texts
or ``UNIT_BYTES`` is dealt into several units that all hold the bucket's first text.  If that
leaves its texts in several classes, the pairs that no unit held are looked for exactly:
of two texts as similar as THRESHOLD, the rarest shingles that make up just over
1 - THRESHOLD of their weights have one in common (prefix filter, rarest in the bucket
first).  Texts meet again by these shingles; where such a group is still too large for one
unit, every two of its parts meet.  Groups whose texts are one class by then are left out.

Defined results: null, empty and blank texts have equal (empty) word sequences and so are
one class; rows that share a doc_id are one document; rows with a null doc_id are left
out of classes (:func:`classes`) and kept as they are by :func:`keep_one`; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.llm import shared
from fieldweave.llm.components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 8, 3
RARE = 10_000
UNIT, UNIT_BYTES = 1024, 1 << 24


# ---------------------------------------------------------------- weighted sets
def _lower(batch: pa.RecordBatch) -> pa.Array:
    return pc.utf8_lower(batch.column("text"))


def _words(b: shared.Block) -> tuple[np.ndarray, np.ndarray]:
    s, e, doc = b.words()
    return shared.names(b.buf, s, e), doc


class Weights:
    """Weights of words by their hash: a sorted table, and 2 for all words that aren't in it."""

    def __init__(self, word: np.ndarray, held_by: np.ndarray, n_docs: int):
        order = np.argsort(word)
        self.word, floor = word[order], max(n_docs / RARE, 1)
        share = np.log(n_docs / np.maximum(held_by[order], floor)) / np.log(n_docs / floor) if n_docs > floor else np.ones(len(word))
        self.weight = np.append(1 + share, 2.0)
        # words by their first bits: a look-up is a step or two, not a binary search
        bits = int(len(word)).bit_length() + 2
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.word >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64))
        self.most = int(np.diff(self.first).max(initial=0))

    def of(self, h: np.ndarray) -> np.ndarray:
        slot = (h >> self.shift).astype(np.int64)
        at, end, found = self.first[slot], self.first[slot + 1], np.full(len(h), len(self.word))
        for k in range(self.most):
            open_ = np.flatnonzero(at + k < end)
            hit = open_[self.word[at[open_] + k] == h[open_]]
            found[hit] = at[hit] + k
        return self.weight[found]


def shingles(h: np.ndarray, doc: np.ndarray, n_docs: int, idf: Weights) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, shingle and weight, sorted by document and shingle."""
    key, at = shared.windows(h, doc, WORDS)
    owner = doc[at]
    rare = idf.of(h)
    best = rare[at]
    for k in range(1, WORDS):
        best = np.maximum(best, rare[at + k])
    count = np.bincount(doc, minlength=n_docs)
    short = np.flatnonzero((count > 0) & (count < WORDS))
    if len(short):
        begin = np.concatenate([[0], np.cumsum(count)])
        keys, tops = [], []
        for i in short:
            value = np.array([count[i]], np.uint64)
            for x in h[begin[i] : begin[i + 1]]:
                value = shared.mix(value * np.uint64(shared.BASE) + x)
            keys.append(value[0])
            tops.append(rare[begin[i] : begin[i + 1]].max())
        key, owner, best = np.append(key, np.array(keys, np.uint64)), np.append(owner, short), np.append(best, tops)
    order = np.lexsort((key, owner))
    key, owner, best = key[order], owner[order], best[order]
    first = np.concatenate([[True], (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])]) if len(key) else np.empty(0, bool)
    begin = np.flatnonzero(first)
    times = np.diff(np.append(begin, len(key)))
    return owner[begin], key[begin], best[begin] * times


_LOG = -np.log((np.arange(8192) + 0.5) / 8192)
_BITS = np.uint64(8191)


def samples(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Documents that have shingles, and ``n`` weighted samples of each (documents x n)."""
    begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.empty(0, np.int64)
    out = np.empty((len(begin), n), np.uint64)
    if not len(begin):
        return owner[:0], out
    log_w, size = np.log(weight), np.diff(np.append(begin, len(owner)))
    for k in range(n):
        u = shared.mix(key + np.uint64((k + 1) * shared.BASE % (1 << 64)))
        r = _LOG[u & _BITS] + _LOG[(u >> np.uint64(13)) & _BITS]
        c = _LOG[(u >> np.uint64(26)) & _BITS] + _LOG[(u >> np.uint64(39)) & _BITS]
        beta = (u >> np.uint64(52)) * (1 / 4096)
        t = np.floor(log_w / r + beta)
        log_a = np.log(c) - r * (t - beta + 1)
        least = np.minimum.reduceat(log_a, begin)
        hit = np.flatnonzero(log_a == np.repeat(least, size))
        hit = hit[np.searchsorted(hit, begin)]
        out[:, k] = shared.mix(key[hit] ^ (t[hit].astype(np.int64).view(np.uint64) * np.uint64(shared.INVERSE)))
    return owner[begin], out


def band_keys(signature: np.ndarray) -> np.ndarray:
    out = np.empty((len(signature), BANDS), np.uint64)
    for b in range(BANDS):
        key = np.full(len(signature), b + 1, np.uint64)
        for x in signature[:, b * ROWS : (b + 1) * ROWS].T:
            key = shared.mix(key * np.uint64(shared.BASE) + x)
        out[:, b] = key
    return out


# ---------------------------------------------------------------- steps
def document_frequencies(docs: DataFrame) -> Weights:
    """The weights of words, from exact counts over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word, seen, n, held, size = np.empty(0, np.uint64), np.empty(0, np.int64), 0, [], 0

        def summed():
            own, at = np.unique(np.concatenate([word, *held]), return_inverse=True)
            return own, np.bincount(at, np.concatenate([seen, np.ones(len(at) - len(seen), np.int64)]), len(own)).astype(np.int64)

        for batch in batches:
            for b in shared.blocks(_lower(batch)):
                h, doc = _words(b)
                order = np.lexsort((h, doc))
                h, doc = h[order], doc[order]
                held.append(h[np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])])] if len(h) else h)
                size, n = size + len(held[-1]), n + b.n
                if size > 1 << 20:
                    (word, seen), held, size = summed(), [], 0
                    if len(word) > 1 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(shared.signed(word)), pa.array(seen)], names=["word", "n"])
                        word, seen = word[:0], seen[:0]
        word, seen = summed()
        yield pa.RecordBatch.from_arrays([pa.array(shared.signed(word)), pa.array(seen)], names=["word", "n"])
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([n])], names=["word", "n"])

    def summed_up():
        return docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))

    counts = shared.finished(summed_up)
    total = (counts.where("word is null").first() or [None, 0])[1]
    # at most RARE times the mean number of distinct words of a document
    rows = counts.where("word is not null").where(F.col("n") > max(total / RARE, 1)).toPandas()
    shared.discard(counts)
    return Weights(rows["word"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64), total)


def signatures(docs: DataFrame, idf: Weights) -> DataFrame:
    """``doc_id, words (digest of the word sequence), size, bands`` for each row."""
    held = docs.sparkSession.sparkContext.broadcast(idf)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in shared.blocks(_lower(batch)):
                h, doc = _words(b)
                edges = np.searchsorted(doc, np.arange(b.n + 1))
                digest = [hashlib.md5(h[i:j].tobytes(), usedforsecurity=False).digest() for i, j in zip(edges[:-1], edges[1:], strict=True)]
                have, drawn = samples(*shingles(h, doc, b.n, held.value), BANDS * ROWS)
                keys = shared.signed(band_keys(drawn))
                lengths = np.zeros(b.n, np.int64)
                lengths[have] = BANDS
                bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(b.first, b.n), pa.array(digest, pa.binary()), pa.array(np.diff(b.offs)), bands], names=["doc_id", "words", "size", "bands"])

    return docs.mapInArrow(sign, "doc_id long, words binary, size long, bands array<long>")


def units(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``unit, doc_id``: what is to be verified together; and the members of buckets in several units.

    ``texts`` has doc_id, size and bands.
    """
    members = texts.select(F.col("doc_id"), "size", F.posexplode("bands").alias("band", "key"))
    hashed = F.xxhash64("doc_id").cast("decimal(20,0)")
    buckets = members.groupBy("band", "key").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"), F.min("doc_id").alias("hub"), F.sum(hashed).alias("mark")).where("n > 1")
    # buckets with the same members in several bands are verified once
    parts = F.greatest(F.ceil(F.col("n") / UNIT), F.ceil(F.col("bytes") / UNIT_BYTES))
    own = buckets.groupBy("n", "hub", "mark").agg(F.min(F.struct("band", "key", "bytes")).alias("b")).select("b.*", "n", "hub").withColumn("parts", parts)
    own = shared.materialize(own)
    part = _part("doc_id", "band")
    dealt = members.join(own, ["band", "key"]).where("parts = 1 or doc_id <> hub").select(F.xxhash64("band", "key", part).alias("unit"), "doc_id")
    hubs = own.where("parts > 1").select("band", "key", "hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    large = members.join(own.where("parts > 1").select("band", "key"), ["band", "key"]).select("band", "key", "doc_id")
    return dealt.unionAll(hubs.select(F.xxhash64("band", "key", "part").alias("unit"), F.col("hub").alias("doc_id"))), large


def _part(*by: str):
    return F.pmod(F.xxhash64(*by), F.col("parts"))


def _several(rows: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose members (with ``root``) are in more than one class."""
    return rows.groupBy(*by).agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum("size").alias("bytes")).where("low <> high").drop("low", "high")


def rest_units(large: DataFrame, docs: DataFrame, roots: DataFrame, idf: Weights) -> DataFrame:
    """``unit, doc_id`` that bring together all similar texts of large buckets that aren't in one class yet.

    ``large`` has band, key and doc_id; ``roots`` the class of each document that isn't its class's first.
    """
    held = large.sparkSession.sparkContext.broadcast(idf)
    placed = large.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    open_ = _several(placed.withColumn("size", F.lit(0).cast("long")), ["band", "key"]).select("band", "key")
    rows = placed.join(open_, ["band", "key"]).join(docs, "doc_id").select("band", "key", "doc_id", "root", "text")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = _lower(batch)
            for b in shared.blocks(text):
                owner, key, weight = shingles(*_words(b), b.n, held.value)
                at = pa.array(owner + b.first)
                own = [batch.column(c).take(at) for c in ("band", "key", "doc_id", "root")]
                size = pa.array(np.diff(b.offs)[owner])
                yield pa.RecordBatch.from_arrays([*own, size, pa.array(shared.signed(key)), pa.array(weight)], names=["band", "key", "doc_id", "root", "size", "shingle", "weight"])

    exploded = rows.mapInArrow(spread, "band int, key long, doc_id long, root long, size long, shingle long, weight double")
    cells = shared.materialize(exploded)
    often = cells.groupBy("band", "key", "shingle").agg(F.count("*").alias("often")).where("often > 1")
    # a shingle of one text alone can't be shared, but its weight counts towards the prefix
    ranked = cells.join(often, ["band", "key", "shingle"], "left").withColumn("often", F.coalesce("often", F.lit(1)))
    order = Window.partitionBy("band", "key", "doc_id").orderBy("often", "shingle")
    whole = Window.partitionBy("band", "key", "doc_id")
    before = F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("weight")
    first = ranked.withColumns({"before": before, "total": F.sum("weight").over(whole)}).where((F.col("before") <= (1 - THRESHOLD) * F.col("total") + 1e-9) & (F.col("often") > 1))
    by = ["band", "key", "shingle"]
    first = shared.materialize(first.select(*by, "doc_id", "root", "size"))
    groups = _several(first, by).withColumn("parts", F.greatest(F.ceil(F.col("n") / UNIT), F.ceil(F.col("bytes") / UNIT_BYTES))).select(*by, "parts")
    met = first.join(groups, by).withColumn("part", _part("doc_id", "shingle"))
    alone = met.where("parts = 1").select(F.xxhash64(*by).alias("unit"), "doc_id")
    others = F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1), lambda q: q != F.col("part")))
    pairs = met.where("parts > 1").withColumn("other", others).select(F.xxhash64(*by, F.least("part", "other"), F.greatest("part", "other")).alias("unit"), "doc_id")
    return alone.unionAll(pairs)


def linked(owner: np.ndarray, key: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` weighted sets the first set of its component of links at THRESHOLD."""
    root = np.full(n, -1)
    if not len(owner):
        return np.arange(n)
    names, local = np.unique(key, return_inverse=True)
    edges = np.searchsorted(owner, np.arange(n + 1))
    total = np.bincount(owner, weight, n)
    dense, open_ = np.zeros(len(names)), np.ones(n, bool)
    for first in range(n):
        if not open_[first]:
            continue
        open_[first], root[first], queue = False, first, [first]
        while queue:
            x = queue.pop()
            # all others that aren't in a component yet, at once
            rest = np.flatnonzero(open_ & (total >= THRESHOLD * total[x] - 1e-9) & (total * THRESHOLD <= total[x] + 1e-9))
            if not len(rest):
                continue
            span = slice(edges[x], edges[x + 1])
            dense[local[span]] = weight[span]
            if len(rest) * 4 < n:
                both = np.array([np.minimum(dense[local[edges[y] : edges[y + 1]]], weight[edges[y] : edges[y + 1]]).sum() for y in rest])
            else:
                both = np.bincount(owner, np.minimum(dense[local], weight), n)[rest]
            dense[local[span]] = 0
            found = rest[both >= THRESHOLD * (total[x] + total[rest] - both) - 1e-9]
            open_[found], root[found] = False, first
            queue += found.tolist()
    return root


def verify(members: DataFrame, idf: Weights, size: int = 0) -> DataFrame:
    """Edges ``u, v`` between the documents of each unit; ``members`` has unit, doc_id and text, and about ``size`` rows."""
    # tasks of about a unit's texts each: a unit isn't much larger than the mean, and a task stays small
    held, n = members.sparkSession.sparkContext.broadcast(idf), max(16, -(-size // UNIT))

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def unit(ids: np.ndarray, texts: list[pa.Array]):
            owners, keys, weights, at = [], [], [], 0
            for column in texts:
                for b in shared.blocks(column):
                    o, k, w = shingles(*_words(b), b.n, held.value)
                    owners.append(o + at)
                    keys.append(k)
                    weights.append(w)
                    at += b.n
            root = linked(np.concatenate(owners), np.concatenate(keys), np.concatenate(weights), len(ids))
            low = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(low, root, ids)
            return ids, low[root]

        def send(found):
            u, v = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(u[u != v]), pa.array(v[u != v])], names=["u", "v"])

        last, ids, texts, found, size = None, [], [], [], 0
        for batch in batches:
            own, doc, text = batch.column("unit").to_numpy(), batch.column("doc_id").to_numpy(), _lower(batch)
            cut = np.concatenate([[0], np.flatnonzero(own[1:] != own[:-1]) + 1, [len(own)]])
            for i, j in zip(cut[:-1], cut[1:], strict=True):
                if i == j:
                    continue
                if last is not None and own[i] != last:
                    found.append(unit(np.concatenate(ids), texts))
                    size += len(found[-1][0])
                    ids, texts = [], []
                    if size > 100_000:
                        yield send(found)
                        found, size = [], 0
                last = own[i]
                ids.append(doc[i:j])
                texts.append(text.slice(i, j - i))
        if ids:
            found.append(unit(np.concatenate(ids), texts))
        if found:
            yield send(found)

    return members.repartition(n, "unit").sortWithinPartitions("unit").mapInArrow(edges, "u long, v long")


# ---------------------------------------------------------------- operator
def classes(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id``: the class of a document is named by its least doc_id."""
    return shared.finished(lambda: _classes(docs.select(F.col("doc_id").cast("long"), "text").where("doc_id is not null")))


def _classes(docs: DataFrame) -> DataFrame:
    idf = document_frequencies(docs)
    signed = shared.materialize(signatures(docs, idf))
    texts = shared.materialize(signed.groupBy("words").agg(F.min("doc_id").alias("doc_id"), F.first("size").alias("size"), F.first("bands").alias("bands")))
    to_verify, large = units(texts)
    to_verify, large = shared.materialize(to_verify), shared.materialize(large)
    # the same join at every size: what is verified grows with the corpus and is never broadcast
    edges = shared.materialize(verify(to_verify.hint("merge").join(docs, "doc_id").select("unit", "doc_id", "text"), idf, to_verify.count()))
    # rows that share a doc_id are one document, whatever their texts
    same = signed.join(texts.select("words", F.col("doc_id").alias("first")), "words").select(F.col("doc_id").alias("u"), F.col("first").alias("v"))
    roots = components(edges.unionAll(same.where("u <> v").distinct()))
    if not large.isEmpty():
        rest = shared.materialize(rest_units(large, docs, roots, idf))
        more = shared.materialize(verify(rest.hint("merge").join(docs, "doc_id").select("unit", "doc_id", "text"), idf, rest.count()))
        roots = components(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionAll(more))
    return signed.select("doc_id").join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("root", "doc_id").alias("class_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without the documents that are near copies of one that stays."""
    found = classes(docs)
    # never a broadcast: the losers grow with the corpus
    losers = found.where("doc_id <> class_id").distinct().select(F.col("doc_id").alias("_loser")).hint("merge")
    kept = docs.join(losers, docs["doc_id"] == losers["_loser"], "left_anti")
    if found.groupBy("doc_id").count().where("count > 1").isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionAll(kept.where("doc_id is null"))
