"""Spelling variants: words at one edit from each other, by a trie walked level by level in joins.

The trie is a table of edges (side, depth, node, letter, n), its nodes named by their prefix;
a walk is a table of states (word, position, node, edits).  Each level joins the states at
one depth with the edges at that depth: a state goes on along its own letter, changes
it (an edge with another letter, one edit) or skips it (the edge of the letter after, one
edit); with one edit spent only the own letter is left.  A state with one edit at the end of its
word, on a node that is a word, is a pair of neighbours.

The top of a trie is dense and would make every word branch there, so two tries are walked,
of the words and of the words reversed, each only for edits in the later half: a word enters
at the node of its first half, where few edges leave a node.  Skipping a letter finds the words that
are shorter by one, a changed letter goes to larger letters only, so each pair comes from one of its
words.  A node has at most as many edges as there are letters, so states grow with the words times their length.  Levels end at
``DEEPEST`` letters; words beyond that are met by the hashes of what is left without one letter,
checked by their edit distance, which is linear in their length too.

Defined results: null and empty texts have no words; repeated rows are counted each; a null ``doc_id`` is hashed as an empty
one; an empty table gives an empty result; other columns are not read; very long runs are words like others.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import shared

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_RUNS = re.compile("[a-zÀ-ÿ]+").findall
_GAP = re.compile("[^a-zÀ-ÿ]")
#: Every so many-th (document, run) loses a letter.
DELETES = 97
#: Words of at most so many letters are walked, and reached.
DEEPEST = 40
#: Distinct words of a task that are counted before they are sent on, and characters of a text taken at once.
HELD, PIECE = 200_000, 1 << 20


def damaged(run: str, head: int) -> str:
    """The run as it counts: without a letter where its hash says so (``head``: crc32 of ``<doc_id>:``)."""
    h = zlib.crc32(run.encode(), head)
    if h % DELETES:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def words(docs: DataFrame, least: int = 5, often: int = 3) -> DataFrame:
    """``word, n`` of the words of ``least`` letters that occur ``often`` times; tasks add up their own counts first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1), strict=True):
                if not value.is_valid:
                    continue
                head = zlib.crc32(f"{'' if key.as_py() is None else key.as_py()}:".encode())
                low = value.as_py().encode().translate(_LOWER).decode()
                for piece in shared.pieces(low, PIECE, _GAP):
                    for found, k in Counter(_RUNS(piece)).items():
                        if len(word := damaged(found, head)) >= least:
                            total[word] += k
                if len(total) >= HELD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    counted = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= often)


def edges(vocabulary: DataFrame) -> DataFrame:
    """``side, depth, node, letter, n``: the edges below the middle of a word, ``n`` where a word ends on them, else 0."""
    both = vocabulary.select("n", F.length("word").alias("size"), F.explode(F.array(F.struct(F.lit("f").alias("side"), F.col("word").alias("q")), F.struct(F.lit("r").alias("side"), F.reverse("word").alias("q")))).alias("w"))
    at = both.select("n", "size", "w.*").withColumn("depth", F.expr("explode(sequence(CAST(IF(side = 'f', size div 2, (size + 1) div 2) AS INT), size - 1))"))
    return (
        at.select("side", "depth", F.expr("substring(q, 1, depth)").alias("node"), F.expr("substring(q, depth + 1, 1)").alias("letter"), F.expr("IF(depth + 1 = size, n, 0)").alias("n"))
        .groupBy("side", "depth", "node", "letter").agg(F.max("n").alias("n"))
    )


def _step(states: DataFrame, trie: DataFrame) -> DataFrame:
    """The states one level down; ``found`` is the count of the word that the new node is, if it is one."""
    met = states.join(trie.withColumnRenamed("node", "at"), (F.col("side") == F.col("its")) & (F.col("node") == F.col("at")))
    met = met.withColumn("own", F.expr("substring(q, pos + 1, 1)")).withColumn("second", F.expr("substring(q, pos + 2, 1)"))
    met = met.where("letter = own OR (edits = 0 AND (letter > own OR letter = second))")
    moves = """filter(array(
        struct(pos + 1 AS pos, IF(letter = own, edits, 1) AS edits, letter = own OR (edits = 0 AND letter > own) AS ok),
        struct(pos + 2 AS pos, 1 AS edits, edits = 0 AND letter = second AND second <> own AS ok)), x -> x.ok)"""
    return met.select("side", "word", "size", "n", "q", F.concat("node", "letter").alias("node"), F.col("ends").alias("found"), F.expr(f"inline({moves})")).drop("ok")


def walked(vocabulary: DataFrame) -> DataFrame:
    """``a, n_a, b, n_b``: each pair of words of at most ``DEEPEST`` letters at one edit, at least once."""
    short = vocabulary.where(F.length("word") <= DEEPEST)
    deepest = short.agg(F.max(F.length("word"))).first()[0]
    if not deepest:
        return short.selectExpr("word AS a", "n AS n_a", "word AS b", "n AS n_b").limit(0)
    trie_path = shared.scratch(short.sparkSession)
    edges(short).write.partitionBy("depth").parquet(trie_path)
    trie = short.sparkSession.read.parquet(trie_path).select(F.col("side").alias("its"), "depth", "node", "letter", F.col("n").alias("ends"))
    sides = F.array(*(F.struct(F.lit(s).alias("side"), q.alias("q"), F.expr(h).cast("int").alias("start")) for s, q, h in (("f", F.col("word"), "length(word) div 2"), ("r", F.reverse("word"), "(length(word) + 1) div 2"))))
    entries = short.select("word", "n", F.length("word").alias("size"), F.explode(sides).alias("s")).select("s.*", "word", "size", "n")
    levels, states = [], None
    for depth in range(short.agg(F.min(F.length("word"))).first()[0] // 2, deepest):
        new = entries.where(F.col("start") == depth).select("side", "word", "size", "n", "q", F.expr("substring(q, 1, start)").alias("node"), F.col("start").alias("pos"), F.lit(0).alias("edits"))
        open_ = new if states is None else new.unionByName(states.where("pos < size").select(*new.columns))
        states = shared.materialize(_step(open_, trie.where(F.col("depth") == depth).drop("depth")))
        levels.append(states)
    every = functools.reduce(DataFrame.unionByName, levels)
    # the last letter is skipped where the node before it is a word
    ends = every.where("found > 0 AND ((edits = 1 AND pos = size) OR (edits = 0 AND pos = size - 1))")
    out = shared.materialize(ends.select(F.col("word").alias("a"), F.col("n").alias("n_a"), F.expr("IF(side = 'f', node, reverse(node))").alias("b"), F.col("found").alias("n_b")))
    for level in levels:
        shared.discard(level)
    shared.delete(short.sparkSession, trie_path)
    return out


def long_pairs(vocabulary: DataFrame) -> DataFrame:
    """As :func:`walked`, of words beyond ``DEEPEST`` letters and those of just as many: by hashes of what one deleted letter leaves."""
    long = vocabulary.where(F.length("word") >= DEEPEST).select("word", "n", F.sha2("word", 256).alias("id"), F.length("word").alias("size"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, word in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                left, rest = _without(word)
                for s in range(0, len(rest), 10_000):
                    part = rest[s : s + 10_000]
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(part)), pa.array(range(s, s + len(part)), pa.int64()), pa.array(part, pa.int64()), pa.array([left] * len(part), pa.int64())], names=["id", "at", "rest", "whole"])

    left = long.select("id", "word").mapInArrow(run, "id string, at long, rest long, whole long")
    x, y = left.alias("x"), left.alias("y")
    # words that share what is left without the letter at one place differ there only, so a key has as many rows as there are letters
    changed = x.join(y, (F.col("x.at") == F.col("y.at")) & (F.col("x.rest") == F.col("y.rest")) & (F.col("x.id") < F.col("y.id"))).select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
    whole = left.where("at = 0").select(F.col("id").alias("b"), "whole")
    skipped = left.select(F.col("id").alias("a"), "rest").join(whole, F.col("rest") == F.col("whole")).select("a", "b")
    named = lambda s: long.select(F.col("id").alias(s), F.col("word").alias(f"w_{s}"), F.col("n").alias(f"n_{s}"))
    pairs = changed.unionByName(skipped).distinct().join(named("a"), "a").join(named("b"), "b")
    return pairs.where(F.levenshtein("w_a", "w_b", 1) == 1).select(F.col("w_a").alias("a"), "n_a", F.col("w_b").alias("b"), "n_b")


def _without(word: str) -> tuple[int, list[int]]:
    """Hash of a word, and of what is left without each letter: sums of letters times powers, modulo 2^61 - 1."""
    p, base = (1 << 61) - 1, 0x1F35B2C94D0A7
    powers, head = [1], [0]
    for c in word:
        head.append((head[-1] + ord(c) * powers[-1]) % p)
        powers.append(powers[-1] * base % p)
    inverse = pow(base, -1, p)
    return head[-1], [(head[i] + (head[-1] - head[i + 1]) * inverse) % p for i in range(len(word))]


def near(vocabulary: DataFrame) -> DataFrame:
    """``word, n, other, n_other``: every ordered pair of words at one edit."""
    pairs = walked(vocabulary)
    if not vocabulary.where(F.length("word") > DEEPEST).isEmpty():
        pairs = pairs.unionByName(long_pairs(vocabulary))
    there = pairs.toDF("word", "n", "other", "n_other")
    back = pairs.select(F.col("b").alias("word"), F.col("n_b").alias("n"), F.col("a").alias("other"), F.col("n_a").alias("n_other"))
    return there.unionByName(back).distinct()


def roots(links: DataFrame) -> DataFrame:
    """``word, root``: the end of each word's chain of forms (``word, up``).  Counts double along a chain, so few rounds of doubling do."""
    now = shared.materialize(links)
    while True:
        step = now.alias("a").join(now.select(F.col("word").alias("up"), F.col("up").alias("beyond")), "up", "left")
        step = shared.materialize(step.select("word", F.coalesce("beyond", "up").alias("up"), F.col("beyond").isNotNull().alias("moved")))
        shared.discard(now)
        if step.where("moved").isEmpty():
            return step.select("word", F.col("up").alias("root"))
        now = step


def group(docs: DataFrame, least: int = 5, often: int = 3) -> DataFrame:
    """One row per word: ``word, n, n_near, form, form_n, root``."""
    vocabulary = shared.materialize(words(docs, least, often))
    best = near(vocabulary).groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("n"), F.col("other").alias("form"))).alias("best"))
    best = shared.materialize(best.select("word", "n_near", F.expr("IF(-best.n >= 2 * n, best.form, NULL)").alias("form"), F.expr("IF(-best.n >= 2 * n, -best.n, NULL)").alias("form_n")))
    root = roots(best.where("form IS NOT NULL").select("word", F.col("form").alias("up")))
    out = vocabulary.join(best, "word", "left").join(root, "word", "left")
    return out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form", "form_n", F.coalesce("root", "word").alias("root"))
