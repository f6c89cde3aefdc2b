"""Token counts by section or field: encode a document once, give each token to a section.

A section is a span of characters: a line of a text, or a field of a record whose fields are
written one after another.  The whole is encoded once with offsets, and the sorted token
spans are interval-joined to the sorted section spans (both by a binary search).  A
token that crosses a border is allocated by rule: ``first`` (the section that holds its
first character, the default), ``last``, or ``most`` (the section that holds most of its
characters, the earlier on a tie).

Defined results: a null or empty text or field is an empty section and has no tokens; repeated
rows are counted alike; an empty table gives an empty result; other columns are not
read.  The sections of a document tile its text, so their counts add up to its tokens by every rule.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.bpe import _rows, codec


def line_starts(text: str) -> np.ndarray:
    """Sections that tile the text: each line with its line feed."""
    at, out = 0, [0]
    while (at := text.find("\n", at) + 1) > 0 and at < len(text):
        out.append(at)
    return np.array(out, np.int64)


def allocate(starts: np.ndarray, ends: np.ndarray, borders: np.ndarray, rule: str = "first") -> tuple[np.ndarray, np.ndarray]:
    """Section number of each token, and which tokens cross a border."""
    first = np.searchsorted(borders, starts, side="right") - 1
    last = np.maximum(np.searchsorted(borders, np.maximum(ends - 1, starts), side="right") - 1, first)
    crosses = last > first
    if rule == "first" or not crosses.any():
        return first, crosses
    if rule == "last":
        return last, crosses
    if rule != "most":
        raise ValueError(f"unknown rule {rule!r}")
    out = first.copy()
    for i in np.flatnonzero(crosses):
        edges = np.clip(np.append(borders[first[i] : last[i] + 1], ends[i]), starts[i], ends[i])
        out[i] = first[i] + int(np.diff(edges).argmax())
    return out, crosses


RULES = ("first", "last", "most")


def section_counts(docs: DataFrame, path: str, pattern: str, rules: tuple[str, ...] = ("first",)) -> DataFrame:
    """Per document ``n_tokens``, ``n_sections``, ``n_crossing`` and the tokens of each line, ``tokens_<rule>``."""
    return _counts(docs.select(F.col("doc_id").cast("long"), "text"), path, pattern, line_starts, rules, "n_sections")


def field_counts(docs: DataFrame, path: str, pattern: str, fields: list[str], rules: tuple[str, ...] = ("first",), separator: str = "\n") -> DataFrame:
    """The same for the named text columns of each record, encoded as one text in this order; a separator counts to the field before it.

    Lengths travel before the text as a line of numbers, so no separator in a field can mislead.
    """
    written = [F.concat(F.coalesce(F.col(f), F.lit("")), F.lit(separator if i < len(fields) - 1 else "")) for i, f in enumerate(fields)]
    head = F.concat_ws(" ", *[F.char_length(w).cast("string") for w in written])
    return _counts(docs.select(F.col("doc_id").cast("long"), F.concat(head, F.lit("\n"), *written).alias("text")), path, pattern, None, rules, "n_fields")


def _counts(rows: DataFrame, path: str, pattern: str, sections, rules: tuple[str, ...], counted: str) -> DataFrame:
    names = ["doc_id", "n_tokens", counted, "n_crossing", *(f"tokens_{r}" for r in rules)]
    types = [pa.int64()] * 4 + [pa.list_(pa.int64())] * len(rules)
    for rule in rules:
        if rule not in RULES:
            raise ValueError(f"unknown rule {rule!r}")

    def marked(batches):
        """Texts without the line of lengths, and their borders."""
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part, texts, borders = batch.slice(i, 64), [], []
                for text in part.column(1).to_pylist():
                    head, _, body = text.partition("\n")
                    texts.append(body)
                    borders.append(np.concatenate([[0], np.cumsum([int(n) for n in head.split(" ")])[:-1]]).astype(np.int64))
                waiting.extend(borders)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    waiting: list[np.ndarray] = []

    def run(batches):
        waiting.clear()
        c, held, size = codec(path, pattern), [], 0
        for key, text, ids in _rows(batches if sections else marked(batches), path, pattern):
            if sections:
                borders = sections(text)
            else:
                borders = waiting[0]
                del waiting[0]
            spans, counts, crosses = c.offsets(text, ids), [], None
            for rule in rules:
                section, crosses = allocate(*spans, borders, rule)
                counts.append(np.bincount(section, minlength=len(borders)))
            held.append((key, len(ids), len(borders), int(crosses.sum()), *counts))
            size += len(borders)
            if len(held) >= 1000 or size > 500_000:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), types, strict=True)], names=names)

    schema = f"doc_id long, n_tokens long, {counted} long, n_crossing long" + "".join(f", tokens_{r} array<long>" for r in rules)
    return rows.mapInArrow(run, schema)
