"""Licence scans: a trained paragraph classifier, scored in DataFrame expressions only.

:func:`train` fits a multinomial logistic regression on word unigrams and bigrams (sparse:
present or not, most weights exactly 0 by an L1 penalty) of public licence notices, other
licences and ordinary sentences (``license_texts``), each in many copies: cut to a part as by
line breaks, with words dropped, and among up to 300 ordinary words.  Half of the copies fit
the weights, the rest the temperature that calibrates the probabilities.

A paragraph is a block between blank lines.  :func:`scan` scores each whole paragraph (so
wrapped notices are read in one piece), and its single lines too if there are several (which
tell where the notice is).  A unit's family is the likeliest one if its calibrated
probability reaches ``CERTAIN``, else ``unknown``.  A prediction is confirmed if the unit
holds at least ``ALIKE`` of the word pairs of one of the family's templates.

Units without any word of the model's ``gate`` give no row.  They are ``unknown`` for certain:
all other n-grams with a weight for a family together can't lift it above ``unknown``
(:func:`largest_margins`), so the gate saves time and changes no verdict.

Defined results: null and empty texts, and units without a gate word, give no rows; repeated
rows are scanned alike; an empty table gives an empty result; other columns are ignored.
Whole texts are read, whatever their length.  Of several notices in one paragraph the
paragraph's row names the likeliest; the lines' rows name their own.
"""

from __future__ import annotations

import functools
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm.license_texts import NAMES, NOTICES, OTHERS, SENTENCES, STOP
from fieldweave.llm.secret_scan import let
from fieldweave.llm.shared import text_or_empty

CERTAIN, ALIKE = 0.5, 0.6
COPIES, SPARSE, STEPS = 16, 6e-4, 200
#: Slots of the table of weights.
SLOTS = 4096
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"
BLANK = r"\n(?:[\x20\x09\x0B-\x0D]*\n)+"
#: A licence's name with its version written onto it, as in GPLv3, LGPLv2.1+ or Apache2.
VERSIONED = r"(agpl|apache|bsd|gpl|lgpl|mpl)[-_]?(?:v(?:er|ersion)?[-_.]?)?([0-9])"


def grams(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:]))}


@dataclass(frozen=True)
class Model:
    families: tuple[str, ...]
    #: n-gram -> weight for each family, the last for unknown text
    weights: dict[str, tuple[float, ...]]
    bias: tuple[float, ...]
    temperature: float
    #: words of which a text must hold one to be of a family
    gate: tuple[str, ...]

    def probabilities(self, text: str) -> np.ndarray:
        """The formula in plain numpy."""
        found = grams(re.findall(WORD, re.sub("(?<![a-z0-9])" + VERSIONED, r"\1 version \2", text.lower())))
        z = np.array(self.bias) + sum((np.array(self.weights[g]) for g in sorted(found) if g in self.weights), np.zeros(len(self.bias)))
        e = np.exp((z - z.max()) / self.temperature)
        return e / e.sum()

    def family(self, text: str) -> str:
        p = self.probabilities(text)
        return [*self.families, "unknown"][int(p.argmax())] if p.max() >= CERTAIN else "unknown"

    @property
    def pattern(self) -> str:
        """Matches every lower-case text with a gate word: a word never starts after a letter, nor goes on with what its pattern takes in."""
        whole, dotted = [w for w in self.gate if "." not in w], [w for w in self.gate if "." in w]
        return "(?:^|[^a-z])(?:" + "|".join([f"{branched(whole)}(?:$|[^a-z0-9])"] * bool(whole) + [re.escape(w) for w in dotted]) + ")"


def branched(words: list[str]) -> str:
    """A pattern for any of ``words`` that shares what they begin with, so few branches are tried at a place."""
    below: dict[str, list[str]] = {}
    for w in words:
        if w:
            below.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(c) + branched(rest) for c, rest in sorted(below.items())]
    if not branches:
        return ""
    return f"(?:{'|'.join(branches)})" + "?" * ("" in words)


# ---------------------------------------------------------------- training
def copies(seed: int, n: int = COPIES) -> list[tuple[list[str], int]]:
    """Labelled word lists; the last label is unknown text."""
    rng = np.random.default_rng(seed)
    every, short = [t.split() for texts in [*NOTICES.values(), OTHERS] for t in texts], [[s.format(n) for n in own for s in SENTENCES] for own in NAMES.values()]
    ordinary, known = [w for t in OTHERS for w in t.split()], sorted({w for t in every for w in t})
    out = []

    def among(words: list[str], label: int):
        size = int(rng.integers(0, 10)) if rng.random() < 0.6 else int(rng.integers(10, 300))
        # ordinary words, one in eight of any kind
        extra = [str(w) for w in np.where(rng.random(size) < 0.125, rng.choice(known, size), rng.choice(ordinary, size))]
        cut = int(rng.integers(0, size + 1))
        out.append((extra[:cut] + words + extra[cut:], label))

    for label, texts in enumerate([*([*own, *more] for own, more in zip(NOTICES.values(), short, strict=True)), OTHERS]):
        for i, text in enumerate(texts):
            whole, written = text.split(), label == len(NOTICES) or i < len(NOTICES[list(NOTICES)[label]])
            for k in range(n if written else 3):
                words = whole
                if len(words) > 16 and k % 3 == 2:  # a part, as of a wrapped line
                    size = int(rng.integers(10, len(words)))
                    at = int(rng.integers(0, len(words) - size + 1))
                    words = words[at : at + size]
                among([w for w in words if k == 0 or rng.random() > 0.08], label)
                if written and label < len(NOTICES) and k % 4 == 1:
                    among([], len(NOTICES))
    return out


def _matrix(rows: list[tuple[list[str], int]], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    x = np.zeros((len(rows), len(index)))
    for i, (words, _) in enumerate(rows):
        x[i, [index[g] for g in grams(words) if g in index]] = 1
    return x, np.array([label for _, label in rows])


def fit(x: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases by accelerated proximal gradient steps; the L1 penalty makes weights exactly 0.

    In double precision: sums differ by threads and machines, and in single precision so did the rounded weights.
    """
    n, target = len(y), np.eye(k)[y]
    v = np.ones(x.shape[1])
    for _ in range(20):  # the largest curvature, by power iteration
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 2 * n / (np.linalg.norm(x @ v) ** 2 + n)
    w, b = np.zeros((x.shape[1], k)), np.zeros(k)
    at, at_b, t = w, b, 1.0
    for _ in range(STEPS):
        z = x @ at + at_b
        p = np.exp(z - z.max(1, keepdims=True))
        p = (p / p.sum(1, keepdims=True) - target) / n
        step = at - rate * (x.T @ p)
        new = np.sign(step) * np.maximum(np.abs(step) - rate * SPARSE, 0)
        new_b = at_b - rate * p.sum(0)
        later = (1 + (1 + 4 * t * t) ** 0.5) / 2
        at, at_b = new + (t - 1) / later * (new - w), new_b + (t - 1) / later * (new_b - b)
        w, b, t = new, new_b, later
    return w, b


def largest_margins(weights: dict[str, tuple[float, ...]], bias: tuple[float, ...], gate: set[str]) -> np.ndarray:
    """For each family how far it can rise above unknown in a text without gate words, at most."""
    b = np.array(bias)
    out = b[:-1] - b[-1]
    for g, w in weights.items():
        if not gate & set(g.split()):
            out = out + np.maximum(np.array(w[:-1]) - w[-1], 0)
    return out


def gate_of(weights: dict[str, tuple[float, ...]], bias: tuple[float, ...]) -> tuple[str, ...]:
    """Words without which no family can rise above unknown; rather those that ordinary sentences don't hold."""
    often = {w: sum(w in t.split() for t in OTHERS) for g in weights for w in g.split()}
    gate: set[str] = set()
    while ((left := largest_margins(weights, bias, gate)) >= -1e-3).any():
        gain = dict.fromkeys(sorted(often.keys() - gate), 0.0)
        for g, w in weights.items():
            own = set(g.split())
            if not own & gate:
                lift = np.minimum(np.maximum(np.array(w[:-1]) - w[-1], 0), np.maximum(left + 1e-3, 0)).sum()
                for word in own:
                    gain[word] += lift
        gate.add(max(gain, key=lambda w: (gain[w] / (1 + often[w] + 100 * (w in STOP)) ** 2, w)))
    return tuple(sorted(gate))


@functools.lru_cache(1)
def train() -> Model:
    """Fit on one half of the copies, calibrate on the other; the same model each time."""
    texts = [t for own in [*NOTICES.values(), OTHERS] for t in own] + [s.format(n) for own in NAMES.values() for n in own for s in SENTENCES]
    known = sorted({g for t in texts for g in grams(t.split()) if set(g.split()) - set(STOP)})
    index = {g: i for i, g in enumerate(known)}
    w, b = fit(*_matrix(copies(1), index), len(NOTICES) + 1)
    w = np.round(np.where(np.abs(w) < 0.02, 0, w).astype(float), 4)
    b = np.round(b.astype(float), 4)
    hx, hy = _matrix(copies(2), index)
    logits = hx @ w + b

    def loss(t: float) -> float:
        z = logits / t
        z = z - z.max(1, keepdims=True)
        return float((np.log(np.exp(z).sum(1)) - z[np.arange(len(hy)), hy]).mean())

    best = min((float(t) for t in np.geomspace(0.2, 5, 60)), key=loss)
    weights = {g: tuple(w[i].tolist()) for g, i in index.items() if w[i].any()}
    return Model(tuple(NOTICES), weights, tuple(b.tolist()), best, gate_of(weights, tuple(b.tolist())))


# ---------------------------------------------------------------- scoring
def _array(values) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def _logits(found: Column, model: Model) -> Column:
    # weights by the checksum of their n-gram, a few in each slot, as a map is searched from end to end for every n-gram;
    # one text, which Spark folds to a table when it plans, as thousands of literals would take it seconds
    slots: list[list[dict]] = [[] for _ in range(SLOTS)]
    for gram, w in model.weights.items():
        slots[zlib.crc32(gram.encode()) % SLOTS].append({"g": gram, "w": w})
    table = F.from_json(F.lit(json.dumps(slots)), "array<array<struct<g:string,w:array<double>>>>")
    own = F.array_sort(F.filter(found, lambda g: g.isin(list(model.weights))))  # a set that is made once, not for each row
    weight = lambda g: F.get(F.filter(F.get(table, (F.crc32(g) % SLOTS).cast("int")), lambda e: e["g"] == g), F.lit(0))["w"]
    return F.aggregate(own, _array(model.bias), lambda a, g: F.zip_with(a, weight(g), lambda x, y: x + y))


def plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "(?<![a-z0-9])" + VERSIONED, "$1 version $2")


def templates(family: str) -> list[list[str]]:
    """Word pairs of the family's notices."""
    return [sorted(g for g in grams(t.split()) if " " in g) for t in NOTICES[family]]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row for each paragraph (``line`` -1), and for each line of one with several lines, that holds a gate word."""
    model = model or train()
    has = lambda t: t.rlike(model.pattern)
    rows = docs.select("doc_id", plain(text_or_empty()).alias("text")).where(has(F.col("text")))
    rows = rows.select("doc_id", F.posexplode(F.split("text", BLANK, -1)).alias("paragraph", "text")).where(has(F.col("text")))
    unit = lambda line, text: F.struct(line.cast("long").alias("line"), text.alias("text"))
    lines = let(F.split("text", "\n", -1), lambda ls: F.when(F.size(ls) > 1, F.filter(F.transform(ls, lambda t, i: unit(i, t)), lambda x: has(x["text"]))).otherwise(F.array().cast("array<struct<line:long,text:string>>")))
    rows = rows.select("doc_id", F.col("paragraph").cast("long").alias("paragraph"), F.explode(F.concat(F.array(unit(F.lit(-1), F.col("text"))), lines)).alias("x"))
    words = F.regexp_extract_all("x.text", F.lit(WORD), F.lit(0))
    return _scored(rows.select("doc_id", "paragraph", F.col("x.line").alias("line"), words.alias("words")), ["doc_id", "paragraph", "line"], model)


def _scored(rows: DataFrame, keys: list[str], model: Model) -> DataFrame:
    """Family, probability, likeness and whether it is confirmed, from the ``words`` of each row."""
    pairs = F.zip_with(F.slice("words", 1, F.greatest(F.size("words") - 1, F.lit(0))), F.slice("words", 2, F.size("words")), lambda a, b: F.concat_ws(" ", a, b))
    rows = rows.select(*keys, F.array_distinct(F.concat("words", pairs)).alias("grams"))
    rows = rows.select(*keys, "grams", _logits(F.col("grams"), model).alias("z"))
    t = model.temperature
    exps = let(F.array_max("z"), lambda m: F.transform("z", lambda v: F.exp((v - m) / t)))
    rows = rows.select(*keys, "grams", exps.alias("e"))
    top = F.array_position("e", F.array_max("e")).cast("int")
    rows = rows.select(*keys, "grams", top.alias("top"), (F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, v: a + v)).alias("probability"))
    names = F.array(*[F.lit(f) for f in model.families], F.lit("unknown"))
    family = F.when(F.col("probability") >= CERTAIN, F.element_at(names, F.col("top"))).otherwise(F.lit("unknown"))
    rows = rows.select(*keys, "grams", family.alias("family"), "probability")
    likeness = F.lit(0.0)
    for name in model.families:
        share = [F.size(F.array_intersect("grams", F.split(F.lit("|".join(own)), "\\|"))) / float(len(own)) for own in templates(name)]
        likeness = F.when(F.col("family") == name, F.greatest(*share) if len(share) > 1 else share[0]).otherwise(likeness)
    rows = rows.select(*keys, "family", F.round("probability", 6).alias("probability"), F.round(likeness, 6).alias("likeness"))
    return rows.withColumn("confirmed", (F.col("family") != "unknown") & (F.col("likeness") >= ALIKE))
