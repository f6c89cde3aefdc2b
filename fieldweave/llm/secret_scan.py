"""Secret scans in DataFrame expressions only.

Base kinds are three patterns, each matched leftmost and without overlaps; positions are
code points, from the lengths of what stands between the matches.

The method adds the kind ``random``: tokens of 20 or more characters of
``[A-Za-z0-9+/_-]`` that hold a letter and a digit.  The encoding is inferred (hex,
base32, base64) and the token tested as a string over that alphabet:

* chi-squared uniformity of the alphabet.  Ordinary text over k characters is far from
  uniform: its statistic is about k - 1 + n * excess.  The chance that ordinary text
  looks as uniform as the token (normal tail of the noncentral chi-squared), combined by
  Fisher's rule with the chance that it keeps to the inferred alphabet, is the p-value.
  It falls with the length n, as longer tokens carry more evidence.
* runs above and below the middle of the alphabet (Wald-Wolfowitz), lag-1 serial
  correlation, and too even an alphabet.  A token that fails one of the three at 0.001
  (Bonferroni) isn't random: counters, repeated units, alphabets written out.

False discoveries are controlled by the Benjamini-Hochberg rule at ``RATE`` over all
tokens of the corpus, within each class of encoding and length, so that the many short
tokens don't decide for the long ones.  P-values are counted in ``BINS`` bins of a tenth of
a decade, so the table of counts has a fixed size; a bin counts as its upper edge.

Spans of kind ``random`` that lie within a base span are not repeated.

Defined results: a null text counts as empty (no spans); repeated rows are scanned alike,
and each counts in the control; an empty table gives an empty result; other columns are
ignored by :func:`scan` and kept by :func:`redact`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.llm import shared

# Fixed patterns of the base kinds, in their order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]
TOKEN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}"
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}
#: How much less uniform ordinary text is (per character), and its chance per character to keep to the alphabet.
EXCESS = {"hex": 0.6, "base32": 1.1, "base64": 3.2}
KEEPS = {"hex": 0.5, "base32": 0.7, "base64": 1.0}
LENGTHS = [20, 32, 48, 80]
RATE, VETO, BINS = 0.01, 0.001, 3000
MASK = "[SECRET]"
_STEP, _CHUNK = 256, 4096
# Fixed coefficients of a published fit to the complementary error function.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


# ---------------------------------------------------------------- spans
def _running(values: Column, plus=lambda a, x: a + x) -> Column:
    """What the values before each element come to, by ``plus`` from 0; two levels, so that long arrays cost n * sqrt(n) at most."""

    def before(xs: Column) -> Column:
        start = F.struct(F.array().cast("array<long>").alias("out"), F.lit(0).cast("long").alias("sum"))
        return F.aggregate(xs, start, lambda a, x: F.struct(F.concat(a["out"], F.array(a["sum"])).alias("out"), plus(a["sum"], x).alias("sum")), lambda a: a["out"])

    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), plus)
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / _STEP).cast("int")), lambda b: F.slice(values, b * _STEP + 1, _STEP))
    several = let(blocks, lambda bs: F.flatten(F.zip_with(bs, before(F.transform(bs, total)), lambda xs, base: F.transform(before(xs), lambda x: plus(x, base)))))
    return F.when(F.size(values) == 0, F.array().cast("array<long>")).when(F.size(values) <= _STEP, before(values)).otherwise(several)


def found(text: Column, pattern: str, group: int | None = None) -> Column:
    """``start, end, match`` (and the group's text) of all matches."""
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    both = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), values.alias("value"))
    whole = F.filter(both, lambda x: x["match"].isNotNull())  # the last gap has no match

    def placed(xs: Column) -> Column:
        lengths = F.transform(xs, lambda x: (F.char_length(x["gap"]) + F.char_length(x["match"])).cast("long"))
        return let(
            lengths,
            lambda ls: F.zip_with(xs, _running(ls), lambda x, s: F.struct((s + F.char_length(x["gap"])).alias("start"), (s + F.char_length(x["gap"]) + F.char_length(x["match"])).alias("end"), x["match"].alias("match"), x["value"].alias("value"))),
        )

    return F.when(text.rlike(pattern), let(whole, placed))


def _spans(kind: int, matches: Column) -> Column:
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    return F.coalesce(F.transform(matches, lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))), none)


# ---------------------------------------------------------------- tests
def _erfc(x: Column) -> Column:
    """Complementary error function for x >= 0, by a rational Chebyshev fit of relative error 1.2e-7."""

    def fit(t: Column) -> Column:
        s = F.lit(ERFC[-1])
        for k in reversed(ERFC[:-1]):
            s = s * t + F.lit(k)
        return t * F.exp(-x * x + s)

    return let(1 / (1 + x / 2), fit)


def _tail(z: Column) -> Column:
    """Chance of a standard normal value of ``z`` or less."""
    return let(z, lambda v: F.when(v < 0, _erfc(-v / 2**0.5) / 2).otherwise(1 - _erfc(v / 2**0.5) / 2))


def _by_encoding(e: Column, value) -> Column:
    names = list(ALPHABETS)
    return F.when(e == names[0], value(names[0])).when(e == names[1], value(names[1])).otherwise(value(names[2]))


def encoding(token: Column) -> Column:
    return F.when(token.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(token.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")


def battery(token: Column) -> Column:
    """``encoding, n, p`` of a token; p is 1 if a test of randomness fails."""

    def of(e: Column) -> Column:
        norm = F.when(e == "hex", F.lower(token)).when(e == "base32", token).otherwise(F.translate(token, "-_", "+/"))
        letters = F.array(*[F.lit(c) for c in ALPHABETS["base64"]])

        def counted(s: Column) -> Column:
            n = F.char_length(s).cast("double")
            squares = F.aggregate(letters, F.lit(0.0), lambda a, c: a + F.pow(F.char_length(s) - F.char_length(F.replace(s, c, F.lit(""))), F.lit(2.0)))
            half = _by_encoding(e, lambda x: F.translate(s, ALPHABETS[x], "0" * (len(ALPHABETS[x]) // 2) + "1" * (len(ALPHABETS[x]) // 2)))
            place = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: _by_encoding(e, lambda x: F.instr(F.lit(ALPHABETS[x]), c)).cast("double"))
            pairs = lambda b, two: (n - F.char_length(F.replace(b, F.lit(two), F.lit("")))) / 2
            serial = let(
                place,
                lambda xs: let(
                    _centred(xs, n),
                    lambda d: F.try_divide(
                        F.aggregate(F.zip_with(F.slice(d, 1, F.size(d) - 1), F.slice(d, 2, F.size(d) - 1), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x),
                        F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x),
                    ),
                ),
            )
            return let(
                F.struct(
                    n.alias("n"), squares.alias("squares"), serial.alias("serial"),
                    let(half, lambda b: F.struct((n - F.char_length(F.replace(b, F.lit("1"), F.lit("")))).alias("ones"), (pairs(b, "01") + pairs(b, "10") + 1).alias("runs"))).alias("half"),
                ),
                lambda v: _judged(e, v),
            )

        return let(norm, counted)

    return let(encoding(token), of)


def _centred(xs: Column, n: Column) -> Column:
    return let(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n, lambda m: F.transform(xs, lambda x: x - m))


def _judged(e: Column, v: Column) -> Column:
    n, ones = v["n"], v["half"]["ones"]
    k = _by_encoding(e, lambda x: F.lit(float(len(ALPHABETS[x]))))
    excess, keeps = _by_encoding(e, lambda x: F.lit(EXCESS[x])), _by_encoding(e, lambda x: F.lit(KEEPS[x]))
    chi = k / n * v["squares"] - n
    expected = 2 * ones * (n - ones) / n + 1
    spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
    two_sided = lambda z: F.least(F.lit(1.0), _erfc(F.abs(z) / 2**0.5))
    runs = F.when((ones == 0) | (ones == n), F.lit(0.0)).otherwise(two_sided((v["half"]["runs"] - expected) / spread))
    serial = F.coalesce(two_sided(v["serial"] * F.sqrt(n)), F.lit(0.0))
    even = _tail((chi - (k - 1)) / F.sqrt(2 * (k - 1)))
    ordinary = _tail((chi - (k - 1 + n * excess)) / F.sqrt(2 * (k - 1) + 4 * n * excess))
    joint = F.greatest(ordinary * F.pow(keeps, n), F.lit(1e-300))
    fails = 3 * F.least(runs, serial, even) < VETO
    p = F.when(fails, F.lit(1.0)).otherwise(F.least(F.lit(1.0), let(joint, lambda q: q * (1 - F.log(q)))))
    return F.struct(e.alias("encoding"), n.cast("long").alias("n"), p.alias("p"))


def _candidate(token: Column) -> Column:
    return token.rlike("[0-9]") & token.rlike("[A-Za-z]")


def _class(e: Column, n: Column) -> Column:
    size = F.lit(0)
    for i, least in enumerate(LENGTHS[1:]):
        size = F.when(n >= least, i + 1).otherwise(size)
    return F.concat(e, F.lit(":"), size.cast("string"))


def _bin(p: Column) -> Column:
    return F.least(F.floor(-10 * F.log10(p)), F.lit(BINS)).cast("int")


def thresholds(tests: DataFrame) -> dict[str, int]:
    """For each class the least bin that Benjamini and Hochberg's rule accepts; ``tests`` has class and p."""
    counts = tests.groupBy("class", _bin(F.col("p")).alias("bin")).agg(F.count("*").alias("n"))
    # at most classes * BINS rows, whatever the corpus
    by: dict[str, dict[int, int]] = {}
    for r in counts.collect():
        by.setdefault(r["class"], {})[r["bin"]] = r["n"]
    out = {}
    for name, own in by.items():
        total, above = sum(own.values()), 0
        for b in sorted(own, reverse=True):
            above += own[b]
            if 10 ** (-b / 10) <= RATE * above / total:
                out[name] = b
    return out


def _accepted(t: Column, least: dict[str, int]) -> Column:
    name = _class(t["encoding"], t["n"])
    ok = F.lit(False)
    for c, b in sorted(least.items()):
        ok = ok | ((name == c) & (_bin(t["p"]) >= b))
    return ok


# ---------------------------------------------------------------- operator
def _tested(text: Column) -> Column:
    """``start, end, encoding, n, p`` of all candidate tokens."""
    kept = F.filter(found(text, TOKEN), lambda m: _candidate(m["match"]))
    return F.coalesce(
        F.transform(kept, lambda m: let(battery(m["match"]), lambda b: F.struct(m["start"].alias("start"), m["end"].alias("end"), b["encoding"].alias("encoding"), b["n"].alias("n"), b["p"].alias("p")))),
        F.array().cast("array<struct<start:long,end:long,encoding:string,n:long,p:double>>"),
    )


def _tests(tokens: DataFrame) -> DataFrame:
    return tokens.select(F.explode("tokens").alias("t")).select(_class(F.col("t.encoding"), F.col("t.n")).alias("class"), F.col("t.p").alias("p"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _base(text: Column) -> Column:
    """Spans of the base kinds in order."""
    assign = F.filter(found(text, ASSIGN, 2), lambda m: F.char_length(m["value"]) >= 6)
    return F.array_sort(F.concat(_spans(0, assign), _spans(1, found(text, ACCESS)), _spans(2, found(text, HEX))))


def _all(base: Column, tokens: Column, least: dict[str, int]) -> Column:
    """Base spans and those of accepted tokens that lie in none of them, in order."""
    new = F.filter(tokens, lambda t: _accepted(t, least) & ~F.exists(base, lambda b: (b["start"] <= t["start"]) & (b["end"] >= t["end"])))
    return F.array_sort(F.concat(base, _spans(3, new)))


def scan(docs: DataFrame) -> DataFrame:
    """Per row ``doc_id``, the base ``spans`` by kind and all spans, as arrays of (start, kind, end)."""
    text = shared.text_or_empty()
    rows = shared.materialize(docs.select("doc_id", _base(text).alias("base"), _tested(text).alias("tokens")))
    least = thresholds(_tests(rows))
    return rows.select("doc_id", "base", _all(F.col("base"), F.col("tokens"), least).alias("spans"))


def digests(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, a digest of the base spans, and all spans as text."""
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return scan(docs).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"),
        (F.size("spans") - F.size("base")).cast("long").alias("n_random"),
    )


def _cut(text: Column, spans: Column) -> Column:
    """``text`` with MASK for each run of overlapping spans (in order of their starts), in one pass over the text as it was."""

    def of(chunks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / _CHUNK).cast("int")
            held = F.slice(chunks, first + 1, F.floor((b - 1) / _CHUNK).cast("int") - first + 1)
            return F.when(b > a, F.substring(F.array_join(held, ""), (a - first * _CHUNK + 1).cast("int"), (b - a).cast("int"))).otherwise(F.lit(""))

        ends = _running(F.transform(spans, lambda s: s["end"]), lambda a, x: F.greatest(a, x))
        gaps = F.zip_with(spans, ends, lambda s, end: F.when(s["start"] >= end, F.concat(piece(end, s["start"]), F.lit(MASK))).otherwise(F.lit("")))
        last = F.array_max(F.transform(spans, lambda s: s["end"]))
        return F.concat(F.array_join(gaps, ""), let(last, lambda a: piece(a, F.char_length(text).cast("long"))))

    return let(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{_CHUNK}}}"), F.lit(0)), of)


def redact(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with every span of :func:`scan` in ``text`` replaced by MASK; ``n_chars`` follows, if there.

    Spans are those of the text as it was; overlapping ones become one MASK, so nothing of any span stays.
    """
    text = shared.text_or_empty()
    least = thresholds(_tests(docs.select(_tested(text).alias("tokens"))))
    tokens = _tested(text) if least else F.array().cast("array<struct<start:long,end:long,encoding:string,n:long,p:double>>")
    spans = let(_base(text), lambda base: let(tokens, lambda own: _all(base, own, least)))
    masked = let(spans, lambda own: F.when(F.size(own) > 0, _cut(F.col("text"), own)).otherwise(F.col("text")))
    out = docs.withColumn("text", F.when(F.col("text").isNotNull(), masked))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out
