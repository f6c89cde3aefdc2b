import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from fieldweave.llm import queries, variants


def counted(docs):
    total = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            total[run if h % 97 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return total


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs, least=5, often=3):
    n = {w: k for w, k in counted(docs).items() if len(w) >= least and k >= often}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x.encode()), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, n[w], len(near[w]), form.get(w), n.get(form.get(w)), root))
    return sorted(out, key=repr)


def run(spark, docs, **more):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, word string, n int").repartition(4)
    return sorted((tuple(r) for r in variants.group(df, **more).collect()), key=repr)


def made(letters="abé", size=(3, 9), docs=60, seed=2):
    r = random.Random(seed)
    words = ["".join(r.choices(letters, k=r.randint(*size))) for _ in range(150)]
    weights = [r.random() ** 4 for _ in words]
    return [(i, " ".join(r.choices(words, weights, k=60))) for i in range(docs)]


def test_equals_brute_force(spark):
    odd = [(100, None), (101, ""), (102, "12 __ 日本"), (7, "aabba aabba aabba"), (7, "aabba aabba aabba"), (None, "abbaa-ABBAA'abbaaÀ×÷ß " * 3)]
    docs = made() + odd
    assert run(spark, docs) == brute(docs)


@pytest.mark.parametrize(("letters", "size", "seed"), [("ab", (4, 7), 1), ("abcdefgh", (5, 6), 2), ("aÿß", (5, 12), 3)])
def test_dense_vocabularies(spark, letters, size, seed):
    docs = made(letters, size, 40, seed)
    assert run(spark, docs, often=1) == brute(docs, often=1)


def test_words_beyond_the_walk(spark, monkeypatch):
    monkeypatch.setattr(variants, "DEEPEST", 7)
    docs = made("ab", (5, 12), 40, 4)
    assert run(spark, docs, often=1) == brute(docs, often=1)


def test_very_long_runs(spark):
    r = random.Random(9)
    base = "".join(r.choices("abcdefghij", k=3000))
    words = [base, base[:1500] + base[1501:], base[:-1], base[:9] + "z" + base[10:], "z" + base, base[::-1], "a" * 40, "a" * 41, "a" * 42, "a" * 39 + "b"]
    docs = [(i, " ".join(w for w in words for _ in range(3 + 7 * (w == base)))) for i in range(2)]
    assert run(spark, docs) == brute(docs)


def test_a_text_of_megabytes_and_chains(spark):
    docs = [(1, "spellings " * 400_000 + "speling " * 3 + "spelings " * 40 + "spelling " * 300)]
    assert run(spark, docs) == brute(docs)


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, "abc ab")]) == []
    assert run(spark, [(1, "single single single single")]) == brute([(1, "single single single single")])


def test_counts_are_sent_on_when_many(spark, monkeypatch):
    monkeypatch.setattr(variants, "HELD", 2)
    monkeypatch.setattr(variants, "PIECE", 20)
    docs = made(docs=10)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.word: r.n for r in variants.words(df, 1, 1).collect()} == {w: k for w, k in counted(docs).items() if w}


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    sql = con.sql(queries.ORACLE_SQL["op13_spelling_variants"])
    got = queries.op13_spelling_variants(spark, "/root/testdata/sf0.001").select(*sql.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(sql.fetchall(), key=repr)
