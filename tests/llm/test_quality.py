import re
from collections import Counter

import numpy as np
import pytest

from fieldweave.llm import quality, shared


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + k for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for k in range(3)}
    n, rep = len(words), len(covered)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, rep, n < 50 or 100 * rep > 50 * n


def made():
    rng = np.random.default_rng(1)
    words = ["a", "bé", "日本", "#x", "|", "<>", "it's", "\x1c", " ", " x", "A", "42"]
    gaps = [" ", "  ", "\n", "\n\n", "\t", "\r\n", "\x0b", "\x0c"]
    out = []
    for _ in range(300):
        n = int(rng.integers(0, 130))
        text = "".join(str(rng.choice(words)) + str(rng.choice(gaps, p=[0.6, 0.05, 0.15, 0.05, 0.05, 0.04, 0.03, 0.03])) for _ in range(n))
        out.append(text)
    return [*out, None, "", "\n", "x\nx\nx", "same line here\n" * 30, "same line here\n" * 30 + "same line here"]


def run(spark, docs, model=None):
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, kept string")
    return quality.judge(df.repartition(3), model).collect()


def test_base_counts_equal_brute_force(spark):
    docs = [*enumerate(made())]
    rows = run(spark, docs)
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(dict(docs)[r.doc_id]), repr(dict(docs)[r.doc_id])
        assert r.kept is not r.base_failed
    assert run(spark, []) == []


def test_documents_of_the_tables(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    for r in run(spark, docs):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(dict(docs)[r.doc_id])


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    ids, x, y = quality.sample_features(docs, labels)
    fit = ids % 2 == 0
    model = quality.fit(x[fit], y[fit], list(quality.FEATURES.values()))
    score = model.score(x[~fit])
    assert ((score >= 0.5) == (y[~fit] == 1)).mean() > 0.97
    assert (score[y[~fit] == 1] >= 0.5).mean() > 0.985  # clean documents stay


def test_scores_are_monotone_and_equal_a_walk_of_the_trees():
    rng = np.random.default_rng(2)
    x = rng.random((3000, 3))
    y = (x[:, 0] + 0.5 * np.sin(9 * x[:, 1]) + 0.2 * rng.standard_normal(3000) < 0.7).astype(float)
    model = quality.fit(x, y, [-1, 0, 0])
    assert (np.diff(model.score(np.stack([np.linspace(-1, 2, 200), np.full(200, 0.3), np.full(200, 0.6)], 1))) <= 1e-12).all()
    for row in x[:50]:
        total = model.base
        for t in range(len(model.feature)):
            k = 0
            while model.left[t, k] != k:
                k = model.left[t, k] if row[model.feature[t, k]] <= model.threshold[t, k] else model.right[t, k]
            total += model.value[t, k]
        assert abs(model.score(row[None])[0] - 1 / (1 + np.exp(-total))) < 1e-12
    assert quality.fit(x, np.ones(3000), [0, 0, 0]) is None


def test_no_labels_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "word " * 10), (1, "word " * 10), (None, " ".join(f"w{i}" for i in range(80)))], "doc_id long, text string")
    empty = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.train(docs, empty) is None
    assert sorted((r.doc_id or 0, r.kept) for r in quality.judge(docs, None).collect()) == [(0, True), (1, False), (1, False)]
    assert [r.doc_id for r in quality.keep_good(docs, None).collect()] == [None]


@pytest.mark.parametrize("n", [2, 3, 12, 19])
def test_few_labels_of_both_classes(spark, n):
    """Half of the documents are full of symbols and bad; another of each kind is judged by the model."""
    texts = [" ".join(f"w{i}x{k}" + "#$%" * (i % 2) for k in range(60)) for i in range(n + 2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(n)], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert model is not None
    got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs, model).collect()}
    assert all(got[i] == (False, i % 2 == 0) for i in (n, n + 1))


def thue_morse(n, letters="ab"):
    word, other = letters
    while len(word) < n:
        word, other = word + other, other + word
    return word, other


@pytest.mark.parametrize("n", [128, 1024, 2048, 4096])
def test_different_lines_that_a_polynomial_hash_takes_for_equal(spark, n):
    a, b = thue_morse(n)
    docs = [(1, f"{a}\n{b}"), (2, f"{a}\n{b}\n{a}"), (3, f"{a} x y {b} x y"), (4, f"{a} x y {a} x y")]
    for r in run(spark, docs):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(dict(docs)[r.doc_id])


def test_counts_do_not_hang_on_the_hash(monkeypatch):
    monkeypatch.setattr(shared, "names", lambda buf, s, e: (e - s).astype(np.uint64) % np.uint64(3))
    monkeypatch.setattr(shared, "BLOCK", 50)
    import pyarrow as pa

    for text in made():
        for b in shared.blocks(pa.array([text or ""]), 1 << 20):
            counts = quality.block_statistics(b)[0][0].tolist()
            assert tuple(counts) == base(text)[:5], repr(text)


def test_texts_of_megabytes(spark):
    docs = [(1, "word after word and line\n" * 100_000), (2, "x" * 3_000_000), (3, " ".join(map(str, range(400_000))))]
    for r in run(spark, docs):
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(dict(docs)[r.doc_id])


def test_query_counts_equal_their_sql(spark):
    import duckdb

    from fieldweave.llm import queries

    con = duckdb.connect()
    con.sql("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.01/documents.parquet'")
    sql = con.sql(queries.QUALITY_COUNTS_SQL)
    got = queries.op4_quality_counts(spark, "/root/testdata/sf0.01").select(*sql.columns)
    assert sorted(map(tuple, got.collect())) == sorted(sql.fetchall())
