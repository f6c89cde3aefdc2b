import re
from collections import Counter, defaultdict

import numpy as np

from fieldweave.llm import nearcopies as nc
from fieldweave.llm.components import components


def weighted(text, idf):
    """The weighted set of a text, from the definition; words are looked up by the hash of a lone word."""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]
    got = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else Counter([tuple(words)] if words else [])
    return {s: n * max(idf[w] for w in s) for s, n in got.items()}


def similar(a, b):
    both = sum(min(w, b.get(s, 0)) for s, w in a.items())
    total = sum(a.values()) + sum(b.values()) - both
    return both >= 0.8 * total - 1e-9 if total else True


def brute(docs):
    texts = dict(docs)
    n = len(docs)
    df = Counter(w for _, t in docs for w in {w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w})
    floor = max(n / nc.RARE, 1)
    idf = {w: 1 + np.log(n / max(c, floor)) / np.log(n / floor) if n > 1 else 2.0 for w, c in df.items()}
    sets = {d: weighted(t, idf) for d, t in docs}
    by = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            by[x].append(d)
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    empty = [d for d, s in sets.items() if not s]
    pairs = {(a, b) for ds in by.values() for i, a in enumerate(ds) for b in ds[i + 1 :]} | {(empty[0], d) for d in empty[1:]}
    for a, b in pairs:
        if similar(sets[a], sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d: find(d) for d in texts}


def classes(spark, docs):
    df = spark.createDataFrame([(d, t, "a") for d, t in docs], "doc_id long, text string, size string")
    return {r.doc_id: r.class_id for r in nc.classes(df.repartition(3)).collect()}


def test_sf_documents_equal_all_pairs(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got, want = classes(spark, docs), brute(docs)
    wrong = [d for d in want if got[d] != want[d]]
    assert len({want[d] for d in want}) < len(want)
    assert len(wrong) <= 0.005 * len(want), wrong


def test_large_bucket_in_several_units(spark, monkeypatch):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(200)]
    docs = []
    for i in range(150):
        words = list(base)
        words[rng.integers(0, 200)] = f"edit{i}"
        docs.append((i, " ".join(words)))
    docs += [(1000 + i, " ".join(f"z{i}_{k}" for k in range(60))) for i in range(20)]
    monkeypatch.setattr(nc, "UNIT", 40)
    got = classes(spark, docs)
    assert {got[i] for i in range(150)} == {0}
    assert all(got[1000 + i] == 1000 + i for i in range(20))


def test_pairs_that_no_unit_held(spark, monkeypatch):
    """One bucket of three kinds of texts that share a passage: only likeness within a kind counts."""
    rng = np.random.default_rng(8)
    passage, docs = " ".join(f"p{i}" for i in range(40)), []
    for i in range(90):
        words = [f"k{i % 3}_{j}" for j in range(80)]
        words[rng.integers(0, 80)] = f"edit{i}"
        docs.append((i, passage + " " + " ".join(words)))
    docs += [(200 + i, passage + " " + " ".join(f"z{i}_{j}" for j in range(80))) for i in range(30)]
    own = spark.createDataFrame(docs, "doc_id long, text string")
    idf = nc.document_frequencies(own)
    large = own.selectExpr("1 AS band", "7L AS key", "doc_id")
    nobody = spark.createDataFrame([], "node long, root long")
    for size in (1024, 12):
        monkeypatch.setattr(nc, "UNIT", size)
        met = nc.rest_units(large, own, nobody, idf)
        edges = nc.verify(met.join(own, "doc_id").select("unit", "doc_id", "text"), idf)
        roots = {r.node: r.root for r in components(edges).collect()}
        assert roots == {d: c for d, c in brute(docs).items() if d != c}
        done = spark.createDataFrame([(d, 0) for d, _ in docs if d], "node long, root long")
        assert nc.rest_units(large, own, done, idf).count() == 0


def test_edges_of_the_input(spark):
    docs = [(5, None), (6, ""), (7, " \n\t"), (8, "one two"), (9, "One  two"), (10, "one"), (11, "x y z " * 50_000), (12, "x y z " * 50_000)]
    assert classes(spark, docs) == {5: 5, 6: 5, 7: 5, 8: 8, 9: 8, 10: 10, 11: 11, 12: 11}
    assert classes(spark, []) == {}
    df = spark.createDataFrame([(1, "a b c", 0), (1, "a b c", 0), (2, "A b c", 1), (None, "a b c", 2), (3, "other text", 3)], "doc_id long, text string, size int")
    assert sorted((r.doc_id or -1, r.size) for r in nc.keep_one(df).collect()) == [(-1, 2), (1, 0), (3, 3)]


def test_samples_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    key = rng.integers(1, 1 << 63, 400, dtype=np.uint64)
    w1, w2 = rng.uniform(0.5, 3, 400), rng.uniform(0.5, 3, 400)
    owner = np.repeat([0, 1], 400)
    _, drawn = nc.samples(owner, np.concatenate([key, key]), np.concatenate([w1, w2]), 3000)
    want = np.minimum(w1, w2).sum() / np.maximum(w1, w2).sum()
    assert abs((drawn[0] == drawn[1]).mean() - want) < 0.04


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(60)] + [(200, 199), (199, 200), (7, 7)], "u long, v long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 200: 199}


def test_document_frequencies_are_exact(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()] + [(-1, None), (-2, "A a B")]
    df = Counter(w for _, t in docs for w in {w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w})
    got = nc.document_frequencies(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    names = sorted(df)
    h = np.concatenate([nc._words(b)[0] for b in nc.shared.blocks(nc.pa.array([" ".join(names)]))])
    want = [1 + np.log(len(docs) / df[w]) / np.log(len(docs)) for w in names]
    assert np.allclose(got.of(h), want) and len(got.word) == sum(c > 1 for c in df.values())
    assert nc.Weights(np.array([7], np.uint64), np.array([50_000]), 10**9).of(np.array([7, 8], np.uint64)).tolist() == [2.0, 2.0]
