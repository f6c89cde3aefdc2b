import re

import numpy as np

from fieldweave.llm import decontaminate as dc


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").lower()) if w]


def distance(item, text):
    """Edit distance of ``item`` to the nearest passage of ``text``."""
    row = [0] * (len(text) + 1)
    for a in item:
        new = [row[0] + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def brute(docs, items):
    out = {}
    for d, text in docs:
        w = words(text)
        for i, item in items:
            m = words(item)
            if len(m) >= 5 and (found := distance(m, w)) <= (len(m) // 5 if len(m) > 5 else 0):
                out[d, i] = found
    return out


def planted(seed, n=120):
    rng = np.random.default_rng(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choice(vocabulary, rng.integers(5, 60)))) for i in range(25)] + [(90, " ".join(rng.choice(vocabulary, 300))), (91, "w1 w2"), (92, None)]
    docs = []
    for d in range(n):
        text = list(rng.choice(vocabulary, rng.integers(0, 150)))
        if d % 2:
            item = words(items[rng.integers(0, 26)][1])
            for _ in range(rng.integers(0, len(item) // 5 + 1) if len(item) > 5 else 0):
                k, kind = rng.integers(0, len(item)), rng.integers(0, 3)
                item[k : k + 1] = [["new"], [], [item[k], "more"]][kind] if len(item) > 5 else [item[k]]
            at = rng.integers(0, len(text) + 1)
            text[at:at] = item
        docs.append((d, " ".join(text)))
    return docs, items


def run(spark, docs, items):
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, item_id int")
    i = spark.createDataFrame([(a, b, "x") for a, b in items], "item_id long, text string, doc_id string")
    return {(r.doc_id, r.item_id): r.distance for r in dc.find(d.repartition(2), i).collect()}


def test_equals_brute_force_but_for_recall(spark):
    hit = total = 0
    for seed in range(3):
        docs, items = planted(seed)
        want, got = brute(docs, items), run(spark, docs, items)
        assert all(want.get(k) is not None and got[k] >= want[k] for k in got)
        hit, total = hit + len(want.keys() & got.keys()), total + len(want)
    assert total > 100 and hit >= 0.98 * total, (hit, total)


def test_exact_copies_are_always_found(spark):
    _, items = planted(5)
    docs = [(i, f"before it {t} and after it") for i, t in items if t]
    got = run(spark, docs, items)
    assert all(got.get((i, i)) == 0 for i, t in items if t and len(words(t)) >= 5)


def test_blocks_nulls_and_empty_tables(spark, monkeypatch):
    docs, items = planted(6, 30)
    whole = run(spark, docs + [(500, None), (501, ""), (None, docs[1][1])], items)
    monkeypatch.setattr(dc, "BLOCK_BYTES", 1000)
    assert run(spark, docs + [(500, None), (501, ""), (None, docs[1][1])], items) == whole
    assert run(spark, [], items) == {} and run(spark, docs, []) == {}
    d = spark.createDataFrame(docs, "doc_id long, text string")
    i = spark.createDataFrame(items, "item_id long, text string")
    left = {r.doc_id for r in dc.keep_clean(d, i).collect()}
    assert left == {x for x, _ in docs} - {x for x, _ in whole}


def test_sf_documents(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").select("item_id", "text").collect()]
    got = run(spark, docs, items)
    joined = {d: " ".join(words(t)) for d, t in docs}
    exact = {(d, i) for i, t in items for d in joined if " ".join(words(t)) in joined[d]}
    assert exact and exact <= got.keys()


def edited(rng, item, d):
    """``item`` with exactly ``d`` random word edits in different places."""
    out = list(item)
    for k in sorted(rng.choice(len(item), d, replace=False), reverse=True):
        kind = rng.integers(0, 3)
        out[k : k + 1] = [[f"new{k}"], [], [out[k], f"more{k}"]][kind]
    return out


def recall(m, n=300, seed=1):
    """Share of items of ``m`` words that are found at the largest distance allowed, in long texts."""
    rng = np.random.default_rng([m, seed])
    items = [[f"i{i}w{j}" for j in range(m)] for i in range(n)]
    index = dc.Index(list(range(n)), [" ".join(x) for x in items])
    found = 0
    for i, item in enumerate(items):
        text = [f"x{k}" for k in range(40)] + edited(rng, item, dc.allowed(m)) + [f"y{k}" for k in range(40)]
        ((_, h, doc, _),) = dc.words_of(dc.pa.array([" ".join(text)]))
        found += any(r[1] == i for r in index.search(h, doc))
    return found / n


def test_recall_at_the_largest_distance_by_size():
    got = {m: recall(m, 150) for m in (6, 9, 10, 14, 19, 20, 29, 30, 45, 64, 100, 160)}
    assert all(v >= 0.9 for v in got.values()), got


def test_work_arrays_follow_the_windows_not_the_text():
    import tracemalloc

    h = np.random.default_rng(1).integers(1, 1 << 63, 1_000_000, dtype=np.uint64)
    start = np.arange(0, 1_000_000, 10_000)
    tracemalloc.start()
    dc.walk(h, np.full(len(start), len(h)), start, 60, np.tile([10, 50], (dc.REPEATS, 1)))
    assert tracemalloc.get_traced_memory()[1] < 4_000_000
    tracemalloc.stop()
