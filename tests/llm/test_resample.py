import hashlib
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import pytest

from fieldweave.llm import queries, resample


def features(text, least=1, most=1):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    return len(words), [" ".join(words[i : i + n]) for n in range(least, most + 1) for i in range(len(words) - n + 1)]


def brute(docs, target, least=1, most=1, percent=10, least_words=20, buckets=10_000, seed=2024):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = (Counter(bucket(f) for x in texts for f in features(x, least, most)[1]) for texts in ([x for _, x in docs], target))
    n_s, n_t = s.total(), t.total()
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
    rows = []
    for key, text in docs:
        n, found = features(text, least, most)
        h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(f)) for f in found)
        rows.append([key, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n])
    able = sorted((r for r in rows if r[5] >= least_words), key=lambda r: (-r[3], r[0] is not None, r[0] or 0, r[2], r[1]))
    for place, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = place
    return sorted(map(tuple, rows), key=repr)


def made():
    r = random.Random(3)
    words = ["Data", "data", "é", "É", "x1", "日本", "the", "İ", " ", "_", "it's", "ALPHA", "ḱ", "\x7f", "\x00"]
    out = [(i, r.choice([" ", "\n", " - ", "\t"]).join(r.choices(words, k=r.randint(0, 60)))) for i in range(300)]
    return [*out, (300, None), (301, ""), (302, "!?"), (7, out[7][1]), (7, out[7][1]), (None, "one two " * 20)]


def run(spark, docs, target, **more):
    df = spark.createDataFrame([(k, t, "x", 1) for k, t in docs], "doc_id long, text string, rank string, bucket int").repartition(5)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    return sorted((tuple(r) for r in resample.resample(df, goal, **more).collect()), key=repr)


@pytest.mark.parametrize("more", [{}, {"least": 1, "most": 3, "buckets": 500}, {"least": 2, "most": 2, "percent": 50, "least_words": 1}])
def test_equals_brute_force(spark, more):
    target = ["data data é the", None, "", "alpha 日本 x1"]
    assert run(spark, made(), target, **more) == brute(made(), target, **more)


def test_long_texts_are_taken_in_pieces(spark, monkeypatch):
    f = resample.Featuriser(1, 3, 1000)
    texts = ["Ab cd-ef " * 500, "x" * 5000 + " y z", "é " * 3000]
    whole = [f.of(t) for t in texts]
    monkeypatch.setattr(resample, "PIECE", 50)
    for t, (n, found) in zip(texts, whole, strict=True):
        got, cut = f.of(t)
        assert got == n and sorted(cut) == sorted(found)
        want = features(t, 1, 3)
        assert n == want[0] and Counter(found.tolist()) == Counter(zlib.crc32(x.encode()) % 1000 for x in want[1])


def test_a_text_of_megabytes(spark):
    big = "Word and word " * 400_000  # 5.6 MB
    assert run(spark, [(1, big), (2, "a b c")], ["word"]) == brute([(1, big), (2, "a b c")], ["word"])


def test_empty_tables(spark):
    assert run(spark, [], ["a"]) == []
    assert run(spark, made()[:40], []) == brute(made()[:40], [])


def test_a_full_table_is_emptied(monkeypatch):
    monkeypatch.setattr(resample, "CACHE", 3)
    f = resample.Featuriser(1, 1, 10_000)
    assert f.of("a b c d e a b")[1].tolist() == [zlib.crc32(x.encode()) % 10_000 for x in "abcdeab"]


def test_query_equals_its_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    sql = con.sql(queries.ORACLE_SQL["op11_resampling"])
    got = queries.op11_resampling(spark, "/root/testdata/sf0.001").select(*sql.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(sql.fetchall(), key=repr)
