import hashlib

import numpy as np
import pytest

from fieldweave.llm import repeats

L = repeats.LENGTH


def brute(docs):
    """Straight from the definition, over all strings of L bytes in order."""
    seen, out = set(), []
    for doc_id, text in sorted(docs, key=lambda x: x[0]):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for i in range(len(data) - L + 1):
            s = data[i : i + L]
            if s in seen:
                gone[i : i + L] = True
            seen.add(s)
        kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((doc_id, len(data), int(gone.sum()), len(repeats.spans_of(gone)[0]), hashlib.sha256(kept).hexdigest()))
    return out


def made(seed, n=40):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeéß 日"), rng.integers(1, 7))) for _ in range(60)]
    line = " ".join(rng.choice(words, 40))
    docs = []
    for i in range(n):
        text = " ".join(rng.choice(words, rng.integers(0, 120)))
        kind = rng.integers(0, 8)
        if kind == 0 and docs:
            text = docs[rng.integers(0, len(docs))][1]
        elif kind == 1:
            cut = rng.integers(0, 60)
            text = text[:50] + line[cut:] + text[50:] + line
        elif kind == 2:
            text = "a" * rng.integers(0, 400) + text
        elif kind == 3:
            text = ("xyz\x00" * 90)[rng.integers(0, 9) :] + text
        elif kind == 4:
            text = text + "q" + text[3:]
        elif kind == 5 and docs:
            other = docs[rng.integers(0, len(docs))][1] or ""
            text = other[: len(other) // 2] + "#" + other[len(other) // 2 + 1 :]
        elif kind == 6:
            text = rng.choice([None, "", "short"])
        docs.append((i, text))
    return docs


def run(spark, docs, hot=None):
    df = spark.createDataFrame([(d, t, 1, "k") for d, t in docs], "doc_id long, text string, bucket int, kind string")
    return [tuple(r) for r in repeats.digests(df.repartition(3), hot).orderBy("doc_id", "n_bytes").collect()]


@pytest.mark.parametrize(("seed", "hot"), [(0, None), (1, None), (2, None), (0, 0), (1, 2), (5, 3)])
def test_equals_brute_force(spark, seed, hot):
    """Small values of ``hot`` send triggers through the order of their suffixes."""
    docs = made(seed)
    assert run(spark, docs, hot) == brute(docs)


def test_long_documents_in_pieces(spark, monkeypatch):
    docs = made(9, 12)
    docs.append((50, " ".join(x for _, x in docs if x)))
    whole = {}
    for piece in (1 << 22, 1000):
        monkeypatch.setattr(repeats, "PIECE", piece)
        rows = []
        for _, text in docs:
            buf = np.frombuffer((text or "").encode(), np.uint8)
            rows.append([tuple(int(v) for v in x) for p in repeats.parse(buf, np.array([0, len(buf)])) for x in zip(p["trigger"], p["first"], p["last"], p["g"], p["f"], strict=True)])
        whole[piece] = rows
    assert whole[1000] == whole[1 << 22]


def test_texts_longer_than_a_piece(spark):
    """Lengths around the piece, where the last piece may hold no window at all."""
    rng = np.random.default_rng(3)
    base = "".join(rng.choice(list("abcdefgh "), repeats.PIECE + 300))
    docs = [(i, base[: repeats.PIECE + extra]) for i, extra in enumerate((-1, 1, 90, 180, 300))]
    got = run(spark, docs)
    assert got[0][2] == 0
    for (_, a), (_, b), r in zip(docs, docs[1:], got[1:], strict=False):
        # all but the bytes that no earlier text has are covered by strings of the text before
        assert r[2] == len(a) and r[1] == len(b)


def test_sf_documents_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert run(spark, docs) == brute(docs)


def test_repeated_rows_and_empty_table(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen"
    rows = run(spark, [(1, text), (1, text), (2, text), (None, None)])
    assert [r[:4] for r in rows] == [(None, 0, 0, 0), (1, len(text), 0, 0), (1, len(text), 0, 0), (2, len(text), len(text), 1)]
    assert run(spark, []) == []


def test_phrases_alike_in_half_their_hash(spark):
    """Two texts around one trigger whose phrase hashes agree in the top 32 bits, but in no window."""
    a = "yrjxntyhqh iiveokm bdzcvuzwdrqmkzb  rpktqkhn obr iiwutgi xeg r dinlmzl k kyy rjqsz vcvjwskbkzsnnl ejr vtk   tbwxaycxoxv aqcsjis  seswexshbj wnh ignqhxvstqeif  iqxtfqihq"
    b = "cp w jjg  gymyjnwbrgoua  pks wyqqt zit ewe g  swsguqkropsu  bq r f pzl k kyy rjqsz vcvjwskbkzsnnl ejiodlkmlxklqdk rcqplamq  h w  b qmyjjhladikagsp xuwdgdt xxfei aiwwmyq"
    p, q = (repeats.phrases(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x)])) for x in (a, b))
    assert p["g"] == q["g"] and p["f"] >> np.uint64(32) == q["f"] >> np.uint64(32)
    docs = [(1, a), (2, b), (3, a)]
    assert run(spark, docs) == brute(docs)


def test_a_line_of_all_documents_is_hot_and_spread(spark, monkeypatch):
    monkeypatch.setattr(repeats, "HOT", 30)
    monkeypatch.setattr(repeats, "HELD", 2000)
    rng = np.random.default_rng(4)
    letters = list("abcdefghijklmnopq ")
    line = "".join(rng.choice(letters, 150))
    docs = [(i, "".join(rng.choice(letters, 120)) + line + "".join(rng.choice(letters, 120))) for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    n, hot = repeats.count_triggers(df, 50)
    assert n == 50 and 0 < len(hot) < 4 * n
    monkeypatch.setattr(repeats.shared, "parts", lambda df: 50)
    assert run(spark, docs) == brute(docs)
