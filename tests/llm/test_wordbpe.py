import hashlib
import json
import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from fieldweave.llm import wordbpe
from fieldweave.llm.queries import WORDS

PATH = P.path(WORDS)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def made():
    r = random.Random(1)
    signs = "aéA ß\n\t日本😀'’sS<|endoftext|> \u0085 \x1c0٣½ǅ́‍\x00İΣς|.,  "
    words = ["the", "Über", "été", "<|endoftext|>", "<|startoftext|>", "it's", "WE'LL", "ababab", "aaaa", "日本語", "x.y,z", "ﬁne", "İx", "ΑΣ", "123"]
    out = ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(600)] + [r.choice([" ", "", "\n"]).join(r.choices(words, k=12)) for _ in range(200)]
    return [*out, None, "", "<|endoftext|>", "<|endoftext|>́x", "́", "a" * 3000, "ab" * 3000, " " * 2000, "<|endoftext|><|startoftext|>", "<|endof"]


def test_ids_and_text_equal_the_library(spark, library):
    docs = [*enumerate(made()), (3, "the same id"), (3, "the same id")]
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, ids int").repartition(3)
    want = []
    for i, t in docs:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    assert sorted(map(tuple, wordbpe.digests(df, PATH).collect())) == sorted(want)
    encoded = wordbpe.encode(df, PATH)
    back = {(r.doc_id, r.text) for r in wordbpe.decode(encoded, PATH).collect()}
    assert back == {(i, library.decode(library.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False)) for i, t in docs}
    assert wordbpe.digests(df.limit(0), PATH).collect() == []


def test_every_character_as_by_the_library(library):
    c = wordbpe.Codec(PATH)
    for low in range(0, 0x30000, 256):
        texts = [f"a{chr(x)} {chr(x)}B {chr(x)} E{chr(x)}É. {chr(x)}, {chr(x)}{chr(x)}" for x in range(low, low + 256) if not 0xD800 <= x < 0xE000]
        for t, ids in zip(texts, c.encode(texts), strict=True):
            assert ids.tolist() == library.encode(t, add_special_tokens=False).ids, repr(t)


def test_documents_of_the_tables(spark, library):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r.ids for r in wordbpe.encode(docs, PATH).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == library.encode(r.text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("many", [1, 3, 10**9])
def test_lists_and_arrays_merge_alike(monkeypatch, library, many):
    monkeypatch.setattr(wordbpe, "MANY", many)
    c, r = wordbpe.Codec(PATH), random.Random(many)
    texts = ["".join(r.choices("abeinthoABé", k=r.randint(1, 25))) for _ in range(3000)] + ["ab" * 50, "a" * 51, "haha" * 9, "inin" * 7]
    assert [x.tolist() for x in c.encode(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_small_memory_and_pieces(monkeypatch, library, spark):
    monkeypatch.setattr(wordbpe, "CACHE", 5)
    monkeypatch.setattr(wordbpe, "LONGEST", 4)
    monkeypatch.setattr(wordbpe, "BLOCK", 10)
    c = wordbpe.Codec(PATH)
    for _ in range(2):
        for t in made()[:150]:
            assert c.encode([t or ""])[0].tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_texts_of_megabytes(spark, library):
    r = random.Random(5)
    texts = [" ".join("".join(r.choices("aeiourstné", k=7)) for _ in range(500_000)), "xyz" * 700_000, "a b\n" * 800_000]
    for row in wordbpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), PATH).collect():
        assert row.ids == library.encode(texts[row.doc_id], add_special_tokens=False).ids


def test_files_that_are_not_supported(tmp_path):
    with pytest.raises(ValueError):
        wordbpe.PairIndex({"a": 0, "b": 1, "ab": 2, "abb": 3}, [("ab", "b"), ("a", "b")], "")
    spec = json.load(open(PATH))
    spec["added_tokens"][0]["lstrip"] = True
    (tmp_path / "t.json").write_text(json.dumps(spec))
    with pytest.raises(ValueError):
        wordbpe.Codec(str(tmp_path / "t.json"))
