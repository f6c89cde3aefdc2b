import base64
import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken

from fieldweave.llm import attribution, bpe
from fieldweave.llm.queries import RANKS

PATH = P.path(RANKS)


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def made():
    r = random.Random(1)
    signs = "aé ß\n\t日本😀'’sS<|endoftext|> \u0085 \x1c0٣½ǅ́‍\x00"
    return ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(400)] + [None, "", "<|endoftext|>", "a" * 3000, " " * 2000, "it's we'll 'S"]


def test_ids_equal_the_library_and_decode(spark, library):
    docs = list(enumerate(made()))
    df = spark.createDataFrame([(i, t, 3) for i, t in docs], "doc_id long, text string, ids int")
    got = {r.doc_id: r for r in bpe.digests(df.repartition(3), PATH, P.PATTERN).collect()}
    for i, t in docs:
        ids = library.encode_ordinary(t or "")
        assert got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest()
        assert got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    encoded = bpe.encode(df, PATH, P.PATTERN)
    assert {r.doc_id: bytes(r.data).decode() for r in bpe.decode(encoded, PATH, P.PATTERN).collect()} == {i: t or "" for i, t in docs}
    assert bpe.digests(df.limit(0), PATH, P.PATTERN).collect() == []


def test_every_character_is_split_as_by_the_library(library):
    c = bpe.codec(PATH, P.PATTERN)
    for low in range(0, 0x110000, 64):
        text = "".join(f"a{chr(x)}1{chr(x)} {chr(x)} {chr(x)}{chr(x)}!" for x in range(low, low + 64) if not 0xD800 <= x < 0xE000)
        if text:
            assert [i for m in c.split(text) for i in library.encode_ordinary(m)] == library.encode_ordinary(text), hex(low)


def test_a_full_table_is_emptied(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE", 5)
    c = bpe.Codec(PATH, P.PATTERN)
    for t in made()[:100]:
        assert c.encode(t or "").tolist() == library.encode_ordinary(t or "")


def test_offsets_cover_the_text(spark):
    docs = [(i, t) for i, t in enumerate(made())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    c = bpe.codec(PATH, P.PATTERN)
    for r in bpe.encode(df, PATH, P.PATTERN, offsets=True).collect():
        text = dict(docs)[r.doc_id] or ""
        at = 0
        for i, s, e in zip(r.ids, r.starts, r.ends, strict=True):
            piece = c.bytes_of[i]
            data = text.encode()
            assert data[at : at + len(piece)] == piece
            assert s == len(data[:at].decode(errors="ignore")) and e == len(text) - len(data[at + len(piece) :].decode(errors="ignore"))
            at += len(piece)
        assert at == len(text.encode())


def owned(spans, owner, n, rule):
    want, crossing = [0] * n, 0
    for s, e in spans:
        own = owner[s : max(e, s + 1)]
        crossing += len(set(own)) > 1
        want[own[0] if rule == "first" else own[-1] if rule == "last" else max(sorted(set(own)), key=own.count)] += 1
    return want, crossing


def spans_of(library, text):
    """Character spans by the library's own pieces of bytes."""
    data, at, out = text.encode(), 0, []
    for piece in library.decode_tokens_bytes(library.encode_ordinary(text)):
        begin, end = len(data[:at].decode(errors="ignore")), len(text) - len(data[at + len(piece) :].decode(errors="ignore"))
        out.append((begin, end))
        at += len(piece)
    return out


def test_section_counts_equal_brute_force(spark, library):
    docs = [*enumerate(made()), (900, "one two\n\nthree\n"), (900, "one two\n\nthree\n")]
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, n_tokens string")
    for r in attribution.section_counts(df, PATH, P.PATTERN, attribution.RULES).collect():
        text = dict(docs)[r.doc_id] or ""
        lines = text.split("\n")
        lines = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or len(lines) == 1 else [])
        owner, spans = [i for i, x in enumerate(lines) for _ in x], spans_of(library, text)
        for rule in attribution.RULES:
            want, crossing = owned(spans, owner, len(lines), rule)
            assert (r.n_tokens, r.n_sections, r.n_crossing, r[f"tokens_{rule}"]) == (len(spans), len(lines), crossing, want)
            assert sum(want) == r.n_tokens


def test_field_counts_equal_brute_force(spark, library):
    rows = [(i, t, ["a title", None, "12 34\n5", "é"][i % 4], "" if i % 3 else t) for i, t in enumerate(made()[:120])]
    df = spark.createDataFrame(rows, "doc_id long, body string, title string, tail string").repartition(3)
    for r in attribution.field_counts(df, PATH, P.PATTERN, ["title", "body", "tail"], attribution.RULES, "\n").collect():
        _, body, title, tail = rows[r.doc_id]
        parts = [(title or "") + "\n", (body or "") + "\n", tail or ""]
        text = "".join(parts)
        owner, spans = [i for i, x in enumerate(parts) for _ in x], spans_of(library, text)
        for rule in attribution.RULES:
            want, crossing = owned(spans, owner, 3, rule)
            assert (r.n_tokens, r.n_fields, r.n_crossing, r[f"tokens_{rule}"]) == (len(spans), 3, crossing, want)


def test_digest_of_offsets(spark, library):
    docs = list(enumerate(made()))
    got = {r.doc_id: r.offsets_sha256 for r in bpe.digests(spark.createDataFrame(docs, "doc_id long, text string"), PATH, P.PATTERN).collect()}
    for i, t in docs:
        spans = spans_of(library, t or "")
        flat = [s for s, _ in spans] + [e for _, e in spans]
        assert got[i] == hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in flat)).hexdigest()
