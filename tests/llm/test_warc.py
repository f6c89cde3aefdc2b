import base64
import gzip
import hashlib
import io
import random

from fieldweave.llm import shared, warc


def frame(spark, rows):
    return spark.createDataFrame([(*r, "2024-01-01T00:00:00Z", "x") for r in rows], "page_id long, url string, html string, date string, digest string")


def histories(spark, rows):
    df = warc.histories(frame(spark, rows).repartition(3), shared.scratch(spark))
    return df.orderBy("capture_no").collect()


def made():
    r = random.Random(1)
    bodies = ["", "<p>é</p>", "a\r\n\r\nWARC/1.1\r\n\r\nb", "\r\n", "plain", "x" * 300_000]
    return [(i, r.choice(["http://b.com/x", "http://www.a.org/Y?q=1", "https://c.net:8443/#f", "odd", None, "http://d/a\nb"]), r.choice([*bodies, None])) for i in range(120)]


def test_round_trip(spark):
    rows = made()
    last = {}
    for page, _, html in rows:
        last[html or ""] = max(page, last.get(html or "", page))
    got = histories(spark, rows)
    assert len(got) == len(rows)
    for r in got:
        body = rows[r.page_id][2] or ""
        own = last[body] == r.page_id
        assert r.payload_bytes == len(body.encode())
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body.encode()).digest()).decode()
        assert r.record_type == ("response" if own else "revisit")
        assert r.refers_to == (None if own else last[body])


def test_histories_are_in_global_order(spark):
    got = histories(spark, made())
    keys = [(r.url_key, r.date, r.page_id) for r in got]
    assert keys == sorted(keys)


def test_archives_are_plain_warc(spark):
    path = shared.scratch(spark)
    warc.write(frame(spark, [(1, "http://a/", "one"), (2, "http://b/", "one")]).coalesce(1), path)
    texts = [gzip.decompress(bytes(r.content)) for r in spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).collect()]
    assert all(t.startswith(b"WARC/1.1\r\n") and t.endswith(b"\r\n\r\n") for t in texts)
    records = [x for t in texts for x in warc.parse(io.BytesIO(t))]
    assert {f["warc-type"]: p for f, _, p in records} == {"response": b"one", "revisit": b""}


def test_repeated_rows_nulls_and_empty_table(spark):
    got = histories(spark, [(1, "http://a/", "t"), (1, "http://a/", "t"), (None, "http://a/", "t"), (2, None, None)])
    assert sorted((r.page_id or 0, r.record_type) for r in got) == [(0, "response"), (1, "response"), (1, "response"), (2, "response")]
    assert histories(spark, []) == []


def test_loser_tree():
    r = random.Random(2)
    for k in range(0, 9):
        runs = [sorted((r.randint(0, 20), i) for _ in range(r.randint(0, 15))) for i in range(k)]
        assert list(warc.LoserTree(lambda x: x, runs)) == sorted(x for run in runs for x in run)


def test_blocks_are_opened_as_they_are_met():
    r = random.Random(3)
    for k in range(0, 9):
        runs = [sorted((r.randint(0, 500), i) for _ in range(r.randint(0, 200))) for i in range(k)]
        blocks = sorted((run[a], i, run[a : a + 7]) for i, run in enumerate(runs) for a in range(0, len(run), 7))
        held, most = set(), 0

        def met():
            for b in blocks:
                held.add(b[0])
                yield b

        out = list(warc.merged(met(), lambda x: x))
        assert out == sorted(x for run in runs for x in run)
    # runs that follow one another: one block of each is held at a time
    tree_sizes = []
    blocks = [(i * 10, i, [i * 10 + j for j in range(10)]) for i in range(50)]

    class Watched(warc.LoserTree):
        def add(self, name, rows):
            super().add(name, rows)
            tree_sizes.append(sum(map(len, self.queues)))

    whole, warc.LoserTree = warc.LoserTree, Watched
    try:
        assert list(warc.merged(iter(blocks), lambda x: x)) == list(range(500))
    finally:
        warc.LoserTree = whole
    assert max(tree_sizes) <= 10


def test_a_record_is_read_by_its_index_row(spark):
    rows, path = made(), shared.scratch(spark)
    got = warc.histories(frame(spark, rows).repartition(2), path).collect()
    assert [r.capture_no for r in sorted(got, key=lambda r: (r.url_key, r.date, r.page_id))] == list(range(1, len(rows) + 1))
    files = {r.path: bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect()}
    for r in got:
        own = gzip.decompress(files[r.file][r.offset : r.offset + r.length])
        ((fields, _, payload),) = warc.parse(io.BytesIO(own))
        assert fields["warc-record-id"] == f"<urn:page:{r.page_id}>" and warc.url_key(fields["warc-target-uri"]) == r.url_key
        assert payload == (b"" if r.record_type == "revisit" else (rows[r.page_id][2] or "").encode())


def test_url_keys():
    want = {"http://user@www.A.org:80/Path?Q=1#f": "org,a)/path?q=1", "https://a.org:8443": "org,a:8443)/", "https://a.org?x": "org,a)/?x", " Odd ": "odd", "": ""}
    assert {u: warc.url_key(u) for u in want} == want


def test_equals_sql(spark):
    import duckdb
    import pandas as pd

    from fieldweave.llm.queries import ORACLE_SQL, op8_warc

    rows, path = made(), shared.scratch(spark)
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    pages.write.parquet(f"{path}/pages.parquet")
    con = duckdb.connect()
    con.register("pages", pd.DataFrame(rows, columns=["page_id", "url", "html"]))
    want = con.sql(ORACLE_SQL["op8_warc"])
    got = op8_warc(spark, path)
    assert sorted(map(tuple, got.select(*want.columns).collect())) == sorted(want.fetchall())


def test_repeated_captures_over_many_blocks_stay_in_order(spark, monkeypatch):
    rows = [("same", "2024-01-01T00:00:00Z", 1, "response")] * 2000 + [("same", "2024-01-01T00:00:00Z", 2, "response")] * 700
    data = [(f"run{k}", i, *r, 0, "D", None, 10 * i, 10) for k in range(3) for i, r in enumerate(rows)]
    runs = warc.shared.materialize(spark.createDataFrame(data, warc.SCHEMA))
    out = warc.merge_runs(runs).orderBy("capture_no").collect()
    assert [r.capture_no for r in out] == list(range(1, len(data) + 1))
    assert [r.page_id for r in out] == sorted(r.page_id for r in out)
    for k in range(3):
        own = [r.offset for r in out if r.file == f"run{k}" and r.page_id == 1]
        assert own == sorted(own)
    cut = [((), 0, list(range(9))), ((), 1, list(range(4))), ((), 1, list(range(4, 9)))]
    assert list(warc.merged(iter(cut), lambda x: ())) == [*range(9), *range(9)]


def test_files_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    import os
    import random

    r = random.Random(4)
    pages = [(i, f"http://a.example/{i}", "".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=400_000)), "2024-01-01T00:00:00Z") for i in range(12)]
    captures = spark.createDataFrame(pages, "page_id long, url string, html string, date string").coalesce(1)
    # the bound travels with the function, so it is set where the tasks read it: in the closure's module constant
    path = str(tmp_path / "w")
    monkeypatch.setattr(warc, "FILE_RECORDS", 3)
    warc.write(captures, path)
    files = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]
    assert len(files) >= 4
    got = warc.histories(captures, str(tmp_path / "v")).collect()
    assert {(x.page_id, x.payload_bytes) for x in got} == {(i, 400_000) for i in range(12)}
