import random
from urllib.parse import urlsplit

from pyspark.sql import functions as F

from fieldweave.llm import url_filter as uf


def brute(captures, entries):
    by = {}
    for pattern, action, entry, day in entries:
        if pattern is not None and day is not None:
            by.setdefault(pattern, {})
            by[pattern][day] = max(by[pattern].get(day, ("", "")), (action, entry))
    out = {}
    for page, url, day in captures:
        best = None
        parts = urlsplit(url or "")
        host = (parts.hostname or "").lower() if "://" in (url or "") else ""
        labels, segments = host.split("."), [s for s in parts.path.split("/") if s]
        keys = [".".join(labels[i:]) for i in range(len(labels))] + [host + "/" + "/".join(segments[:i]) for i in range(1, len(segments) + 1)]
        for key in keys if host else ():
            past = [d for d in by.get(key, {}) if d <= day]
            if past and by[key][max(past)][0] != "remove":
                best = max(best or (), (len(key), max(past), key, *by[key][max(past)]))
        out[page] = (best[3], best[2], best[1]) if best else ("none", None, None)
    return out


def run(spark, captures, entries):
    c = spark.createDataFrame([(*x, "z") for x in captures], "page_id long, url string, day long, pattern string")
    e = spark.createDataFrame([(*x, "z") for x in entries], "pattern string, action string, entry_id string, day long, url string")
    return {r.page_id: (r.verdict, r.pattern, r.valid_from) for r in uf.judge(c, e).collect()}


def test_equals_brute_force(spark):
    r = random.Random(1)
    hosts = ["a.com", "x.a.com", "y.x.a.com", "b.org", "c.b.org"]
    captures = [(i, f"{r.choice(['http', 'https'])}://{r.choice(hosts)}{r.choice(['', ':80'])}/{r.choice(['', 'p', 'p/q', 'p/q/r?x=/p'])}", r.randint(0, 400)) for i in range(400)]
    entries = [(r.choice([*hosts, "com", "a.com/p", "x.a.com/p/q", "b.org/p"]), r.choice(["block", "allow", "remove"]), f"e{i}", r.randint(0, 380)) for i in range(60)]
    assert run(spark, captures, entries) == brute(captures, entries)


def test_edges(spark):
    captures = [(1, None, 5), (2, "", 5), (3, "no url", 5), (4, "http://a.com", 5), (5, "http://A.com/p", 4), (6, "http://a.com/" + "s/" * 20_000, 9)]
    entries = [("a.com", "block", "1", 5), (None, "block", "2", 1), ("a.com/p", "allow", "3", None), ("a.com", "allow", "0", 5)]
    assert run(spark, captures, entries) == brute(captures, entries)
    assert run(spark, captures, []) == {i: ("none", None, None) for i in range(1, 7)}
    assert run(spark, [], entries) == {}


def test_unlisted_patterns_are_dropped_before_any_shuffle(spark):
    pages = spark.range(4000).selectExpr("id AS page_id", "concat('http://h', id, '.example.com/') AS url", "5L AS day")
    entries = spark.createDataFrame([("h7.example.com", "block", "e", 1), ("h8.example.com", "block", "f", 9), ("com.au", "block", "g", 1)], "pattern string, action string, entry_id string, day long")
    asked = pages.withColumn("pattern", F.explode(uf.lookups(uf.host_of(F.col("url")), uf.path_of(F.col("url")), 0)))
    left = uf._maybe_listed(asked, entries.select("pattern"))
    assert {"h7.example.com", "h8.example.com"} <= {r.pattern for r in left.select("pattern").collect()}
    assert left.count() <= 20 and left.where("pattern in ('com', 'example.com')").count() == 0
    assert [r.page_id for r in uf.judge(pages, entries).where("verdict <> 'none'").collect()] == [7]


def test_the_table_of_bits_misses_nothing(spark, monkeypatch):
    monkeypatch.setattr(uf, "FILTER_BITS", 1 << 16)
    patterns = spark.range(20_000).selectExpr("concat('p', id) AS pattern")
    assert uf._maybe_listed(patterns, patterns).count() == 20_000
    assert uf._maybe_listed(patterns, patterns.limit(0)).count() == 0
