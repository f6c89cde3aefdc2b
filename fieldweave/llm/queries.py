"""One query per operator, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import attribution, bpe, decontaminate, license_scan, nearcopies, quality, repeats, resample, secret_scan, url_filter, variants, warc, wordbpe
from fieldweave.llm.shared import delete, finished, read, scratch

RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS = "word_bpe_49k.json"


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(read(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return quality.judge(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def op4_quality_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of operator 4, which SQL can express."""
    return quality.judge(read(spark, sf_dir, "documents"), None).drop("kept", "score")


#: Fixed entries of the dated list: pattern, action, entry_id, day.
FIXED_ENTRIES = [
    ("casino-win.example.com", "block", "f1", 100), ("free-bets.example.com", "block", "f2", 400),
    ("cheap-pills.example.com", "block", "f3", 0), ("cheap-pills.example.com", "remove", "f4", 900), ("example.org", "block", "f5", 1200),
]


def dated_list(pages: DataFrame) -> DataFrame:
    """A dated list by rule, as the tables have none: days from each host's and directory's least page_id."""
    at = pages.select("page_id", url_filter.host_of(F.col("url")).alias("host"), F.element_at(F.split(url_filter.path_of(F.col("url")), "/"), 1).alias("dir")).where("host <> ''")
    hosts = at.groupBy("host").agg(F.min("page_id").alias("m"))
    dirs = at.where("dir <> ''").groupBy(F.concat_ws("/", "host", "dir").alias("pattern")).agg(F.min("page_id").alias("m"))
    own = [
        hosts.where("m % 2 = 0").selectExpr("host AS pattern", "'block' AS action", "concat('h', host) AS entry_id", "m * 37 % 1461 AS day"),
        hosts.where("m % 2 = 0").selectExpr("host AS pattern", "'remove' AS action", "concat('r', host) AS entry_id", "m * 37 % 1461 + 30 + m % 400 AS day"),
        hosts.where("m % 6 = 0").selectExpr("host AS pattern", "'block' AS action", "concat('a', host) AS entry_id", "m * 37 % 1461 + 500 + m % 100 AS day"),
        dirs.where("m % 5 = 0").selectExpr("pattern", "'allow' AS action", "concat('p', pattern) AS entry_id", "m * 11 % 1461 AS day"),
    ]
    out = pages.sparkSession.createDataFrame(FIXED_ENTRIES, "pattern string, action string, entry_id string, day long")
    for part in own:
        out = out.unionByName(part)
    return out


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    captures = pages.selectExpr("page_id", "url", "page_id * 7919 % 1461 AS day")
    return url_filter.judge(captures, dated_list(pages))


def op6_near_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.classes(read(spark, sf_dir, "documents"))


def op7_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents"))


def op7_license_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(read(spark, sf_dir, "documents")).where("line = -1").drop("line")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the tables have no fetch time: seconds of 2024 from the page_id
    date = "date_format(timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, coalesce(pmod(page_id, 31536000), 0)), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS date"
    captures = read(spark, sf_dir, "pages").selectExpr("page_id", "url", "html", date)
    archives = scratch(spark)
    out = warc.histories(captures, archives).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "date", "capture_no")
    delete(spark, archives)  # the query's result is its index
    return out


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_counts(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, attribution.RULES)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: resample.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")))


def op12_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordbpe.digests(read(spark, sf_dir, "documents"), public_tokenizers.path(WORDS))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return finished(lambda: variants.group(read(spark, sf_dir, "documents")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_secret_scans, op2_decontamination, op3_suffix_dedup, op4_quality_rules, op4_quality_counts, op5_url_filters,
        op6_near_copies, op7_license_scans, op7_license_paragraphs, op8_warc, op9_token_counts, op10_byte_bpe, op11_resampling, op12_word_bpe, op13_spelling_variants,
    )
}

_HOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1))"
_DIR = "split_part(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)', 1), '/', 1)"


def _erfc(x: str) -> str:
    t = f"(1 / (1 + ({x}) / 2))"
    fit = f"({secret_scan.ERFC[-1]})"
    for c in reversed(secret_scan.ERFC[:-1]):
        fit = f"({fit} * {t} + ({c}))"
    return f"({t} * exp(-({x}) * ({x}) + {fit}))"


def _tail(z: str) -> str:
    root = "1.4142135623730951"
    return f"(CASE WHEN {z} < 0 THEN {_erfc(f'-({z}) / {root}')} / 2 ELSE 1 - {_erfc(f'({z}) / {root}')} / 2 END)"


def _two_sided(z: str) -> str:
    return f"least(1.0, {_erfc(f'abs({z}) / 1.4142135623730951')})"


def _sql_spans(kind: int, pattern: str, keep: str = "true", value: int = 0) -> str:
    quoted = pattern.replace("'", "''")
    return f"""SELECT doc_id, n, {kind} AS kind, list_sum([length(g[j]) FOR j IN range(1, i + 1)]) + coalesce(list_sum([length(m[j]) FOR j IN range(1, i)]), 0) AS s, m[i] AS tok
  FROM (SELECT doc_id, n, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}') AS m, regexp_extract_all(t, '{quoted}', {value}) AS v FROM d) z, unnest(range(1, len(m) + 1)) u(i) WHERE {keep}"""


def _by_encoding(values: dict) -> str:
    return "CASE enc " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + " END"


_B64 = f"string_split('{secret_scan.ALPHABETS['base64']}', '')"
_LEAST = " ".join(f"WHEN n_ >= {n} THEN {i + 1}" for i, n in reversed(list(enumerate(secret_scan.LENGTHS[1:]))))


#: The table of crc32 for one byte (a rule, not a list), and the checksum of a string whose hex digits are in ``h``.
_CRC = "crc(t) AS (SELECT [list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) FOR i IN range(256)])"
_CRC_OF_H = """xor(4294967295, list_reduce([4294967295] || [16 * (instr('0123456789ABCDEF', h[2 * i + 1]) - 1) + instr('0123456789ABCDEF', h[2 * i + 2]) - 1 FOR i IN range(CAST(length(h) // 2 AS BIGINT))],
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""
_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _license_sql() -> str:
    model = license_scan.train()
    weights = ", ".join(f"('{g}', {list(w)!r}::DOUBLE[])" for g, w in model.weights.items())
    templates = ", ".join(f"('{f}', {own!r})" for f in model.families for own in license_scan.templates(f))
    logits = ", ".join(f"{b!r} + coalesce(sum(w[{i + 1}]), 0)" for i, b in enumerate(model.bias))
    return f"""
WITH m(gram, w) AS (VALUES {weights}), tpl(family, pairs) AS (VALUES {templates}),
d AS (SELECT doc_id, row_number() OVER () AS n, string_split_regex(regexp_replace(lower(coalesce(text, '')), '(^|[^a-z0-9]){license_scan.VERSIONED}', '\\1\\2 version \\3', 'g'), '{license_scan.BLANK}') AS ps FROM documents),
p AS (SELECT * FROM (SELECT doc_id, n, unnest(range(0, len(ps))) AS paragraph, unnest(ps) AS t FROM d) WHERE regexp_matches(t, '{model.pattern}')),
l AS (SELECT doc_id, n, paragraph, string_split(t, chr(10)) AS ls FROM p),
u AS (SELECT doc_id, n, paragraph, -1 AS line, t FROM p
  UNION ALL SELECT * FROM (SELECT doc_id, n, paragraph, unnest(range(0, len(ls))) AS line, unnest(ls) AS t FROM l WHERE len(ls) > 1) WHERE regexp_matches(t, '{model.pattern}')),
a AS (SELECT doc_id, row_number() OVER () AS n, paragraph, line, regexp_extract_all(t, '{license_scan.WORD}') AS words FROM u),
b AS (SELECT n, list_distinct(words || [words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS grams FROM a),
g AS (SELECT n, unnest(grams) AS gram FROM b),
z AS (SELECT a.n, [{logits}] AS z FROM a LEFT JOIN (SELECT g.n, m.w FROM g JOIN m ON m.gram = g.gram) g ON g.n = a.n GROUP BY a.n),
e AS (SELECT n, [exp((v - list_max(z)) / {model.temperature!r}) FOR v IN z] AS e FROM z),
f AS (SELECT n, list_max(e) / list_sum(e) AS probability, list_position(e, list_max(e)) AS top FROM e),
k AS (SELECT n, probability, CASE WHEN probability >= {license_scan.CERTAIN} THEN {[*model.families, "unknown"]!r}[top] ELSE 'unknown' END AS family FROM f),
s AS (SELECT k.n, max(len(list_intersect(b.grams, tpl.pairs)) / len(tpl.pairs)) AS likeness FROM k JOIN b ON b.n = k.n JOIN tpl ON tpl.family = k.family GROUP BY k.n)
SELECT a.doc_id, CAST(a.paragraph AS BIGINT) AS paragraph, CAST(a.line AS BIGINT) AS line, k.family, round(k.probability, 6) AS probability, round(coalesce(s.likeness, 0), 6) AS likeness,
  k.family <> 'unknown' AND round(coalesce(s.likeness, 0), 6) >= {license_scan.ALIKE} AS confirmed
FROM a JOIN k ON k.n = a.n LEFT JOIN s ON s.n = a.n
"""


QUALITY_COUNTS_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, coalesce(text, '') AS text FROM documents),
w AS (SELECT k, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT k, unnest(range(1, len(ws) - 1)) AS i, unnest([ws[j:j + 2] FOR j IN range(1, len(ws) - 1)]) AS g FROM w),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, g) AS c FROM g) WHERE c > 1),
r AS (SELECT k, count(DISTINCT i) AS n FROM (SELECT k, unnest([i, i + 1, i + 2]) AS i FROM again) GROUP BY k),
c AS (SELECT k, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(list_sum([length(x) FOR x IN ws]), 0) AS BIGINT) AS word_chars,
  CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines FROM w)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, n_words < 50 OR 100 * coalesce(r.n, 0) > 50 * n_words AS base_failed
FROM d JOIN c ON c.k = d.k LEFT JOIN r ON r.k = d.k
"""

ORACLE_SQL: dict[str, str] = {
    "op4_quality_counts": QUALITY_COUNTS_SQL,
    "op1_secret_scans": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS n FROM documents),
base AS ({_sql_spans(0, secret_scan.ASSIGN, "length(v[i]) >= 6", 2)}
  UNION ALL {_sql_spans(1, secret_scan.ACCESS)}
  UNION ALL {_sql_spans(2, secret_scan.HEX)}),
tok AS (SELECT *, CASE WHEN regexp_full_match(tok, '[0-9a-f]+|[0-9A-F]+') THEN 'hex' WHEN regexp_full_match(tok, '[A-Z2-7]+') THEN 'base32' ELSE 'base64' END AS enc
  FROM ({_sql_spans(3, secret_scan.TOKEN.split(")", 1)[1])}) WHERE regexp_matches(tok, '[0-9]') AND regexp_matches(tok, '[A-Za-z]')),
norm AS (SELECT *, CASE enc WHEN 'hex' THEN lower(tok) WHEN 'base32' THEN tok ELSE translate(tok, '-_', '+/') END AS x, CAST(length(tok) AS DOUBLE) AS n_,
  {_by_encoding(secret_scan.ALPHABETS)} AS a, {_by_encoding(secret_scan.EXCESS)} AS excess, {_by_encoding(secret_scan.KEEPS)} AS keeps FROM tok),
chars AS (SELECT *, CAST(length(a) AS DOUBLE) AS k, list_sum([power(length(x) - length(replace(x, c, '')), 2) FOR c IN {_B64}]) AS squares,
  [CAST(instr(a, c) AS DOUBLE) FOR c IN string_split(x, '')] AS place FROM norm),
mid AS (SELECT *, list_sum(place) / n_ AS m, [CASE WHEN p > k / 2 THEN 1 ELSE 0 END FOR p IN place] AS b FROM chars),
sums AS (SELECT *, CAST(list_sum(b) AS DOUBLE) AS ones, 1 + list_sum([CASE WHEN b[i] <> b[i + 1] THEN 1.0 ELSE 0.0 END FOR i IN range(1, len(b))]) AS runs,
  list_sum([(place[i] - m) * (place[i + 1] - m) FOR i IN range(1, len(place))]) AS top, list_sum([(p - m) * (p - m) FOR p IN place]) AS var FROM mid),
stats AS (SELECT *, k / n_ * squares - n_ AS chi, 2 * ones * (n_ - ones) / n_ + 1 AS mu, CASE WHEN var > 0 THEN top / var * sqrt(n_) END AS zs FROM sums),
zed AS (SELECT *, (runs - mu) / sqrt(greatest((mu - 1) * (mu - 2) / (n_ - 1), 1e-9)) AS zr, (chi - (k - 1)) / sqrt(2 * (k - 1)) AS ze,
  (chi - (k - 1 + n_ * excess)) / sqrt(2 * (k - 1) + 4 * n_ * excess) AS zo FROM stats),
tested AS (SELECT *, 3 * least(CASE WHEN ones = 0 OR ones = n_ THEN 0.0 ELSE {_two_sided("zr")} END, coalesce({_two_sided("zs")}, 0.0), {_tail("ze")}) < {secret_scan.VETO} AS fails,
  greatest({_tail("zo")} * power(keeps, n_), 1e-300) AS q FROM zed),
binned AS (SELECT *, enc || ':' || CASE {_LEAST} ELSE 0 END AS class, least(floor(-10 * log10(CASE WHEN fails THEN 1.0 ELSE least(1.0, q * (1 - ln(q))) END)), {secret_scan.BINS}) AS bin FROM tested),
ranked AS (SELECT class, bin, count(*) OVER (PARTITION BY class) AS total, count(*) OVER (PARTITION BY class ORDER BY bin DESC RANGE UNBOUNDED PRECEDING) AS above FROM binned),
least_ AS (SELECT class, min(bin) AS bin FROM ranked WHERE power(10, -bin / 10) <= {secret_scan.RATE} * above / total GROUP BY class),
found AS (SELECT b.doc_id, b.n, b.kind, b.s, b.tok FROM binned b JOIN least_ l ON l.class = b.class AND b.bin >= l.bin
  WHERE NOT EXISTS (SELECT 1 FROM base x WHERE x.n = b.n AND x.s <= b.s AND x.s + length(x.tok) >= b.s + length(b.tok))),
spans AS (SELECT *, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || CAST(s AS VARCHAR) || ':' || CAST(s + length(tok) AS VARCHAR) AS label FROM (SELECT doc_id, n, kind, s, tok FROM base UNION ALL SELECT * FROM found)),
each AS (SELECT n, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex, count(*) FILTER (WHERE kind = 3) AS n_random,
  string_agg(label, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(label, ',' ORDER BY s, kind) AS spans FROM spans GROUP BY n)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_random, 0) AS n_random
FROM d LEFT JOIN each ON each.n = d.n
""",
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, unnest(range(0, octet_length(b) - 99)) AS i, unnest([b[j + 1:j + 100] FOR j IN range(0, octet_length(b) - 99)]) AS s FROM d),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS k FROM w) WHERE k > 1),
starts AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 100 THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 100 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM starts) GROUP BY doc_id, g),
kept AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM runs
  UNION ALL SELECT d.doc_id, coalesce(max(r.z), 0), any_value(octet_length(b)) FROM d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id),
rest AS (SELECT d.doc_id, string_agg(hex(b[k.a + 1:k.z]), '' ORDER BY k.a) AS h, count(*) - 1 AS n_spans, sum(k.z - k.a) AS n_kept FROM d JOIN kept k ON k.doc_id = d.doc_id GROUP BY d.doc_id)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(octet_length(b) - n_kept AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN rest t ON t.doc_id = d.doc_id
""",
    "op5_url_filters": f"""
WITH cap AS (SELECT page_id, url, page_id * 7919 % 1461 AS day, coalesce({_HOST}, '') AS host, coalesce({_DIR}, '') AS dir FROM pages),
hosts AS (SELECT host, min(page_id) AS m FROM cap WHERE host <> '' GROUP BY host),
dirs AS (SELECT host || '/' || dir AS pattern, min(page_id) AS m FROM cap WHERE host <> '' AND dir <> '' GROUP BY 1),
entries AS (
  SELECT * FROM (VALUES {", ".join(str(e) for e in FIXED_ENTRIES)}) AS v(pattern, action, entry_id, day)
  UNION ALL SELECT host, 'block', 'h' || host, m * 37 % 1461 FROM hosts WHERE m % 2 = 0
  UNION ALL SELECT host, 'remove', 'r' || host, m * 37 % 1461 + 30 + m % 400 FROM hosts WHERE m % 2 = 0
  UNION ALL SELECT host, 'block', 'a' || host, m * 37 % 1461 + 500 + m % 100 FROM hosts WHERE m % 6 = 0
  UNION ALL SELECT pattern, 'allow', 'p' || pattern, m * 11 % 1461 FROM dirs WHERE m % 5 = 0),
one AS (SELECT pattern, day, max({{'action': action, 'entry_id': entry_id}}) AS e FROM entries GROUP BY pattern, day),
held AS (SELECT pattern, e.action AS action, e.entry_id AS entry_id, day AS valid_from, lead(day) OVER (PARTITION BY pattern ORDER BY day) AS valid_to FROM one),
met AS (
  SELECT a.page_id, a.url, a.day, h.*, row_number() OVER (PARTITION BY a.page_id, a.url, a.day ORDER BY length(h.pattern) DESC, h.valid_from DESC) AS k
  FROM (SELECT DISTINCT * FROM cap) a JOIN held h ON (a.host = h.pattern OR ends_with(a.host, '.' || h.pattern) OR (a.dir <> '' AND a.host || '/' || a.dir = h.pattern))
   AND h.action <> 'remove' AND h.valid_from <= a.day AND (h.valid_to IS NULL OR a.day < h.valid_to))
SELECT a.page_id, a.url, CAST(a.day AS BIGINT) AS day, a.host, coalesce(m.action, 'none') AS verdict, m.pattern, m.entry_id, CAST(m.valid_from AS BIGINT) AS valid_from
FROM (SELECT DISTINCT * FROM cap) a LEFT JOIN met m ON m.k = 1 AND m.page_id IS NOT DISTINCT FROM a.page_id AND m.url IS NOT DISTINCT FROM a.url
""",
    "op8_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, replace(replace(coalesce(url, ''), chr(13), '%0D'), chr(10), '%0A') AS url,
  strftime(TIMESTAMP '2024-01-01' + to_seconds(coalesce((page_id % 31536000 + 31536000) % 31536000, 0)), '%Y-%m-%dT%H:%M:%SZ') AS date FROM pages),
d AS (SELECT page_id, html, url, date, CAST(strlen(html) AS BIGINT) AS payload_bytes, CAST(CAST(unhex(sha1(html)) AS BIT) AS VARCHAR) AS bits FROM p),
u AS (SELECT *, regexp_replace(lower(regexp_extract(url, '{warc.URL}', 1)), '^www\\.', '') AS host, regexp_extract(url, '{warc.URL}', 2) AS port, lower(regexp_extract(url, '{warc.URL}', 3)) AS rest FROM d),
k AS (SELECT *, CASE WHEN regexp_matches(url, '{warc.URL}') THEN array_to_string(list_reverse(string_split(host, '.')), ',') || CASE WHEN port IN ('', '80', '443') THEN '' ELSE ':' || port END || ')'
  || CASE WHEN starts_with(rest, '/') THEN rest ELSE '/' || rest END ELSE lower(trim(url)) END AS url_key FROM u),
e AS (
  SELECT page_id, payload_bytes, url_key, date, max(page_id) OVER (PARTITION BY html) AS last,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + 16 * CAST(substr(bits, 5 * i + 1, 1) AS INT) + 8 * CAST(substr(bits, 5 * i + 2, 1) AS INT)
      + 4 * CAST(substr(bits, 5 * i + 3, 1) AS INT) + 2 * CAST(substr(bits, 5 * i + 4, 1) AS INT) + CAST(substr(bits, 5 * i + 5, 1) AS INT), 1) FOR i IN range(32)], '') AS payload_digest
  FROM k)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to, url_key, date, row_number() OVER (ORDER BY url_key, date, page_id NULLS FIRST) AS capture_no
FROM e
""",
    "op11_resampling": rf"""
WITH {_CRC},
d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT k, unnest(ws) AS w FROM d),
v AS (SELECT unnest(regexp_extract_all({_LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
b AS (SELECT w, {_CRC_OF_H} % 10000 AS b FROM (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM w UNION SELECT w FROM v)) x, crc),
s AS (SELECT b, count(*) AS n FROM w JOIN b USING (w) GROUP BY b),
t AS (SELECT b, count(*) AS n FROM v JOIN b USING (w) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM w) + 10000) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM v) + 10000)))) AS BIGINT) AS gain FROM s FULL JOIN t USING (b)),
x AS (SELECT k, CAST(sum(gain) AS BIGINT) AS weight FROM w JOIN b USING (w) JOIN g USING (b) GROUP BY k),
y AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n, coalesce(weight, 0) AS weight, CAST(('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) AS h FROM d LEFT JOIN x USING (k)),
z AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM y),
r AS (SELECT *, row_number() OVER (PARTITION BY n >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE n >= 20) OVER () AS eligible FROM z)
SELECT doc_id, n AS n_features, weight, score, CASE WHEN n >= 20 AND place <= eligible * 10 // 100 THEN place END AS rank, n AS n_words FROM r
""",
    "op13_spelling_variants": rf"""
WITH RECURSIVE {_CRC},
o AS (SELECT doc_id, w, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all({_LOWERED}, '[a-z\x{{C0}}-\x{{FF}}]+')) AS w FROM documents) GROUP BY doc_id, w),
c AS (SELECT w, k, {_CRC_OF_H} AS h FROM (SELECT w, k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || w)) AS h FROM o) x, crc),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, CAST(h % length(w) AS BIGINT)) || substr(w, CAST(h % length(w) AS BIGINT) + 2) ELSE w END AS word, k FROM c) GROUP BY word HAVING length(word) >= 5 AND sum(k) >= 3),
x AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM v)),
p AS (SELECT a.word AS a, a.n AS n_a, b.word AS b, b.n AS n_b FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT x.word, x.n, v.word, v.n FROM x JOIN v ON v.word = x.rest UNION SELECT v.word, v.n, x.word, x.n FROM x JOIN v ON v.word = x.rest),
m AS (SELECT a AS word, n_a AS n, count(*) AS n_near, min({{'n': -n_b, 'w': b}}) AS best FROM p GROUP BY a, n_a),
f AS (SELECT word, n_near, CASE WHEN -best.n >= 2 * n THEN best.w END AS form, CASE WHEN -best.n >= 2 * n THEN -best.n END AS form_n FROM m),
r(word, root) AS (SELECT word, form FROM f WHERE form IS NOT NULL UNION SELECT r.word, f.form FROM r JOIN f ON f.word = r.root WHERE f.form IS NOT NULL),
e AS (SELECT r.word, r.root FROM r LEFT JOIN f ON f.word = r.root WHERE f.form IS NULL)
SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, form, form_n, coalesce(root, v.word) AS root FROM v LEFT JOIN f ON f.word = v.word LEFT JOIN e ON e.word = v.word
""",
}


def oracle_sql() -> dict[str, str]:
    """SQL of all queries that have one; that of the licence scan holds its fitted weights."""
    whole = _license_sql()
    return ORACLE_SQL | {"op7_license_scans": whole, "op7_license_paragraphs": f"SELECT * EXCLUDE (line) FROM ({whole}) WHERE line = -1"}
