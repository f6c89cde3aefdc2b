"""WARC archives: written and read by Spark, indexed by an external loser-tree merge.

*Writing.*  Every record is a gzip member of its own, so a capture can be read by its file,
offset and length alone.  The members are rows of Spark's text writer, whose line separator
here is an empty gzip member: files are plain concatenated gzip, and go to any store that Spark
writes to.  Of records with equal payloads the one with the largest page_id is the response,
the others are revisits that name it and carry its HTTP header only.  Roles are decided
on (digest, page_id) alone; payloads are never dealt by digest.

*Reading.*  Files are parsed member by member and by Content-Length in Arrow batches, so payloads may hold
anything.  Each file gives a run of captures sorted by URL key, time and page.

*Merging.*  Spark cuts the runs into key ranges and keeps each run's piece in its order
(its sort spills).  Pieces are packed in blocks of ``BLOCK_ROWS`` captures, and blocks are met by their
first key: a loser tree merges the runs, and a block is opened only when its first key is
next.  So memory holds the blocks that overlap, not the range.  Ranges in order, counted,
give every capture its place in the global order.

Defined results: a null payload is an empty one; a null url is an empty one; line breaks
in a url are percent-encoded; rows that repeat page_id and payload are all responses; a
null page_id is a response (it can't be referred to); an empty table gives no archives
and an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.llm import shared

#: Payloads below this size are never stored as revisits.
LEAST_REVISIT = 0
#: Rows of a file at most, and its bytes (one record more at most): bound the archive that one task opens.
FILE_RECORDS, FILE_BYTES = 5_000, 1 << 26
#: Captures of a block, and of a key range at most on average.
BLOCK_ROWS, RANGE_ROWS = 512, 200_000
# Fixed strings of the formats.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"
#: An empty gzip member.
NOTHING = bytes([0x1F, 0x8B, 8, 0, 0, 0, 0, 0, 0, 255, 3, 0, 0, 0, 0, 0, 0, 0, 0, 0])
#: Host, port, and path with query of a URL.
URL = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)(?::([0-9]*))?([^#]*)"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of UTF-8 text: four letters for every five hex digits."""
    digits = F.sha1(data)
    letters = []
    for i in range(0, 40, 5):
        value = F.conv(F.substring(digits, i + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_roles(captures: DataFrame) -> DataFrame:
    """``captures`` (page_id, url, html, date) with payload, digest, n_bytes and response_id (null for a response)."""
    rows = captures.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("payload"), "date")
    rows = rows.withColumns({"sha": F.unhex(F.sha1("payload")), "n_bytes": F.octet_length("payload").cast("long")})
    pages = rows.where(F.col("n_bytes") >= LEAST_REVISIT).select("page_id", "sha").distinct()
    last = pages.groupBy("sha").agg(F.max("page_id").alias("response_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = pages.hint("merge").join(last, "sha").where("page_id < response_id")
    return rows.join(revisits.hint("merge"), ["page_id", "sha"], "left").withColumn("digest", base32_sha1(F.col("payload"))).drop("sha")


def record(rows: DataFrame) -> Column:
    """One WARC record without the blank lines that end it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    uri = lambda page: F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(">"))
    url = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    revisit = F.col("response_id").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n_bytes").cast("string"), F.lit(END))
    size = F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("n_bytes"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise(F.lit("response"))), line("WARC-Record-ID", uri(F.col("page_id"))),
        line("WARC-Date", F.col("date")), line("WARC-Target-URI", url), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(revisit, F.concat(line("WARC-Refers-To", uri(F.col("response_id"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", size.cast("string")), F.lit("\r\n"),
        http, F.when(revisit, F.lit("")).otherwise(F.col("payload")),
    )


def write(captures: DataFrame, path: str) -> None:
    """Write ``captures`` (page_id, url, html, date as ISO 8601 text) as WARC files of gzipped records below ``path``.

    A task begins another file after ``FILE_RECORDS`` records or ``FILE_BYTES`` bytes.
    """

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = 0
        for batch in batches:
            made = [gzip.compress(v.as_buffer(), 6, mtime=0) for v in batch.column(0)]
            upto = [sent, *(sent := sent + len(m) for m in made)]
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary()), pa.array([at // FILE_BYTES for at in upto[:-1]], pa.int32())], names=["value", "roll"])

    rows = with_roles(captures)
    members = rows.select(F.concat(record(rows), F.lit(END)).cast("binary").alias("value")).mapInArrow(squeeze, "value binary, roll int")
    # the writer takes the bytes of a string as they are; the encoding is that of the separator
    out = members.select(F.col("value").cast("string"), "roll").write.partitionBy("roll").option("lineSep", NOTHING.decode("latin-1")).option("encoding", "ISO-8859-1")
    out.option("compression", "none").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def url_key(url: str) -> str:
    """Sort-friendly key: host labels reversed, then path and query, in lower case, without scheme, user, default port and fragment."""
    found = re.match(URL, url)
    if not found:
        return url.strip(" ").lower()
    host, port, rest = found[1].lower().removeprefix("www."), found[2] or "", found[3].lower()
    port = "" if port in ("", "80", "443") else f":{port}"
    return f"{','.join(reversed(host.split('.')))}{port}){rest if rest.startswith('/') else '/' + rest}"


def members(content) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and data of each gzip member that isn't empty."""
    view, at = memoryview(content), 0
    while at < len(view):
        d, out, end = zlib.decompressobj(31), [], at
        while not d.eof:
            if end >= len(view):
                raise ValueError(f"gzip member at {at} isn't whole")
            out.append(d.decompress(view[end : end + (1 << 16)]))
            end += min(1 << 16, len(view) - end)
        end -= len(d.unused_data)
        if data := b"".join(out):
            yield at, end - at, data
        at = end


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Header fields (names in lower case), HTTP header and payload of each record."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record at {line[:40]!r}")
        fields = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            fields[name.lower()] = value
        block = stream.read(int(fields["content-length"]))
        http, _, payload = block.partition(END.encode())
        yield fields, http, payload


SCHEMA = "run string, seq long, url_key string, date string, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, offset long, length long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
_TYPES = [pa.string() if x.endswith("string") else pa.int64() for x in SCHEMA.split(", ")]
_NONE = -(1 << 63)


def _batch(rows: list[tuple], names: list[str] = NAMES, types: list[pa.DataType] = _TYPES) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def capture(data: bytes) -> tuple:
    """URL key, date, page, type, payload size, digest and response of a record; an error if it is damaged."""
    ((fields, http, payload),) = parse(io.BytesIO(data))
    page = lambda uri: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", uri)) else None
    declared = fields["warc-payload-digest"].removeprefix("sha1:")
    size = int(re.search(rb"(?i)^content-length: *(\d+)", http, re.M)[1])
    kind = fields["warc-type"]
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode() != declared):
        raise ValueError(f"damaged record {fields['warc-record-id']}")
    refers = page(fields["warc-refers-to"]) if kind == "revisit" else None
    return url_key(fields["warc-target-uri"]), fields["warc-date"], page(fields["warc-record-id"]), kind, size, declared, refers


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """Captures of all archives below ``path``, with file, offset and length; every file is one run in order of key, date and page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows = sorted(((*capture(data), at, n) for at, n, data in members(content.as_buffer())), key=_order)
                for first in range(0, len(rows), 10_000):
                    yield _batch([(name.as_py(), first + i, *r) for i, r in enumerate(rows[first : first + 10_000])])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    return files.mapInArrow(run, SCHEMA)


def _order(row: tuple) -> tuple:
    """Order of captures within and across runs; a null page first."""
    return row[0], row[1], _NONE if row[2] is None else row[2], row[3]


class LoserTree:
    """Merges sorted sequences that may come in pieces: an inner node keeps the loser of its match, node 0 the winner."""

    def __init__(self, key, runs=()):
        self.key, self.names, self.queues, self.head = key, {}, [], []
        for i, rows in enumerate(runs):
            self.add(i, rows)

    def add(self, name, rows) -> None:
        """More rows of the run ``name``, none of them before one it had."""
        i = self.names.setdefault(name, len(self.queues))
        if i == len(self.queues):
            self.queues.append(deque())
            self.head.append(None)
        self.queues[i].extend(rows)
        if self.head[i] is None:
            self._advance(i)
            self._play()

    def _advance(self, i: int) -> None:
        self.head[i] = self.key(self.queues[i][0]) if self.queues[i] else None

    def _beats(self, a: int, b: int) -> bool:
        """Does run ``a`` come before run ``b``?  A finished run comes last; ties go to the earlier run."""
        if self.head[a] is None or self.head[b] is None:
            return self.head[b] is None and (self.head[a] is not None or a < b)
        return (self.head[a], a) < (self.head[b], b)

    def _play(self) -> None:
        """All matches from the leaves (nodes k to 2 k - 1) to the root."""
        k = len(self.queues)
        self.loser, winner = [0] * k, [*range(k), *range(k)]  # winner[node]; leaves are right already
        for node in range(k - 1, 0, -1):
            a, b = winner[2 * node], winner[2 * node + 1]
            winner[node], self.loser[node] = (a, b) if self._beats(a, b) else (b, a)
        self.loser[0] = winner[1] if k > 1 else 0

    def peek(self):
        """Key of the next row, None at the end."""
        return self.head[self.loser[0]] if self.queues else None

    def pop(self):
        winner = self.loser[0]
        row = self.queues[winner].popleft()
        self._advance(winner)
        node = (winner + len(self.queues)) // 2
        while node > 0:  # up from the winner's leaf
            if self._beats(self.loser[node], winner):
                self.loser[node], winner = winner, self.loser[node]
            node //= 2
        self.loser[0] = winner
        return row

    def __iter__(self) -> Iterator:
        while self.peek() is not None:
            yield self.pop()


def merged(blocks: Iterator[tuple[tuple, object, list]], key) -> Iterator:
    """Rows in order from blocks (first key, run, rows) in order of their first keys, and of their places in a run."""
    tree = LoserTree(key)
    for first, run, rows in blocks:
        while (head := tree.peek()) is not None and head < first:
            yield tree.pop()
        tree.add(run, rows)
    yield from tree


_KEY = "url_key string, date string, page_id long, record_type string, run string, seq long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of runs, in order of run and seq, as blocks with their first keys."""
    held: list[tuple] = []

    def send():
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, (b := _batch(held)).schema) as out:
            out.write_batch(b)
        return _batch([(*held[0][2:6], *held[0][:2], sink.getvalue().to_pybytes())], [*NAMES[2:6], *NAMES[:2], "block"], [*_TYPES[2:6], *_TYPES[:2], pa.binary()])

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if held and (row[0] != held[0][0] or len(held) == BLOCK_ROWS):
                yield send()
                held = []
            held.append(row)
    if held:
        yield send()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    number, at, out = TaskContext.get().partitionId(), 0, []

    def blocks():
        for batch in batches:
            for *first, run, _, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                table = pa.ipc.open_stream(block).read_all()
                yield _order(first), run, list(zip(*(c.to_pylist() for c in table.columns), strict=True))

    names, types = ["range", "place", *NAMES], [pa.int64(), pa.int64(), *_TYPES]
    for row in merged(blocks(), lambda r: _order(r[2:])):
        out.append((number, at, *row))
        at += 1
        if len(out) == 10_000:
            yield _batch(out, names, types)
            out = []
    if out:
        yield _batch(out, names, types)


def merge_runs(runs: DataFrame) -> DataFrame:
    """All captures with ``capture_no``, their place in the order of URL key, date and page; partition after partition, row after row.

    ``runs`` is a written table.  Equal keys are in one range; null pages come first.
    """
    n = max(shared.parts(runs), -(-runs.count() // RANGE_ROWS))
    keys = ["url_key", "date", "page_id", "record_type"]
    ranges = runs.repartitionByRange(n, *keys).sortWithinPartitions("run", "seq")
    blocks = ranges.mapInArrow(_blocks, f"{_KEY}, block binary").sortWithinPartitions(*keys, "run", "seq")
    out = shared.materialize(blocks.mapInArrow(_merge, f"range long, place long, {SCHEMA}"))
    # as many rows as there are ranges
    counts = sorted((r["range"], r["n"]) for r in out.groupBy("range").agg(F.count("*").alias("n")).collect())
    begin = [0]
    for _, own in counts:
        begin.append(begin[-1] + own)
    offsets = runs.sparkSession.createDataFrame([(r, b) for (r, _), b in zip(counts, begin, strict=False)], "range long, begin long")
    placed = out.join(F.broadcast(offsets), "range").withColumn("capture_no", F.col("begin") + F.col("place") + 1)
    return placed.select("capture_no", F.col("run").alias("file"), *NAMES[2:])


def histories(captures: DataFrame, path: str) -> DataFrame:
    """Write archives below ``path``, read them back, and merge their index: every capture with its place, file, offset and length."""
    write(captures, path)
    return shared.finished(lambda: merge_runs(shared.materialize(read_runs(captures.sparkSession, path))))
