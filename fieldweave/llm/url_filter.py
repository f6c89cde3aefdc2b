"""URL filters as a temporal join: captures against the list entries active when they were fetched.

Dated entries of a pattern become validity intervals: each holds from its date until the
pattern's next entry, a ``remove`` entry only ends the one before.  A pattern is a host
(with all hosts below it) or a host and leading path segments.  A capture is looked up by
all its host suffixes and path prefixes; of the entries active at its time the longest
pattern decides.

Patterns that no entry has, such as most top-level domains, are dropped by a table of bits before anything
is shuffled.  The as-of join asks once for each pattern and day, not for each capture: an equi-join on
pattern and time bucket with the interval as residual, in which an interval is listed in
every bucket it touches.  Its answers (one entry at most for a pattern and day) are joined to the captures
by pattern and day.  So a host with a third of all captures is spread over its days, after
its rows were counted as one for each day before any shuffle.

Defined results: a null or unparsable url has no host and no entry; entries without
pattern or date are ignored; of several entries of one pattern and date the last by
(action, entry_id) holds; rows that repeat key, url and time give one row; without entries
nothing is listed; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_DAYS = 30
#: Bits of the table by which patterns that no entry has are dropped before any shuffle (1 MB).
FILTER_BITS = 1 << 23


def host_of(url: Column) -> Column:
    """Lower-case host without user and port; empty where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """Path without leading slash, query and fragment."""
    return F.coalesce(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^?#]*)", 1), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """``pattern, action, entry_id, valid_from, valid_to`` (days; null: still valid) from dated entries."""
    own = entries.where("pattern is not null and day is not null")
    one = own.groupBy("pattern", "day").agg(F.max(F.struct("action", "entry_id")).alias("e")).select("pattern", "day", "e.*")
    after = Window.partitionBy("pattern").orderBy("day")
    return one.select("pattern", "action", "entry_id", F.col("day").alias("valid_from"), F.lead("day").over(after).alias("valid_to")).where("action <> 'remove'")


def lookups(host: Column, path: Column, depth: int) -> Column:
    """All patterns that cover a URL: host suffixes, and the host with up to ``depth`` path segments."""
    labels = F.split(host, "\\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    segments = F.filter(F.slice(F.split(path, "/"), 1, max(depth, 1)), lambda s: s != "")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(segments)), lambda i: F.concat(host, F.lit("/"), F.array_join(F.slice(segments, F.lit(1), i), "/")))
    none = F.array().cast("array<string>")
    return F.concat(F.when(host == "", none).otherwise(suffixes), F.when((host == "") | (F.size(segments) == 0) | F.lit(depth == 0), none).otherwise(prefixes))


def _maybe_listed(asked: DataFrame, patterns: DataFrame) -> DataFrame:
    """The rows of ``asked`` whose pattern may be one of ``patterns``: by a table of ``FILTER_BITS`` bits.

    The table is ``FILTER_BITS`` / 8 bytes whatever the list's size, so it can be broadcast; it never misses a
    listed pattern, and lets through one in FILTER_BITS / (size of the list) of the others.
    """
    place = F.pmod(F.xxhash64("pattern"), F.lit(FILTER_BITS)) + 1
    bits = patterns.select(F.bitmap_bucket_number(place).alias("page"), F.bitmap_bit_position(place).alias("bit")).groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))
    own = asked.withColumns({"page": F.bitmap_bucket_number(place), "bit": F.bitmap_bit_position(place)})
    byte = F.conv(F.hex(F.expr("substring(bits, CAST(bit div 8 + 1 AS INT), 1)")), 16, 10).cast("int")
    met = own.join(F.broadcast(bits), "page")
    return met.where(byte.bitwiseAND(F.expr("shiftleft(1, CAST(bit % 8 AS INT))")) > 0).select(*asked.columns)


def judge(captures: DataFrame, entries: DataFrame, key: str = "page_id") -> DataFrame:
    """For each capture (``key``, url, day) the deciding entry: ``verdict`` is its action, or ``none``."""
    held = intervals(entries)
    depth = held.agg(F.max(F.size(F.split("pattern", "/")) - 1)).first()[0] or 0
    rows = captures.select(key, "url", F.col("day").cast("long")).distinct().withColumn("host", host_of(F.col("url")))
    latest = rows.agg(F.max("day")).first()[0] or 0
    bucket = lambda day: F.floor(day / BUCKET_DAYS)
    last = F.least(F.coalesce(F.col("valid_to") - 1, F.lit(latest)), F.lit(latest))
    spread = held.where(F.col("valid_from") <= last).select("*", F.explode(F.sequence(bucket(F.col("valid_from")), bucket(last))).alias("bucket"))
    asked = rows.select("*", F.explode(lookups(F.col("host"), path_of(F.col("url")), depth)).alias("pattern"), bucket(F.col("day")).alias("bucket"))
    asked = _maybe_listed(asked, held.select("pattern"))
    active = (F.col("valid_from") <= F.col("day")) & (F.col("valid_to").isNull() | (F.col("day") < F.col("valid_to")))
    answers = asked.select("pattern", "bucket", "day").distinct().join(spread, ["pattern", "bucket"]).where(active).drop("bucket")
    met = asked.drop("bucket").join(answers, ["pattern", "day"])
    best = met.groupBy(key, "url", "day").agg(F.max(F.struct(F.char_length("pattern").alias("size"), "valid_from", "pattern", "action", "entry_id")).alias("e"))
    met_by = " and ".join(f"r.{c} <=> e.{c}" for c in (key, "url", "day"))
    return rows.alias("r").join(best.alias("e"), F.expr(met_by), "left").select(
        f"r.{key}", "r.url", "r.day", "r.host", F.coalesce("e.e.action", F.lit("none")).alias("verdict"),
        F.col("e.e.pattern").alias("pattern"), F.col("e.e.entry_id").alias("entry_id"), F.col("e.e.valid_from").alias("valid_from"),
    )
