"""All queries of the field operators over the driver's tables, and the same in SQL.

Fields: ``R`` is a raster of 100 columns from the events' running number, ``S`` the series
of each user's events, ``P`` points from the first two embedding numbers, ``M`` the raster
with an order line's quantity beside it, ``ST`` a cube of eight times.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.domains import GridDomain, RasterDomain
from fieldweave.functions import windows as win
from fieldweave.operators import aggregations as agg
from fieldweave.operators import coregister, custom
from fieldweave.operators import geometry as geo
from fieldweave.operators import matched as mat
from fieldweave.operators import opaque
from fieldweave.operators import samplers as smp
from fieldweave.operators import scan
from fieldweave.operators import spacetime as st
from fieldweave.operators import temporal as tmp
from fieldweave.plans import policy
from fieldweave.plans.patcher import SpatialPatcher, parallel_map, unpack_at
from fieldweave.sources import fields as fld
from fieldweave.sources import chunks, images, tiles
from fieldweave.tables import shared_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

WIDTH, PATCH, STEP = 100, 16, 8
CLASSES = ["click", "error", "purchase", "signup", "view"]


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def r6(name: str, alias: str | None = None):
    return F.round(F.col(name), 6).alias(alias or name)


# ---------------------------------------------------------------- fields
def events(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/events.parquet")


def klass() -> F.Column:
    return F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("event_type")) - 1


def raster(spark, sf, nodata: bool = False) -> fld.Field:
    value = F.when(F.col("event_type") != "error", F.col("value")) if nodata else F.col("value")
    return fld.from_flat(events(spark, sf).select("event_id", value.alias("value"), klass().alias("k")), "event_id", WIDTH, ("value", "k"))


def patcher(window: win.Window | None = None, aggregation: agg.Aggregation | None = None, size=PATCH, step=STEP, boundary="drop") -> SpatialPatcher:
    return SpatialPatcher(geo.Rectangular(size, boundary), smp.RegularStride(step), window or win.Boxcar(), aggregation or agg.OverlapAdd())


def user_series(spark, sf) -> fld.Field:
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return fld.series(events(spark, sf).select("user_id", (F.row_number().over(order) - 1).cast("long").alias("t"), "value"), ("user_id",))


def whole_series(spark, sf) -> fld.Field:
    own = events(spark, sf)
    return fld.series(own.select(F.col("event_id").alias("t"), "value"), length=(own.agg(F.max("event_id")).first()[0] or 0) + 1)


def points(spark, sf) -> fld.Field:
    own = spark.read.parquet(f"{sf}/embeddings.parquet")
    return fld.points(own.select(F.col("vec_id").alias("pid"), F.get("embedding", F.lit(0)).cast("double").alias("x"), F.get("embedding", F.lit(1)).cast("double").alias("y")), "pid")


def lonlat(field: fld.Field) -> DataFrame:
    return field.df.select("pid", (F.col("x") * 180).alias("x"), (F.col("y") * 90).alias("y"))


def anchors_at(points_: DataFrame, every: int) -> DataFrame:
    """Every so many-th point as an anchor: the operator's own choice of anchors."""
    return points_.where(F.col("pid") % every == 0).select(F.col("pid").alias("seq"), F.col("x").alias("ax"), F.col("y").alias("ay"))


def quantity(spark, sf) -> fld.Field:
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_quantity").alias("value"))
    return fld.from_flat(lines, "l_orderkey", WIDTH, height=1)


def matched(spark, sf) -> mat.MatchedField:
    return mat.MatchedField(raster(spark, sf, True), {"quantity": quantity(spark, sf)}, {"quantity": lambda q, p: q * 2})


def cube(spark, sf) -> fld.Field:
    own = events(spark, sf)
    height = ((own.agg(F.max("event_id")).first()[0] or 0) // 8) // 25 + 1
    cells = own.select((F.col("event_id") % 8).alias("t"), F.floor(F.floor(F.col("event_id") / 8) / 25).cast("long").alias("r"), (F.floor(F.col("event_id") / 8) % 25).cast("long").alias("c"), "value")
    return fld.Field(cells, RasterDomain(height, 25), ("t", "r", "c"))


def _decay() -> scan.Monoid:
    """Half of the state, and a patch's total."""
    return scan.affine(0.5, lambda data: F.aggregate(data, F.lit(0.0), lambda a, x: a + x))


def polygons(spark) -> DataFrame:
    """Fixed rings: a triangle, a square and a concave arrow in the raster's plane."""
    rings = [(0, [(2.0, 1.0), (40.0, 3.0), (20.0, 9.5)]), (1, [(50.0, 0.0), (60.0, 0.0), (60.0, 30.0), (50.0, 30.0)]), (2, [(5.0, 20.0), (30.0, 50.0), (55.0, 20.0), (30.0, 90.0)])]
    return spark.createDataFrame(rings, "seq long, ring array<struct<x:double,y:double>>")


# ---------------------------------------------------------------- SQL of the fields
def _lattice(d: str, size: int = PATCH, step: int = STEP, extent: str = "(SELECT max(event_id) // 100 + 1 FROM events)") -> str:
    return f"SELECT CAST(x AS BIGINT) AS {d} FROM range(0, greatest({extent} - {size} + 1, 1), {step}) t(x)"


def _rows(nodata: bool = False) -> str:
    value = "CASE WHEN event_type <> 'error' THEN value END" if nodata else "value"
    names = " ".join(f"WHEN '{c}' THEN {i}" for i, c in enumerate(CLASSES))
    return f"SELECT CAST(event_id // 100 AS BIGINT) AS r, CAST(event_id % 100 AS BIGINT) AS c, {value} AS value, CASE event_type {names.replace(',', '')} END AS k FROM events"


def _patches(nodata: bool = False, size: int = PATCH, step: int = STEP) -> str:
    """CTEs r (cells), pc (patch cells with seq and offsets)."""
    return f"""WITH r AS ({_rows(nodata)}), ar AS ({_lattice("ar", size, step)}), ac AS ({_lattice("ac", size, step, "100")}),
pc AS (SELECT r.*, ar, ac, r.r - ar AS i, r.c - ac AS j, (ar // {step}) * (SELECT count(*) FROM ac) + ac // {step} AS seq
  FROM r JOIN ar ON r.r >= ar AND r.r < ar + {size} JOIN ac ON r.c >= ac AND r.c < ac + {size})"""


_HANN = f"(0.5 - 0.5 * cos(2 * pi() * i / {PATCH - 1})) * (0.5 - 0.5 * cos(2 * pi() * j / {PATCH - 1}))"
_GAUSS = f"exp(-0.5 * power((i - {(PATCH - 1) / 2}) / {0.5 * PATCH / 2}, 2)) * exp(-0.5 * power((j - {(PATCH - 1) / 2}) / {0.5 * PATCH / 2}, 2))"
#: A value that differs from patch to patch, so that merges have something to merge.
_SHIFTED = "(value + (ar + 2 * ac) % 5)"


def shifted(x) -> F.Column:
    return F.col("value") + (x["ar"] + 2 * x["ac"]) % 5


def _merged(columns: str, weight: str = "1.0", nodata: bool = True, extra: str = "", defaults: str = "") -> str:
    """Dense merge of shifted values: ``v`` and ``w`` in ``columns``."""
    return f"""{_patches(nodata)}, p AS (SELECT *, {_SHIFTED} AS v, {weight} AS w FROM pc){extra},
m AS (SELECT r, c, {columns} FROM p GROUP BY r, c)
SELECT r.r, r.c, {defaults} FROM r LEFT JOIN m ON r.r = m.r AND r.c = m.c"""


def _merge_query(name: str, aggregation, sql: str, window=None, nodata=True, value=shifted):
    def run(spark, sf):
        out = patcher(window, aggregation).merge_cells(raster(spark, sf, nodata), value)
        kinds = dict(out.dtypes)
        return out.select("r", "c", *[r6(c) if kinds[c] == "double" else F.col(c) for c in aggregation.outputs])

    def shuffled(spark, sf):
        source, own = raster(spark, sf, nodata), patcher(window, aggregation)
        cells = own.split(source)
        out = own.merge(cells, source, value({c: F.col(c) for c in cells.columns}))
        kinds = dict(out.dtypes)
        return out.select("r", "c", *[r6(c) if kinds[c] == "double" else F.col(c) for c in aggregation.outputs])

    run.__name__, shuffled.__name__ = name, f"{name}_shuffled"
    query(sql)(run)
    query(sql)(shuffled)


def _value(default: str, expr: str = "m.value") -> str:
    return f"round(coalesce({expr}, {default}), 6) AS value"


_OVERLAP = "CASE WHEN sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) > 0 THEN sum(v * w) / sum(CASE WHEN v IS NOT NULL THEN w ELSE 0 END) ELSE 0 END AS value"
_merge_query("overlap_add_hann", agg.OverlapAdd(), _merged(_OVERLAP, _HANN, defaults=_value("0")), win.Hann())
_merge_query("overlap_add_boxcar", agg.OverlapAdd(), _merged(_OVERLAP, defaults=_value("0")))
_merge_query("overlap_add_raw", agg.OverlapAdd(normalize=False), _merged("sum(v * w) AS value", _HANN, defaults=_value("0")), win.Hann())
_merge_query("agg_sum", agg.Sum(), _merged("sum(v) AS value", defaults=_value("0")))
_merge_query("agg_max", agg.Max(), _merged("max(v) AS value", defaults="coalesce(round(m.value, 6), '-infinity'::DOUBLE) AS value"))
_merge_query("agg_min", agg.Min(), _merged("min(v) AS value", defaults="coalesce(round(m.value, 6), 'infinity'::DOUBLE) AS value"))
_merge_query("agg_weighted_sum", agg.WeightedSum(), _merged("sum(v * w) AS value", _GAUSS, defaults=_value("0")), win.Gaussian())
_merge_query("agg_mean", agg.Mean(), _merged("avg(v) AS value", defaults=_value("0")))
_merge_query("agg_variance", agg.Variance(), _merged("CASE WHEN count(v) > 1 THEN var_samp(v) ELSE 0 END AS value", defaults=_value("0")))
_merge_query("agg_median", agg.Median(), _merged("median(v) AS value", defaults="coalesce(round(m.value, 6), 'nan'::DOUBLE) AS value"))
_TUKEY = "(CASE WHEN {x} <= 4 THEN 0.5 * (1 + cos(pi() * (2.0 * {x} / 8 - 1))) WHEN {x} >= 12 THEN 0.5 * (1 + cos(pi() * (2.0 * {x} / 8 - 4 + 1))) ELSE 1 END)"
_merge_query("overlap_add_tukey", agg.OverlapAdd(), _merged(_OVERLAP, f"{_TUKEY.format(x='i')} * {_TUKEY.format(x='j')}", defaults=_value("0")), win.Tukey(0.5))
_merge_query("overlap_add_custom", agg.OverlapAdd(), _merged(_OVERLAP, "(1 + i + j) / 10.0", defaults=_value("0")), win.Custom(lambda shape: (1 + np.add.outer(*(np.arange(n) for n in shape))) / 10))
_merge_query(
    "agg_invvar", agg.InvVarWeightedMean(),
    _merged("sum(w * v / var) AS top, sum(w / var) AS p", _HANN, False, ", q AS (SELECT * FROM p)",
            "round(CASE WHEN p > 0 THEN top / p ELSE 0 END, 6) AS mu, CASE WHEN p > 0 THEN round(1 / p, 6) ELSE 'infinity'::DOUBLE END AS var").replace("FROM p GROUP", "FROM (SELECT *, 1.0 + (i + j) % 3 AS var FROM p) GROUP").replace(", q AS (SELECT * FROM p)", ""),
    win.Hann(), False, lambda x: F.struct(shifted(x).alias("mu"), (F.lit(1.0) + (x["o_r"] + x["o_c"]) % 3).alias("var")),
)
_VOTED = ", n AS (SELECT r, c, cls, count(*) AS n FROM p WHERE cls BETWEEN 0 AND 4 GROUP BY r, c, cls), b AS (SELECT r, c, cls FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, cls) AS x FROM n) WHERE x = 1)"
_merge_query(
    "agg_hard_vote", agg.HardVote(5),
    f"{_patches()}, p AS (SELECT *, (k + (ar // 8) * (ac // 8)) % 6 AS cls FROM pc){_VOTED} SELECT r.r, r.c, CAST(coalesce(cls, 0) AS BIGINT) AS value FROM r LEFT JOIN b ON r.r = b.r AND r.c = b.c",
    None, False, lambda x: (F.col("k") + F.floor(x["ar"] / 8) * F.floor(x["ac"] / 8)) % 6,
)
_merge_query(
    "agg_mode", agg.Mode(),
    f"{_patches(True)}, p AS (SELECT *, CAST(trunc(value) AS BIGINT) % 3 + (ar // 8 + ac // 8) % 2 AS cls FROM pc), n AS (SELECT r, c, cls, count(*) AS n FROM p WHERE cls IS NOT NULL GROUP BY r, c, cls), "
    "b AS (SELECT r, c, cls FROM (SELECT *, row_number() OVER (PARTITION BY r, c ORDER BY n DESC, cls) AS x FROM n) WHERE x = 1) SELECT r.r, r.c, CAST(coalesce(cls, 0) AS BIGINT) AS value FROM r LEFT JOIN b ON r.r = b.r AND r.c = b.c",
    None, True, lambda x: F.col("value").cast("long") % 3 + (F.floor(x["ar"] / 8) + F.floor(x["ac"] / 8)) % 2,
)
_merge_query(
    "agg_soft_vote", agg.SoftVote(3),
    f"{_patches()}, p AS (SELECT *, (k + ar // 8) % 4 AS a, (k + ac // 8) % 4 AS b FROM pc), s AS (SELECT r, c, sum(a) AS s0, sum(b) AS s1, sum(2) AS s2 FROM p GROUP BY r, c) "
    "SELECT r.r, r.c, CAST(CASE WHEN s0 IS NULL THEN 0 WHEN s0 >= s1 AND s0 >= s2 THEN 0 WHEN s1 >= s2 THEN 1 ELSE 2 END AS BIGINT) AS value FROM r LEFT JOIN s ON r.r = s.r AND r.c = s.c",
    None, False, lambda x: F.array(((F.col("k") + F.floor(x["ar"] / 8)) % 4).cast("double"), ((F.col("k") + F.floor(x["ac"] / 8)) % 4).cast("double"), F.lit(2.0)),
)


@query(f"{_patches()}, p AS (SELECT ar, ac, sum(value) AS total, count(*) AS n FROM pc GROUP BY ar, ac) SELECT ar, ac, n, round(2 * total, 6) AS total FROM p")
def agg_by_index(spark, sf):
    """Every anchor was met twice, the second time with doubled values: the last patch counts."""
    packed = patcher().packed(raster(spark, sf))
    later = packed.withColumns({"seq": F.col("seq") + 1_000_000_000, "data": F.transform("data", lambda x: x * 2)})
    out = agg.by_index(packed.unionByName(later), ["ar", "ac"], ["data"])
    return out.select("ar", "ac", F.size("data").cast("long").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _second(state, values, weights):
    return sorted([*state, *values.tolist()])[-2:]


SECOND = opaque.Opaque(list, _second, lambda a, b: sorted([*a, *b])[-2:], lambda state: state[0] if len(state) == 2 else None)


@query(_merged("list_sort(list(v) FILTER (WHERE v IS NOT NULL), 'DESC')[2] AS value", defaults="round(m.value, 6) AS value"))
def agg_opaque(spark, sf):
    """A user's own aggregation with states in Python: the second largest value of each cell."""
    source, own = raster(spark, sf, True), patcher(aggregation=SECOND)
    cells = own.split(source)
    return own.merge(cells, source, shifted({c: F.col(c) for c in cells.columns})).select("r", "c", r6("value"))


@query("SELECT event_type, round(list_sort(list(value), 'DESC')[2], 6) AS value FROM events GROUP BY event_type")
def agg_opaque_hot(spark, sf):
    """Few keys with very many values each, from states of two runs that are merged later."""
    own = events(spark, sf).select("event_type", "value", "event_id")
    halves = [SECOND.states(own.where(f"event_id % 2 = {k}"), ["event_type"], F.col("value"), F.lit(1.0)) for k in (0, 1)]
    return SECOND.finished(SECOND.union(halves, ["event_type"]), ["event_type"]).select("event_type", r6("value"))


@query(f"{_patches()} SELECT seq, max(value) AS top FROM pc GROUP BY seq")
def agg_learned(spark, sf):
    """A model of whole patches, batch by batch."""
    model = agg.Learned(lambda pdf: pdf[["seq"]].assign(top=[np.nanmax(np.asarray(d, float)) for d in pdf["data"]]), "seq long, top double")
    return model.merge_packed(patcher().packed(raster(spark, sf)))


@query(f"{_patches()} SELECT seq, max(value) AS top FROM pc GROUP BY seq")
def agg_learned_cells(spark, sf):
    """A model of the cells of one patch at a time."""
    cells = patcher().split(raster(spark, sf)).select("seq", "value")
    model = agg.Learned(lambda pdf: pdf.groupby("seq", as_index=False).agg(top=("value", "max")), "seq long, top double")
    return model.merge(cells, ["seq"])


@query("SELECT q, CAST(CASE WHEN q = 0.25 THEN (SELECT quantile_disc(value, 0.25) FROM events) WHEN q = 0.5 THEN (SELECT quantile_disc(value, 0.5) FROM events) ELSE (SELECT quantile_disc(value, 0.9) FROM events) END AS DOUBLE) AS value FROM (VALUES (0.25::DOUBLE), (0.5), (0.9)) t(q)")
def sketch_quantile(spark, sf):
    # accurate enough here to be exact
    return agg.ApproxQuantile((0.25, 0.5, 0.9), 20_000).reduce(events(spark, sf))


@query("SELECT true AS near")
def sketch_cardinality(spark, sf):
    """Is the estimate within a tenth of the exact count?"""
    own = events(spark, sf)
    exact = own.agg(F.count_distinct("user_id").alias("exact"))
    return agg.ApproxCardinality(12).reduce(own, "user_id").crossJoin(exact).select((F.abs(F.col("estimate") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


@query("SELECT 'cardinality' AS sketch, true AS near UNION ALL SELECT 'histogram', true UNION ALL SELECT 'mode', true UNION ALL SELECT 'quantile', true UNION ALL SELECT 'reservoir', true")
def sketch_stored(spark, sf):
    """States of four parts of the table, merged: does each tell what one summary of all rows tells?"""
    own = events(spark, sf).withColumns({"part": F.col("event_id") % 4, "k": klass()})
    count, middle, top, bins, drawn = agg.ApproxCardinality(12), agg.ApproxQuantile(0.5, 2000), agg.ApproxMode(16), agg.StreamingHistogram(32), agg.Reservoir(50, 1, ("event_id",))
    merged = lambda plan, value: plan.merge(plan.sketch(own, value, ("part",)))
    near = lambda name, ok, df: df.select(F.lit(name).alias("sketch"), ok.alias("near"))
    whole = own.agg(F.min("value").alias("low"), F.max("value").alias("high"), F.count("value").alias("all"), F.avg("value").alias("mean"))
    half = merged(middle, "value").select(F.col("value").alias("median"))
    share = own.crossJoin(half).agg((F.count_if(F.col("value") <= F.col("median")) / F.count("*")).alias("share"))
    tops = merged(top, "k").join(top.reduce(own.select(F.col("k").alias("value"))).select("item", F.col("n").alias("m")), "item", "full").agg(F.bool_and(F.col("n").eqNullSafe(F.col("m"))).alias("same"))
    mass = merged(bins, "value").agg(F.sum("n").alias("n"), F.count("*").alias("bins"), (F.sum(F.col("n") * F.col("center")) / F.sum("n")).alias("middle")).crossJoin(whole)
    sample = merged(drawn, "value").select("event_id").join(drawn.reduce(own.select("event_id", "value")).select("event_id", F.lit(1).alias("m")), "event_id", "full").agg(F.bool_and(F.col("m").isNotNull()).alias("same"), F.count("*").alias("n"))
    out = near("cardinality", F.col("estimate") == F.col("whole"), merged(count, "user_id").crossJoin(count.reduce(own, "user_id").withColumnRenamed("estimate", "whole")))
    out = out.unionByName(near("quantile", F.abs(F.col("share") - 0.5) < 0.02, share)).unionByName(near("mode", F.col("same"), tops)).unionByName(near("reservoir", F.col("same") & (F.col("n") == 50), sample))
    return out.unionByName(near("histogram", (F.abs(F.col("n") - F.col("all")) < 0.5) & (F.col("bins") <= 32) & (F.abs(F.col("middle") - F.col("mean")) < 1e-6 * (F.col("high") - F.col("low"))), mass))


@query("SELECT CAST(row_number() OVER (ORDER BY n DESC) - 1 AS INTEGER) AS rank, CAST(k AS BIGINT) AS item, n FROM (SELECT CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END AS k, count(*) AS n FROM events GROUP BY 1)")
def sketch_mode(spark, sf):
    return agg.ApproxMode(16).reduce(events(spark, sf).select(klass().alias("value")))


@query("SELECT CAST(count(*) AS DOUBLE) AS mass, true AS few, true AS rising, true AS central FROM events")
def sketch_histogram(spark, sf):
    """Mass, number of bins, their order, and whether their mean is the values' mean."""
    own = events(spark, sf)
    bins = agg.StreamingHistogram(32).reduce(own).agg(F.sum("n").alias("mass"), F.count("*").alias("bins"), F.transform(F.array_sort(F.collect_list(F.struct("bin", "center"))), lambda x: x["center"]).alias("at"), (F.sum(F.col("n") * F.col("center")) / F.sum("n")).alias("middle"))
    whole = own.agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"))
    return bins.crossJoin(whole).select("mass", (F.col("bins") <= 32).alias("few"), (F.col("at") == F.array_sort("at")).alias("rising"), (F.abs(F.col("middle") - F.col("mean")) <= 1e-6 * F.col("std")).alias("central"))


@query("SELECT least(50, count(*)) AS n, least(50, count(*)) AS distinct_ids, true AS members FROM events")
def sketch_reservoir(spark, sf):
    """Size, distinctness and membership of the sample."""
    own = events(spark, sf).select("event_id", "value")
    drawn = agg.Reservoir(50, 1).reduce(own, key=("event_id",))
    met = drawn.join(own.withColumnRenamed("value", "real"), "event_id", "left")
    return met.agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_ids"), F.bool_and(F.col("value").eqNullSafe(F.col("real"))).alias("members"))


# ---------------------------------------------------------------- windows
def _window_query(name: str, window: win.Window, sql: str | None):
    def run(spark, sf):
        at = spark.range(PATCH * PATCH).select(F.floor(F.col("id") / PATCH).alias("i"), (F.col("id") % PATCH).alias("j"))
        return at.select("i", "j", F.round(window.weight([F.col("i"), F.col("j")], [PATCH, PATCH]), 6).alias("w"))

    run.__name__ = name
    query(f"SELECT CAST(a AS BIGINT) AS i, CAST(b AS BIGINT) AS j, round(CAST({sql} AS DOUBLE), 6) AS w FROM (SELECT a, b, a AS i, b AS j FROM range(16) x(a), range(16) y(b))" if sql else None)(run)


_window_query("w_boxcar", win.Boxcar(), "1.0")
_window_query("w_hann", win.Hann(), _HANN)
_window_query("w_gaussian", win.Gaussian(), _GAUSS)
_window_query("w_tukey", win.Tukey(0.5), f"{_TUKEY.format(x='i')} * {_TUKEY.format(x='j')}")
_window_query("w_custom", win.Custom(lambda shape: np.add.outer(*(np.arange(n) for n in shape)) / 10), "(i + j) / 10.0")


# ---------------------------------------------------------------- patches, boundaries, anchors
@query(f"{_patches(True)} SELECT seq, ar, ac, count(*) AS n, count(value) AS n_valid, round(sum(value), 6) AS total FROM pc GROUP BY seq, ar, ac")
def rect_patches(spark, sf):
    return patcher().split(raster(spark, sf, True)).groupBy("seq", "ar", "ac").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"), F.round(F.sum("value"), 6).alias("total"))


def _boundary_sql(extent_r: str, condition: str) -> str:
    return f"""WITH r AS ({_rows()}), ar AS (SELECT CAST(x AS BIGINT) AS ar FROM range(0, {extent_r}, 13) t(x)), ac AS (SELECT CAST(x AS BIGINT) AS ac FROM range(0, 100, 13) t(x)),
b AS (SELECT ar, ac, (ar // 13) * (SELECT count(*) FROM ac) + ac // 13 AS seq FROM ar, ac)
SELECT seq, ar, ac, {condition} AS n, count(value) AS n_valid, round(coalesce(sum(value), 0), 6) AS total FROM b LEFT JOIN r ON r.r >= ar AND r.r < ar + 16 AND r.c >= ac AND r.c < ac + 16 GROUP BY seq, ar, ac"""


def _boundary(spark, sf, boundary):
    cells = patcher(size=16, step=13, boundary=boundary).split(raster(spark, sf))
    return cells.groupBy("seq", "ar", "ac").agg(F.count("*").alias("n"), F.count("value").alias("n_valid"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("total"))


@query(f"{_patches(size=16, step=13)} SELECT seq, ar, ac, count(*) AS n, count(value) AS n_valid, round(coalesce(sum(value), 0), 6) AS total FROM pc GROUP BY seq, ar, ac")
def boundary_drop(spark, sf):
    return _boundary(spark, sf, "drop")


@query(_boundary_sql("(SELECT max(event_id) // 100 + 1 FROM events)", "CAST(256 AS BIGINT)"))
def boundary_pad(spark, sf):
    return _boundary(spark, sf, "pad")


@query(_boundary_sql("(SELECT max(event_id) // 100 + 1 FROM events)", "count(value)"))
def boundary_shrink(spark, sf):
    return _boundary(spark, sf, "shrink")


@query(f"WITH ar AS ({_lattice('ar')}), ac AS ({_lattice('ac', extent='100')}) SELECT (ar // 8) * (SELECT count(*) FROM ac) + ac // 8 AS seq, ar, ac FROM ar, ac")
def stride_anchors(spark, sf):
    return patcher().anchors(raster(spark, sf))


@query(f"WITH ar AS ({_lattice('ar')}), ac AS ({_lattice('ac', extent='100')}) SELECT count(*) AS n FROM ar, ac")
def n_anchors(spark, sf):
    return spark.createDataFrame([(patcher().n_anchors(raster(spark, sf)),)], "n long")


@query("SELECT CAST(seq AS BIGINT) AS seq, CAST(ar AS BIGINT) AS ar, CAST(ac AS BIGINT) AS ac FROM (VALUES (0, 3, 5), (1, 0, 80), (2, 3, 5)) t(seq, ar, ac)")
def explicit_anchors(spark, sf):
    return SpatialPatcher(geo.Rectangular(4), smp.Explicit(((3, 5), (0, 80), (3, 5)))).anchors(raster(spark, sf))


@query(f"WITH r AS ({_rows()}), a AS (SELECT * FROM (VALUES (0, 3, 5), (1, 0, 80), (2, 3, 5), (3, 8, 97)) t(seq, ar, ac)) SELECT CAST(seq AS BIGINT) AS seq, count(*) AS n, round(sum(value), 6) AS total FROM a JOIN r ON r.r >= ar AND r.r < ar + 4 AND r.c >= ac AND r.c < ac + 4 GROUP BY seq")
def explicit_patches(spark, sf):
    own = SpatialPatcher(geo.Rectangular(4), smp.Explicit(((3, 5), (0, 80), (3, 5), (8, 97))))
    return own.split(raster(spark, sf)).groupBy("seq").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


def _grid(spark, sf) -> fld.Field:
    own = raster(spark, sf)
    return fld.grid(own.df.withColumnsRenamed({"r": "lat", "c": "lon"}), {"lat": [-45 + 0.05 * i for i in range(own.domain.height)], "lon": [-100 + 2.0 * i for i in range(WIDTH)]})


@query(f"WITH ar AS ({_lattice('a_lat', 5, 4)}), ac AS ({_lattice('a_lon', 20, 10, '100')}) SELECT (a_lat // 4) * (SELECT count(*) FROM ac) + a_lon // 10 AS seq, a_lat, a_lon FROM ar, ac")
def grid_anchors(spark, sf):
    return SpatialPatcher(geo.Rectangular({"lat": 5, "lon": 20}), smp.RegularStride({"lat": 4, "lon": 10})).anchors(_grid(spark, sf))


@query(f"WITH r AS ({_rows()}), ar AS ({_lattice('a_lat', 5, 4)}), ac AS ({_lattice('a_lon', 20, 10, '100')}) SELECT (a_lat // 4) * (SELECT count(*) FROM ac) + a_lon // 10 AS seq, count(*) AS n, round(sum(value), 6) AS total FROM r JOIN ar ON r.r >= a_lat AND r.r < a_lat + 5 JOIN ac ON r.c >= a_lon AND r.c < a_lon + 20 GROUP BY 1")
def grid_rect_patches(spark, sf):
    own = SpatialPatcher(geo.Rectangular({"lat": 5, "lon": 20}), smp.RegularStride({"lat": 4, "lon": 10}))
    return own.split(_grid(spark, sf)).groupBy("seq").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH ar AS ({_lattice('ar')}), ac AS ({_lattice('ac', extent='100')}) SELECT (ar // 8) * (SELECT count(*) FROM ac) + ac // 8 AS seq, true AS near, true AS fits FROM ar, ac")
def jittered_anchors(spark, sf):
    """Of every place of the lattice: is its anchor within half a step, and does its patch fit?"""
    own = raster(spark, sf)
    plan = SpatialPatcher(geo.Rectangular(PATCH), smp.JitteredStride(STEP, 0.5, 7))
    home = patcher().anchors(own).withColumnsRenamed({"ar": "hr", "ac": "hc"})
    met = plan.anchors(own).join(home, "seq")
    fits = (F.col("ar") >= 0) & (F.col("ac") >= 0) & (F.col("ar") <= F.lit(max(own.domain.height - PATCH, 0))) & (F.col("ac") <= WIDTH - PATCH)
    return met.select("seq", (F.greatest(F.abs(F.col("ar") - F.col("hr")), F.abs(F.col("ac") - F.col("hc"))) <= STEP // 2).alias("near"), fits.alias("fits"))


@query("SELECT CAST(x AS BIGINT) AS seq, true AS fits, true AS again FROM range(40) t(x)")
def random_anchors(spark, sf):
    """Do all patches fit, and does the seed give the same ones again?"""
    own, plan = raster(spark, sf), SpatialPatcher(geo.Rectangular(PATCH), smp.RandomAnchors(40, 7))
    again = plan.anchors(own).select("seq", F.struct("ar", "ac").alias("other"))
    fits = (F.col("ar") >= 0) & (F.col("ac") >= 0) & (F.col("ar") <= F.lit(max(own.domain.height - PATCH, 0))) & (F.col("ac") <= WIDTH - PATCH)
    return plan.anchors(own).join(again, "seq").select("seq", fits.alias("fits"), (F.struct("ar", "ac") == F.col("other")).alias("again"))


@query("SELECT true AS many, true AS inside, 0::BIGINT AS crowded")
def poisson_anchors(spark, sf):
    """Enough anchors, all of them inside, and how many pairs are nearer than whole cells allow."""
    own = raster(spark, sf)
    found = SpatialPatcher(geo.Rectangular(4), smp.PoissonDisk(6.0, seed=7)).anchors(own)
    points_ = found.select(F.col("seq").alias("pid"), F.col("ar").cast("double").alias("y"), F.col("ac").cast("double").alias("x"))
    near = geo.RadiusGraph(6.0 - 2**0.5 - 1e-9).neighbours(points_.select(F.col("pid").alias("seq"), F.col("x").alias("ax"), F.col("y").alias("ay")), points_).where("seq <> pid")
    inside = (F.col("ar") >= 0) & (F.col("ac") >= 0) & (F.col("ar") <= F.lit(max(own.domain.height - 4, 0))) & (F.col("ac") <= WIDTH - 4)
    # a full board holds an anchor for each disk of twice the distance at least
    full = own.domain.height * WIDTH / (3.15 * 12.0**2)
    return found.agg((F.count("*") >= F.lit(full)).alias("many"), F.bool_and(inside).alias("inside")).crossJoin(near.agg(F.count("*").alias("crowded")))


@query("SELECT true AS many, true AS inside, 0::BIGINT AS crowded")
def poisson_spread(spark, sf):
    """The same of anchors that are placed on the executors."""
    own = raster(spark, sf)
    found = SpatialPatcher(geo.Rectangular(4), smp.PoissonDisk(6.0, 10, seed=7, spread=True)).anchors(own)
    points_ = found.select(F.col("seq").alias("pid"), F.col("ar").cast("double").alias("y"), F.col("ac").cast("double").alias("x"))
    near = geo.RadiusGraph(6.0 - 2**0.5 - 1e-9).neighbours(points_.select(F.col("pid").alias("seq"), F.col("x").alias("ax"), F.col("y").alias("ay")), points_).where("seq <> pid")
    inside = (F.col("ar") >= 0) & (F.col("ac") >= 0) & (F.col("ar") <= F.lit(max(own.domain.height - 4, 0))) & (F.col("ac") <= WIDTH - 4)
    return found.agg((F.count("*") >= F.lit(own.domain.height * WIDTH / (3.15 * 12.0**2))).alias("many"), F.bool_and(inside).alias("inside")).crossJoin(near.agg(F.count("*").alias("crowded")))


# ---------------------------------------------------------------- points and polygons
@query("SELECT vec_id AS pid, true AS covered, 0::BIGINT AS crowded FROM embeddings")
def poisson_points(spark, sf):
    """A well-spaced choice of points: each point has a chosen one within the distance, and no two chosen are nearer."""
    own = points(spark, sf)
    chosen = SpatialPatcher(geo.RadiusGraph(0.1), smp.PoissonDisk(0.05, seed=3, spread=True)).anchors(own).select(F.col("a_id").alias("pid")).join(own.df, "pid")
    at = own.df.select(F.col("pid").alias("seq"), F.col("x").alias("ax"), F.col("y").alias("ay"))
    near = geo.RadiusGraph(0.05).neighbours(at, chosen).where("distance < 0.05")
    mine = near.groupBy(F.col("seq").alias("pid")).agg(F.lit(True).alias("covered"), F.count_if(F.col("seq") != F.col("pid")).alias("n"), F.max((F.col("seq") == F.col("pid")).cast("int")).alias("taken"))
    return mine.select("pid", "covered", F.when(F.col("taken") == 1, F.col("n")).otherwise(0).cast("long").alias("crowded"))


_POINTS = "p AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y FROM embeddings), g AS (SELECT pid, x * 180 AS x, y * 90 AS y FROM p)"
_DIST = "sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))"
_HAV = "2 * 6371.0 * asin(least(sqrt(power(sin((radians(b.y) - radians(a.y)) / 2), 2) + cos(radians(a.y)) * cos(radians(b.y)) * power(sin((radians(b.x) - radians(a.x)) / 2), 2)), 1.0))"


def _knn_sql(table: str, distance: str, every: int = 10) -> str:
    return f"WITH {_POINTS}, d AS (SELECT a.pid AS seq, b.pid AS pid, {distance} AS distance FROM {table} a, {table} b WHERE a.pid % {every} = 0), n AS (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY distance, pid) AS rank FROM d) SELECT seq, pid, CAST(rank AS INTEGER) AS rank, round(distance, 6) AS distance FROM n WHERE rank <= 5"


def _near_sql(table: str, distance: str, radius: float, every: int) -> str:
    return f"WITH {_POINTS} SELECT a.pid AS seq, b.pid AS pid, round({distance}, 6) AS distance FROM {table} a, {table} b WHERE a.pid % {every} = 0 AND {distance} <= {radius}"


@query(_knn_sql("p", _DIST))
def knn_euclid(spark, sf):
    own = points(spark, sf).df
    return geo.KNNGraph(5).neighbours(anchors_at(own, 10), own).select("seq", "pid", "rank", r6("distance"))


@query(_knn_sql("g", _HAV))
def knn_haversine(spark, sf):
    own = lonlat(points(spark, sf))
    return geo.KNNGraph(5, "haversine").neighbours(anchors_at(own, 10), own).select("seq", "pid", "rank", r6("distance"))


@query(_knn_sql("q", _DIST).replace("WITH p AS", "WITH q AS (SELECT vec_id AS pid, CAST(embedding[1] AS DOUBLE) + 0.5 AS x, CAST(embedding[2] AS DOUBLE) + 0.5 AS y FROM embeddings), p AS"))
def knn_centroid(spark, sf):
    """Features are unit squares; their area centroids are compared."""
    own = points(spark, sf).df
    ring = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    centres = own.select("pid", geo.centroid(ring).alias("p")).select("pid", "p.x", "p.y")
    return geo.KNNGraph(5).neighbours(anchors_at(centres, 10), centres).select("seq", "pid", "rank", r6("distance"))


@query(_near_sql("p", _DIST, 0.1, 1))
def radius_euclid(spark, sf):
    return geo.RadiusGraph(0.1).pairs(points(spark, sf).df).select("seq", "pid", r6("distance"))


@query(_near_sql("g", _HAV, 500, 1))
def radius_haversine(spark, sf):
    return geo.RadiusGraph(500.0, "haversine").pairs(lonlat(points(spark, sf))).select("seq", "pid", r6("distance"))


@query(_near_sql("g", _HAV, 2000, 50))
def spherical_cap_point(spark, sf):
    own = lonlat(points(spark, sf))
    return geo.SphericalCap(2000.0).neighbours(anchors_at(own, 50), own).select("seq", "pid", r6("distance"))


@query("WITH b AS (SELECT CAST(i AS BIGINT) AS lat, CAST(j AS BIGINT) AS lon, -10 + 1.0 * i AS y, -20 + 2.0 * j AS x FROM range(21) s(i), range(21) t(j)), "
       "a AS (SELECT * FROM (VALUES (0, 0.0, 0.0), (1, 5.0, -20.0)) v(seq, y, x)) "
       f"SELECT CAST(seq AS BIGINT) AS seq, lat, lon, round({_HAV}, 6) AS distance FROM a, b WHERE {_HAV} <= 400")  # fmt: skip
def spherical_cap_grid(spark, sf):
    domain = GridDomain({"lat": tuple(-10 + 1.0 * i for i in range(21)), "lon": tuple(-20 + 2.0 * j for j in range(21))})
    anchors = spark.createDataFrame([(0, 0.0, 0.0), (1, 5.0, -20.0)], "seq long, a_lat double, a_lon double")
    return geo.SphericalCap(400.0).on_grid(anchors, spark, domain).select("seq", "lat", "lon", r6("distance"))


_GRID = "s AS (SELECT event_id % 37 AS lat, event_id // 37 % 72 AS lon, sum(value) AS value FROM events GROUP BY 1, 2), g AS (SELECT lat, lon, value, lat * 5.0 - 90 AS y, lon * 5.0 - 180 AS x FROM s), a AS (SELECT CAST(k AS BIGINT) AS seq, (k // 6) * 25.0 - 90 AS y, (k % 6) * 60.0 - 180 AS x FROM range(48) t(k))"


@query(f"WITH {_GRID} SELECT seq, round(sum(value), 6) AS value FROM (SELECT a.seq, b.value FROM a, g b WHERE {_HAV} <= 1000) GROUP BY seq")
def cap_grid_merge(spark, sf):
    """Sums over caps on a grid of 5 degrees that the events fill; anchors are labels."""
    cells = events(spark, sf).groupBy((F.col("event_id") % 37).alias("lat"), (F.floor(F.col("event_id") / 37) % 72).alias("lon")).agg(F.sum("value").alias("value"))
    source = fld.grid(cells, {"lat": [5.0 * i - 90 for i in range(37)], "lon": [5.0 * j - 180 for j in range(72)]})
    anchors = spark.range(48).select(F.col("id").alias("seq"), (F.floor(F.col("id") / 6) * 25.0 - 90).alias("a_lat"), (F.col("id") % 6 * 60.0 - 180).alias("a_lon"))
    plan = SpatialPatcher(geo.SphericalCap(1000.0), aggregation=agg.Sum())
    return plan.merge_anchors(plan.split(source, anchors)).select("seq", r6("value"))


_SQUARES = "f AS (SELECT pid, x * 10 AS x, y * 10 AS y, CASE pid % 3 WHEN 0 THEN 0.001 WHEN 1 THEN 0.5 ELSE 40 END AS s FROM p)"
_GAP = "sqrt(power(greatest(b.x - a.x, 0, a.x - b.x - b.s), 2) + power(greatest(b.y - a.y, 0, a.y - b.y - b.s), 2))"


def _squares(spark, sf) -> DataFrame:
    """Houses, towns and continents at the points: squares with sides of 0.001, 0.5 and 40."""
    side = F.when(F.col("pid") % 3 == 0, 0.001).when(F.col("pid") % 3 == 1, 0.5).otherwise(40.0)
    own = points(spark, sf).df.select("pid", (F.col("x") * 10).alias("x"), (F.col("y") * 10).alias("y"), side.alias("s"))
    at = lambda i, j: F.struct((F.col("x") + i * F.col("s")).alias("x"), (F.col("y") + j * F.col("s")).alias("y"))
    return own.select("*", F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1)).alias("ring"))


@query(f"WITH {_POINTS}, {_SQUARES}, m AS (SELECT a.pid AS seq, b.pid % 3 AS size, {_GAP} AS distance, a.pid <> b.pid AS other FROM f a, f b WHERE a.pid % 25 = 0) "
       "SELECT radius, seq, CAST(size AS BIGINT) AS size, count(*) AS n, round(sum(distance), 4) AS distance FROM m, (VALUES (0.0::DOUBLE), (0.2), (30.0)) t(radius) WHERE distance <= radius GROUP BY 1, 2, 3")  # fmt: skip
def features_uneven(spark, sf):
    """Features of very different sizes near places, at three radii: each feature stands in four squares at most."""
    own, out = _squares(spark, sf), None
    for radius in (0.0, 0.2, 30.0):
        met = geo.RadiusGraph(radius).features_near(anchors_at(own, 25), own, "pid").groupBy("seq", (F.col("pid") % 3).alias("size")).agg(F.count("*").alias("n"), F.round(F.sum("distance"), 4).alias("distance"))
        met = met.select(F.lit(radius).alias("radius"), "seq", "size", "n", "distance")
        out = met if out is None else out.unionByName(met)
    return out


@query(f"WITH {_POINTS}, {_SQUARES} SELECT a.pid AS seq, CAST(b.pid % 3 AS BIGINT) AS size, count(*) AS n FROM f a, f b WHERE a.pid % 20 = 0 AND a.x <= b.x + b.s AND b.x <= a.x + a.s AND a.y <= b.y + b.s AND b.y <= a.y + a.s GROUP BY 1, 2")
def polygons_uneven(spark, sf):
    """Polygons and features of very different sizes that meet."""
    own = _squares(spark, sf)
    met = geo.PolygonIntersection().features_in(own.where("pid % 20 = 0").select(F.col("pid").alias("seq"), "ring"), own, "pid")
    return met.groupBy("seq", (F.col("pid") % 3).alias("size")).agg(F.count("*").alias("n"))


_EDGES = """e AS (SELECT * FROM (VALUES (0, 2.0, 1.0, 40.0, 3.0), (0, 40.0, 3.0, 20.0, 9.5), (0, 20.0, 9.5, 2.0, 1.0), (1, 50.0, 0.0, 60.0, 0.0), (1, 60.0, 0.0, 60.0, 30.0), (1, 60.0, 30.0, 50.0, 30.0), (1, 50.0, 30.0, 50.0, 0.0),
  (2, 5.0, 20.0, 30.0, 50.0), (2, 30.0, 50.0, 55.0, 20.0), (2, 55.0, 20.0, 30.0, 90.0), (2, 30.0, 90.0, 5.0, 20.0)) v(seq, x1, y1, x2, y2))"""
_ODD = "sum(CASE WHEN (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1 THEN 1 ELSE 0 END) % 2 = 1"


@query(f"WITH {_EDGES}, r AS (SELECT event_id // 100 AS r, event_id % 100 AS c, value, event_id % 100 + 0.5 AS x, event_id // 100 + 0.5 AS y FROM events) SELECT CAST(seq AS BIGINT) AS seq, CAST(r AS BIGINT) AS r, CAST(c AS BIGINT) AS c, value FROM e, r GROUP BY seq, r, c, value HAVING {_ODD}")
def polygon_mask(spark, sf):
    return geo.PolygonIntersection().mask(polygons(spark), raster(spark, sf).df).select("seq", "r", "c", "value")


@query(f"WITH {_EDGES}, {_POINTS}, s AS (SELECT pid, (x + 1) * 40 AS x, (y + 1) * 40 AS y FROM p) SELECT CAST(seq AS BIGINT) AS seq, pid FROM e, s GROUP BY seq, pid, x, y HAVING {_ODD}")
def polygon_features(spark, sf):
    scaled = points(spark, sf).df.select("pid", ((F.col("x") + 1) * 40).alias("x"), ((F.col("y") + 1) * 40).alias("y"))
    return geo.PolygonIntersection(16).points_in(polygons(spark), scaled).select("seq", "pid")


# ---------------------------------------------------------------- merges of shapes without a box
def _valued(df: DataFrame) -> fld.Field:
    return fld.points(df.withColumn("value", (F.col("pid") % 7).cast("double")), "pid", ("value",))


def _moved() -> F.Column:
    """A value that differs from patch to patch."""
    return F.col("value") + F.col("seq") % 5


def _shape_sql(patches: str, table: str, column: str, default: str) -> str:
    return f"{patches}, v AS (SELECT pid, pid % 7 + seq % 5 AS v FROM n), m AS (SELECT pid, {column} AS value FROM v GROUP BY pid) SELECT a.pid, round(coalesce(m.value, {default}), 6) AS value FROM {table} a LEFT JOIN (SELECT pid, CAST(value AS DOUBLE) AS value FROM m) m ON m.pid = a.pid"


_KNN = f"WITH {_POINTS}, d AS (SELECT a.pid AS seq, b.pid AS pid, {_DIST} AS distance FROM p a, p b WHERE a.pid % 10 = 0), n AS (SELECT seq, pid FROM (SELECT *, row_number() OVER (PARTITION BY seq ORDER BY distance, pid) AS rank FROM d) WHERE rank <= 5)"


@query(_shape_sql(_KNN, "p", "avg(v)", "0"))
def knn_merge(spark, sf):
    source = _valued(points(spark, sf).df)
    plan = SpatialPatcher(geo.KNNGraph(5), aggregation=agg.Mean())
    return plan.merge(plan.split(source, anchors_at(source.df, 10)), source, _moved()).select("pid", r6("value"))


@query(f"WITH {_POINTS}, n AS (SELECT a.pid AS seq, b.pid AS pid FROM p a, p b WHERE a.pid % 3 = 0 AND {_DIST} <= 0.1) SELECT seq, CAST(max(pid % 7 + seq % 5) AS DOUBLE) AS value FROM n GROUP BY seq")
def radius_merge(spark, sf):
    """By anchor: the largest value near each."""
    source = _valued(points(spark, sf).df)
    plan = SpatialPatcher(geo.RadiusGraph(0.1), aggregation=agg.Max())
    return plan.merge_anchors(plan.split(source, anchors_at(source.df, 3)), _moved())


@query(_shape_sql(f"WITH {_POINTS}, n AS (SELECT a.pid AS seq, b.pid AS pid FROM g a, g b WHERE a.pid % 50 = 0 AND {_HAV} <= 2000)", "g", "sum(v)", "0"))
def cap_merge(spark, sf):
    source = _valued(lonlat(points(spark, sf)))
    plan = SpatialPatcher(geo.SphericalCap(2000.0), aggregation=agg.Sum())
    return plan.merge(plan.split(source, anchors_at(source.df, 50)), source, _moved()).select("pid", r6("value"))


@query(f"WITH {_POINTS}, n AS (SELECT a.pid AS seq, b.pid AS pid FROM p a, p b WHERE a.pid % 3 = 0 AND {_DIST} <= 0.1), s AS (SELECT seq, avg(pid % 7) AS mean FROM n GROUP BY seq), m AS (SELECT n.pid, sum(pid % 7 - mean) AS value FROM n JOIN s ON s.seq = n.seq GROUP BY n.pid) SELECT p.pid, round(coalesce(value, 0), 6) + 0.0 AS value FROM p LEFT JOIN m ON m.pid = p.pid")
def radius_map(spark, sf):
    """An opaque operator on whole neighbourhoods, then the merge by point."""
    source = _valued(points(spark, sf).df)
    plan = SpatialPatcher(geo.RadiusGraph(0.1), aggregation=agg.Sum())
    done = plan.map(source, lambda values: values - values.mean(), anchors=anchors_at(source.df, 3))
    return plan.merge(unpack_at(done.patches), source).select("pid", (F.round("value", 6) + 0.0).alias("value"))


@query(f"WITH {_POINTS}, t AS (SELECT pid, t, x, y, CAST(pid % 7 + 10 * t AS DOUBLE) AS value FROM p, range(3) r(t)), n AS (SELECT a.pid AS seq, b.pid AS pid FROM p a, p b WHERE a.pid % 20 = 0 AND {_DIST} <= 0.1) SELECT n.seq, CAST(t AS INTEGER) AS t, count(*) AS n, sum(value) AS total FROM n JOIN t ON t.pid = n.pid GROUP BY n.seq, t")
def point_cube(spark, sf):
    """Points with values at three times, met by place."""
    at = points(spark, sf).df
    cells = at.select("pid", "x", "y", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("t")).withColumn("value", (F.col("pid") % 7 + 10 * F.col("t")).cast("double"))
    source = fld.point_cube(cells, "pid")
    near = SpatialPatcher(geo.RadiusGraph(0.1)).split(source, anchors_at(at, 20))
    return near.groupBy("seq", "t").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


@query(_merged("sum(v * power(w, 2)) AS value", _GAUSS, defaults=_value("0")))
def agg_weight_fn(spark, sf):
    """A weighted sum whose weights are squared."""
    out = patcher(win.Gaussian(), agg.WeightedSum(lambda w: w * w)).merge_cells(raster(spark, sf, True), shifted)
    return out.select("r", "c", r6("value"))


#: A raster turned upside down and stretched: x = 2 c + 3, y = 100 - r.
_TURNED = (2.0, 0.0, 3.0, 0.0, -1.0, 100.0)


@query(f"WITH {_EDGES}, r AS (SELECT event_id // 100 AS r, event_id % 100 AS c, value, 2 * (event_id % 100 + 0.5) + 3 AS x, 100 - (event_id // 100 + 0.5) AS y FROM events), n AS (SELECT seq, r, c, value FROM e, r GROUP BY seq, r, c, value, x, y HAVING {_ODD}), "
       "m AS (SELECT r, c, avg(value + seq % 5) AS value FROM n GROUP BY r, c) SELECT CAST(r.r AS BIGINT) AS r, CAST(r.c AS BIGINT) AS c, round(coalesce(m.value, 0), 6) AS value FROM r LEFT JOIN m ON m.r = r.r AND m.c = r.c")  # fmt: skip
def polygon_merge(spark, sf):
    """Polygons in the plane of the raster's transform; cells of a bounding window outside its polygon weigh nothing."""
    own = raster(spark, sf)
    source = fld.raster(own.df, own.domain.height, WIDTH, transform=_TURNED)
    plan = SpatialPatcher(geo.PolygonIntersection())
    return plan.merge(plan.split(source, polygons(spark)), source, _moved()).select("r", "c", r6("value"))


@query(f"WITH {_POINTS}, a AS (SELECT pid, x * 10 AS x, y * 10 AS y FROM p), n AS (SELECT a.pid AS seq, b.pid AS pid FROM a, (SELECT pid, least(greatest(q.x, 0), 0) AS z, x, y FROM a q) b WHERE a.pid % 25 = 0 "
       "AND sqrt(power(greatest(b.x - a.x, 0, a.x - b.x - 1), 2) + power(greatest(b.y - a.y, 0, a.y - b.y - 1), 2)) <= 1.5) SELECT seq, count(*) AS n, CAST(sum(pid % 7) AS DOUBLE) AS total FROM n GROUP BY seq")
def feature_merge(spark, sf):
    """Unit squares within a radius of places: a field of features, merged by anchor."""
    own = points(spark, sf).df.select("pid", (F.col("x") * 10).alias("x"), (F.col("y") * 10).alias("y"))
    ring = F.array(*[F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y")) for dx, dy in ((0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0))])
    source = fld.features(own.select("pid", ring.alias("ring"), (F.col("pid") % 7).cast("double").alias("value")), "pid", ("value",))
    plan = SpatialPatcher(geo.RadiusGraph(1.5), aggregation=agg.Sum())
    cells = plan.split(source, anchors_at(own, 25))
    total = plan.merge_anchors(cells).withColumnRenamed("value", "total")
    return total.join(cells.groupBy("seq").agg(F.count("*").alias("n")), "seq")


@query(f"""WITH {_POINTS}, {_EDGES.replace('e AS (SELECT * FROM (VALUES', 'e0 AS (SELECT * FROM (VALUES', 1)}, r AS ({_rows()}), o AS (SELECT p.* FROM p JOIN (SELECT max(pid) // 2 AS m FROM p) ON pid = m),
hit AS (SELECT r, c, value FROM e0, (SELECT r, c, value, c + 0.5 AS x, r + 0.5 AS y FROM r) q WHERE seq = 2 GROUP BY r, c, value HAVING {_ODD})
SELECT 'box' AS shape, count(*) AS n, round(sum(value), 6) AS total FROM r WHERE r >= 3 AND r < 19 AND c >= 5 AND c < 21
UNION ALL SELECT 'radius', count(*), round(sum(b.pid % 7), 6) FROM o a, p b WHERE {_DIST} <= 0.1
UNION ALL SELECT 'place', count(*), round(sum(b.pid % 7), 6) FROM (SELECT 0.05 AS x, 0.02 AS y) a, p b WHERE {_DIST} <= 0.1
UNION ALL SELECT 'nearest', count(*), round(sum(pid % 7), 6) FROM (SELECT b.pid FROM o a, p b ORDER BY {_DIST}, b.pid LIMIT 5)
UNION ALL SELECT 'polygon', count(*), round(coalesce(sum(value), 0), 6) FROM hit""")
def patch_at_shapes(spark, sf):
    """One patch of each kind of shape, by its anchor alone."""
    own, source = raster(spark, sf), _valued(points(spark, sf).df)
    middle = source.df.agg(F.max("pid")).first()[0] // 2
    arrow = [(5.0, 20.0), (30.0, 50.0), (55.0, 20.0), (30.0, 90.0)]
    asked = [
        ("box", patcher().patch_at(own, {"r": 3, "c": 5})), ("radius", SpatialPatcher(geo.RadiusGraph(0.1)).patch_at(source, middle)), ("place", SpatialPatcher(geo.RadiusGraph(0.1)).patch_at(source, (0.05, 0.02))),
        ("nearest", SpatialPatcher(geo.KNNGraph(5)).patch_at(source, middle)), ("polygon", SpatialPatcher(geo.PolygonIntersection()).patch_at(own, arrow).where("w > 0")),
    ]
    out = None
    for name, cells in asked:
        one = cells.agg(F.count("*").alias("n"), F.round(F.coalesce(F.sum("value"), F.lit(0.0)), 6).alias("total")).select(F.lit(name).alias("shape"), "n", "total")
        out = one if out is None else out.unionByName(one)
    return out


def _diagonals(domain, part, parts):
    """A user's sampler: two anchors of every eighth row, each part its share of rows."""
    for r in range(8 * part, domain.height, 8 * parts):
        yield r, r % domain.width
        yield r, (3 * r + 50) % domain.width


def _cross(anchor):
    """A user's neighbourhood: the five cells of a cross, its centre with weight 2."""
    r, c = anchor["ar"], anchor["ac"]
    for dr, dc in ((0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)):
        yield r + dr, c + dc, 1.0 + (dr == dc == 0)


@query(f"WITH r AS ({_rows()}), d AS (SELECT max(r) + 1 AS h FROM r), a AS (SELECT CAST(k % 2 AS BIGINT) AS which, CAST(k // 2 * 8 AS BIGINT) AS ar FROM range(0, (SELECT CAST((h + 7) // 8 * 2 AS BIGINT) FROM d)) t(k)), "
       "b AS (SELECT ar, CASE which WHEN 0 THEN ar % 100 ELSE (3 * ar + 50) % 100 END AS ac FROM a), x AS (SELECT * FROM (VALUES (0, 0, 2.0), (1, 0, 1.0), (-1, 0, 1.0), (0, 1, 1.0), (0, -1, 1.0)) v(dr, dc, w)) "
       "SELECT ar, ac, count(*) AS n, round(sum(value * w), 6) AS total FROM b, x JOIN r ON r.r = ar + dr AND r.c = ac + dc GROUP BY ar, ac")  # fmt: skip
def custom_shapes(spark, sf):
    """A sampler and a neighbourhood that a user wrote in Python."""
    own = raster(spark, sf)
    shape = custom.CustomNeighbourhood(_cross, weighted=True)
    anchors = custom.CustomSampler(_diagonals, 4).table(spark, own.domain, shape)
    cells = SpatialPatcher(shape).split(own, anchors)
    return cells.groupBy("ar", "ac").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * F.col("w")), 6).alias("total"))


# ---------------------------------------------------------------- tiles
_TILE = "greatest({s}, 0) AS lo_{a}, least({s} + {n}, {e}) AS hi_{a}"


@query("WITH w AS (SELECT event_id AS seq, event_id * 7 % 140 - 20 AS r0, event_id * 11 % 150 - 25 AS c0, 5 + event_id % 40 AS h, 5 + event_id % 30 AS w FROM events), "
       f"x AS (SELECT seq, {_TILE.format(s='r0', n='h', e='100', a='r')}, {_TILE.format(s='c0', n='w', e='100', a='c')} FROM w) "
       "SELECT seq, CAST(CASE WHEN ok THEN lo_r // 16 ELSE 0 END AS BIGINT) AS ty0, CAST(CASE WHEN ok THEN (hi_r - 1) // 16 ELSE -1 END AS BIGINT) AS ty1, CAST(CASE WHEN ok THEN lo_c // 16 ELSE 0 END AS BIGINT) AS tx0, CAST(CASE WHEN ok THEN (hi_c - 1) // 16 ELSE -1 END AS BIGINT) AS tx1 "
       "FROM (SELECT *, lo_r < hi_r AND lo_c < hi_c AS ok FROM x)")  # fmt: skip
def tile_range(spark, sf):
    asked = events(spark, sf).selectExpr("event_id AS seq", "event_id * 7 % 140 - 20 AS r0", "event_id * 11 % 150 - 25 AS c0", "5 + event_id % 40 AS h", "5 + event_id % 30 AS w")
    return tiles.TiledRaster(RasterDomain(100, 100), 16, 16).ranges(asked).selectExpr("seq", "cast(ty0 AS bigint) ty0", "cast(ty1 AS bigint) ty1", "cast(tx0 AS bigint) tx0", "cast(tx1 AS bigint) tx1")


@query(f"WITH r AS ({_rows()}), w AS (SELECT * FROM (VALUES (0, -2, 3, 6, 5), (1, 4, 90, 5, 20), (2, 500000, 0, 2, 2)) v(seq, r0, c0, h, w)), f AS (SELECT seq, i, j, r0 + i AS r, c0 + j AS c FROM w, range(6) s(i), range(20) t(j) WHERE i < h AND j < w) "
       "SELECT CAST(seq AS BIGINT) AS seq, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, coalesce(value, 0) AS value FROM f LEFT JOIN r ON f.r = r.r AND f.c = r.c")  # fmt: skip
def tile_select_many(spark, sf):
    own = raster(spark, sf)
    image = tiles.TiledRaster(own.domain, 16, 16)
    asked = spark.createDataFrame([(0, -2, 3, 6, 5), (1, 4, 90, 5, 20), (2, 500000, 0, 2, 2)], "seq long, r0 long, c0 long, h long, w long")
    return image.select_many(image.tiles(own.df, windows=asked), asked).select("seq", "i", "j", "value")


@query(f"WITH r AS ({_rows()}), w AS (SELECT * FROM (VALUES (0, -2, 3, 6, 5), (1, 4, 90, 5, 20)) v(seq, r0, c0, h, w)), f AS (SELECT seq, i, j, b, r0 + i AS r, c0 + j AS c FROM w, range(6) s(i), range(20) t(j), range(2) u(b) WHERE i < h AND j < w) "
       "SELECT CAST(seq AS BIGINT) AS seq, CAST(b AS INTEGER) AS band, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, coalesce(CASE b WHEN 0 THEN value ELSE -value END, 0) + 0.0 AS value FROM f LEFT JOIN r ON f.r = r.r AND f.c = r.c")  # fmt: skip
def tile_bands(spark, sf):
    """Windows of a tiled image with two bands."""
    own = raster(spark, sf)
    cells = own.df.select("r", "c", "value", F.explode(F.array(F.lit(0), F.lit(1))).alias("band")).withColumn("value", F.when(F.col("band") == 0, F.col("value")).otherwise(-F.col("value")))
    image = tiles.TiledRaster(RasterDomain(own.domain.height, WIDTH, 2), 16, 16)
    asked = spark.createDataFrame([(0, -2, 3, 6, 5), (1, 4, 90, 5, 20)], "seq long, r0 long, c0 long, h long, w long")
    return image.select_many(image.tiles(cells, windows=asked), asked).select("seq", "band", "i", "j", (F.col("value") + 0.0).alias("value"))


@query(f"WITH m AS (SELECT * FROM ({_merged(_OVERLAP, _HANN, defaults=_value('0'))})) SELECT r, c, value FROM m WHERE r >= 3 AND r < 60 AND c >= 20 AND c < 75")
def chunk_store(spark, sf):
    """A merge kept as a chunk store of shards, and a window read back from it by the chunks it meets."""
    source, plan = raster(spark, sf, True), patcher(win.Hann())
    merged = plan.merge_cells(source, shifted)
    kept = chunks.write_field(source.with_data(merged), shared_path(spark), (16, 16), (64, 64), "value", "float64")
    found = chunks.opened(kept.path).cells(spark, {"r": slice(3, 60), "c": slice(20, 75)})
    return found.select("r", "c", r6("value"))


def _image(spark, sf, depth: int = 0) -> list[images.Level]:
    """The events' raster as a tiled image in the shared folder, and its levels."""
    own = raster(spark, sf)
    plan = tiles.TiledRaster(RasterDomain(own.domain.height, WIDTH, None, (10.0, 0.0, 500000.0, 0.0, -10.0, 4000000.0), "EPSG:32630"), 16, 16)
    return images.levels(images.write_image(plan.tiles(own.df), shared_path(spark).removeprefix("file:") + ".tif", plan, depth))


@query(f"WITH r AS ({_rows()}), w AS (SELECT event_id AS seq, event_id * 7 % 140 - 20 AS r0, event_id * 11 % 150 - 25 AS c0, 1 + event_id % 6 AS h, 1 + event_id % 5 AS w FROM events WHERE event_id % 50 = 0), f AS (SELECT seq, i, j, r0 + i AS r, c0 + j AS c FROM w, range(6) s(i), range(5) t(j) WHERE i < h AND j < w) "
       "SELECT CAST(seq AS BIGINT) AS seq, CAST(0 AS INTEGER) AS band, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, coalesce(value, 0) AS value FROM f LEFT JOIN r ON f.r = r.r AND f.c = r.c")  # fmt: skip
def image_windows(spark, sf):
    """Windows of an image file: only the tiles they touch are opened, each once."""
    asked = events(spark, sf).where("event_id % 50 = 0").selectExpr("event_id AS seq", "event_id * 7 % 140 - 20 AS r0", "event_id * 11 % 150 - 25 AS c0", "1 + event_id % 6 AS h", "1 + event_id % 5 AS w")
    return images.read_windows(_image(spark, sf)[0], asked).select("seq", "band", "i", "j", "value")


@query(f"WITH r0 AS ({_rows()}), d AS (SELECT max(r) + 1 AS h FROM r0), r AS (SELECT CAST(y AS BIGINT) AS r, CAST(x AS BIGINT) AS c, coalesce(value, 0) AS value FROM range(0, (SELECT h FROM d)) a(y) CROSS JOIN range(0, 100) b(x) LEFT JOIN r0 ON r0.r = y AND r0.c = x) "
       "SELECT CAST(k AS INTEGER) AS level, CAST(r // (1 << k) AS BIGINT) AS r, CAST(c // (1 << k) AS BIGINT) AS c, round(avg(value) + 1e-9, 6) AS value FROM r, range(4) l(k) GROUP BY 1, 2, 3")  # fmt: skip
def image_overviews(spark, sf):
    """All levels of an image file written with three overviews."""
    out = None
    for k, level in enumerate(_image(spark, sf, 3)):
        cells = images.read_tiles(spark, level.path, k).select("ty", "tx", F.posexplode("tile").alias("k", "value"))
        cells = cells.select(F.lit(k).alias("level"), (F.col("ty") * 16 + F.floor(F.col("k") / 16)).alias("r"), (F.col("tx") * 16 + F.col("k") % 16).alias("c"), F.round(F.col("value") + 1e-9, 6).alias("value")).where(f"r < {level.height} and c < {level.width}")
        out = cells if out is None else out.unionByName(cells)
    return out


@query(f"WITH r AS ({_rows()}) SELECT CAST(r // 16 AS BIGINT) AS ty, CAST(c // 16 AS BIGINT) AS tx, round(sum(value), 6) AS total FROM r WHERE r // 16 >= 1 AND r // 16 < 5 AND c // 16 <= 3 GROUP BY 1, 2")
def image_scan(spark, sf):
    """A scan of an image file: conditions on tiles reach the reader."""
    found = images.read_tiles(spark, _image(spark, sf)[0].path).where("ty >= 1 AND ty < 5 AND tx <= 3")
    return found.select("ty", "tx", F.round(F.aggregate("tile", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"{_patches(True)}, b AS (SELECT * FROM range(2) t(b)), p AS (SELECT b, r, c, CASE b WHEN 0 THEN {_SHIFTED} ELSE 2 * {_SHIFTED} END AS v, {_HANN} AS w FROM pc, b), m AS (SELECT b, r, c, {_OVERLAP} FROM p GROUP BY b, r, c) "
       "SELECT CAST(b.b AS INTEGER) AS band, r.r, r.c, round(coalesce(m.value, 0), 6) AS value FROM r CROSS JOIN b LEFT JOIN m ON m.b = b.b AND m.r = r.r AND m.c = r.c")  # fmt: skip
def bands_merge(spark, sf):
    """Every band of a raster of two is merged with the same weights."""
    one = raster(spark, sf, True)
    cells = one.df.select("r", "c", F.explode(F.array(F.lit(0), F.lit(1))).alias("band"), "value")
    source = fld.raster(cells, one.domain.height, WIDTH, bands=2)
    own = patcher(win.Hann())
    split = own.split(source)
    return own.merge(split, source, shifted({c: F.col(c) for c in split.columns}) * (1 + F.col("band"))).select("band", "r", "c", r6("value"))


# ---------------------------------------------------------------- time
_S = "s AS (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, value FROM events), n AS (SELECT user_id, max(t) + 1 AS length FROM s GROUP BY user_id)"


def _time_sql(before: str, after: str, anchors: str, out: str = "count(*) AS n, round(avg(value), 6) AS mean", extra: str = "") -> str:
    """Patches of every user's series; ``a`` lists (user_id, length, t_anchor, scale)."""
    return f"""WITH {_S}, a AS ({anchors}), p AS (SELECT a.user_id, t_anchor, scale, greatest(0, t_anchor - ({before})) AS start, least(length, t_anchor + ({after}) + 1) AS stop FROM a),
pc AS (SELECT p.*, s.t, s.value FROM p JOIN s ON s.user_id = p.user_id AND s.t >= p.start AND s.t < p.stop){extra}
SELECT user_id, t_anchor, CAST(start AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop, {out} FROM pc GROUP BY user_id, t_anchor, scale, start, stop"""


def _steps(step: int, first: int = 0) -> str:
    return f"SELECT user_id, length, CAST(x AS BIGINT) AS t_anchor, 0 AS scale FROM n, (SELECT unnest(range({first}, (SELECT CAST(max(length) AS BIGINT) FROM n), {step})) AS x) WHERE x < length"


def _patches_of(spark, sf, geometry, sampler, window=None, anchors=None) -> DataFrame:
    return tmp.TemporalPatcher(geometry, sampler, window or win.CausalBoxcar()).split(user_series(spark, sf), anchors)


def _digest(cells: DataFrame, *more) -> DataFrame:
    return cells.groupBy("user_id", "t_anchor", "scale", "start", "stop").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), *more).drop("scale")


@query(_time_sql("4", "0", _steps(3)))
def t_lookback(spark, sf):
    return _digest(_patches_of(spark, sf, tmp.FixedLookback(5), smp.TemporalStride(3)))


@query(_time_sql("11", "6", _steps(5)))
def t_lookback_horizon(spark, sf):
    return _digest(_patches_of(spark, sf, tmp.LookbackHorizon(12, 6), smp.TemporalStride(5)))


@query(_time_sql("CASE scale WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 9 END", "0", "SELECT user_id, length, t_anchor, k AS scale FROM (" + _steps(4) + ") b(user_id, length, t_anchor, z), range(3) q(k)"))
def t_multiscale(spark, sf):
    return _digest(_patches_of(spark, sf, tmp.MultiScale((2, 5, 10)), smp.TemporalStride(4)))


@query(_time_sql("2", "2", _steps(3)))
def t_phase(spark, sf):
    return _digest(_patches_of(spark, sf, tmp.PhaseWindow(24, 2), smp.TemporalStride(3)))


@query("SELECT CAST(x // 7 AS BIGINT) AS seq, CAST(x AS BIGINT) AS t_anchor FROM range(0, (SELECT max(event_id) + 1 FROM events), 7) t(x)")
def t_stride(spark, sf):
    return smp.TemporalStride(7).table(spark, whole_series(spark, sf).domain.length)


@query("SELECT CAST((x - 10) // 4 AS BIGINT) AS seq, CAST(x AS BIGINT) AS t_anchor FROM range(10, (SELECT max(event_id) + 1 FROM events), 4) t(x)")
def t_causal(spark, sf):
    return smp.CausalRolling(4, 10).table(spark, whole_series(spark, sf).domain.length)


_EVENT = "SELECT n.user_id, length, t AS t_anchor, 0 AS scale FROM n JOIN (SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS t, event_type FROM events) e ON e.user_id = n.user_id WHERE event_type = 'purchase'"


@query(_time_sql("2", "1", _EVENT))
def t_events(spark, sf):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    at = events(spark, sf).select("user_id", "event_type", (F.row_number().over(order) - 1).cast("long").alias("t_anchor")).where("event_type = 'purchase'")
    anchors = at.select("user_id", "t_anchor", F.col("t_anchor").alias("seq"))
    return _digest(_patches_of(spark, sf, tmp.LookbackHorizon(3, 1), smp.EventTriggered(()), anchors=anchors))


@query(_time_sql("2", "0", "SELECT user_id, length, t_anchor, 0 AS scale FROM n, (VALUES (0), (3), (7), (900000)) v(t_anchor) WHERE t_anchor < length").replace("user_id, t_anchor, CAST(start", "user_id, CAST(t_anchor AS BIGINT) AS t_anchor, CAST(start"))
def t_explicit(spark, sf):
    return _digest(_patches_of(spark, sf, tmp.FixedLookback(3), smp.TemporalExplicit((0, 3, 7, 900_000))))


@query("SELECT CAST(x AS BIGINT) AS seq, true AS fits, true AS again FROM range(25) t(x)")
def t_random(spark, sf):
    """Do all times lie on the axis, and does the seed give the same ones again?"""
    n, plan = whole_series(spark, sf).domain.length, smp.TemporalRandom(25, 3)
    again = plan.table(spark, n).withColumnRenamed("t_anchor", "other")
    return plan.table(spark, n).join(again, "seq").select("seq", ((F.col("t_anchor") >= 0) & (F.col("t_anchor") < n)).alias("fits"), (F.col("t_anchor") == F.col("other")).alias("again"))


@query(_time_sql("4", "0", _steps(3), "count(*) AS n, round(avg(value), 6) AS mean, round(sum(value * exp(-(stop - 1 - t) / 2.0)), 6) AS weighted"))
def t_expdecay(spark, sf):
    return _digest(_patches_of(spark, sf, tmp.FixedLookback(5), smp.TemporalStride(3), win.ExponentialDecay(2.0)), F.round(F.sum(F.col("value") * F.col("w")), 6).alias("weighted"))


@query(_time_sql("7", "0", _steps(3), "count(*) AS n, round(avg(value), 6) AS mean, round(sum(value * w), 6) AS weighted",
       ", pw AS (SELECT *, t - start AS k, stop - start AS m FROM pc), pz AS (SELECT *, CASE WHEN m <= 1 THEN 1 WHEN k <= floor(0.25 * m) THEN 0.5 * (1 + cos(pi() * (4.0 * k / m - 1))) WHEN k >= m - floor(0.25 * m) THEN 0.5 * (1 + cos(pi() * (4.0 * k / m - 3))) ELSE 1 END AS w FROM pw)").replace("FROM pc GROUP", "FROM pz GROUP"))
def t_tukey(spark, sf):
    return _digest(_patches_of(spark, sf, tmp.FixedLookback(8), smp.TemporalStride(3), win.TaperedTukey(0.5)), F.round(F.sum(F.col("value") * F.col("w")), 6).alias("weighted"))


def _packed(spark, sf, geometry, step, first=0) -> DataFrame:
    return tmp.TemporalPatcher(geometry, smp.TemporalStride(step, first)).packed(user_series(spark, sf))


@query(f"WITH {_S}, a AS ({_steps(4)}), q AS (SELECT a.user_id, t_anchor, sum(value) AS total FROM a JOIN s ON s.user_id = a.user_id AND s.t > a.t_anchor - 4 AND s.t <= a.t_anchor GROUP BY a.user_id, t_anchor) SELECT user_id, round(list_reduce(list_prepend(0::DOUBLE, list(total ORDER BY t_anchor)), lambda x, y: x * 0.5 + y), 6) AS state FROM q GROUP BY user_id")
def t_fold_sum(spark, sf):
    packed = _packed(spark, sf, tmp.FixedLookback(4), 4)
    folded = tmp.fold(packed, ["user_id"], F.lit(0.0), lambda a, data: a * 0.5 + F.aggregate(data, F.lit(0.0), lambda s, x: s + x))
    return folded.select("user_id", r6("state"))


@query("WITH s AS (SELECT event_id AS t, value FROM events) SELECT CAST(a.t AS BIGINT) AS t_anchor, round(sum(b.value * power(0.5, a.t - b.t)), 6) AS state FROM s a JOIN s b ON b.t <= a.t AND b.t > a.t - 80 GROUP BY a.t")
def t_scan(spark, sf):
    """The running state of one series over all events, by a parallel scan (terms older than 80 steps are below 1e-20)."""
    packed = tmp.TemporalPatcher(tmp.FixedLookback(1), smp.TemporalStride(1)).packed(whole_series(spark, sf))
    states = tmp.FoldBy(_decay()).states(packed, [])
    return states.select(F.col("seq").alias("t_anchor"), r6("state"))


@query(f"WITH {_S}, a AS ({_steps(3, 4)}) SELECT a.user_id, CAST(s.t - a.t_anchor + 4 AS INTEGER) AS pos, round(avg(value), 6) AS value FROM a JOIN s ON s.user_id = a.user_id AND s.t > a.t_anchor - 5 AND s.t <= a.t_anchor GROUP BY 1, 2")
def t_mean(spark, sf):
    return tmp.mean(_packed(spark, sf, tmp.FixedLookback(5), 3, 4), ["user_id"]).select("user_id", "pos", r6("value"))


@query(f"WITH {_S}, a AS (SELECT user_id, length, t_anchor, CASE k WHEN 0 THEN 2 ELSE 6 END AS scale FROM ({_steps(6)}) b(user_id, length, t_anchor, z), range(2) q(k)), g AS (SELECT *, greatest(0, t_anchor - scale + 1) AS start, t_anchor + 1 AS stop FROM a), "
       "h AS (SELECT *, CASE WHEN stop - start IN (2, 6) THEN CAST(stop - start AS VARCHAR) ELSE '[' || start || ',' || stop || ')' END AS key FROM g), l AS (SELECT user_id, t_anchor, key, max(scale) AS scale FROM h GROUP BY 1, 2, 3) "
       "SELECT l.user_id, l.t_anchor, l.key, count(*) AS n, round(sum(value), 6) AS total FROM l JOIN s ON s.user_id = l.user_id AND s.t > l.t_anchor - l.scale AND s.t <= l.t_anchor GROUP BY 1, 2, 3")  # fmt: skip
def t_hier(spark, sf):
    out = tmp.hierarchical(_packed(spark, sf, tmp.MultiScale((2, 6)), 6), ["user_id"], (2, 6))
    return out.select("user_id", "t_anchor", "key", F.size("data").cast("long").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH {_S}, a AS ({_steps(5)}), p AS (SELECT a.user_id, t_anchor, list(value ORDER BY t) AS d FROM a JOIN s ON s.user_id = a.user_id AND s.t > a.t_anchor - 3 AND s.t <= least(a.t_anchor + 2, length - 1) GROUP BY 1, 2), "
       "b AS (SELECT user_id, t_anchor, d, CASE WHEN len(d) >= 2 THEN len(d) - 2 ELSE greatest(0, 2 * len(d) - 2) END AS first FROM p) SELECT user_id, t_anchor, CAST(pos AS INTEGER) AS pos, d[first + pos + 1] AS value FROM b, range(2) r(pos) WHERE first + pos < len(d)")  # fmt: skip
def t_forecast(spark, sf):
    out = tmp.forecast(_packed(spark, sf, tmp.LookbackHorizon(3, 2), 5), ["user_id"], 2)
    return out.select("user_id", "t_anchor", F.posexplode("data").alias("pos", "value"))


@query("WITH a AS (SELECT x AS t_anchor FROM range(0, (SELECT max(event_id) + 1 FROM events), 50) t(x)) SELECT CAST(t_anchor // 50 AS BIGINT) AS seq, CAST(t_anchor AS BIGINT) AS t_anchor, count(*) AS n, round(sum(value), 6) AS total FROM a JOIN events ON event_id > t_anchor - 20 AND event_id <= t_anchor GROUP BY t_anchor")
def t_split(spark, sf):
    own = tmp.TemporalPatcher(tmp.FixedLookback(20), smp.TemporalStride(50)).split(whole_series(spark, sf))
    return own.groupBy("seq", "t_anchor").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


# ---------------------------------------------------------------- space and time
_ST = "u AS (SELECT event_id % 8 AS t, (event_id // 8) // 25 AS r, (event_id // 8) % 25 AS c, value FROM events), ar AS (SELECT x AS ar FROM range(0, greatest((SELECT max(r) + 1 FROM u) - 8 + 1, 1), 8) t(x)), ac AS (SELECT x AS ac FROM range(0, 18, 8) t(x)), tt AS (SELECT x AS t_anchor, greatest(0, x - 2) AS start, least(8, x + 1) AS stop FROM range(0, 8, 3) t(x))"
_STC = "pc AS (SELECT ar, ac, t_anchor, start, u.r - ar AS i, u.c - ac AS j, u.t, value FROM u JOIN ar ON r >= ar AND r < ar + 8 JOIN ac ON c >= ac AND c < ac + 8 JOIN tt ON t >= start AND t < stop)"


def _spacetime(coupling="product", pairs=()) -> st.SpatioTemporalPatcher:
    return st.SpatioTemporalPatcher(patcher(size=8, step=8), tmp.TemporalPatcher(tmp.FixedLookback(3), smp.TemporalStride(3)), coupling, pairs)


@query(f"WITH {_ST}, {_STC} SELECT CAST(ar AS BIGINT) AS ar, CAST(ac AS BIGINT) AS ac, CAST(t_anchor AS BIGINT) AS t_anchor, count(*) AS n, round(sum(value), 6) AS total FROM pc GROUP BY 1, 2, 3")
def st_product(spark, sf):
    return _spacetime().split(cube(spark, sf), 8).groupBy("ar", "ac", "t_anchor").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query("WITH u AS (SELECT event_id % 8 AS t, (event_id // 8) // 25 AS r, (event_id // 8) % 25 AS c, value FROM events), a AS (SELECT * FROM (VALUES (0, 0, 0, 0), (1, 0, 8, 4), (2, 1, 3, 7)) v(seq, ar, ac, t_anchor)) SELECT CAST(seq AS BIGINT) AS seq, CAST(t_anchor AS BIGINT) AS t_anchor, count(*) AS n, round(sum(value), 6) AS total FROM a JOIN u ON r >= ar AND r < ar + 8 AND c >= ac AND c < ac + 8 AND t > t_anchor - 3 AND t <= t_anchor GROUP BY 1, 2")
def st_coupled(spark, sf):
    out = _spacetime("coupled", (((0, 0), 0), ((0, 8), 4), ((1, 3), 7))).split(cube(spark, sf), 8)
    return out.groupBy("seq", "t_anchor").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))


@query(f"WITH {_ST}, {_STC} SELECT CAST(ar AS BIGINT) AS ar, CAST(ac AS BIGINT) AS ac, CAST(i AS BIGINT) AS o_r, CAST(j AS BIGINT) AS o_c, CAST(t - start AS BIGINT) AS o_t, round(avg(value), 6) AS value FROM pc GROUP BY 1, 2, 3, 4, 5")
def st_merge_mean(spark, sf):
    own, plan = cube(spark, sf), _spacetime()
    return plan.merge_mean(plan.split(own, 8), own).select("ar", "ac", "o_r", "o_c", "o_t", r6("value"))


_AT = "CAST(ar AS BIGINT) AS ar, CAST(ac AS BIGINT) AS ac, CAST(i AS BIGINT) AS o_r, CAST(j AS BIGINT) AS o_c"
_SERIES = f"ser AS (SELECT {_AT}, t_anchor, list(value ORDER BY t) AS d, sum(value) AS total FROM pc GROUP BY 1, 2, 3, 4, t_anchor)"


@query(f"WITH {_ST}, {_STC}, {_SERIES} SELECT ar, ac, o_r, o_c, round(list_reduce(list_prepend(0::DOUBLE, list(total ORDER BY t_anchor)), lambda x, y: x * 0.5 + y), 6) AS state FROM ser GROUP BY 1, 2, 3, 4")
def st_merge_fold(spark, sf):
    own, plan = cube(spark, sf), _spacetime()
    fold = tmp.Fold(lambda a, data: a * 0.5 + F.aggregate(data, F.lit(0.0), lambda s, x: s + x))
    return plan.merge(plan.split(own, 8), own, fold).select("ar", "ac", "o_r", "o_c", r6("state"))


@query(f"WITH {_ST}, {_STC}, {_SERIES} SELECT ar, ac, o_r, o_c, CAST(t_anchor AS BIGINT) AS t_anchor, CAST(pos AS INTEGER) AS pos, d[greatest(len(d) - 2, 0) + pos + 1] AS value FROM ser, range(2) r(pos) WHERE pos < len(d)")
def st_merge_forecast(spark, sf):
    own, plan = cube(spark, sf), _spacetime()
    out = plan.merge(plan.split(own, 8), own, tmp.Forecast(2))
    return out.select("ar", "ac", "o_r", "o_c", "t_anchor", F.posexplode("data").alias("pos", "value"))


# ---------------------------------------------------------------- matched sources
_M = f"q AS (SELECT l_orderkey // 100 AS r, l_orderkey % 100 AS c, 2 * min(l_quantity) AS quantity FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey), r0 AS ({_rows(True)}), r AS (SELECT r0.r, r0.c, r0.value AS primary_, q.quantity FROM r0 LEFT JOIN q ON q.r = r0.r AND q.c = r0.c)"
_MP = f"{_M}, ar AS ({_lattice('ar')}), ac AS ({_lattice('ac', extent='100')}), pc AS (SELECT r.*, ar, ac, r.r - ar AS i, r.c - ac AS j FROM r JOIN ar ON r.r >= ar AND r.r < ar + 16 JOIN ac ON r.c >= ac AND r.c < ac + 16)"


@query(f'WITH {_M} SELECT r, c, primary_ AS "primary", quantity FROM r WHERE r >= 2 AND r < 9 AND c >= 10 AND c < 60')
def matched_select(spark, sf):
    return matched(spark, sf).select((slice(2, 9), slice(10, 60)))


_COARSE = "s AS (SELECT CAST(l_orderkey // 40 AS BIGINT) AS r, CAST(l_orderkey % 40 AS BIGINT) AS c, min(l_quantity) AS q FROM lineitem WHERE l_linenumber = 1 GROUP BY l_orderkey)"
_PLACES = f"p AS (SELECT r, c, value, (r + 0.5 + 1.25) / 3.0 - 0.5 AS y, (c + 0.5 - 2.0) / 2.5 - 0.5 AS x FROM ({_rows(True)}))"


@query(f"""WITH {_COARSE}, {_PLACES}, n AS (SELECT p.r, p.c, sum(q * wy * wx) AS top, sum(wy * wx) AS below FROM (
  SELECT r, c, floor(y) + i AS sr, floor(x) + j AS sc, CASE i WHEN 0 THEN 1 - (y - floor(y)) ELSE y - floor(y) END AS wy, CASE j WHEN 0 THEN 1 - (x - floor(x)) ELSE x - floor(x) END AS wx FROM p, range(2) a(i), range(2) b(j)) p JOIN s ON s.r = p.sr AND s.c = p.sc GROUP BY p.r, p.c)
SELECT p.r, p.c, round(p.value, 6) AS "primary", round(CASE WHEN n.below > 0 THEN n.top / n.below END, 6) AS smooth, CASE WHEN t.q IS NULL THEN NULL ELSE t.q - p.value END AS nearest_diff FROM p LEFT JOIN n ON n.r = p.r AND n.c = p.c LEFT JOIN s t ON t.r = floor(y + 0.5) AND t.c = floor(x + 0.5)""")
def matched_resample(spark, sf):
    """A raster of another resolution and origin beside the primary: bilinear, and nearest with an expression of both."""
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_linenumber = 1").groupBy("l_orderkey").agg(F.min("l_quantity").alias("value"))
    coarse = fld.from_flat(lines, "l_orderkey", 40, transform=(2.5, 0.0, 2.0, 0.0, 3.0, -1.25))
    own = raster(spark, sf, True)
    smooth, nearest = coregister.resample(coarse, own), coregister.resample(coarse, own, "nearest")
    both = mat.MatchedField(own, {"smooth": smooth, "nearest": nearest}, {"smooth": lambda s, p: s, "nearest": lambda q, p: q - p})
    return both.field().df.select("r", "c", r6("primary"), r6("smooth"), F.col("nearest").alias("nearest_diff"))


def _centred(secondary, primary):
    """A whole-patch co-registration: the secondary without its patch mean, moved to the primary's."""
    with np.errstate(all="ignore"):
        known = ~np.isnan(secondary)
        return secondary - secondary[known].mean() + primary[~np.isnan(primary)].mean() if known.any() and (~np.isnan(primary)).any() else secondary


@query(f"""WITH {_MP}, m AS (SELECT ar, ac, avg(quantity) AS mq, avg(primary_) AS mp FROM pc GROUP BY ar, ac)
SELECT pc.r, pc.c, round(coalesce(sum(quantity - mq + mp), 0), 4) AS quantity FROM pc JOIN m ON m.ar = pc.ar AND m.ac = pc.ac GROUP BY pc.r, pc.c""")
def matched_patches(spark, sf):
    """Co-registration of whole patches by a Python function of both arrays, then a merge."""
    own, plan = matched(spark, sf), mat.MatchedSpatialPatcher(patcher(), {"quantity": agg.Sum()})
    cells = plan.split(own, {"quantity": _centred})
    return plan.merge(cells, own).join(cells.select("r", "c").distinct(), ["r", "c"]).select("r", "c", F.round("quantity", 4).alias("quantity"))


@query(f"""WITH {_MP}, m AS (SELECT r, c, sum(CASE WHEN primary_ IS NOT NULL THEN {_HANN} ELSE 0 END) AS d, sum(primary_ * {_HANN}) AS n, max(quantity) AS quantity FROM pc GROUP BY r, c)
SELECT r.r, r.c, round(CASE WHEN d > 0 THEN n / d ELSE 0 END, 6) AS "primary", coalesce(m.quantity, '-infinity'::DOUBLE) AS quantity FROM r LEFT JOIN m ON m.r = r.r AND m.c = r.c""")
def matched_merge(spark, sf):
    own, plan = matched(spark, sf), mat.MatchedSpatialPatcher(patcher(win.Hann()), {"quantity": agg.Max()})
    return plan.merge(plan.split(own), own).select("r", "c", r6("primary"), "quantity")


@query(f"WITH {_MP} SELECT ar, ac, count(*) AS n, count(primary_) AS n_primary, count(quantity) AS n_quantity FROM pc GROUP BY ar, ac")
def matched_valid_mask(spark, sf):
    cells = mat.MatchedSpatialPatcher(patcher()).split(matched(spark, sf))
    return cells.groupBy("ar", "ac").agg(F.count("*").alias("n"), F.count_if("primary_valid").alias("n_primary"), F.count_if("quantity_valid").alias("n_quantity"))


@query("WITH o AS (SELECT o_orderkey AS t, o_totalprice * 2 AS price FROM orders), a AS (SELECT x AS t_anchor FROM range(0, (SELECT max(event_id) + 1 FROM events), 40) t(x)) SELECT CAST(t_anchor AS BIGINT) AS t_anchor, count(*) AS n, round(sum(value), 6) AS total, round(sum(price), 6) AS price FROM a JOIN events e ON event_id > t_anchor - 15 AND event_id <= t_anchor LEFT JOIN o ON o.t = e.event_id GROUP BY t_anchor")
def matched_temporal(spark, sf):
    own = whole_series(spark, sf)
    price = fld.series(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("value")), length=own.domain.length)
    plan = mat.MatchedTemporalPatcher(tmp.TemporalPatcher(tmp.FixedLookback(15), smp.TemporalStride(40)))
    cells = plan.split(mat.MatchedField(own, {"price": price}, {"price": lambda p, v: p * 2}))
    return cells.groupBy("t_anchor").agg(F.count("*").alias("n"), F.round(F.sum("primary"), 6).alias("total"), F.round(F.sum("price"), 6).alias("price"))


@query("WITH o AS (SELECT o_orderkey AS t, o_totalprice * 2 AS price FROM orders), a AS (SELECT x AS t_anchor FROM range(0, (SELECT max(event_id) + 1 FROM events), 40) t(x)), p AS (SELECT t_anchor, sum(value) AS total FROM a JOIN events ON event_id > t_anchor - 15 AND event_id <= t_anchor GROUP BY t_anchor), "
       "s AS (SELECT round(list_reduce(list_prepend(0::DOUBLE, list(total ORDER BY t_anchor)), lambda x, y: x * 0.5 + y), 6) AS state FROM p) "
       "SELECT CAST(t_anchor AS BIGINT) AS t_anchor, round(price, 6) AS price, state FROM a JOIN o ON o.t = a.t_anchor, s")  # fmt: skip
def matched_temporal_merge(spark, sf):
    """The primary is folded over all patches, the secondary keeps the last value of each."""
    own = whole_series(spark, sf)
    price = fld.series(spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("t"), F.col("o_totalprice").alias("value")), length=own.domain.length)
    both = mat.MatchedField(own, {"price": price}, {"price": lambda p, v: p * 2})
    fold = tmp.FoldBy(_decay())
    plan = mat.MatchedTemporalPatcher(tmp.TemporalPatcher(tmp.FixedLookback(15), smp.TemporalStride(40)), {"primary": fold, "price": tmp.Forecast(1)})
    merged = plan.merge(plan.split(both), both)
    last = merged["price"].select("t_anchor", F.round(F.element_at("data", 1), 6).alias("price")).where("price is not null")
    return last.crossJoin(merged["primary"].select(r6("state")))  # one row


@query(f"WITH {_ST}, {_STC}, {_SERIES}, f AS (SELECT ar, ac, o_r, o_c, sum(total) AS state FROM ser GROUP BY 1, 2, 3, 4) SELECT ar, ac, o_r, o_c, CAST(t_anchor AS BIGINT) AS t_anchor, round(9 * d[len(d)], 6) AS last, round(state, 6) AS state FROM ser JOIN f USING (ar, ac, o_r, o_c)")
def matched_st_merge(spark, sf):
    """Another aggregation for each source: a chunked fold of the primary, the last values of the other."""
    own = cube(spark, sf)
    both = mat.MatchedField(own, {"other": own.with_data(own.df.withColumn("value", F.col("value") * 10))}, {"other": lambda o, p: o - p})
    total = tmp.Fold(lambda a, data: a + F.aggregate(data, F.lit(0.0), lambda s, x: s + x), 0.0, lambda a, b: a + b)
    plan = mat.MatchedSpatioTemporalPatcher(_spacetime(), {"primary": total, "other": tmp.Forecast(1)})
    merged, at = plan.merge(plan.split(both, 8), both), ["ar", "ac", "o_r", "o_c"]
    last = merged["other"].select(*at, "t_anchor", F.round(F.element_at("data", 1), 6).alias("last"))
    return last.join(merged["primary"].select(*at, r6("state")), at)


@query(f"WITH {_ST}, {_STC} SELECT CAST(ar AS BIGINT) AS ar, CAST(ac AS BIGINT) AS ac, CAST(i AS BIGINT) AS o_r, CAST(j AS BIGINT) AS o_c, CAST(t - start AS BIGINT) AS o_t, round(avg(value), 6) AS value, round(avg(value * 10 - value), 6) AS other FROM pc GROUP BY 1, 2, 3, 4, 5")
def matched_st(spark, sf):
    own = cube(spark, sf)
    both = mat.MatchedField(own, {"other": own.with_data(own.df.withColumn("value", F.col("value") * 10))}, {"other": lambda o, p: o - p})
    plan = mat.MatchedSpatioTemporalPatcher(_spacetime())
    merged = plan.merge_mean(plan.split(both, 8), both)
    at = ["ar", "ac", "o_r", "o_c", "o_t"]
    return merged["primary"].select(*at, r6("value")).join(merged["other"].select(*at, r6("value", "other")), at)


# ---------------------------------------------------------------- whole-field statistics and runtime
@query(f"{_patches()} SELECT count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std FROM pc")
def reduce_mean_std(spark, sf):
    return patcher().reduce(raster(spark, sf), agg.MeanStd()).select("n", r6("mean"), r6("std"))


@query(f"{_patches(True, 3, 2)}, s AS (SELECT seq, count(*) FILTER (WHERE value IS NULL) AS gaps, min(value) AS low, max(value) AS high FROM pc GROUP BY seq) SELECT coalesce(min(low), 'infinity'::DOUBLE) AS min, coalesce(max(high), '-infinity'::DOUBLE) AS max FROM s WHERE gaps = 0")
def reduce_min_max(spark, sf):
    return patcher(size=3, step=2).reduce(raster(spark, sf, True), agg.MinMax())


@query(f"{_patches()}, s AS (SELECT avg(value) AS mean, stddev_samp(value) AS std FROM pc), m AS (SELECT r, c, avg((value - mean) / std) AS value FROM pc, s GROUP BY r, c) SELECT r.r, r.c, round(coalesce(m.value, 0), 6) AS value FROM r LEFT JOIN m ON m.r = r.r AND m.c = r.c")
def two_pass_zscore(spark, sf):
    out = patcher(aggregation=agg.Mean()).two_pass(raster(spark, sf), agg.MeanStd(), lambda v, stat: (v - stat("mean")) / stat("std"))
    return out.select("r", "c", r6("value"))


@query(f"{_patches()} SELECT seq, count(*) AS n, round(sum(value * 2), 6) AS total FROM pc GROUP BY seq")
def parallel_map_double(spark, sf):
    out = parallel_map(patcher(), raster(spark, sf), lambda values: values * 2)
    return out.select("seq", F.size("data").cast("long").alias("n"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"WITH ar AS ({_lattice('ar')}), ac AS ({_lattice('ac', extent='100')}), a AS (SELECT (ar // 8) * (SELECT count(*) FROM ac) + ac // 8 AS seq, ar, ac FROM ar, ac) SELECT seq, ar, ac FROM a WHERE NOT (seq % 3 = 0 AND seq % 2 = 0)")
def journal_pending(spark, sf):
    """Every third anchor was done; a later commit has two rows for each even one of those, a success and then a failure."""
    book, plan, source = policy.Journal(shared_path(spark)), patcher(), raster(spark, sf)
    row = lambda df, status: df.select(policy.anchor_key("ar", "ac").alias("anchor"), F.lit(status).alias("status"), F.lit(0.1).alias("runtime_s"), F.lit(None).cast("string").alias("output_uri"), F.lit(None).cast("string").alias("error"), "seq")
    done = plan.anchors(source).where("seq % 3 = 0")
    book.commit(row(done, "ok").drop("seq"))
    odd, even = done.where("seq % 2 = 1"), done.where("seq % 2 = 0")
    last = row(odd, "ok").withColumn("k", F.lit(0)).unionByName(row(odd, "error").withColumn("k", F.lit(1))).unionByName(row(even, "error").withColumn("k", F.lit(0))).unionByName(row(even, "ok").withColumn("k", F.lit(1)))
    book.commit(last.repartition("anchor").sortWithinPartitions("anchor", "k").drop("seq", "k"))
    return book.pending(plan.anchors(source), policy.anchor_key("ar", "ac"))


@query(f"{_patches(size=4, step=4)} SELECT CAST(seq // 64 AS BIGINT) AS stack, CAST(seq % 64 AS BIGINT) AS slot, round(sum(value), 6) AS total FROM pc GROUP BY seq")
def stack_patches(spark, sf):
    """Stacks of 64 patches: a stack is one row, so its size doesn't grow with the table."""
    packed = patcher(size=4, step=4).packed(raster(spark, sf)).withColumn("stack", F.floor(F.col("seq") / 64))
    out = policy.stack_patches(packed, by=("stack",)).select("stack", F.posexplode("stacked").alias("slot", "data"))
    return out.select("stack", F.col("slot").cast("long").alias("slot"), F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"{_patches(size=4, step=4)} SELECT CAST(ar AS BIGINT) AS ar, CAST(ac // 4 AS BIGINT) AS slot, CAST(seq AS BIGINT) AS seq, round(sum(value), 6) AS total FROM pc GROUP BY ar, ac, seq")
def stack_patches_whole(spark, sf):
    """The whole raster: a stack for each row of patches, so that the size of a stack doesn't grow with the table."""
    out = policy.stack_patches(patcher(size=4, step=4).packed(raster(spark, sf)), by=("ar",))
    out = out.select("ar", F.posexplode(F.arrays_zip("seqs", "stacked")).alias("slot", "x"))
    return out.select("ar", F.col("slot").cast("long").alias("slot"), F.col("x.seqs").alias("seq"), F.round(F.aggregate("x.stacked", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query(f"{_patches(size=10, step=10)}, p AS (SELECT seq, sum(value) AS total FROM pc GROUP BY seq), n AS (SELECT count(*) AS n FROM p), s AS (SELECT x AS seq FROM range(0, (SELECT CAST((n + 6) // 7 * 7 AS BIGINT) FROM n)) t(x)) SELECT CAST(s.seq // 7 AS BIGINT) AS batch, CAST(s.seq % 7 AS BIGINT) AS slot, total IS NOT NULL AS valid, round(coalesce(total, 0), 6) AS total FROM s LEFT JOIN p ON p.seq = s.seq")
def batch_split(spark, sf):
    out = policy.batch_split(patcher(size=10, step=10).packed(raster(spark, sf)), 7)
    return out.select("batch", "slot", "valid", F.round(F.aggregate("data", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))
