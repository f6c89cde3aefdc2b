"""Shapes of neighbourhoods: each is the condition of a join between anchors and cells.

Joins are equi-joins on a bucket with the exact condition as residual; no plan here holds
a nested-loop or Cartesian join of two data-sized inputs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldweave.domains import Configured, GridDomain, PointDomain, RasterDomain, VectorDomain
from fieldweave.operators import pairs
from fieldweave.operators.samplers import anchor_name, per_dim

EARTH_KM = 6371.0
BOUNDARIES = ("drop", "pad", "shrink", "raise")


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), F.lit(2)) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((F.radians(lon2) - F.radians(lon1)) / 2), F.lit(2))
    return 2 * EARTH_KM * F.asin(F.least(F.sqrt(a), F.lit(1.0)))


def unit_sphere(lon: Column, lat: Column) -> list[Column]:
    """Coordinates in space: distance along the sphere grows with the straight distance of these."""
    x, y = F.radians(lon), F.radians(lat)
    return [F.cos(y) * F.cos(x), F.cos(y) * F.sin(x), F.sin(y)]


@dataclass(frozen=True)
class Rectangular(Configured):
    """A box that begins at its anchor."""

    size: int | tuple[int, ...] | dict[str, int]
    boundary: str = "drop"

    def __post_init__(self):
        if self.boundary not in BOUNDARIES:
            raise ValueError(f"boundary must be one of {BOUNDARIES}, not {self.boundary!r}")

    def sizes(self, domain) -> dict[str, int]:
        return per_dim(self.size, domain.dims)

    # ------------------------------------------------------------ placement
    def placed(self, anchors: DataFrame, domain) -> DataFrame:
        """Adds each patch's size after boundary handling (``n_<dim>``)."""
        out = anchors
        for d, n in self.sizes(domain).items():
            left = F.greatest(F.lit(domain.dims[d]) - F.col(anchor_name(d)), F.lit(0))
            out = out.withColumn(f"n_{d}", F.least(F.lit(n), left) if self.boundary == "shrink" or isinstance(domain, GridDomain) else F.lit(n).cast("long"))
        if self.boundary == "raise":
            over = F.lit(False)
            for d, n in self.sizes(domain).items():
                over = over | (F.col(anchor_name(d)) + n > domain.dims[d])
            text = F.concat(F.lit("patch reaches over the domain at "), F.to_json(F.struct(*[anchor_name(d) for d in domain.dims])))
            out = out.where(F.when(over, F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))
        return out

    # ------------------------------------------------------------ cells of a lattice
    def cover(self, cells: DataFrame, domain, sampler) -> DataFrame:
        """Each cell with every lattice anchor whose patch covers it: arithmetic, no join.

        Adds ``seq``, the anchors and the offsets ``o_<dim>``.
        """
        out, sizes, seq, below = cells, self.sizes(domain), F.lit(0).cast("long"), sampler.count(domain, self)
        axes = sampler.axes(domain, self)
        for d, (step, n) in axes.items():
            below //= n
            low = F.greatest(F.lit(0), F.floor((F.col(d) - sizes[d] + step) / step))
            high = F.least(F.floor(F.col(d) / step), F.lit(n - 1))
            # an empty range is left out (a sequence that falls would run backwards)
            ks = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long")))
            out = out.withColumn(f"k_{d}", F.explode(ks))
            seq = seq + F.col(f"k_{d}") * below
        out = out.withColumn("seq", seq)
        out = out.withColumns({anchor_name(d): F.col(f"k_{d}") * step for d, (step, _) in axes.items()})
        out = out.withColumns({f"o_{d}": F.col(d) - F.col(anchor_name(d)) for d in axes})
        return out.drop(*(f"k_{d}" for d in axes))

    def covers(self, domain, sampler) -> Column:
        """The same as an array of (seq, anchors, offsets) inside the cell's own row."""
        sizes, axes = self.sizes(domain), sampler.axes(domain, self)
        below, out = sampler.count(domain, self), F.array(F.struct(F.lit(0).cast("long").alias("seq")))
        for d, (step, n) in axes.items():
            below //= n
            low = F.greatest(F.lit(0), F.floor((F.col(d) - sizes[d] + step) / step)).cast("long")
            high = F.least(F.floor(F.col(d) / step), F.lit(n - 1)).cast("long")
            ks = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<long>"))
            seen = [x for x in axes if x in list(axes)[: list(axes).index(d)]]

            out = F.flatten(F.transform(out, self._more(ks, d, step, below, seen)))
        return out

    def terms(self, domain, sampler, most: int = 64) -> list[tuple[Column, dict[str, Column]]] | None:
        """The covers one by one: (does it cover the cell?, {seq, anchors, offsets}), or None if there may be over ``most``.

        The q-th cover of an axis lies q steps before the last anchor at or before the cell,
        so everything is plain arithmetic, which Spark compiles.
        """
        sizes, axes = self.sizes(domain), sampler.axes(domain, self)
        if math.prod(-(-sizes[d] // step) for d, (step, _) in axes.items()) > most:
            return None
        below, out = sampler.count(domain, self), [(F.lit(True), {"seq": F.lit(0).cast("long")})]
        for d, (step, n) in axes.items():
            below //= n
            own = []
            for q in range(-(-sizes[d] // step)):
                k, offset = F.floor(F.col(d) / step) - q, F.col(d) % step + q * step
                own.append(((k >= 0) & (k < n) & (offset < sizes[d]), k * below, {anchor_name(d): k * step, f"o_{d}": offset}))
            out = [(ok & more, {**cover, "seq": cover["seq"] + seq, **cols}) for ok, cover in out for more, seq, cols in own]
        return out

    @staticmethod
    def _more(ks: Column, d: str, step: int, below: int, seen: list[str]):
        """Extends the covers by one dimension: one for each of its anchors."""

        def add(head: Column) -> Column:
            kept = [head[name].alias(name) for x in seen for name in (anchor_name(x), f"o_{x}")]
            return F.transform(ks, lambda k: F.struct((head["seq"] + k * below).alias("seq"), *kept, (k * step).alias(anchor_name(d)), (F.col(d) - k * step).alias(f"o_{d}")))

        return add

    # ------------------------------------------------------------ cells of any anchors
    def expand(self, anchors: DataFrame, cells: DataFrame, domain) -> DataFrame:
        """Patch cells of any anchors.

        A cell has one block of the patch size, a patch touches two blocks of each axis;
        they meet by block.  With ``pad`` every offset is listed and cells outside of the
        domain are NULL.
        """
        sizes, dims = self.sizes(domain), list(domain.dims)
        placed = self.placed(anchors, domain)
        if self.boundary == "pad" and isinstance(domain, RasterDomain):
            for d, n in sizes.items():
                placed = placed.withColumn(f"o_{d}", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>")))
            asked = placed.withColumns({d: F.col(anchor_name(d)) + F.col(f"o_{d}") for d in dims})
            return asked.join(cells, dims, "left").drop(*(f"n_{d}" for d in dims))
        for d, n in sizes.items():
            a = F.col(anchor_name(d))
            placed = placed.withColumn(f"b_{d}", F.explode(F.array_distinct(F.array(F.floor(a / n), F.floor((a + n - 1) / n)))))
        blocked = cells.withColumns({f"b_{d}": F.floor(F.col(d) / n) for d, n in sizes.items()})
        met = placed.join(blocked, [f"b_{d}" for d in dims])
        for d in dims:
            met = met.where((F.col(d) >= F.col(anchor_name(d))) & (F.col(d) < F.col(anchor_name(d)) + F.col(f"n_{d}")))
        return met.withColumns({f"o_{d}": F.col(d) - F.col(anchor_name(d)) for d in dims}).drop(*(x for d in dims for x in (f"b_{d}", f"n_{d}")))


class Neighbourhood(Configured):
    """A shape without fixed patch size: its patches are the cells, points or features near each anchor."""

    boundary = "drop"

    def sizes(self, domain) -> dict[str, int]:
        """None: such patches have no box."""
        return {}

    def patches(self, anchors: DataFrame, source) -> DataFrame:
        """``seq`` and the anchor with the keys and values of ``source`` (a field), and the weight ``w`` where the shape has one."""
        raise NotImplementedError(f"{type(self).__name__} has no patches on {type(source.domain).__name__}")

    @staticmethod
    def of_domain(source, *kinds) -> bool:
        return isinstance(source.domain, kinds)


# ---------------------------------------------------------------- points
def _bucketed(df: DataFrame, axes: list[Column], side: Column | float, reach: int | Column = 0, tag: str = "b") -> DataFrame:
    """Adds bucket columns; with ``reach`` the row stands in every bucket that many away."""
    for k, x in enumerate(axes):
        own = F.floor(x / side).cast("long")
        if isinstance(reach, int) and reach == 0:
            df = df.withColumn(f"{tag}{k}", own)
        else:
            df = df.withColumn(f"{tag}{k}", F.explode(F.sequence(own - reach, own + reach)))
    return df


#: Squares have sides of 2 to these powers at most and at least.
LOWEST, HIGHEST = -20, 60


def _level(width: Column, height: Column) -> Column:
    """The power of 2 that is the side of a box's own squares: its extent rounded up, so it touches two along an axis at most."""
    extent = F.greatest(width, height)
    return F.when(extent > 0, F.greatest(F.lit(LOWEST), F.least(F.lit(HIGHEST), F.ceil(F.log2(extent)).cast("int")))).otherwise(F.lit(LOWEST)).cast("int")


def levels_of(boxes: DataFrame) -> list[int]:
    """The levels in use: as many as there are sizes, by powers of 2; 81 at most."""
    return sorted(r[0] for r in boxes.select("_lv").distinct().collect())


def _square(x: Column | str, level: Column | int) -> Column:
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x / F.pow(F.lit(2.0), F.lit(level) if isinstance(level, int) else level)).cast("long")


def leveled(boxes: DataFrame) -> DataFrame:
    """``x0, y0, x1, y1`` in the squares of their own level: ``_lv, bx, by``, four rows at most."""
    own = boxes.withColumn("_lv", _level(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")))
    span = lambda low, high: F.explode(F.sequence(_square(low, F.col("_lv")), _square(high, F.col("_lv"))))
    return own.withColumn("bx", span("x0", "x1")).withColumn("by", span("y0", "y1"))


def listed(boxes: DataFrame, levels: list[int], above: bool = False, strictly: bool = False) -> DataFrame:
    """Boxes, or points as boxes without extent, in the squares of all ``levels``; with ``above`` of those from their own up."""
    own = boxes.withColumn("_own", _level(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))) if above else boxes
    out = own.withColumn("_lv", F.explode(F.array(*[F.lit(k) for k in levels]).cast("array<int>")))
    if above:
        out = out.where(F.col("_lv") > F.col("_own") if strictly else F.col("_lv") >= F.col("_own")).drop("_own")
    span = lambda low, high: F.explode(F.sequence(_square(low, F.col("_lv")), _square(high, F.col("_lv"))))
    return out.withColumn("bx", span("x0", "x1")).withColumn("by", span("y0", "y1"))


def _box(rings: DataFrame, margin: float = 0.0) -> DataFrame:
    """Adds the bounds ``x0, x1, y0, y1`` of each ring."""
    low, high = lambda a: F.array_min(F.transform("ring", lambda p: p[a])) - margin, lambda a: F.array_max(F.transform("ring", lambda p: p[a])) + margin
    return rings.withColumns({"x0": low("x"), "x1": high("x"), "y0": low("y"), "y1": high("y")})


#: Buckets of more pairs than this number's square are met block by block, of about so many rows each.
BLOCK = 2048
#: Rows that a point meets at a time where pairs are told both ways.
RUN = 128
#: Anchors of a square that share one copy of the points around it.
ANCHORS = 1024


def _blocked(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with blocks ``_i, _j``: in a bucket of very many pairs each block of one side meets each of the other.

    Rows are told apart by hashes of their ids.  A row is copied as often as the other side has blocks, so copies are about
    2 for each ``BLOCK`` pairs; the table of such buckets has fewer rows than both sides by ``BLOCK``.
    """
    many = left.groupBy(*keys).agg(F.count("*").alias("_m")).join(right.groupBy(*keys).agg(F.count("*").alias("_n")), keys).where(F.col("_m").cast("double") * F.col("_n") > BLOCK**2)
    many = F.broadcast(many.select(*keys, F.ceil(F.col("_m") / BLOCK).alias("_m"), F.ceil(F.col("_n") / BLOCK).alias("_n")))
    own = lambda ids, n: F.pmod(F.xxhash64(*ids), F.coalesce(n, F.lit(1).cast("long")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n, F.lit(1).cast("long")) - 1))
    here = left.join(many, keys, "left").withColumn("_i", own(left_id, F.col("_m"))).withColumn("_j", every(F.col("_n"))).drop("_m", "_n")
    there = right.join(many, keys, "left").withColumn("_j", own(right_id, F.col("_n"))).withColumn("_i", every(F.col("_m"))).drop("_m", "_n")
    return here, there


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], left_id: list[str], right_id: list[str], lists: list[str] | None = None) -> DataFrame:
    """The equi-join of both on ``keys``, crowded buckets dealt over tasks.

    With ``lists`` whole blocks meet: a row for each block of the right side and each group of the left block by these columns, the
    other columns as lists ``_there`` and ``_here``.
    """
    here, there = _blocked(left, right, keys, left_id, right_id)
    at, tasks = [*keys, "_i", "_j"], int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # few bytes may be very many pairs, so neither side is broadcast and tasks aren't joined by their bytes
    here, there = here.repartition(tasks, *at), there.repartition(tasks, *at)
    if lists:
        held = lambda df, by: df.groupBy(*by).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in by])).alias("_all"))
        here, there = held(here, [*at, *lists]).withColumnRenamed("_all", "_here"), held(there, at).withColumnRenamed("_all", "_there")
    return here.join(there.hint("shuffle_merge"), at).drop("_i", "_j")


def _ids(df: DataFrame) -> list[str]:
    """Columns that tell rows apart, of kinds that can be hashed."""
    return [c for c, kind in df.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]


def _flat(boxed: DataFrame) -> DataFrame:
    """Marks rings that are their own bounds (``_flat``): four corners, each side along an axis.  Their ``ring`` becomes NULL."""
    at = lambda k, a: F.get("ring", F.lit(k))[a]
    same = lambda i, j, a: at(i, a) == at(j, a)
    turn = (same(0, 1, "y") & same(1, 2, "x") & same(2, 3, "y") & same(3, 0, "x")) | (same(0, 1, "x") & same(1, 2, "y") & same(2, 3, "x") & same(3, 0, "y"))
    flat = F.coalesce((F.size("ring") == 4) & turn, F.lit(False))
    return boxed.withColumn("_flat", flat).withColumn("ring", F.when(~F.col("_flat"), F.col("ring")))


def _rectangle(x0: str, y0: str, x1: str, y1: str) -> Column:
    return F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def _coordinates(metric: str, x: str, y: str) -> list[Column]:
    if metric == "euclidean":
        return [F.col(x), F.col(y)]
    if metric == "haversine":
        return unit_sphere(F.col(x), F.col(y))
    raise ValueError(f"unknown metric {metric!r}")


def _distance(metric: str) -> Column:
    if metric == "haversine":
        return haversine_km(F.col("ax"), F.col("ay"), F.col("x"), F.col("y"))
    return F.sqrt(F.pow(F.col("x") - F.col("ax"), F.lit(2)) + F.pow(F.col("y") - F.col("ay"), F.lit(2)))


@dataclass(frozen=True)
class RadiusGraph(Neighbourhood):
    """All points within ``radius`` (kilometres for haversine), the rim included."""

    radius: float
    metric: str = "euclidean"

    def patches(self, anchors, source):
        if self.of_domain(source, PointDomain):
            return self.neighbours(anchors, source.df)
        if self.of_domain(source, VectorDomain):
            return self.features_near(anchors, source.df, source.keys[0]).join(source.df, source.keys[0])
        return super().patches(anchors, source)

    def neighbours(self, anchors: DataFrame, points: DataFrame) -> DataFrame:
        """``anchors`` (seq, ax, ay) with each ``points`` row (x, y) near them and its ``distance``."""
        if self.metric == "euclidean" and not self.radius:
            same = points.withColumns({"_x": F.col("x") + 0.0, "_y": F.col("y") + 0.0})
            met = anchors.withColumns({"_x": F.col("ax") + 0.0, "_y": F.col("ay") + 0.0}).join(same, ["_x", "_y"]).drop("_x", "_y")
            return met.withColumn("distance", F.lit(0.0))
        side, keys = self._side(), [f"b{k}" for k in range(len(_coordinates(self.metric, "x", "y")))]
        near = _bucketed(anchors, _coordinates(self.metric, "ax", "ay"), side, 1)
        there = _bucketed(points, _coordinates(self.metric, "x", "y"), side)
        met = _dealt(near, there, keys, ["seq"], _ids(points)).drop(*keys)
        return met.withColumn("distance", _distance(self.metric)).where(F.col("distance") <= self.radius)

    def _side(self) -> float:
        """The side of buckets of which only neighbours can hold points within the radius."""
        return self.radius if self.metric == "euclidean" else max(2 * math.sin(min(self.radius / (2 * EARTH_KM), math.pi / 2)), 1e-9) * (1 + 1e-9)

    def pairs(self, points: DataFrame, key: str = "pid") -> DataFrame:
        """(seq, key, distance) of ``points`` (x, y): what :meth:`neighbours` finds with every point as an anchor.

        Only half of the buckets around a point are joined, block by block.  Pairs come in runs of ``RUN`` rows at most and then as many rows
        back, with the same distances in the same order.  Runs are of whole eights (``pairs``), so a file's codec keeps the rows back as a copy.
        """
        here = points.select(F.col(key).alias("seq"), F.col("x").alias("ax"), F.col("y").alias("ay"))
        points = points.select(key, "x", "y")
        if self.metric == "euclidean" and not self.radius:
            return self.neighbours(here, points).select("seq", key, "distance")
        side, axes = self._side(), range(len(_coordinates(self.metric, "x", "y")))
        keys, own = [f"b{k}" for k in axes], [f"o{k}" for k in axes]
        near = _bucketed(here, _coordinates(self.metric, "ax", "ay"), side, tag="o")
        for o, b in zip(own, keys):
            near = near.withColumn(b, F.explode(F.sequence(F.col(o) - int(o != "o0"), F.col(o) + 1)))
        near = near.where(F.array(*keys) >= F.array(*own))
        met = _dealt(near, _bucketed(points, _coordinates(self.metric, "x", "y"), side), keys, ["seq"], [key], own)
        kind = dict(points.dtypes)[key]
        # candidates are told a little beyond the radius, and judged here
        met = met.select((F.array(*keys) == F.array(*own)).alias("_own"), "_here", "_there").mapInArrow(
            pairs.runs_of(key, side * (1 + 1e-9) + (1e-12 if self.metric == "haversine" else 0), self.metric == "haversine", RUN),
            f"_back boolean, _run array<struct<seq: {kind}, ax: double, ay: double, `{key}`: {kind}, x: double, y: double>>",
        )
        met = met.select(F.explode(F.when(F.col("_back"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))).alias("_turn"), "_run").select("_turn", F.inline("_run"))
        met = met.withColumn("distance", _distance(self.metric)).where(F.col("distance") <= self.radius)
        turned = lambda a, b: F.when(F.col("_turn"), F.col(b)).otherwise(F.col(a))
        return met.select(turned("seq", key).alias("seq"), turned(key, "seq").alias(key), "distance")

    def gathered(self, anchors: DataFrame, points: DataFrame) -> DataFrame:
        """Blocks of anchors, each behind all ``points`` rows that may be near one of them: whole neighbourhoods without a row for each pair.

        Partitions hold whole blocks ``b0, b1, _i``, first their points (``_anchor`` false; x, y and the other columns, by which
        they are ordered), then their anchors at x, y.  A point is copied to the nine squares around it, once for each ``ANCHORS`` anchors there.
        """
        if self.metric != "euclidean" or not self.radius > 0:
            raise NotImplementedError("neighbourhoods are gathered in the plane, within a radius above 0")
        keys, rest = ["b0", "b1"], [c for c in points.columns if c not in ("x", "y")]
        near = _bucketed(anchors.select("seq", F.col("ax").alias("x"), F.col("ay").alias("y")), _coordinates(self.metric, "x", "y"), self.radius)
        held = near.groupBy(*keys).agg(F.ceil(F.count("*") / ANCHORS).alias("_m"))
        here = near.join(held, keys).select(*keys, F.pmod(F.xxhash64("seq"), F.col("_m")).alias("_i"), F.lit(True).alias("_anchor"), "seq", "x", "y")
        there = _bucketed(points, _coordinates(self.metric, "x", "y"), self.radius, 1).join(held, keys)
        there = there.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("_m") - 1)).alias("_i"), F.lit(False).alias("_anchor"), "x", "y", *rest)
        both = there.unionByName(here, allowMissingColumns=True)
        tasks = int(anchors.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # few bytes may be much work, so tasks aren't joined by their bytes
        return both.repartition(tasks, *keys, "_i").sortWithinPartitions(*keys, "_i", "_anchor", *[F.col(c).asc_nulls_last() for c in rest])

    def features_near(self, anchors: DataFrame, features: DataFrame, key: str = "fid") -> DataFrame:
        """(seq, key, distance) of the features whose rings lie within ``radius`` of an anchor, in the plane."""
        if self.metric != "euclidean":
            raise NotImplementedError("features are measured in the plane")
        sides = ["x0", "x1", "y0", "y1"]
        boxed = _flat(_box(features.select(key, "ring"))).withColumns({f"f{n}": F.col(n) for n in sides})
        boxed = boxed.withColumns({n: F.col(n) + (self.radius if n.endswith("1") else -self.radius) for n in sides})
        at = anchors.select("seq", "ax", "ay").withColumns({"x0": F.col("ax"), "x1": F.col("ax"), "y0": F.col("ay"), "y1": F.col("ay")})
        own, out = leveled(boxed), None
        kinds = own.select("_lv", "_flat").distinct().collect()  # two for each level at most
        for flat in sorted({r[1] for r in kinds}) or [False]:
            levels = sorted(r[0] for r in kinds if r[1] == flat)
            here = listed(at, levels).select("seq", "ax", "ay", "_lv", "bx", "by")
            there = own.where(F.col("_flat") == flat).drop("_flat", *sides, *(["ring"] if flat else [f"f{n}" for n in sides]))
            if flat:  # the distance of a box needs no ring
                gap = lambda v, low, high: F.greatest(F.col(low) - F.col(v), F.lit(0.0), F.col(v) - F.col(high))
                distance = F.hypot(gap("ax", "fx0", "fx1"), gap("ay", "fy0", "fy1"))
            else:
                distance = ring_distance(F.col("ring"), F.col("ax"), F.col("ay"))
            met = _dealt(here, there, ["_lv", "bx", "by"], ["seq"], [key]).select("seq", key, distance.alias("distance")).where(F.col("distance") <= self.radius)
            out = met if out is None else out.unionByName(met)
        return out


@dataclass(frozen=True)
class SphericalCap(Neighbourhood):
    """All points within ``radius_km`` along the sphere.

    Anchors on points are (longitude, latitude) as ``ax, ay``; on a grid (latitude, longitude)
    as ``a_lat, a_lon``, with label tables for the grid's indices.
    """

    radius_km: float

    def patches(self, anchors, source):
        if self.of_domain(source, PointDomain):
            return self.neighbours(anchors, source.df)
        if self.of_domain(source, GridDomain):
            lat, lon = list(source.keys)
            return self.on_grid(anchors, source.df.sparkSession, source.domain, lat, lon).drop("x", "y").join(source.df, [lat, lon])
        return super().patches(anchors, source)

    def neighbours(self, anchors: DataFrame, points: DataFrame) -> DataFrame:
        return RadiusGraph(self.radius_km, "haversine").neighbours(anchors, points)

    def on_grid(self, anchors: DataFrame, spark, domain: GridDomain, lat: str = "lat", lon: str = "lon") -> DataFrame:
        """Grid indices within the cap; label tables hold one row for each index of an axis."""
        rows = [spark.createDataFrame([(i, float(v)) for i, v in enumerate(domain.coords[d])], f"{d} long, {name} double") for d, name in ((lat, "y"), (lon, "x"))]
        cells = rows[0].crossJoin(rows[1])  # the grid itself: a product of its axes
        placed = anchors.withColumnsRenamed({f"a_{lat}": "ay", f"a_{lon}": "ax"})
        return self.neighbours(placed, cells)


@dataclass(frozen=True)
class KNNGraph(Neighbourhood):
    """The ``k`` nearest points, or features by their centroids in the plane; ties go to the lesser id.

    Points are counted in squares of halving sides (a quadtree of counts, an octree on the
    sphere); only occupied squares are rows.  For each anchor the smallest square whose
    neighbourhood of one square each way holds k points bounds the distance of the k-th, and
    only squares of that size within the bound are joined.  There are no rounds, and dense places and
    far-off anchors ask for as few squares as others.
    """

    k: int
    metric: str = "euclidean"

    def patches(self, anchors, source):
        key = source.keys[0]
        if self.of_domain(source, PointDomain):
            return self.neighbours(anchors, source.df, key)
        if self.of_domain(source, VectorDomain):
            centres = source.df.select("*", centroid(F.col("ring")).alias("_p")).select("*", "_p.x", "_p.y").drop("_p")
            return KNNGraph(self.k).neighbours(anchors, centres, key).drop("x", "y")
        return super().patches(anchors, source)

    def neighbours(self, anchors: DataFrame, points: DataFrame, key: str = "pid") -> DataFrame:
        own, ask = _coordinates(self.metric, "x", "y"), _coordinates(self.metric, "ax", "ay")
        d = len(own)
        ends = points.agg(F.count("*").alias("n"), *[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(own) for f in (F.min, F.max)]).first()
        if not ends["n"]:
            return anchors.join(points.where("false"), how="inner").withColumns({"distance": F.lit(None).cast("double"), "rank": F.lit(None).cast("int")})
        spans = anchors.agg(*[f(c).alias(f"{f.__name__}{i}") for i, c in enumerate(ask) for f in (F.min, F.max)]).first()
        low = [min(v for v in (ends[f"min{i}"], spans[f"min{i}"]) if v is not None) for i in range(d)]
        width = max(max(v for v in (ends[f"max{i}"], spans[f"max{i}"]) if v is not None) - low[i] for i in range(d)) or 1e-9
        wanted = min(self.k, ends["n"])
        # at level 0 one square holds all; even points would have k in a square some levels above the last
        last = min(40, max(1, math.ceil(math.log2(max(ends["n"] / wanted, 1)) / d)) + 8)
        names = [f"b{i}" for i in range(d)]
        square = lambda axes, level: [F.floor((x - low[i]) / width * F.pow(F.lit(2.0), level)).cast("long").alias(f"b{i}") for i, x in enumerate(axes)]
        fine = points.groupBy(*square(own, F.lit(last))).agg(F.count("*").alias("held"))
        levels = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("level")
        counts = fine.select(*names, "held", levels).groupBy("level", *[F.floor(F.col(n) / F.pow(F.lit(2.0), F.lit(last) - F.col("level"))).cast("long").alias(n) for n in names]).agg(F.sum("held").alias("held"))
        near = anchors.select("*", levels)
        near = near.select("seq", "level", *square(ask, F.col("level")))
        for n in names:
            near = near.withColumn(n, F.explode(F.sequence(F.col(n) - 1, F.col(n) + 1)))
        enough = near.join(counts, ["level", *names]).groupBy("seq", "level").agg(F.sum("held").alias("held")).where(F.col("held") >= wanted)
        chosen = enough.groupBy("seq").agg(F.max("level").alias("level"))
        # points of a neighbourhood lie within two sides along each axis
        reach = math.ceil(2 * math.sqrt(d))
        placed = anchors.join(chosen, "seq").select(*anchors.columns, "level", *square(ask, F.col("level")))
        for n in names:
            placed = placed.withColumn(n, F.explode(F.sequence(F.col(n) - reach, F.col(n) + reach)))
        asked = placed.join(counts.drop("held"), ["level", *names])  # occupied squares only
        used = chosen.select("level").distinct()
        bucketed = points.crossJoin(F.broadcast(used))  # at most as many rows as levels
        bucketed = bucketed.select(*points.columns, "level", *square(own, F.col("level")))
        met = asked.join(bucketed, ["level", *names]).drop("level", *names)
        met = met.withColumn("distance", _distance(self.metric))
        best = Window.partitionBy("seq").orderBy("distance", key)
        return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= self.k)


# ---------------------------------------------------------------- polygons
def centroid(ring: Column) -> Column:
    """Area centroid of a simple ring as struct (x, y)."""
    pairs = F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct((p["x"] * q["y"] - q["x"] * p["y"]).alias("w"), (p["x"] + q["x"]).alias("sx"), (p["y"] + q["y"]).alias("sy")))
    total = lambda f: F.aggregate(pairs, F.lit(0.0), lambda a, e: a + f(e))
    area = total(lambda e: e["w"])
    return F.struct((total(lambda e: e["w"] * e["sx"]) / (3 * area)).alias("x"), (total(lambda e: e["w"] * e["sy"]) / (3 * area)).alias("y"))


def inside(ring: Column, x: Column, y: Column) -> Column:
    """Even-odd rule: does the ring go around (x, y)?"""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    hits = F.zip_with(ring, after, lambda p, q: ((p["y"] > y) != (q["y"] > y)) & (x < F.coalesce(F.try_divide((q["x"] - p["x"]) * (y - p["y"]), q["y"] - p["y"]), F.lit(0.0)) + p["x"]))
    return F.size(F.filter(hits, lambda h: h)) % 2 == 1


def ring_distance(ring: Column, x: Column, y: Column) -> Column:
    """Distance of (x, y) from a polygon, 0 inside."""

    def to_edge(p: Column, q: Column) -> Column:
        dx, dy = q["x"] - p["x"], q["y"] - p["y"]
        along = F.coalesce(F.try_divide((x - p["x"]) * dx + (y - p["y"]) * dy, dx * dx + dy * dy), F.lit(0.0))
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), along))
        return F.hypot(p["x"] + t * dx - x, p["y"] + t * dy - y)

    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.when(inside(ring, x, y), F.lit(0.0)).otherwise(F.array_min(F.zip_with(ring, after, to_edge)))


def _cross(p: Column, q: Column, r: Column) -> Column:
    return (q["x"] - p["x"]) * (r["y"] - p["y"]) - (q["y"] - p["y"]) * (r["x"] - p["x"])


def rings_meet(a: Column, b: Column) -> Column:
    """Do two rings share a point?  Some edges cross or touch, or one holds the other."""

    def edges(ring: Column) -> Column:
        return F.zip_with(ring, F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1)), lambda p, q: F.struct(p.alias("p"), q.alias("q")))

    def between(v: Column, s: Column, t: Column) -> Column:
        return (v >= F.least(s, t)) & (v <= F.greatest(s, t))

    def meets(e: Column, f: Column) -> Column:
        d1, d2, d3, d4 = _cross(f["p"], f["q"], e["p"]), _cross(f["p"], f["q"], e["q"]), _cross(e["p"], e["q"], f["p"]), _cross(e["p"], e["q"], f["q"])
        touch = F.lit(False)
        for d, s, v in ((d1, f, e["p"]), (d2, f, e["q"]), (d3, e, f["p"]), (d4, e, f["q"])):
            touch = touch | ((d == 0) & between(v["x"], s["p"]["x"], s["q"]["x"]) & between(v["y"], s["p"]["y"], s["q"]["y"]))
        return ((d1 * d2 < 0) & (d3 * d4 < 0)) | touch

    crossing = F.exists(edges(a), lambda e: F.exists(edges(b), lambda f: meets(e, f)))
    first = lambda r: F.element_at(r, 1)
    return crossing | inside(a, first(b)["x"], first(b)["y"]) | inside(b, first(a)["x"], first(a)["y"])


@dataclass(frozen=True)
class PolygonIntersection(Neighbourhood):
    """Cells whose centre, or features, that polygons hold.

    The centre of cell (r, c) is the raster's transform of column c + 1/2 and row r + 1/2.
    ``block`` is the side of the buckets in which polygons and cells meet, in the polygons' units.
    """

    block: int = 64

    def patches(self, anchors, source):
        """Anchors are polygons (seq, ring).  A raster's patch is the polygon's bounding window, with weight 1 inside and 0 outside."""
        if self.of_domain(source, RasterDomain):
            return self.window(anchors, source.df, source.domain.transform)
        if self.of_domain(source, PointDomain):
            return self.points_in(anchors, source.df)
        if self.of_domain(source, VectorDomain):
            return self.features_in(anchors, source.df, source.keys[0]).join(source.df, source.keys[0])
        return super().patches(anchors, source)

    def _boxed(self, polygons: DataFrame) -> DataFrame:
        low, high = lambda a: F.array_min(F.transform("ring", lambda p: p[a])), lambda a: F.array_max(F.transform("ring", lambda p: p[a]))
        box = polygons.withColumns({"x0": low("x"), "x1": high("x"), "y0": low("y"), "y1": high("y")})
        span = lambda a, b: F.sequence(F.floor(F.col(a) / self.block), F.floor(F.col(b) / self.block))
        return box.withColumn("bx", F.explode(span("x0", "x1"))).withColumn("by", F.explode(span("y0", "y1")))

    def window(self, polygons: DataFrame, cells: DataFrame, transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
        """Cells (r, c) in each polygon's bounding box, with ``w`` 1 inside the polygon and 0 outside."""
        a, b, c, d, e, f = transform
        col, row = F.col("c") + 0.5, F.col("r") + 0.5
        at = cells.withColumns({"_x": a * col + b * row + c, "_y": d * col + e * row + f})
        at = at.withColumns({"bx": F.floor(F.col("_x") / self.block), "by": F.floor(F.col("_y") / self.block)})
        met = self._boxed(polygons).join(at, ["bx", "by"]).where("_x >= x0 and _x <= x1 and _y >= y0 and _y <= y1")
        return met.withColumn("w", F.when(inside(F.col("ring"), F.col("_x"), F.col("_y")), 1.0).otherwise(0.0)).drop("bx", "by", "x0", "x1", "y0", "y1", "ring", "_x", "_y")

    def mask(self, polygons: DataFrame, cells: DataFrame, transform: tuple[float, ...] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)) -> DataFrame:
        """Cells (r, c) of each polygon (seq, ring)."""
        return self.window(polygons, cells, transform).where("w > 0").drop("w")

    def points_in(self, polygons: DataFrame, points: DataFrame) -> DataFrame:
        """Points (x, y) of each polygon."""
        own = leveled(_box(polygons)).drop("x0", "x1", "y0", "y1")
        at = points.withColumns({"x0": F.col("x"), "x1": F.col("x"), "y0": F.col("y"), "y1": F.col("y")})
        met = own.join(listed(at, levels_of(own)).drop("x0", "x1", "y0", "y1"), ["_lv", "bx", "by"])
        return met.where(inside(F.col("ring"), F.col("x"), F.col("y"))).drop("_lv", "bx", "by", "ring")

    def features_in(self, polygons: DataFrame, features: DataFrame, key: str = "fid") -> DataFrame:
        """(seq, key) of the features whose rings meet a polygon."""
        there, here = _flat(_box(features.select(F.col(key), "ring"))), _flat(_box(polygons.select("seq", "ring")))
        names = {"ring": "feature", **{n: f"f{n}" for n in ("x0", "x1", "y0", "y1")}}
        out, at = None, ["_lv", "bx", "by"]
        kinds = {id(df): {r[0] for r in df.select("_flat").distinct().collect()} for df in (there, here)}
        for a, b in [(a, b) for a in sorted(kinds[id(here)]) or [False] for b in sorted(kinds[id(there)]) or [False]]:
            mine, theirs = here.where(F.col("_flat") == a).drop("_flat"), there.where(F.col("_flat") == b).drop("_flat")
            if a and b:  # boxes that meet need no rings
                mine, theirs = mine.drop("ring"), theirs.drop("ring")
            own_there, own_here = leveled(theirs), leveled(mine)
            # two boxes meet in the squares of the larger one: polygons at their level with features as small or smaller, and the other way round
            larger = _dealt(own_here, listed(theirs, levels_of(own_here), above=True).withColumnsRenamed(names), at, ["seq"], [key])
            smaller = _dealt(listed(mine, levels_of(own_there), above=True, strictly=True), own_there.withColumnsRenamed(names), at, ["seq"], [key])
            met = larger.unionByName(smaller).where("x0 <= fx1 and fx0 <= x1 and y0 <= fy1 and fy0 <= y1")
            # of the squares that both touch, the one with the lower corner of what they share
            met = met.where((F.col("bx") == _square(F.greatest("x0", "fx0"), F.col("_lv"))) & (F.col("by") == _square(F.greatest("y0", "fy0"), F.col("_lv"))))
            if not (a and b):
                met = met.where(rings_meet(F.coalesce("ring", _rectangle("x0", "y0", "x1", "y1")), F.coalesce("feature", _rectangle("fx0", "fy0", "fx1", "fy1"))))
            met = met.select("seq", key)
            out = met if out is None else out.unionByName(met)
        # a pair comes up once, unless an id does more often
        single = there.groupBy(key).count().where("count > 1").isEmpty() and here.groupBy("seq").count().where("count > 1").isEmpty()
        return out if single else out.distinct()
