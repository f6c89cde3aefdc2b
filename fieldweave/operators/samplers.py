"""Where patches are placed.

Lattices, also jittered ones, are generated by the executors: a shift is a hash of seed and
place, so it doesn't depend on partitioning.  Other seeded samplers draw as many anchors as
they are asked for on the driver.  One seed, the same anchors; no seed, new ones each time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldweave.domains import Configured, GridDomain, PointDomain, RasterDomain, VectorDomain
from fieldweave.tables import discard, written

ANCHOR = {"r": "ar", "c": "ac"}


def anchor_name(dim: str) -> str:
    return ANCHOR.get(dim, f"a_{dim}")


def per_dim(value: int | Sequence[int] | dict[str, int], dims: Iterable[str]) -> dict[str, int]:
    dims = list(dims)
    if isinstance(value, dict):
        return {d: value[d] for d in dims}
    return dict(zip(dims, [value] * len(dims) if isinstance(value, int) else value, strict=True))


def table(spark: SparkSession, rows: Iterable[Sequence[int]], dims: Sequence[str]) -> DataFrame:
    """``seq`` and the anchor columns, in the order given."""
    schema = ", ".join(["seq long", *(f"{anchor_name(d)} long" for d in dims)])
    return spark.createDataFrame([(i, *map(int, row)) for i, row in enumerate(rows)], schema)


class Sampler(Configured):
    def table(self, spark: SparkSession, domain, geometry) -> DataFrame:
        raise NotImplementedError

    def count(self, domain, geometry) -> int:
        raise NotImplementedError

    def table_of(self, source, geometry) -> DataFrame:
        """Anchors on a field, for samplers that look at its points; others know the domain only."""
        return self.table(source.df.sparkSession, source.domain, geometry)


@dataclass(frozen=True)
class RegularStride(Sampler):
    """A lattice in row-major order.  With ``drop`` it ends where a whole patch fits, but has one anchor at least."""

    step: int | tuple[int, ...] | dict[str, int] = 1

    def axes(self, domain, geometry) -> dict[str, tuple[int, int]]:
        """Step and number of anchors of each dimension."""
        steps, sizes = per_dim(self.step, domain.dims), geometry.sizes(domain)
        whole = geometry.boundary == "drop" or isinstance(domain, GridDomain)
        return {d: (steps[d], len(range(0, max(n - sizes[d] + 1, 1) if whole else n, steps[d]))) for d, n in domain.dims.items()}

    def count(self, domain, geometry) -> int:
        return math.prod(n for _, n in self.axes(domain, geometry).values())

    def table(self, spark, domain, geometry) -> DataFrame:
        axes, out = self.axes(domain, geometry), [F.col("id").alias("seq")]
        below = self.count(domain, geometry)
        for d, (step, n) in axes.items():
            below //= n
            out.append((F.floor(F.col("id") / below) % n * step).cast("long").alias(anchor_name(d)))
        return spark.range(self.count(domain, geometry)).select(*out)


class Drawn(Sampler):
    """A sampler whose anchors are listed on the driver."""

    def anchors(self, domain, geometry) -> list[tuple[int, ...]]:
        raise NotImplementedError

    def dims(self, domain) -> list[str]:
        return list(domain.dims) if isinstance(domain, RasterDomain | GridDomain) else ["id"]

    def count(self, domain, geometry) -> int:
        return len(self.anchors(domain, geometry))

    def table(self, spark, domain, geometry) -> DataFrame:
        return table(spark, self.anchors(domain, geometry), self.dims(domain))


@dataclass(frozen=True)
class JitteredStride(Drawn):
    """A lattice whose anchors are moved by up to ``jitter`` steps each way and kept inside the domain.

    Shifts are hashes of seed, place and dimension, made where the lattice is made.  ``drawn``
    takes them from a generator instead, one after another on the driver.
    """

    step: int | tuple[int, ...] | dict[str, int] = 1
    jitter: float = 0.5
    seed: int | None = None
    drawn: bool = False

    def count(self, domain, geometry) -> int:
        return RegularStride(self.step).count(domain, geometry)

    def table(self, spark, domain, geometry) -> DataFrame:
        if self.drawn:
            return super().table(spark, domain, geometry)
        seed = int(np.random.default_rng().integers(1 << 62)) if self.seed is None else self.seed
        whole, sizes = geometry.boundary == "drop" or isinstance(domain, GridDomain), geometry.sizes(domain)
        out = RegularStride(self.step).table(spark, domain, geometry)
        moved = {}
        for i, (d, (step, _)) in enumerate(RegularStride(self.step).axes(domain, geometry).items()):
            top = max(domain.dims[d] - sizes[d], 0) if whole else domain.dims[d] - 1
            # 53 bits of the hash as a number in -1..1
            unit = F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(i), "seq"), 11) / 2.0**52 - 1
            at = F.col(anchor_name(d)) + (unit * (self.jitter * step)).cast("long")  # towards 0
            moved[anchor_name(d)] = F.greatest(F.lit(0), F.least(at, F.lit(top))).cast("long")
        return out.withColumns(moved)

    def anchors(self, domain, geometry):
        rng, sizes = np.random.default_rng(self.seed), geometry.sizes(domain)
        axes = RegularStride(self.step).axes(domain, geometry)
        whole = geometry.boundary == "drop" or isinstance(domain, GridDomain)
        top = {d: max(n - sizes[d], 0) if whole else n - 1 for d, n in domain.dims.items()}
        out = []
        for place in np.ndindex(*(n for _, n in axes.values())):
            anchor = []
            for k, (d, (step, _)) in zip(place, axes.items(), strict=True):
                shift = rng.uniform(-self.jitter, self.jitter) * step
                at = int(k * step + shift) if isinstance(domain, GridDomain) else k * step + int(shift)
                anchor.append(min(max(at, 0), top[d]))
            out.append(tuple(anchor))
        return out


@dataclass(frozen=True)
class RandomAnchors(Drawn):
    """``n`` independent anchors; features are drawn with replacement."""

    n: int = 1
    seed: int | None = None

    def anchors(self, domain, geometry):
        rng = np.random.default_rng(self.seed)
        if isinstance(domain, PointDomain | VectorDomain):
            return [(int(i),) for i in rng.integers(0, domain.count, self.n)]
        sizes = geometry.sizes(domain)
        highs = [max(n - sizes[d] + 1, 1) if geometry.boundary == "drop" or isinstance(domain, GridDomain) else n for d, n in domain.dims.items()]
        if isinstance(domain, GridDomain):
            return [tuple(int(rng.integers(0, h)) for h in highs) for _ in range(self.n)]
        return list(zip(*(rng.integers(0, h, self.n).tolist() for h in highs), strict=True))


def well_spaced(candidates: DataFrame, near: float) -> DataFrame:
    """A choice of ``candidates`` (seq, x, y, rank) with no two nearer than ``near``, to which none could be added.

    In squares whose diagonal is the distance one candidate is chosen at most.  In every round the first by
    rank of each square is taken if it is before those of the squares around within the distance; then
    all within the distance of one taken go.  So rows compared grow with the squares, not with the
    candidates in them, however crowded a place is, and rounds with the logarithm of the squares.
    """
    side = near / math.sqrt(2) * (1 - 1e-9)
    square = {"sx": F.floor(F.col("x") / side).cast("long"), "sy": F.floor(F.col("y") / side).cast("long")}
    apart = F.hypot(F.col("x") - F.col("ox"), F.col("y") - F.col("oy"))
    open_, taken = written(candidates.select("seq", "x", "y", "rank").withColumns(square)), None

    def around(df: DataFrame) -> DataFrame:
        """In all squares that may hold a point within the distance."""
        steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-2, 3) for j in range(-2, 3) if abs(i * j) < 4])
        out = df.select(F.col("seq").alias("other"), F.col("rank").alias("other_rank"), F.col("x").alias("ox"), F.col("y").alias("oy"), "sx", "sy", F.explode(steps).alias("_s"))
        # Spark takes the copies for no more bytes than the table they are made of, and would broadcast them
        return out.withColumns({"sx": F.col("sx") + F.col("_s.i"), "sy": F.col("sy") + F.col("_s.j")}).drop("_s").hint("shuffle_merge")

    while not open_.isEmpty():
        first = written(open_.groupBy("sx", "sy").agg(F.min(F.struct("rank", "seq", "x", "y")).alias("b")).select("sx", "sy", "b.*"))
        before = (F.col("other_rank") < F.col("rank")) | ((F.col("other_rank") == F.col("rank")) & (F.col("other") < F.col("seq")))
        own, others = first.alias("p"), around(first).alias("q")
        met = (F.col("p.sx") == F.col("q.sx")) & (F.col("p.sy") == F.col("q.sy"))
        won = written(own.join(others, met & before & (apart < near), "left_anti"))
        rest = written(open_.alias("p").join(around(won).alias("q"), met & ((apart < near) | (F.col("other") == F.col("seq"))), "left_anti"))
        taken = won if taken is None else taken.unionByName(won)
        discard(first)
        discard(open_)
        open_ = rest
    discard(open_)
    return taken if taken is not None else open_.sparkSession.createDataFrame([], candidates.select("seq", "x", "y", "rank").schema)


@dataclass(frozen=True)
class PoissonDisk(Drawn):
    """Anchors at least ``min_distance`` apart (before they are cut to whole cells), placed by dart throwing around placed ones.

    That is one after another, on the driver.  ``spread`` places them on the executors (see :func:`well_spaced`), for rasters
    and point fields of any size: on rasters among ``max_tries`` candidates for each square of the distance, at
    hashed places; on points among the points, numbered by their ids.  Ranks are hashes of seed and number.
    """

    min_distance: float = 1.0
    max_tries: int = 30
    seed: int | None = None
    spread: bool = False
    #: coordinates of points, needed on a point domain
    xy: tuple[tuple[float, float], ...] | None = field(default=None, repr=False)

    def count(self, domain, geometry) -> int:
        if self.spread:
            raise ValueError("anchors that are spread are counted by their table")
        return super().count(domain, geometry)

    def table(self, spark, domain, geometry) -> DataFrame:
        if not (self.spread and isinstance(domain, RasterDomain)):
            return super().table(spark, domain, geometry)
        seed = int(np.random.default_rng().integers(1 << 62)) if self.seed is None else self.seed
        sizes, near = geometry.sizes(domain), self.min_distance
        high, wide = (float(max(n - sizes[d] + 1, 1) if geometry.boundary == "drop" else n) for d, n in domain.dims.items())
        rows, cols = math.ceil(high / near), math.ceil(wide / near)
        unit = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(k), "id"), 11) / 2.0**53
        square = F.floor(F.col("id") / self.max_tries)
        drawn = spark.range(rows * cols * self.max_tries).select(
            F.col("id").alias("seq"), ((F.floor(square / cols) + unit(0)) * near).alias("y"), ((square % cols + unit(1)) * near).alias("x"), F.xxhash64(F.lit(seed), F.lit(2), "id").alias("rank"))
        taken = well_spaced(drawn.where((F.col("y") < high) & (F.col("x") < wide)), near)
        return taken.select("seq", F.floor("y").cast("long").alias("ar"), F.floor("x").cast("long").alias("ac"))

    def table_of(self, source, geometry) -> DataFrame:
        if not (self.spread and isinstance(source.domain, PointDomain)):
            return super().table_of(source, geometry)
        key, seed = source.keys[0], int(np.random.default_rng().integers(1 << 62)) if self.seed is None else self.seed
        own = source.df.groupBy(F.col(key).alias("seq")).agg(F.first("x").alias("x"), F.first("y").alias("y"))
        return well_spaced(own.withColumn("rank", F.xxhash64(F.lit(seed), "seq")), self.min_distance).select("seq", F.col("seq").alias("a_id"))

    def anchors(self, domain, geometry):
        rng, near = np.random.default_rng(self.seed), self.min_distance
        if isinstance(domain, PointDomain):
            taken: list[int] = []
            xy = np.asarray(self.xy, float)
            for i in rng.permutation(len(xy)):
                if not taken or np.hypot(*(xy[taken] - xy[i]).T).min() >= near:
                    taken.append(int(i))
            return [(i,) for i in taken]
        sizes = geometry.sizes(domain)
        high = np.array([max(n - sizes[d] + 1, 1) if geometry.boundary == "drop" else n for d, n in domain.dims.items()], float)
        side = near / math.sqrt(2)
        # plain floats, as an array for each dart costs more than all its sums; the same draws and anchors as with arrays
        board: dict[tuple[int, int], tuple[float, float]] = {}
        around = [(i, j) for i in range(-2, 3) for j in range(-2, 3)]
        (rows, cols), square, turn = high.tolist(), near * near, 2 * math.pi

        def free(y: float, x: float, a: int, b: int) -> bool:
            for i, j in around:
                if q := board.get((a + i, b + j)):
                    d = (y - q[0]) ** 2 + (x - q[1]) ** 2
                    if d < square * (1 - 1e-12) or (d < square * (1 + 1e-12) and np.hypot(y - q[0], x - q[1]) < near):
                        return False
            return True

        first = tuple(rng.uniform(0, high).tolist())
        placed, active = [first], [first]
        board[int(first[0] // side), int(first[1] // side)] = first
        while active:
            at = int(rng.integers(len(active)))
            own_y, own_x = active[at]
            for _ in range(self.max_tries):
                angle, reach = turn * rng.random(), near * math.sqrt(1 + 3 * rng.random())
                y, x = own_y + reach * math.sin(angle), own_x + reach * math.cos(angle)
                if 0 <= y < rows and 0 <= x < cols and free(y, x, a := int(y // side), b := int(x // side)):
                    board[a, b] = p = (y, x)
                    placed.append(p)
                    active.append(p)
                    break
            else:
                active.pop(at)
        return [tuple(int(x) for x in p) for p in placed]


@dataclass(frozen=True)
class Explicit(Drawn):
    """Anchors as they are given."""

    places: tuple

    def __post_init__(self):
        object.__setattr__(self, "places", tuple(self.places))

    def anchors(self, domain, geometry):
        return [p if isinstance(p, tuple) else (p,) for p in self.places]


# ---------------------------------------------------------------- time
class TemporalSampler(Configured):
    #: (first, step) if the anchors are a lattice
    lattice: tuple[int, int] | None = None

    def times(self, length: int) -> list[int]:
        raise NotImplementedError

    def table(self, spark: SparkSession, length: int) -> DataFrame:
        return spark.createDataFrame([(i, int(t)) for i, t in enumerate(self.times(length))], "seq long, t_anchor long")


@dataclass(frozen=True)
class TemporalStride(TemporalSampler):
    step: int = 1
    start: int = 0

    @property
    def lattice(self):
        return self.start, self.step

    def times(self, length: int) -> list[int]:
        return list(range(self.start, length, self.step))

    def table(self, spark, length: int) -> DataFrame:
        return spark.range(len(range(self.start, length, self.step))).select(F.col("id").alias("seq"), (F.col("id") * self.step + self.start).alias("t_anchor"))


#: Anchors that begin once enough past is there.
CausalRolling = TemporalStride


@dataclass(frozen=True)
class EventTriggered(TemporalSampler):
    """The times of events that lie on the axis, in the order given."""

    event_times: tuple[int, ...]

    def times(self, length: int) -> list[int]:
        return [int(t) for t in self.event_times if 0 <= t < length]


@dataclass(frozen=True)
class TemporalExplicit(TemporalSampler):
    at: tuple[int, ...]

    def times(self, length: int) -> list[int]:
        return [int(t) for t in self.at if 0 <= t < length]


@dataclass(frozen=True)
class TemporalRandom(TemporalSampler):
    """Drawn with replacement."""

    n: int = 1
    seed: int | None = None

    def times(self, length: int) -> list[int]:
        return np.random.default_rng(self.seed).integers(0, length, self.n).tolist() if length else []
