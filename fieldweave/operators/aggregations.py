"""Merging overlapping patches: one value for each cell from all patches that cover it.

Every aggregation has two forms of one meaning.  ``grouped`` is a set of SQL aggregates
for patch cells dealt by cell.  ``local`` works on the array of a cell's own covers: with
a lattice and an operator on single cells all of them come from the cell's own row, and
the merge needs no shuffle at all.  Values are NULL where there is no data.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as SQLWindow
from pyspark.sql import functions as F

from fieldweave.domains import Configured

INF = float("inf")


def total(xs: Column, f: Callable[[Column], Column] = lambda x: x) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + F.coalesce(f(x), F.lit(0.0)))


def known(xs: Column) -> Column:
    return F.filter(xs, lambda x: x["v"].isNotNull())


def plus(columns: list[Column]) -> Column:
    """Sum of columns, NULL as 0."""
    out = F.lit(0.0)
    for c in columns:
        out = out + F.coalesce(c, F.lit(0.0))
    return out


def count_of(terms: list[tuple[Column, Column]]) -> Column:
    return plus([F.when(v.isNotNull(), F.lit(1.0)) for v, _ in terms])


def extreme(f: Callable, terms, empty: float) -> Column:
    vs = [v for v, _ in terms]
    return F.coalesce(f(*vs) if len(vs) > 1 else vs[0], F.lit(empty))


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(0.0))


class Aggregation(Configured):
    #: May results of parts be merged in bounded memory?
    streaming_safe = True
    #: columns of the result
    outputs: tuple[str, ...] = ("value",)

    def grouped(self, v: Column, w: Column) -> dict[str, Column]:
        """Aggregates, which :meth:`finish` turns into the result."""
        raise NotImplementedError

    def finish(self, df: DataFrame) -> DataFrame:
        return df

    def local(self, xs: Column) -> dict[str, Column]:
        """Result from an array of structs (v, w)."""
        raise NotImplementedError

    def prepared(self, terms: list[tuple[Column, Column]]) -> dict[str, Column]:
        """Columns that :meth:`unrolled` uses more than once, so that they are computed once."""
        return {}

    def unrolled(self, terms: list[tuple[Column, Column]]) -> dict[str, Column]:
        """Result from a fixed list of (v, w), v NULL where there is none; plain arithmetic where the aggregation has it."""
        return self.local(F.array(*[F.struct(v.alias("v"), w.alias("w")) for v, w in terms]))

    def untouched(self) -> dict[str, Column]:
        """What a cell without any covering value has."""
        return {"value": F.lit(0.0)}


@dataclass(frozen=True)
class Sum(Aggregation):
    def grouped(self, v, w):
        return {"value": F.coalesce(F.sum(v), F.lit(0.0))}

    def unrolled(self, terms):
        return {"value": plus([v for v, _ in terms])}

    def local(self, xs):
        return {"value": total(xs, lambda x: x["v"])}


@dataclass(frozen=True)
class Max(Aggregation):
    def grouped(self, v, w):
        return {"value": F.coalesce(F.max(v), F.lit(-INF))}

    def unrolled(self, terms):
        return {"value": extreme(F.greatest, terms, -INF)}

    def local(self, xs):
        return {"value": F.coalesce(F.array_max(F.transform(xs, lambda x: x["v"])), F.lit(-INF))}

    def untouched(self):
        return {"value": F.lit(-INF)}


@dataclass(frozen=True)
class Min(Aggregation):
    def grouped(self, v, w):
        return {"value": F.coalesce(F.min(v), F.lit(INF))}

    def unrolled(self, terms):
        return {"value": extreme(F.least, terms, INF)}

    def local(self, xs):
        return {"value": F.coalesce(F.array_min(F.transform(xs, lambda x: x["v"])), F.lit(INF))}

    def untouched(self):
        return {"value": F.lit(INF)}


@dataclass(frozen=True)
class WeightedSum(Aggregation):
    """Not normalised.  ``weight_fn`` turns the window's weight into another; where patches are rows it may use their columns."""

    weight_fn: Callable[[Column], Column] | None = None

    def _weight(self, w: Column) -> Column:
        return self.weight_fn(w) if self.weight_fn else w

    def grouped(self, v, w):
        return {"value": F.coalesce(F.sum(v * self._weight(w)), F.lit(0.0))}

    def unrolled(self, terms):
        return {"value": plus([v * self._weight(w) for v, w in terms])}

    def local(self, xs):
        return {"value": total(xs, lambda x: x["v"] * self._weight(x["w"]))}


@dataclass(frozen=True)
class Mean(Aggregation):
    """Weights are ignored."""

    def grouped(self, v, w):
        return {"value": F.coalesce(F.avg(v), F.lit(0.0))}

    def unrolled(self, terms):
        return {"value": ratio(plus([v for v, _ in terms]), count_of(terms))}

    def local(self, xs):
        return {"value": ratio(total(xs, lambda x: x["v"]), F.size(known(xs)).cast("double"))}


@dataclass(frozen=True)
class Variance(Aggregation):
    """Of the sample (n - 1); 0 for fewer than two values."""

    def grouped(self, v, w):
        return {"value": F.when(F.count(v) > 1, F.var_samp(v)).otherwise(F.lit(0.0))}

    def prepared(self, terms):
        return {"_near": F.coalesce(*[v for v, _ in terms])}

    def unrolled(self, terms):
        # differences from one of the values keep the sums small
        n, ds = count_of(terms), [v - F.col("_near") for v, _ in terms]
        spread = plus([d * d for d in ds]) - F.try_divide(plus(ds) * plus(ds), n)
        return {"value": F.when(n > 1, F.greatest(F.lit(0.0), F.try_divide(spread, n - 1))).otherwise(F.lit(0.0))}

    def local(self, xs):
        vs = F.transform(known(xs), lambda x: x["v"])
        n = F.size(vs)
        spread = F.transform(F.array(F.try_divide(total(vs), n)), lambda m: total(vs, lambda x: (x - m) * (x - m)))
        return {"value": F.when(n > 1, F.element_at(spread, 1) / (n - 1)).otherwise(F.lit(0.0))}


@dataclass(frozen=True)
class OverlapAdd(Aggregation):
    """Weighted mean of the covering values; not divided by the weights unless ``normalize``."""

    normalize: bool = True

    def grouped(self, v, w):
        out = {"value": F.coalesce(F.sum(v * w), F.lit(0.0))}
        return out | {"_weight": F.coalesce(F.sum(F.when(v.isNotNull(), w)), F.lit(0.0))} if self.normalize else out

    def finish(self, df):
        return df.withColumn("value", ratio(F.col("value"), F.col("_weight"))).drop("_weight") if self.normalize else df

    def unrolled(self, terms):
        top = plus([v * w for v, w in terms])
        return {"value": ratio(top, plus([F.when(v.isNotNull(), w) for v, w in terms])) if self.normalize else top}

    def local(self, xs):
        top = total(xs, lambda x: x["v"] * x["w"])
        return {"value": ratio(top, total(known(xs), lambda x: x["w"])) if self.normalize else top}


@dataclass(frozen=True)
class InvVarWeightedMean(Aggregation):
    """Fusion of estimates: ``v`` is a struct (mu, var).  Without precision the result is (0, infinity)."""

    outputs = ("mu", "var")

    def grouped(self, v, w):
        return {"mu": F.sum(F.try_divide(w * v["mu"], v["var"])), "var": F.sum(F.try_divide(w, v["var"]))}

    def finish(self, df):
        return df.withColumns(self._fused(F.col("mu"), F.col("var")))

    @staticmethod
    def _fused(top: Column, precision: Column) -> dict[str, Column]:
        ok = (precision > 0) & ~F.isnan(precision)
        return {"mu": F.when(ok, F.try_divide(top, precision)).otherwise(F.lit(0.0)), "var": F.when(ok, F.try_divide(F.lit(1.0), precision)).otherwise(F.lit(INF))}

    def unrolled(self, terms):
        own = terms
        return self._fused(plus([F.try_divide(w * v["mu"], v["var"]) for v, w in own]), plus([F.try_divide(w, v["var"]) for v, w in own]))

    def local(self, xs):
        return self._fused(total(xs, lambda x: F.try_divide(x["w"] * x["v"]["mu"], x["v"]["var"])), total(xs, lambda x: F.try_divide(x["w"], x["v"]["var"])))

    def untouched(self):
        return {"mu": F.lit(0.0), "var": F.lit(INF)}


def _first_largest(xs: Column) -> Column:
    """Index of the first largest element, 0 in an array of zeros."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("long")


@dataclass(frozen=True)
class HardVote(Aggregation):
    """The commonest class in 0 .. n_classes - 1, the lesser on a tie; other classes don't count."""

    n_classes: int

    def grouped(self, v, w):
        return {f"_n{k}": F.count(F.when(v == k, 1)) for k in range(self.n_classes)}

    def finish(self, df):
        names = [f"_n{k}" for k in range(self.n_classes)]
        return df.withColumn("value", _first_largest(F.array(*names))).drop(*names)

    def unrolled(self, terms):
        own = terms
        return {"value": _first_largest(F.array(*[plus([F.when(v == k, F.lit(1.0)) for v, _ in own]) for k in range(self.n_classes)]))}

    def local(self, xs):
        votes = [F.size(F.filter(xs, self._is(k))) for k in range(self.n_classes)]
        return {"value": _first_largest(F.array(*votes))}

    @staticmethod
    def _is(k: int) -> Callable[[Column], Column]:
        return lambda x: x["v"] == k

    def untouched(self):
        return {"value": F.lit(0).cast("long")}


@dataclass(frozen=True)
class SoftVote(Aggregation):
    """The class of largest summed probability; ``v`` is an array of n_classes probabilities."""

    n_classes: int

    def grouped(self, v, w):
        return {f"_p{k}": F.coalesce(F.sum(F.get(v, F.lit(k))), F.lit(0.0)) for k in range(self.n_classes)}

    def finish(self, df):
        names = [f"_p{k}" for k in range(self.n_classes)]
        return df.withColumn("value", _first_largest(F.array(*names))).drop(*names)

    def unrolled(self, terms):
        own = terms
        return {"value": _first_largest(F.array(*[plus([F.get(v, F.lit(k)) for v, _ in own]) for k in range(self.n_classes)]))}

    def local(self, xs):
        return {"value": _first_largest(F.array(*[total(xs, lambda x, k=k: F.get(x["v"], F.lit(k))) for k in range(self.n_classes)]))}

    def untouched(self):
        return {"value": F.lit(0).cast("long")}


@dataclass(frozen=True)
class Median(Aggregation):
    """Exact, between the middle two of an even number; NaN for a cell without values."""

    streaming_safe = False

    def grouped(self, v, w):
        return {"value": F.coalesce(F.percentile(v, F.lit(0.5)), F.lit(float("nan")))}

    def prepared(self, terms):
        return {"_sorted": F.sort_array(F.array_compact(F.array(*[v for v, _ in terms])))}

    def unrolled(self, terms):
        return self._middle(F.col("_sorted"))

    @staticmethod
    def _middle(vs: Column) -> dict[str, Column]:
        n = F.size(vs)
        low, high = F.get(vs, F.floor((n - 1) / 2).cast("int")), F.get(vs, F.floor(n / 2).cast("int"))
        return {"value": F.when(n == 0, F.lit(float("nan"))).when(low == high, low).otherwise(low + (high - low) * 0.5)}

    def local(self, xs):
        return self._middle(F.array_sort(F.transform(known(xs), lambda x: x["v"])))

    def untouched(self):
        return {"value": F.lit(float("nan"))}


@dataclass(frozen=True)
class Mode(Aggregation):
    """The commonest whole number, the least on a tie."""

    streaming_safe = False

    def grouped(self, v, w):
        return {"value": F.coalesce(F.mode(v.cast("long"), True), F.lit(0).cast("long"))}

    def local(self, xs):
        vs = F.transform(known(xs), lambda x: x["v"].cast("long"))
        counted = F.transform(F.array_distinct(vs), lambda d: F.struct(F.size(F.filter(vs, lambda x: x == d)).alias("n"), (-d).alias("least")))
        return {"value": F.coalesce(-F.array_max(counted)["least"], F.lit(0).cast("long"))}

    def untouched(self):
        return {"value": F.lit(0).cast("long")}


# ---------------------------------------------------------------- by anchor and over all patches
def by_index(patches: DataFrame, keys: list[str], data: list[str]) -> DataFrame:
    """The last patch of each anchor, by ``seq``."""
    return patches.groupBy(*keys).agg(*[F.max_by(c, "seq").alias(c) for c in data])


@dataclass(frozen=True)
class MeanStd(Configured):
    """Over all patch values, so overlaps count repeatedly; NaN spoils it, none is an error."""

    def reduce(self, patch_cells: DataFrame, value: str = "value") -> DataFrame:
        v = F.coalesce(F.col(value), F.lit(float("nan")))
        out = patch_cells.agg(F.count("*").alias("n"), F.avg(v).alias("mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("std"))
        return out.where(F.when(F.col("n") == 0, F.raise_error(F.lit("no patches to reduce")).cast("boolean")).otherwise(F.lit(True)))


@dataclass(frozen=True)
class MinMax(Configured):
    """Over all patches without missing values."""

    def reduce(self, patch_cells: DataFrame, value: str = "value") -> DataFrame:
        by = patch_cells.groupBy("seq").agg(F.count_if(F.col(value).isNull() | F.isnan(value)).alias("gaps"), F.min(value).alias("low"), F.max(value).alias("high"))
        out = by.agg(F.count("*").alias("n"), F.coalesce(F.min(F.when(F.col("gaps") == 0, F.col("low"))), F.lit(INF)).alias("min"), F.coalesce(F.max(F.when(F.col("gaps") == 0, F.col("high"))), F.lit(-INF)).alias("max"))
        return out.where(F.when(F.col("n") == 0, F.raise_error(F.lit("no patches to reduce")).cast("boolean")).otherwise(F.lit(True))).drop("n")


@dataclass(frozen=True)
class Learned(Configured):
    """``model(pandas frame) -> pandas frame`` of ``schema``.

    :meth:`merge` gives it the patch cells of one group at a time; :meth:`merge_packed` a batch of whole patches, a row
    each with ``data`` and ``weights``, as they travel, without a shuffle of their own.
    """

    model: Callable
    schema: str

    def merge_packed(self, packed: DataFrame) -> DataFrame:
        model = self.model
        return packed.mapInPandas(lambda batches: (model(b) for b in batches), self.schema)

    def merge(self, patch_cells: DataFrame, by: list[str]) -> DataFrame:
        return patch_cells.groupBy(*by).applyInPandas(self.model, self.schema)


# ---------------------------------------------------------------- sketches over all patch values
def finite(df: DataFrame, value: str) -> DataFrame:
    v = F.col(value).cast("double")
    return df.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < INF))


class Sketch(Configured):
    """A summary whose state is a row that can be stored, and merged with others: ``sketch`` makes states, ``merge`` answers from any of them."""

    def sketch(self, df: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
        """``by`` and ``sketch``: one state for each group."""
        raise NotImplementedError

    def merge(self, sketches: DataFrame) -> DataFrame:
        raise NotImplementedError

    def reduce(self, df: DataFrame, value: str = "value") -> DataFrame:
        return self.merge(self.sketch(df, value))


@dataclass(frozen=True)
class ApproxQuantile(Sketch):
    """Quantiles of finite values.

    :meth:`reduce` uses Spark's summary, whose error falls with ``compression``; states that are
    stored are KLL sketches of 2 to 8 times as many items.
    """

    q: float | tuple[float, ...] = 0.5
    compression: int = 200

    @property
    def _qs(self) -> list[float]:
        return [float(x) for x in (self.q if isinstance(self.q, tuple) else (self.q,))]

    def sketch(self, df, value="value", by=()):
        own = finite(df, value).withColumn("_v", F.col(value).cast("double"))
        return own.groupBy(*by).agg(F.expr(f"kll_sketch_agg_double(_v, {min(max(2 * self.compression, 8), 65535)})").alias("sketch"))

    def merge(self, sketches):
        whole = sketches.agg(F.expr("kll_merge_agg_double(sketch)").alias("s"))
        pairs = F.array(*[F.struct(F.lit(x).alias("q"), F.expr(f"kll_sketch_get_quantile_double(s, {x!r}D)").alias("value")) for x in self._qs])
        return whole.where(F.expr("kll_sketch_get_n_double(s) > 0")).select(F.explode(pairs).alias("p")).select("p.q", "p.value")

    def reduce(self, df: DataFrame, value: str = "value") -> DataFrame:
        found = finite(df, value).agg(F.percentile_approx(value, self._qs, self.compression * 50).alias("x"))
        pairs = F.arrays_zip(F.array(*[F.lit(x) for x in self._qs]).alias("q"), F.col("x").alias("value"))
        return found.select(F.explode(pairs).alias("p")).select("p.q", "p.value")


@dataclass(frozen=True)
class ApproxCardinality(Sketch):
    """Distinct values by HyperLogLog of 2**p registers; sketches can be stored and merged."""

    p: int = 14

    def __post_init__(self):
        if not 4 <= self.p <= 16:
            raise ValueError("p must lie in 4..16")

    def sketch(self, df: DataFrame, value: str = "value", by: tuple[str, ...] = ()) -> DataFrame:
        own = F.col(value).cast("string") if dict(df.dtypes)[value] in ("double", "float", "boolean") else F.col(value)
        return df.where(F.col(value).isNotNull()).groupBy(*by).agg(F.hll_sketch_agg(own, self.p).alias("sketch"))

    def merge(self, sketches: DataFrame) -> DataFrame:
        return sketches.agg(F.coalesce(F.hll_sketch_estimate(F.hll_union_agg("sketch", F.lit(True))), F.lit(0).cast("long")).alias("estimate"))


@dataclass(frozen=True)
class ApproxMode(Sketch):
    """Up to ``k`` heavy hitters by Spark's frequent-items sketch."""

    k: int = 16

    def sketch(self, df, value="value", by=()):
        return finite(df, value).groupBy(*by).agg(F.expr(f"approx_top_k_accumulate({value}, {max(64 * self.k, 1024)})").alias("sketch"))

    def merge(self, sketches):
        whole = sketches.agg(F.expr(f"approx_top_k_combine(sketch, {max(64 * self.k, 1024)})").alias("s"))
        return self._listed(whole.select(F.expr(f"approx_top_k_estimate(s, {self.k})").alias("top")))

    @staticmethod
    def _listed(found: DataFrame) -> DataFrame:
        return found.select(F.posexplode("top").alias("rank", "t")).select("rank", F.col("t.item").alias("item"), F.col("t.count").alias("n"))

    def reduce(self, df: DataFrame, value: str = "value") -> DataFrame:
        return self._listed(finite(df, value).agg(F.expr(f"approx_top_k({value}, {self.k})").alias("top")))


@dataclass(frozen=True)
class StreamingHistogram(Sketch):
    """At most ``bins`` centroids of merged neighbours; states are lists of centroids, and merge by their nearest pairs."""

    bins: int = 64

    def sketch(self, df, value="value", by=()):
        own = finite(df, value).groupBy(*by).agg(F.histogram_numeric(F.col(value).cast("double"), F.lit(self.bins)).alias("h"))
        return own.select(*by, F.transform("h", lambda b: F.struct(b["x"].alias("x"), b["y"].cast("double").alias("y"))).alias("sketch"))

    def merge(self, sketches):
        listed = sketches.agg(F.array_sort(F.flatten(F.collect_list("sketch"))).alias("_all"))  # as many lists of at most ``bins`` as there are states

        def joined(bins: Column) -> Column:
            """The two nearest neighbours as one."""
            gaps = F.transform(F.sequence(F.lit(1), F.size(bins) - 1), lambda i: F.struct((F.element_at(bins, i + 1)["x"] - F.element_at(bins, i)["x"]).alias("gap"), i.alias("i")))

            def at(i: Column) -> Column:
                a, b = F.element_at(bins, i), F.element_at(bins, i + 1)
                both = F.struct(((a["x"] * a["y"] + b["x"] * b["y"]) / (a["y"] + b["y"])).alias("x"), (a["y"] + b["y"]).alias("y"))
                return F.concat(F.slice(bins, F.lit(1), i - 1), F.array(both), F.slice(bins, i + 2, F.size(bins)))

            return F.element_at(F.transform(F.array(F.array_min(gaps)["i"]), at), 1)

        held = F.aggregate("_all", F.array().cast("array<struct<x:double,y:double>>"), lambda acc, b: F.element_at(F.transform(F.array(F.concat(acc, F.array(b))), lambda xs: F.when(F.size(xs) > self.bins, joined(xs)).otherwise(xs)), 1))
        return listed.select(F.posexplode(held).alias("bin", "b")).select("bin", F.col("b.x").alias("center"), F.col("b.y").alias("n"))

    def reduce(self, df: DataFrame, value: str = "value") -> DataFrame:
        found = finite(df, value).agg(F.histogram_numeric(value, F.lit(self.bins)).alias("h"))
        return found.select(F.posexplode("h").alias("bin", "b")).select("bin", F.col("b.x").cast("double").alias("center"), F.col("b.y").cast("double").alias("n"))


@dataclass(frozen=True)
class Reservoir(Sketch):
    """A uniform sample of ``k`` rows that depends on seed and row key only, not on partitioning.

    A state holds the ``k`` rows of least hash of its group, so the least of several states are the sample of all.
    """

    k: int = 100
    seed: int = 0
    key: tuple[str, ...] = ("seq",)

    def sketch(self, df, value="value", by=()):
        """A row for each kept row, as (hash, key, value)."""
        own = finite(df, value).select(*by, F.struct(F.xxhash64(F.lit(self.seed), *self.key).alias("hash"), *self.key, F.col(value).alias("value")).alias("sketch"))
        if not by:
            return own.orderBy("sketch").limit(self.k)
        place = F.row_number().over(SQLWindow.partitionBy(*by).orderBy("sketch"))
        return own.withColumn("_place", place).where(F.col("_place") <= self.k).drop("_place")

    def merge(self, sketches):
        return sketches.orderBy("sketch").limit(self.k).select("sketch.*").drop("hash")

    def reduce(self, df: DataFrame, value: str = "value", key: tuple[str, ...] | None = None) -> DataFrame:
        own = key or self.key
        return finite(df, value).orderBy(F.xxhash64(F.lit(self.seed), *own), *own).limit(self.k)
