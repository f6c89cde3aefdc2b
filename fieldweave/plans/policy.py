"""Settings and policies that stand beside a plan: strictness, hooks, journal, errors."""

from __future__ import annotations

import json
import os
import pickle
import threading
import time
import traceback
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from fieldweave.domains import Configured
from fieldweave.operators.scan import prefix_sums
from fieldweave.tables import written

_strict: bool | None = None


def set_strict(on: bool | None) -> None:
    """Make unsafe plans errors (True) or warnings (False); None goes back to FIELDWEAVE_STRICT."""
    global _strict
    _strict = on


def strict() -> bool:
    return os.environ.get("FIELDWEAVE_STRICT", "") not in ("", "0", "false") if _strict is None else _strict


def check_streaming(aggregation) -> None:
    """An aggregation that needs all values of a cell at once is no good for merging parts."""
    if not aggregation.streaming_safe:
        text = f"{type(aggregation).__name__} keeps every value of a cell; parts can't be merged in bounded memory"
        if strict():
            raise RuntimeError(text)
        warnings.warn(text, RuntimeWarning, stacklevel=3)


@dataclass
class Hooks:
    """Driver-side callbacks; one that fails is a warning, not an error.  A total that isn't known is -1.

    A plan with hooks writes what it splits, maps or merges as a table in the shared folder
    before it goes on, so that each callback tells what has happened, not what is planned.

    ``on_split_start(n)``, ``on_split_end()``: around the making of patches.
    ``on_patch(seq, runtime_s, n_bytes)``, ``on_error(seq, error)``: for each patch that an operator
    or reader has made, and for each failed try, after the run, in the order of ``seq``.
    ``on_merge_start(n)``, ``on_merge_end(n_cells)``: around a merge.  ``on_progress(n)``: patches done.
    """

    on_split_start: Callable | None = None
    on_patch: Callable | None = None
    on_error: Callable | None = None
    on_split_end: Callable | None = None
    on_merge_start: Callable | None = None
    on_merge_end: Callable | None = None
    on_progress: Callable | None = None

    #: Tell of splits and merges once the caller's own job has run, by metrics of the plan; nothing is written for it.
    observe: bool = False

    def watched(self, df: DataFrame, name: str, counted: bool) -> DataFrame:
        """``df`` with a count that calls the hook ``name`` when the first job over it is done."""
        seen = Observation()

        def wait() -> None:
            try:
                n = seen.get["n"]
            except Exception:  # the job had no need of this part of the plan, so it didn't happen
                return
            self.call(name, *([n] if counted else []))

        out = df.observe(seen, F.count(F.lit(1)).alias("n"))
        if getattr(self, name):
            threading.Thread(target=wait, daemon=True).start()
        return out

    def call(self, name: str, *args) -> None:
        if fn := getattr(self, name):
            try:
                fn(*args)
            except Exception as e:
                warnings.warn(f"hook {name} failed: {e!r}", RuntimeWarning, stacklevel=2)

    def done(self, result: MapResult) -> None:
        """Tells of every patch and failure of a written result; rows stream through the driver."""
        if self.on_patch:
            for r in result.patches.select("seq", "runtime_s", F.size("data").alias("n")).orderBy("seq").toLocalIterator():
                self.call("on_patch", r["seq"], r["runtime_s"], 8 * r["n"])
        if self.on_error:
            for r in result.errors.orderBy("anchor", "retry_count").toLocalIterator():
                self.call("on_error", r["anchor"], RuntimeError(f"{r['kind']}: {r['message']}"))
        if self.on_progress:
            self.call("on_progress", result.patches.count())


# ---------------------------------------------------------------- journal
JOURNAL = "anchor string, status string, runtime_s double, output_uri string, error string"


@dataclass(frozen=True)
class Journal(Configured):
    """An append-only JSON table of what was done with each anchor; the last row of an anchor counts."""

    path: str

    def commit(self, rows: DataFrame) -> None:
        """Append rows of :data:`JOURNAL`; ``written`` orders the appends, ``row`` the rows of one, so that an anchor's last row wins."""
        rows.withColumns({"written": F.lit(time.time_ns()), "row": F.monotonically_increasing_id()}).write.mode("append").json(self.path)

    def read(self, spark: SparkSession) -> DataFrame:
        """All rows; malformed ones are left out with a warning."""
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(self.path)
        if not at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            return spark.createDataFrame([], JOURNAL + ", written long, row long")
        parsed = spark.read.schema(JOURNAL + ", written long, row long, _bad string").option("columnNameOfCorruptRecord", "_bad").json(self.path)
        bad, _ = parsed.agg(F.count("_bad"), F.count("anchor")).first()  # a scan of the bad rows alone isn't allowed
        if bad:
            warnings.warn(f"{bad} malformed journal rows", RuntimeWarning, stacklevel=2)
        return parsed.where("_bad is null").drop("_bad")

    def done(self, spark: SparkSession) -> DataFrame:
        return latest_ok(self.read(spark))

    def pending(self, anchors: DataFrame, key: F.Column) -> DataFrame:
        """The anchors without a successful last row."""
        done = self.done(anchors.sparkSession).select(F.col("anchor").alias("_done"))
        return anchors.join(done, key == F.col("_done"), "left_anti")


def latest_ok(rows: DataFrame) -> DataFrame:
    """Anchors whose last row is a success; ``row``, where there is one, orders the rows of one append."""
    last = F.struct("written", *(["row"] if "row" in rows.columns else []))
    return rows.groupBy("anchor").agg(F.max_by("status", last).alias("status")).where("status = 'ok'").select("anchor")


def anchor_key(*names: str) -> F.Column:
    """The anchor as a JSON array, as the journal has it."""
    return F.concat(F.lit("["), F.concat_ws(",", *[F.col(n).cast("string") for n in names]), F.lit("]"))


# ---------------------------------------------------------------- errors
ERRORS = ("raise", "skip", "retry", "mask")


@dataclass(frozen=True)
class ErrorPolicy(Configured):
    """What happens when a patch operator or reader fails.

    ``skip`` leaves the patch out, ``mask`` gives NULL values, ``retry`` tries ``max_retries``
    times more if the error is one of ``retry_on`` (class names; empty: any), then skips;
    another error is raised.  Every failed try is a row of a table of their own.
    """

    on_error: str = "raise"
    max_retries: int = 3
    retry_on: tuple[str, ...] = ()
    capture_traceback: bool = False

    def __post_init__(self):
        if self.on_error not in ERRORS:
            raise ValueError(f"on_error must be one of {ERRORS}, not {self.on_error!r}")
        if self.max_retries < 0:
            raise ValueError("max_retries can't be negative")

    def apply(self, fn: Callable, data, anchor):
        """(result or None, records of the failed tries)."""
        records = []
        while True:
            try:
                return fn(data), records
            except Exception as e:
                names = {c.__name__ for c in type(e).__mro__}
                wanted = not self.retry_on or bool(names & set(self.retry_on))
                if self.on_error == "raise" or (self.on_error == "retry" and not wanted):
                    raise
                trace = traceback.format_exc() if self.capture_traceback else None
                records.append({"anchor": anchor, "kind": type(e).__name__, "message": str(e), "traceback": trace, "retry_count": len(records)})
                if self.on_error != "retry" or len(records) > self.max_retries:
                    return None, records


def picklable(fn: Callable) -> None:
    try:
        from pyspark import cloudpickle

        cloudpickle.dumps(fn)
    except (pickle.PicklingError, TypeError, AttributeError) as e:
        raise ValueError(f"the operator can't be sent to executors: {e}") from e


@dataclass
class MapResult:
    """Patches that came out, and the failures."""

    patches: DataFrame
    errors: DataFrame = field(repr=False, default=None)


def map_patches(packed: DataFrame, operator: Callable, policy: ErrorPolicy | None = None, max_patch_bytes: int | None = None, hooks: Hooks | None = None) -> MapResult:
    """Run ``operator`` (array -> array of the same shape) on each packed patch.

    Patches are rows with ``shape`` and ``data``; they travel in Arrow batches.  Order is kept
    by ``seq``.  A patch over ``max_patch_bytes`` is an error of the plan.  Unless failures are
    raised, and with hooks, the operator runs once, into a table from which patches and
    errors are read; they belong together even if it is random.
    """
    policy = policy or ErrorPolicy()
    picklable(operator)
    import numpy as np

    def one(row):
        values = np.array(row.data, float).reshape(tuple(row.shape))
        if max_patch_bytes and values.nbytes > max_patch_bytes:
            raise ValueError(f"patch {row.seq} has {values.nbytes} bytes, the budget is {max_patch_bytes}")
        out, records = policy.apply(operator, values, row.seq)
        return np.full(values.shape, np.nan) if out is None and policy.on_error == "mask" else out, records

    return _run(packed, one, policy, hooks)


#: Cells of a batch of patches that :func:`map_gathered` sends; a batch has one patch at least.
CELLS = 1 << 17


def map_gathered(gathered: DataFrame, keys: list[str], value: str, radius: float, operator: Callable, policy: ErrorPolicy | None = None, max_patch_bytes: int | None = None) -> MapResult:
    """Run ``operator`` on the values within ``radius`` of each anchor of blocks that :meth:`RadiusGraph.gathered` made.

    The result is that of :func:`map_patches` on packed patches, but a neighbourhood is cut out of its block's points where the
    operator runs.  So no pair is shuffled, and a task holds the points of a block and ``CELLS`` cells of results.
    """
    policy = policy or ErrorPolicy()
    picklable(operator)
    one, schema = _mapper(operator, policy, max_patch_bytes), gathered.schema
    import numpy as np
    import pyarrow as pa

    def sent(rows: list, kinds: list) -> pa.RecordBatch:
        """Rows (seq, columns of keys, values or None, errors, seconds) as a batch."""
        ends = lambda ns: pa.array(np.cumsum([0, *ns]), pa.int32())
        n = [len(r[1][0]) for r in rows]
        data = [np.empty(0) if r[2] is None else r[2] for r in rows]
        flat = np.concatenate(data)
        return pa.RecordBatch.from_arrays([
            pa.array([r[0] for r in rows], pa.int64()), pa.ListArray.from_arrays(ends(n), pa.StructArray.from_arrays([pa.concat_arrays([r[1][k] for r in rows]) for k in range(len(keys))], fields=[pa.field(c, kind) for c, kind in zip(keys, kinds, strict=True)])),
            pa.array([[k] for k in n], pa.list_(pa.int32())), pa.ListArray.from_arrays(ends(map(len, data)), pa.array(flat, pa.float64(), mask=np.isnan(flat)), mask=pa.array([r[2] is None for r in rows])),
            pa.ListArray.from_arrays(ends(n), pa.array(np.ones(sum(n)))), pa.array([r[3] for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.float64())],
            ["seq", "at", "shape", "data", "weights", "_errors", "runtime_s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, own, rows, cells, kinds = None, [], None, [], 0, None
        for b in batches:
            col = {c: b.column(c) for c in b.schema.names}
            kinds = [col[k].type for k in keys]
            at = np.stack([np.asarray(col[c].to_numpy(zero_copy_only=False), np.int64) for c in ("b0", "b1", "_i", "_anchor")], 1)
            cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]).any(1)) + 1), len(at)]
            for low, high in zip(cuts, cuts[1:]):
                if low == high:
                    continue
                if tuple(at[low, :3]) != block:
                    block, held, own = tuple(at[low, :3]), [], None
                if not at[low, 3]:
                    held.append(b.slice(low, high - low).select([*keys, "x", "y", value]))
                    continue
                if not held:
                    continue
                if own is None:
                    whole = pa.Table.from_batches(held).combine_chunks()
                    named = [whole.column(k).chunk(0) for k in keys]
                    own = named, *(whole.column(c).cast(pa.float64()).to_numpy() for c in ("x", "y", value))
                named, x, y, v = own
                for seq, ax, ay in zip(*(col[c].slice(low, high - low).to_pylist() for c in ("seq", "x", "y")), strict=True):
                    hit = np.flatnonzero(np.sqrt((x - ax) ** 2 + (y - ay) ** 2) <= radius)
                    if not len(hit):
                        continue
                    out, records, took = one(seq, v[hit])
                    rows.append((seq, [k.take(pa.array(hit)) for k in named], out, records, took))
                    cells += len(hit)
                    if cells >= CELLS:
                        yield sent(rows, kinds)
                        rows, cells = [], 0
        if rows:
            yield sent(rows, kinds)

    at = ",".join(f"`{k}`:{schema[k].dataType.simpleString()}" for k in keys)
    done = gathered.mapInArrow(run, f"seq bigint, at array<struct<{at}>>, shape array<int>, data array<double>, weights array<double>, _errors string, runtime_s double")
    return _result(done, policy)


def _mapper(operator: Callable, policy: ErrorPolicy, max_patch_bytes: int | None) -> Callable:
    import numpy as np

    def one(seq, values):
        """(the operator's values or None, failures as JSON or None, seconds)"""
        began = time.perf_counter()
        if max_patch_bytes and values.nbytes > max_patch_bytes:
            raise ValueError(f"patch {seq} has {values.nbytes} bytes, the budget is {max_patch_bytes}")
        out, records = policy.apply(operator, values, seq)
        if out is None and policy.on_error == "mask":
            out = np.full(values.shape, np.nan)
        return None if out is None else np.asarray(out, float).ravel(), json.dumps(records) if records else None, time.perf_counter() - began

    return one


def read_patches(asked: DataFrame, reader: Callable, policy: ErrorPolicy | None = None, max_patch_bytes: int | None = None, hooks: Hooks | None = None) -> MapResult:
    """Packed patches from an opaque ``reader(dict of the row's columns) -> array``, run on the executors.

    ``asked`` has ``seq``, the place to read and ``shape``.  Failed reads follow the policy, as failed operators do.
    """
    policy = policy or ErrorPolicy()
    picklable(reader)
    import numpy as np

    def one(row):
        shape = tuple(int(n) for n in row.shape)
        out, records = policy.apply(lambda r: np.asarray(reader(r), float).reshape(shape), row._asdict(), row.seq)
        if out is None and policy.on_error == "mask":
            out = np.full(shape, np.nan)
        if max_patch_bytes and out is not None and out.nbytes > max_patch_bytes:
            raise ValueError(f"patch {row.seq} has {out.nbytes} bytes, the budget is {max_patch_bytes}")
        return out, records

    empty = F.array().cast("array<double>")
    return _run(asked.withColumns({"data": empty, "weights": F.transform(F.sequence(F.lit(1), F.aggregate("shape", F.lit(1), lambda a, n: a * n)), lambda i: F.lit(1.0))}), one, policy, hooks)


def _run(packed: DataFrame, one: Callable, policy: ErrorPolicy, hooks: Hooks | None) -> MapResult:
    import numpy as np

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            data, errors, took = [], [], []
            for row in batch.itertuples(index=False):
                began = time.perf_counter()
                out, records = one(row)
                took.append(time.perf_counter() - began)
                data.append(None if out is None else np.asarray(out, float).ravel())
                errors.append(json.dumps(records) if records else None)
            yield batch.assign(data=data, _errors=errors, runtime_s=took)

    schema = packed.schema.simpleString()[7:-1] + ",_errors:string,runtime_s:double"
    done = packed.mapInPandas(run, schema)
    nulls = F.transform("data", lambda x: F.nanvl(x, F.lit(None).cast("double")))
    return _result(done, policy, hooks, nulls)


def _result(done: DataFrame, policy: ErrorPolicy, hooks: Hooks | None = None, data: Column | str = "data") -> MapResult:
    """Patches and errors of rows that an operator made; where both are read or a hook is told, they are made once."""
    if policy.on_error != "raise" or hooks:
        done = written(done)
    record = "array<struct<anchor: bigint, kind: string, message: string, traceback: string, retry_count: int>>"
    errors = done.where("_errors is not null").select(F.explode(F.from_json("_errors", record)).alias("e")).select("e.*")
    result = MapResult(done.where("data is not null").drop("_errors").withColumn("data", F.col(data) if isinstance(data, str) else data), errors)
    if hooks:
        hooks.done(result)
    return result


# ---------------------------------------------------------------- stacking and batches
def stack_patches(packed: DataFrame, attribute: str = "data", by: tuple[str, ...] = ()) -> DataFrame:
    """One row ``n, shape, stacked`` for each group ``by``, else for all; its patches need one shape.  Ordered by ``seq``.

    A stack is one row, so name groups of bounded size for a whole field, as the rows of patches.
    Groups also hold ``seqs``, the patches' numbers in the order of the stack; without patches there is no group.
    """
    numbers = [F.array_sort(F.collect_list("seq")).alias("seqs")] if by else []
    out = packed.groupBy(*by).agg(*numbers, F.count("*").alias("n"), F.count(attribute).alias("there"), F.collect_set("shape").alias("shapes"), F.transform(F.array_sort(F.collect_list(F.struct("seq", attribute))), lambda x: x[attribute]).alias("stacked"))
    bad = F.when(F.col("n") == 0, F.lit("no patches to stack")).when(F.col("there") < F.col("n"), F.lit("a patch has no data to stack")).when(F.size("shapes") > 1, F.lit("patches differ in shape"))
    return out.where(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.lit(True))).select(*by, *(["seqs"] if by else []), "n", F.element_at("shapes", 1).alias("shape"), "stacked")


def batch_split(packed: DataFrame, batch_size: int, pad_last: bool = True, by: str = "seq") -> DataFrame:
    """Patches with ``batch, slot, valid``; the last batch is filled with zero patches.

    ``seq`` numbers patches from 0, so batches need no global order.
    """
    own = packed.withColumns({"batch": F.floor(F.col(by) / batch_size), "slot": (F.col(by) % batch_size).cast("long"), "valid": F.lit(True)})
    if not pad_last:
        return own
    last = own.groupBy("batch").agg(F.count("*").alias("held"), F.first("shape").alias("shape"), F.first(F.size("data")).alias("size")).where(F.col("held") < batch_size)
    filled = last.select("batch", "shape", "size", F.explode(F.sequence(F.col("held"), F.lit(batch_size - 1).cast("long"))).alias("slot"))
    filled = filled.select("batch", "slot", "shape", F.array_repeat(F.lit(0.0), F.col("size")).alias("data"), F.lit(False).alias("valid"))
    return own.unionByName(filled, allowMissingColumns=True)


def unbatch(batches: DataFrame) -> DataFrame:
    return batches.where("valid").drop("batch", "slot", "valid")


def deal_by_bytes(packed: DataFrame, most: int) -> DataFrame:
    """Packed patches in tasks of about ``most`` bytes each, in the order of ``seq``: a task has less than ``most`` and its last patch.

    Sizes are added up over all patches; only where tasks begin is gathered, a number for each task.
    """
    if most <= 0:
        raise ValueError("a task needs room for bytes")
    bytes_of = sum((F.coalesce(F.size(c), F.lit(0)) for c in ("data", "weights") if c in packed.columns), F.lit(0)) * 8
    held = written(packed)
    sizes = prefix_sums(held.select("seq", bytes_of.cast("long").alias("bytes")), ["seq"], "bytes")
    begins = [r["seq"] for r in sizes.groupBy(F.floor(F.col("before") / most).alias("task")).agg(F.min("seq").alias("seq")).orderBy("seq").collect()]
    if len(begins) < 2:
        return held.coalesce(1)
    task = F.size(F.filter(F.array(*[F.lit(int(b)) for b in begins[1:]]), lambda b: b <= F.col("seq")))
    return held.repartitionById(len(begins), task)


def deal(packed: DataFrame, tasks: int) -> DataFrame:
    """Patches as tasks of their own accord: dealt by number, each task a share of all."""
    return packed.repartition(tasks, "seq")


def first_seen(df: DataFrame, by: list[str]) -> DataFrame:
    """Groups numbered in the order in which they were first met.

    Numbers are given range by range: places within a range, and what the ranges before it
    hold (as many rows as ranges), so no task has all groups.
    """
    met = df.groupBy(*by).agg(F.min("seq").alias("first")).repartitionByRange("first").withColumn("_range", F.spark_partition_id())
    met = written(met)
    counts = met.groupBy("_range").agg(F.count("*").alias("n"))
    before = counts.select("_range", (F.coalesce(F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_range").orderBy("first", *by)) - 1
    return met.withColumn("place", place).join(F.broadcast(before), "_range").withColumn("place", (F.col("place") + F.col("_before")).cast("long")).drop("_range", "_before")
