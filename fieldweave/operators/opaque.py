"""Aggregations of a user's own: states that Python makes, extends and merges.

Tasks extend a state for each cell they meet, batch by batch, and send the states; these meet in a
tree, at most ``FAN`` tasks' states of a cell at once, each merged into one as the sorted
rows pass by.  So neither the values nor the states of a cell that very many
patches cover are ever gathered.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldweave.domains import Configured
from fieldweave.plans.policy import picklable
from fieldweave.tables import discard, written

#: Tasks whose states meet in one step, and cells of which a task holds states before it sends them.
FAN, HELD = 16, 100_000


@dataclass(frozen=True)
class Opaque(Configured):
    """``init() -> state``, ``update(state, values, weights) -> state`` with a cell's values of a batch as arrays,
    ``merge(state, state) -> state`` in any grouping, ``finalise(state) -> number or None``.

    Values are those with data; ``merge`` must be associative and commutative, as the order of
    rows isn't fixed.  States are pickled between tasks.
    """

    init: Callable
    update: Callable
    merge: Callable
    finalise: Callable
    streaming_safe: bool = True
    outputs: tuple[str, ...] = ("value",)

    def untouched(self) -> dict[str, Column]:
        out = self.finalise(self.init())
        return {"value": F.lit(None if out is None else float(out)).cast("double")}

    def states(self, cells: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
        """``keys, _state``: one mergeable state for each cell, to be kept, merged with others or finished."""
        for fn in (self.init, self.update, self.merge, self.finalise):
            picklable(fn)
        parts = written(self._partial(cells.select(*keys, value.cast("double").alias("_v"), weight.cast("double").alias("_w")), keys))
        n = (parts.agg(F.max("_part")).first()[0] or 0) + 1
        out = parts
        while True:
            n = -(-n // FAN)
            own = out.select(*keys, F.floor(F.col("_part") / FAN).cast("long").alias("_part"), "_state")
            out = self._merged(own.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part"), keys)
            if n <= 1:
                break
        out = written(out.drop("_part"))
        discard(parts)
        return out

    def union(self, states: list[DataFrame], keys: list[str]) -> DataFrame:
        """States of several runs as one for each cell."""
        every = states[0].withColumn("_part", F.lit(0).cast("long"))
        for k, s in enumerate(states[1:], 1):
            every = every.unionByName(s.withColumn("_part", F.lit(k).cast("long")))
        own = every.withColumn("_part", F.lit(0).cast("long"))
        return self._merged(own.select(*keys, "_part", "_state").repartition(*keys).sortWithinPartitions(*keys), keys).drop("_part")

    def finished(self, states: DataFrame, keys: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                found = [self.finalise(pickle.loads(s)) for s in b.column("_state").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array([None if x is None else float(x) for x in found], pa.float64())], names=[*keys, "value"])

        return states.select(*keys, "_state").mapInArrow(run, _schema(states, keys) + ", value double")

    def by_cell(self, cells: DataFrame, keys: list[str], value: Column, weight: Column) -> DataFrame:
        return self.finished(self.states(cells, keys, value, weight), keys)

    def _partial(self, cells: DataFrame, keys: list[str]) -> DataFrame:
        kinds = _schema(cells, keys)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            part, held, kind = TaskContext.get().partitionId(), {}, None

            def send():
                columns = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), kind, strict=True)]
                return pa.RecordBatch.from_arrays([*columns, pa.array([part] * len(held), pa.int64()), pa.array([pickle.dumps(s) for s in held.values()], pa.binary())], names=[*keys, "_part", "_state"])

            for b in batches:
                kind = [b.schema.field(k).type for k in keys]
                table = pa.Table.from_batches([b]).to_pandas()
                v, w = table["_v"].to_numpy(float), table["_w"].to_numpy(float)
                known = ~np.isnan(v)
                order = b.select(keys).to_pylist()
                places: dict[tuple, list[int]] = {}
                for i, row in enumerate(order):
                    places.setdefault(tuple(row.values()), []).append(i)
                for key, rows in places.items():
                    at = np.array(rows)
                    at = at[known[at]]
                    state = held[key] if key in held else self.init()
                    held[key] = self.update(state, v[at], w[at]) if len(at) else state
                if len(held) >= HELD:
                    yield send()
                    held = {}
            if held:
                yield send()

        return cells.mapInArrow(run, f"{kinds}, _part long, _state binary")

    def _merged(self, states: DataFrame, keys: list[str]) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, state, out, kind = None, None, [], None

            def send():
                return pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(zip(*(k for k, _ in out), strict=True), kind, strict=True)), pa.array([pickle.dumps(s) for _, s in out], pa.binary())], names=[*keys, "_part", "_state"])

            for b in batches:
                kind = [*(b.schema.field(k).type for k in keys), pa.int64()]
                for *key, raw in zip(*(b.column(k).to_pylist() for k in (*keys, "_part", "_state")), strict=True):
                    if key == now:
                        state = self.merge(state, pickle.loads(raw))
                        continue
                    if now is not None:
                        out.append((now, state))
                    now, state = key, pickle.loads(raw)
                    if len(out) == 10_000:
                        yield send()
                        out.clear()
            if now is not None:
                out.append((now, state))
                yield send()

        return states.select(*keys, "_part", "_state").mapInArrow(run, _schema(states, keys) + ", _part long, _state binary")


def _schema(df: DataFrame, keys: list[str]) -> str:
    kinds = dict(df.dtypes)
    return ", ".join(f"{k} {kinds[k]}" for k in keys)
