"""Pairs of near points, told both ways in an order that a file keeps in few bytes; runs inside tasks, on two blocks of points at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Numbers that Parquet packs at a time: runs of a multiple are the same bytes wherever they stand.
EIGHT = 8
#: Candidates that are compared at a time.
MOST = 65536


def unit_sphere(lonlat: np.ndarray) -> np.ndarray:
    lon, lat = np.radians(lonlat).T
    return np.column_stack([np.cos(lat) * np.cos(lon), np.cos(lat) * np.sin(lon), np.sin(lat)])


def along(at: np.ndarray) -> np.ndarray:
    """An order of places in which ``EIGHT`` that follow each other lie close together: along strips."""
    across, down = np.argsort(-np.ptp(at, axis=0))[:2]
    strip = np.empty(len(at), "i8")
    strip[np.argsort(at[:, across], kind="stable")] = np.arange(len(at)) // (EIGHT * round((len(at) / EIGHT) ** 0.5 + 0.5))
    return np.lexsort((at[:, down], strip))


def of_blocks(xy: np.ndarray, at: np.ndarray, n: int, reach: float, own: bool, run: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """Numbers of points within ``reach``, one of the first ``n`` and one of the others, the sizes of their runs, and whether they are told back too.

    A point meets eights of others whose points are all near, so that a run is the same for many points; what is near in other eights comes
    in runs of its own.  In a bucket of its own a point takes those behind it; points in one place meet each other, and themselves, one way.
    """
    here, there, rest, wide = along(at[:n]), n + along(at[n:]), [], max(run // EIGHT, 1) * EIGHT

    def runs(whole: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, bool]:
        i, j = (np.concatenate(x) for x in zip(*rest))
        m = len(i) - (len(i) % wide if whole else 0)
        rest[:] = [(i[m:], j[m:])]
        return i[:m], j[:m], np.array([wide] * (m // wide) + [m % wide]), True

    for js in np.split(there, range(wide, len(there), wide)):
        for a in np.split(here, range(MOST // wide, n, MOST // wide)):
            near = sum((at[a, d, None] - at[js, d]) ** 2 for d in range(at.shape[1])) <= reach**2
            if own:
                (ax, ay), (x, y) = xy[a].T[:, :, None], xy[js].T
                i, j = np.nonzero(near & (ax == x) & (ay == y))
                yield a[i], js[j], np.array([len(i)]), False
                near &= (ax < x) | ((ax == x) & (ay < y))
            whole = np.zeros_like(near)
            full = len(js) // EIGHT * EIGHT
            whole[:, :full] = np.repeat(near[:, :full].reshape(len(a), -1, EIGHT).all(2), EIGHT, axis=1)
            i, j = np.nonzero(whole)
            yield a[i], js[j], whole.sum(1), True
            i, j = np.nonzero(near & ~whole)
            rest.append((a[i], js[j]))
            if sum(len(i) for i, _ in rest) > MOST:
                yield runs(True)
    yield runs(False)


def runs_of(key: str, reach: float, sphere: bool, run: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From rows ``_own``, ``_here`` (seq, ax, ay) and ``_there`` (key, x, y) runs of all pairs that may be near, as ``_run``; ``_back`` if they count both ways."""

    def told(batches):
        for batch in batches:
            for own, a, b in zip(*(batch.column(c) for c in ("_own", "_here", "_there"))):
                (seq, ax, ay), (to, x, y) = a.values.flatten(), b.values.flatten()
                ids, xy = pa.concat_arrays([seq, to]), np.column_stack([np.concatenate([ax, x]), np.concatenate([ay, y])])
                with np.errstate(all="ignore"):
                    for i, j, sizes, back in of_blocks(xy, unit_sphere(xy) if sphere else xy, len(seq), reach, own.as_py(), run):
                        sizes = sizes[sizes > 0]
                        if len(sizes):
                            told = pa.StructArray.from_arrays([ids.take(pa.array(i)), *xy[i].T.copy(), ids.take(pa.array(j)), *xy[j].T.copy()], ["seq", "ax", "ay", key, "x", "y"])
                            yield pa.RecordBatch.from_arrays([pa.array([back] * len(sizes)), pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), "i4"), told)], ["_back", "_run"])

    return told
