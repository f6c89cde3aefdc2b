"""Weights over a patch: one-dimensional tapers, computed once on the driver, as literal arrays.

A patch weight is the product of its axes' tapers, so a plan holds sum(n) numbers, not
prod(n), and looks them up inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldweave.domains import Configured


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


class Window(Configured):
    def taper(self, n: int) -> np.ndarray:
        raise NotImplementedError

    def weight(self, offsets: Sequence[Column], sizes: Sequence[int]) -> Column:
        """Weight at ``offsets`` in a patch of ``sizes``."""
        out = F.lit(1.0)
        for at, n in zip(offsets, sizes, strict=True):
            out = out * F.get(literal(self.taper(n)), at.cast("int"))
        return out


@dataclass(frozen=True)
class Boxcar(Window):
    def taper(self, n: int) -> np.ndarray:
        return np.ones(n)

    def weight(self, offsets, sizes) -> Column:
        return F.lit(1.0)


@dataclass(frozen=True)
class Hann(Window):
    """Symmetric, zero at both ends."""

    def taper(self, n: int) -> np.ndarray:
        return np.hanning(n)


@dataclass(frozen=True)
class Tukey(Window):
    """Periodic cosine taper: the symmetric one of n + 1 points without its last."""

    alpha: float = 0.5

    def taper(self, n: int) -> np.ndarray:
        if n <= 1 or self.alpha <= 0:
            return np.ones(n)
        at = np.arange(n) / n
        if self.alpha >= 1:
            return 0.5 - 0.5 * np.cos(2 * np.pi * at)
        rising, falling = at <= math.floor(self.alpha * n / 2) / n, at >= 1 - math.floor(self.alpha * n / 2) / n
        up = 0.5 * (1 + np.cos(np.pi * (2 * at / self.alpha - 1)))
        down = 0.5 * (1 + np.cos(np.pi * (2 * at / self.alpha - 2 / self.alpha + 1)))
        return np.where(rising, up, np.where(falling, down, 1.0))


@dataclass(frozen=True)
class Gaussian(Window):
    """``sigma`` is relative to half the length."""

    sigma: float = 0.5

    def taper(self, n: int) -> np.ndarray:
        if n <= 1:
            return np.ones(n)
        return np.exp(-0.5 * ((np.arange(n) - (n - 1) / 2) / max(self.sigma * n / 2, 1e-12)) ** 2)


@dataclass(frozen=True)
class Custom(Window):
    """Any weights: ``fn`` is called once on the driver with the patch size and returns an array of that shape."""

    fn: Callable[[tuple[int, ...]], np.ndarray]

    def weight(self, offsets, sizes) -> Column:
        values = np.asarray(self.fn(tuple(sizes)), float)
        if values.shape != tuple(sizes):
            raise ValueError(f"weights have shape {values.shape}, patches {tuple(sizes)}")
        at = F.lit(0)
        for x, n in zip(offsets, sizes, strict=True):
            at = at * n + x.cast("int")
        return F.get(literal(values.ravel()), at)


# ---------------------------------------------------------------- time
class TemporalWindow(Configured):
    def weight(self, at: Column, n: Column) -> Column:
        """Weight of the ``at``-th of ``n`` times."""
        return F.lit(1.0)


@dataclass(frozen=True)
class CausalBoxcar(TemporalWindow):
    pass


@dataclass(frozen=True)
class Periodic(TemporalWindow):
    """Ones; the period is a note for the reader."""

    period: int = 1


@dataclass(frozen=True)
class ExponentialDecay(TemporalWindow):
    tau: float = 1.0

    def weight(self, at: Column, n: Column) -> Column:
        return F.exp(-(n - 1 - at) / F.lit(max(self.tau, 1e-12)))


@dataclass(frozen=True)
class TaperedTukey(TemporalWindow):
    """Periodic cosine taper of the window's actual length."""

    alpha: float = 0.5

    def weight(self, at: Column, n: Column) -> Column:
        if self.alpha <= 0:
            return F.lit(1.0)
        x, a = at / n, self.alpha
        if a >= 1:
            return F.when(n <= 1, F.lit(1.0)).otherwise(0.5 - 0.5 * F.cos(2 * math.pi * x))
        edge = F.floor(a * n / 2)
        up, down = 0.5 * (1 + F.cos(math.pi * (2 * x / a - 1))), 0.5 * (1 + F.cos(math.pi * (2 * x / a - 2 / a + 1)))
        return F.when(n <= 1, F.lit(1.0)).when(at <= edge, up).when(at >= n - edge, down).otherwise(F.lit(1.0))
