"""What a field is known to be without reading it: driver-side metadata, never a DataFrame."""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass


class Configured:
    """Every part of a plan tells its settings."""

    def get_config(self) -> dict:
        return {"kind": type(self).__name__, **{k: v for k, v in asdict(self).items() if not callable(v)}}


@dataclass(frozen=True)
class RasterDomain(Configured):
    height: int
    width: int
    bands: int | None = None
    #: x = a * col + b * row + c, y = d * col + e * row + f
    transform: tuple[float, float, float, float, float, float] = (1.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    crs: str | None = None

    @property
    def dims(self) -> dict[str, int]:
        return {"r": self.height, "c": self.width}

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.height, self.width) if self.bands is None else (self.bands, self.height, self.width)

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        a, b, c, d, e, f = self.transform
        xs = [a * x + b * y + c for x in (0, self.width) for y in (0, self.height)]
        ys = [d * x + e * y + f for x in (0, self.width) for y in (0, self.height)]
        return min(xs), min(ys), max(xs), max(ys)


def from_geo_tags(tags: dict) -> tuple[RasterDomain, str]:
    """Domain and cell type of a tiled image from its header's tags, read by whatever opens the file.

    ``width``, ``height``, ``samples``, ``tile_width``, ``tile_height``, ``tiepoint`` (i, j, k, x, y, z) and
    ``pixel_scale`` (x, y, z); ``projected`` or ``geographic`` is the EPSG number, if there is one; ``bits`` and ``sample_format``
    (1 unsigned, 2 signed, 3 floating) are those of the first sample, without them cells are float32.
    An image in strips, or without tie point and scale, is an error.
    """
    if not tags.get("tile_width") or not tags.get("tile_height"):
        raise ValueError("the image is in strips, not in tiles")
    if tags.get("tiepoint") is None or tags.get("pixel_scale") is None:
        raise ValueError("without a tie point and a pixel scale the image has no place")
    i, j, _, x, y, _ = tags["tiepoint"][:6]
    across, down = tags["pixel_scale"][:2]
    number = tags.get("projected") or tags.get("geographic")
    transform = (across, 0.0, x - i * across, 0.0, -down, y + j * down)
    kind = {1: "uint", 2: "int", 3: "float"}.get(tags.get("sample_format"))
    domain = RasterDomain(int(tags["height"]), int(tags["width"]), int(tags.get("samples") or 1), transform, f"EPSG:{int(number)}" if number else None)
    return domain, f"{kind}{int(tags['bits'])}" if kind and tags.get("bits") else "float32"


@dataclass(frozen=True)
class GridDomain(Configured):
    """A labelled dense grid; the order of ``coords`` is the order of the dimensions."""

    coords: dict[str, tuple[float, ...]]
    crs: str | None = None

    @property
    def dims(self) -> dict[str, int]:
        return {k: len(v) for k, v in self.coords.items()}

    @property
    def shape(self) -> tuple[int, ...]:
        return tuple(self.dims.values())

    @property
    def bounds(self) -> dict[str, tuple[float, float]]:
        return {k: (min(v), max(v)) for k, v in self.coords.items()}


@dataclass(frozen=True)
class PointDomain(Configured):
    """Points as (x, y), which is (longitude, latitude)."""

    count: int
    bounds: tuple[float, float, float, float] = (-math.inf, -math.inf, math.inf, math.inf)
    crs: str | None = None


@dataclass(frozen=True)
class VectorDomain(Configured):
    count: int
    bounds: tuple[float, float, float, float] = (-math.inf, -math.inf, math.inf, math.inf)
    crs: str | None = None


@dataclass(frozen=True)
class SeriesDomain(Configured):
    """An integer time axis ``0 .. length - 1``; no length means that every series has its own."""

    length: int | None = None


def extent(domain) -> tuple[int, int] | dict[str, int] | int:
    """(height, width) of a raster, {dimension: length} of a grid, or the number of features."""
    if isinstance(domain, RasterDomain):
        return domain.height, domain.width
    if isinstance(domain, GridDomain):
        return domain.dims
    return domain.count
