"""Layers, rasters and arrays as DataFrames with side metadata.

    features : fid LONG, <attributes>, geom BINARY (WKB), env STRUCT<xmin, ymin, xmax, ymax DOUBLE>
    cells    : band INT, row INT, col INT, v DOUBLE (null: no data)
    mdcells  : i0 INT, i1 INT, ..., v DOUBLE
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Layer:
    """A vector layer."""

    df: DataFrame
    name: str = "layer"
    geometry_type: str = "Unknown"
    crs: str | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def with_df(self, df: DataFrame, **changes: object) -> Layer:
        return replace(self, df=df, **changes)

    @property
    def attributes(self) -> list[str]:
        return [c for c in self.df.columns if c not in ("fid", "geom", "env")]


@dataclass(frozen=True)
class Raster:
    """A raster; gt is (x0, dx, 0, y0, 0, dy)."""

    df: DataFrame
    width: int
    height: int
    bands: int = 1
    gt: tuple[float, ...] = (0.0, 1.0, 0.0, 0.0, 0.0, 1.0)
    crs: str | None = None
    dtype: str = "Float64"
    nodata: float | None = None
    metadata: dict[str, str] = field(default_factory=dict)

    def with_df(self, df: DataFrame, **changes: object) -> Raster:
        return replace(self, df=df, **changes)
