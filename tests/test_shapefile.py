"""Shapefiles of many points: linear cost, files of bounded size, the same rows."""

from __future__ import annotations

import struct
import time

import pytest

from geoloom.functions import geometry as g
from geoloom.sources import shapefile

FIELDS = [("id", "N", 11, 0), ("name", "C", 254, 0)]


def test_encoding_is_linear():
    """20,000 wide records took 12 s when each was appended to a copy of those before it."""
    rows = [(float(k), 1.0, k, str(k)) for k in range(20_000)]
    began = time.process_time()
    shp, dbf = shapefile.encode_points(rows, FIELDS)
    assert time.process_time() - began < 3
    assert len(shp) == 100 + 28 * len(rows) and shapefile.dbf_columns(dbf) == [[r[2] for r in rows], [r[3] for r in rows]]
    assert shapefile.shapes(shp) == [(1, [r[0], r[1]]) for r in rows]


def test_a_partition_makes_several_files(spark, tmp_path):
    rows = [(k / 4, -k / 2, k if k % 7 else None, f"é{k}") for k in range(500)]
    df = spark.createDataFrame(rows, "x double, y double, id long, name string").coalesce(1)
    paths = shapefile.write_points(df, f"file://{tmp_path}/out", FIELDS, file_bytes=294 * 60)
    assert len(paths) == 9 and sorted(p.name for p in (tmp_path / "out").glob("*.shp")) == [p.rsplit("/", 1)[-1] for p in paths]
    assert not (tmp_path / "out.parts").exists()
    got = shapefile.read(spark, f"file://{tmp_path}/out/*.shp").df.collect()
    assert sorted((*g.from_wkb(bytes(r["geom"]))[1], r["id"], r["name"]) for r in got if r["id"] is not None) == sorted(r for r in rows if r[2] is not None)
    assert len(got) == 500 and all((r["env"]["xmin"], r["env"]["ymax"]) == tuple(g.from_wkb(bytes(r["geom"]))[1]) for r in got)


def test_other_shapes_and_lengths(spark, tmp_path):
    """A null shape beside points is read one by one; a .dbf of another length is refused."""
    shp, dbf = shapefile.encode_points([(1.0, 2.0, 1, "a"), (3.0, 4.0, 2, "b")], FIELDS)
    (tmp_path / "n.shp").write_bytes(shp + struct.pack(">II", 3, 2) + struct.pack("<i", 0))
    (tmp_path / "n.dbf").write_bytes(dbf)
    with pytest.raises(Exception, match="3 shapes beside 2 rows"):
        shapefile.read(spark, f"file://{tmp_path}/n.shp").df.collect()
    (tmp_path / "n.dbf").write_bytes(shapefile.encode_points([(0.0, 0.0, k, str(k)) for k in (1, 2, 10**17 + 1)], [("id", "N", 18, 0)])[1])
    got = shapefile.read(spark, f"file://{tmp_path}/n.shp").df.orderBy("fid").collect()
    assert [(r["id"], r["geom"] and g.from_wkb(bytes(r["geom"]))) for r in got] == [(1, (1, [1.0, 2.0])), (2, (1, [3.0, 4.0])), (10**17 + 1, None)]
