"""Connected components of cells, and what builds on them: polygonize, sieve, footprint, clean-collar.

Two levels: each tile is labelled by union-find in one Arrow group, then labels of neighbouring tiles that touch are
joined by propagating the least label over the graph of borders, which is far smaller than the raster.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import cache


import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TILE = 256


@cache
def own_dir() -> str:
    path = tempfile.mkdtemp(prefix="geoloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder (see shared_path)."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_path(spark: SparkSession) -> str:
    """A new path in the folder that spark.checkpoint.dir names; on a single machine, where it is unset, in one of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(base or own_dir()).rstrip('/')}/geoloom-{uuid.uuid4().hex}"


def _label(values: np.ndarray, valid: np.ndarray, eight: bool) -> np.ndarray:
    """Labels of equal neighbouring values: the least index of each component, -1 where not valid. Union-find over pixel pairs by halving."""
    h, w = values.shape
    parent = np.arange(h * w)
    idx = parent.reshape(h, w)
    pairs = []
    shifts = [((slice(None), slice(1, None)), (slice(None), slice(None, -1))), ((slice(1, None), slice(None)), (slice(None, -1), slice(None)))]
    if eight:
        shifts += [((slice(1, None), slice(1, None)), (slice(None, -1), slice(None, -1))), ((slice(1, None), slice(None, -1)), (slice(None, -1), slice(1, None)))]
    for a, b in shifts:
        same = (values[a] == values[b]) & valid[a] & valid[b]
        pairs.append(np.stack([idx[a][same], idx[b][same]]))
    i, j = np.concatenate(pairs, axis=1)
    while True:  # roots hook onto lesser roots, then paths are halved until flat
        a, b = parent[i], parent[j]
        differ = a != b
        if not differ.any():
            break
        low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
        np.minimum.at(parent, high, low)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent = up
    out = parent.copy().reshape(h, w)
    out[~valid] = -1
    return out


def components(df: DataFrame, width: int, eight: bool = False, tile: int = TILE) -> DataFrame:
    """row, col, v, label: the least row * width + col of the component. Null values have no label."""
    cells = df.select("row", "col", F.col("v").cast("double").alias("v"), F.expr(f"row div {tile}").cast("int").alias("tr"), F.expr(f"col div {tile}").cast("int").alias("tc"))
    schema = "row int, col int, v double, tr int, tc int, local long"

    def run(t: pa.Table) -> pa.Table:
        r, c = t["row"].to_numpy(), t["col"].to_numpy()
        v = t["v"].to_numpy(zero_copy_only=False)
        r0, c0 = r.min(), c.min()
        values = np.full((r.max() - r0 + 1, c.max() - c0 + 1), np.nan)
        values[r - r0, c - c0] = v
        labels = _label(values, ~np.isnan(values), eight)[r - r0, c - c0]
        w = values.shape[1]
        own = (labels // w + r0).astype(np.int64) * width + labels % w + c0
        return t.append_column("local", pa.array(np.where(labels >= 0, own, -1), pa.int64())).cast(pa.schema([("row", pa.int32()), ("col", pa.int32()), ("v", pa.float64()), ("tr", pa.int32()), ("tc", pa.int32()), ("local", pa.int64())]))

    local = cut_lineage(cells.groupBy("tr", "tc").applyInArrow(run, schema)).filter("local >= 0")
    near = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    edge = local.filter(f"row % {tile} in (0, {tile - 1}) or col % {tile} in (0, {tile - 1})")
    sent = edge.select("v", F.col("local").alias("b"), F.col("tr").alias("btr"), F.col("tc").alias("btc"), F.explode(F.array(*[F.struct((F.col("row") - dr).alias("row"), (F.col("col") - dc).alias("col")) for dr, dc in near])).alias("p")).select("v", "b", "btr", "btc", "p.*")
    links = edge.select("row", "col", "v", F.col("local").alias("a"), "tr", "tc").join(sent, ["row", "col", "v"]).filter("tr <> btr or tc <> btc").select("a", "b").distinct()
    labels = least_labels(links)
    out = local.join(labels.toDF("local", "label"), "local", "left")
    return out.select("row", "col", "v", F.coalesce("label", "local").alias("label"))


def least_labels(links: DataFrame) -> DataFrame:
    """node, label for the nodes of links (a, b): the least node of the component, by propagation and shortening."""
    both = cut_lineage(links.union(links.select("b", "a")).distinct().toDF("node", "other"))
    labels = cut_lineage(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")))
    while True:
        seen = both.join(labels.toDF("other", "near"), "other").groupBy("node").agg(F.min("near").alias("near"))
        moved = cut_lineage(labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        new = cut_lineage(moved.join(moved.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").select("node", "old", F.least("label", F.coalesce("top", "label")).alias("label")))
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels


def polygonize(df: DataFrame, width: int, eight: bool = False) -> DataFrame:
    """One row per component: label, v, cells, the bounding box in pixels, and the length of its boundary."""
    found = cut_lineage(components(df, width, eight))
    key = lambda dr, dc: found.select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("label").alias("other"))
    same = None
    for dr, dc in ((0, 1), (1, 0)):
        joined = found.join(key(dr, dc), ["row", "col"]).filter("label = other").groupBy("label").agg(F.count("*").alias("inner"))
        same = joined if same is None else same.unionByName(joined)
    inner = same.groupBy("label").agg(F.sum("inner").alias("inner"))
    boxes = found.groupBy("label").agg(F.first("v").alias("v"), F.count("*").alias("cells"), F.min("col").alias("xmin"), F.min("row").alias("ymin"), (F.max("col") + 1).alias("xmax"), (F.max("row") + 1).alias("ymax"))
    return boxes.join(inner, "label", "left").select("label", "v", "cells", "xmin", "ymin", "xmax", "ymax", (4 * F.col("cells") - 2 * F.coalesce("inner", F.lit(0))).alias("perimeter"))


def rings(df: DataFrame, width: int, eight: bool = False) -> DataFrame:
    """label, v, rings: the closed boundary rings of each component in pixel corners, traced per component by Arrow.

    A component is one group, so its cells must fit in a task.
    """
    found = components(df, width, eight)

    def run(batch: pa.Table) -> pa.Table:
        cells = set(zip(batch["row"].to_pylist(), batch["col"].to_pylist(), strict=True))
        after: dict[tuple, list[tuple]] = {}
        for r, c in cells:  # edges run with the component on the right
            for there, a, b in (((r - 1, c), (c, r), (c + 1, r)), ((r, c + 1), (c + 1, r), (c + 1, r + 1)), ((r + 1, c), (c + 1, r + 1), (c, r + 1)), ((r, c - 1), (c, r + 1), (c, r))):
                if there not in cells:
                    after.setdefault(a, []).append(b)
        out = []
        while after:
            start = min(after)
            ring, at, before = [start], start, None
            while True:
                ends = after[at]
                k = 0
                if len(ends) > 1 and before is not None:  # at a pinch, turn so as to stay with the same cell
                    d = (at[0] - before[0], at[1] - before[1])
                    right = (at[0] - d[1], at[1] + d[0])
                    k = ends.index(right) if right in ends else 0
                nxt = ends.pop(k)
                if not ends:
                    del after[at]
                before, at = at, nxt
                ring.append(at)
                if at == start:
                    break
            flat = [p for k, p in enumerate(ring[:-1]) if (ring[k - 1 if k else -2][0] - p[0], ring[k - 1 if k else -2][1] - p[1]) != (p[0] - ring[k + 1][0], p[1] - ring[k + 1][1])]
            out.append([list(map(float, p)) for p in [*flat, flat[0]]])
        return pa.table({"label": [batch["label"][0].as_py()], "v": [batch["v"][0].as_py()], "rings": pa.array([out], pa.list_(pa.list_(pa.list_(pa.float64()))))})

    return found.groupBy("label").applyInArrow(run, "label long, v double, rings array<array<array<double>>>")


def sieve(df: DataFrame, width: int, threshold: int, eight: bool = False) -> DataFrame:
    """Components of less than threshold cells take the value of their largest neighbour (the least label among equals).

    Chains of small components are followed to the first that is large enough; a ring of small ones stays.
    """
    found = cut_lineage(components(df, width, eight))
    sizes = found.groupBy("label").agg(F.count("*").alias("size"), F.first("v").alias("v"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if eight else [])
    pairs = None
    for dr, dc in steps:
        moved = found.select((F.col("row") + dr).alias("row"), (F.col("col") + dc).alias("col"), F.col("label").alias("b"))
        touch = found.select("row", "col", F.col("label").alias("a")).join(moved, ["row", "col"]).filter("a <> b").select("a", "b")
        both = touch.union(touch.select("b", "a"))
        pairs = both if pairs is None else pairs.union(both)
    pairs = pairs.distinct().toDF("label", "near")
    best = pairs.join(sizes.select(F.col("label").alias("near"), F.col("size").alias("near_size")), "near").groupBy("label").agg(F.max(F.struct("near_size", (-F.col("near")).alias("minus"))).alias("m")).select("label", (-F.col("m.minus")).alias("to"))
    tree = cut_lineage(sizes.join(best, "label", "left").select("label", "size", "v", F.when(F.col("size") < threshold, F.coalesce("to", "label")).otherwise(F.col("label")).alias("to")))
    for _ in range(64):
        up = tree.select(F.col("label").alias("to"), F.col("to").alias("next"))
        new = cut_lineage(tree.join(up, "to", "left").select("label", "size", "v", "to", F.coalesce("next", "to").alias("next")))
        moved = new.filter("next <> to and next <> label").limit(1).count()
        tree = new.select("label", "size", "v", F.when(F.col("next") == F.col("label"), F.col("to")).otherwise(F.col("next")).alias("to"))
        if not moved:
            break
    values = tree.select(F.col("to"), "label").join(sizes.select(F.col("label").alias("to"), F.col("v").alias("new")), "to").select("label", "new")
    return found.join(values, "label").select("row", "col", F.col("new").alias("v"))


def footprint(df: DataFrame, width: int, combine: str = "union") -> DataFrame:
    """Components of the mask of valid cells over all bands: label, cells, bounding box."""
    valid = F.max(F.when(F.col("v").isNotNull(), 1).otherwise(0)) if combine == "union" else F.min(F.when(F.col("v").isNotNull(), 1).otherwise(0))
    mask = df.groupBy("row", "col").agg(valid.alias("m")).select("row", "col", F.when(F.col("m") == 1, 1.0).alias("v"))
    return polygonize(mask, width).drop("v")


def clean_collar(df: DataFrame, width: int, height: int, color: float = 0.0, near: float = 15.0) -> DataFrame:
    """row, col, v, collar: whether a cell belongs to the near-colour area that touches the border."""
    mask = df.withColumn("x", F.col("v")).select("row", "col", F.when(F.abs(F.col("v") - color) <= near, 1.0).alias("v"))
    found = cut_lineage(components(mask, width))
    border = found.filter(f"row in (0, {height - 1}) or col in (0, {width - 1})").select("label").distinct()
    inside = found.join(border, "label").select("row", "col", F.lit(True).alias("hit"))
    return df.join(inside, ["row", "col"], "left").select("row", "col", "v", F.coalesce("hit", F.lit(False)).alias("collar"))


