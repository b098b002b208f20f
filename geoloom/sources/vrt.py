"""Virtual rasters: XML that places windows of other rasters; read as a lazy plan over their cells."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.model import Raster
from geoloom.operators import warp

from . import tiff


def _rect(node: ET.Element | None, default: tuple[int, int, int, int]) -> tuple[int, int, int, int]:
    return default if node is None else tuple(round(float(node.get(k))) for k in ("xOff", "yOff", "xSize", "ySize"))


def read(spark: SparkSession, path: str, opener: Callable[[SparkSession, str], Raster] = tiff.read) -> Raster:
    """Simple and complex sources: windows, scale ratio and offset, nodata. Later sources paint over earlier ones."""
    text = spark.read.text(path, wholetext=True).first()["value"]
    base = path.rsplit("/", 1)[0]
    root = ET.fromstring(text)
    width, height = int(root.get("rasterXSize")), int(root.get("rasterYSize"))
    gt_text = root.findtext("GeoTransform")
    g = [float(x) for x in gt_text.split(",")] if gt_text else [0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    opened: dict[str, Raster] = {}
    parts: list[DataFrame] = []
    bands = root.findall("VRTRasterBand")
    for k, band in enumerate(bands, 1):
        for seq, s in enumerate([x for x in band if x.tag in ("SimpleSource", "ComplexSource")]):
            name = s.find("SourceFilename")
            where = f"{base}/{name.text}" if name.get("relativeToVRT") == "1" else name.text
            if where not in opened:
                opened[where] = read(spark, where, opener) if where.endswith(".vrt") else opener(spark, where)
            src = opened[where]
            sx, sy, sw, sh = _rect(s.find("SrcRect"), (0, 0, src.width, src.height))
            dx, dy, dw, dh = _rect(s.find("DstRect"), (0, 0, sw, sh))
            cells = src.df.filter(F.col("band") == int(s.findtext("SourceBand", "1"))).filter(F.col("col").between(sx, sx + sw - 1) & F.col("row").between(sy, sy + sh - 1))
            cells = cells.withColumns({"row": F.col("row") - sy, "col": F.col("col") - sx})
            if (dw, dh) != (sw, sh):
                cells = warp.resize(cells, (sh, sw), (dh, dw))
            v = F.col("v")
            if s.findtext("NODATA") is not None:
                v = F.when(v != float(s.findtext("NODATA")), v)
            v = v * float(s.findtext("ScaleRatio", "1")) + float(s.findtext("ScaleOffset", "0"))
            parts.append(cells.select(F.lit(k).alias("band"), (F.col("row") + dy).cast("int").alias("row"), (F.col("col") + dx).cast("int").alias("col"), v.alias("v"), F.lit(seq).alias("seq")))
    if not parts:
        df = spark.createDataFrame([], "band int, row int, col int, v double")
    else:
        union = reduce(lambda a, b: a.unionByName(b), parts)
        df = union.groupBy("band", "row", "col").agg(F.max_by("v", F.when(F.col("v").isNotNull(), F.col("seq"))).alias("v"))
    return Raster(df, width, height, len(bands), (g[0], g[1], g[2], g[3], g[4], g[5]), root.findtext("SRS"), bands[0].get("dataType", "Byte") if bands else "Byte")


def write(width: int, height: int, sources: list[tuple[str, int, tuple[int, int, int, int], tuple[int, int, int, int]]], gt: tuple[float, ...], dtype: str = "Float64", bands: int = 1) -> str:
    """The XML of sources (file, band, source window, target window), each in every band of its number."""
    root = ET.Element("VRTDataset", rasterXSize=str(width), rasterYSize=str(height))
    ET.SubElement(root, "GeoTransform").text = ", ".join(repr(float(x)) for x in gt)
    for k in range(1, bands + 1):
        band = ET.SubElement(root, "VRTRasterBand", dataType=dtype, band=str(k))
        for name, source_band, src, dst in sources:
            if source_band == k:
                s = ET.SubElement(band, "SimpleSource")
                ET.SubElement(s, "SourceFilename", relativeToVRT="0").text = name
                ET.SubElement(s, "SourceBand").text = str(source_band)
                for tag, rect in (("SrcRect", src), ("DstRect", dst)):
                    ET.SubElement(s, tag, dict(zip(("xOff", "yOff", "xSize", "ySize"), map(str, rect), strict=True)))
    return ET.tostring(root, encoding="unicode")


def read_arrays(spark: SparkSession, path: str) -> dict[str, tuple[DataFrame, list]]:
    """Arrays of a multidimensional VRT with inline values or regular spacing: name -> (cells, dimensions)."""
    from geoloom.operators.mdim import Dimension

    root = ET.fromstring(spark.read.text(path, wholetext=True).first()["value"])
    out: dict[str, tuple[DataFrame, list]] = {}

    def group(node: ET.Element, prefix: str, known: dict[str, Dimension]) -> None:
        dims = dict(known)
        for d in node.findall("Dimension"):
            dims[d.get("name")] = Dimension(d.get("name"), int(d.get("size")))
        arrays = node.findall("Array")
        for a in arrays:  # an indexing variable gives its dimension's labels
            spaced = a.find("RegularlySpacedValues")
            refs = [r.get("ref").rsplit("/", 1)[-1] for r in a.findall("DimensionRef")]
            if len(refs) == 1 and spaced is not None and a.get("name") == refs[0]:
                dims[refs[0]] = Dimension(refs[0], dims[refs[0]].size, float(spaced.get("start")), float(spaced.get("increment")))
        for a in arrays:
            own = [dims[r.get("ref").rsplit("/", 1)[-1]] for r in a.findall("DimensionRef")]
            own += [Dimension(d.get("name"), int(d.get("size"))) for d in a.findall("Dimension")]
            total = 1
            for d in own:
                total *= d.size
            cell, cols = F.col("id"), []
            for k in reversed(range(len(own))):
                cols.append((cell % own[k].size).cast("int").alias(f"i{k}"))
                cell = F.call_function("div", cell, F.lit(own[k].size))
            spaced, inline = a.find("RegularlySpacedValues"), a.findtext("InlineValues")
            if spaced is not None:
                v = F.lit(float(spaced.get("start"))) + F.col("id") * float(spaced.get("increment"))
            elif inline is not None:
                values = F.from_json(F.lit("[" + ",".join(inline.replace(",", " ").split()) + "]"), "array<double>")
                v = F.get(values, F.col("id").cast("int"))
            else:
                v = F.lit(float(a.findtext("ConstantValue", "nan")))
            out[prefix + a.get("name")] = (spark.range(total).select(*reversed(cols), v.alias("v")), own)
        for sub in node.findall("Group"):
            group(sub, f"{prefix}{sub.get('name')}/", dims)

    for top in root.findall("Group"):
        group(top, "" if top.get("name") == "/" else f"{top.get('name')}/", {})
    return out
