"""Files and datasets through Hadoop's file systems: list, copy, move, delete, sync, identify."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def _fs(spark: SparkSession, path: str):  # noqa: ANN202
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def listing(spark: SparkSession, path: str, recursive: bool = False) -> list[dict]:
    fs, p = _fs(spark, path)
    out = []
    for s in fs.listStatus(p):
        out.append({"path": s.getPath().toString(), "size": s.getLen(), "directory": s.isDirectory(), "modified": s.getModificationTime()})
        if recursive and s.isDirectory():
            out += listing(spark, s.getPath().toString(), True)
    return sorted(out, key=lambda x: x["path"])


def copy(spark: SparkSession, source: str, target: str, delete_source: bool = False) -> None:
    (a, p), (b, q) = _fs(spark, source), _fs(spark, target)
    spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil.copy(a, p, b, q, delete_source, spark.sparkContext._jsc.hadoopConfiguration())


def move(spark: SparkSession, source: str, target: str) -> None:
    (fs, p), (_, q) = _fs(spark, source), _fs(spark, target)
    if not fs.rename(p, q):
        raise OSError(f"{source} can't be moved to {target}")


def delete(spark: SparkSession, path: str, recursive: bool = False) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, recursive)


def sync(spark: SparkSession, source: str, target: str) -> list[str]:
    """Copies the files of a folder that the target lacks, or has with another size or an older time."""
    have = {x["path"].rsplit("/", 1)[-1]: x for x in listing(spark, target)} if _fs(spark, target)[0].exists(_fs(spark, target)[1]) else {}
    done = []
    for x in listing(spark, source):
        name = x["path"].rsplit("/", 1)[-1]
        old = have.get(name)
        if not x["directory"] and (old is None or old["size"] != x["size"] or old["modified"] < x["modified"]):
            copy(spark, x["path"], f"{target}/{name}")
            done.append(name)
    return done


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.getFileStatus(p).isDirectory()


def head(spark: SparkSession, path: str, size: int = 4096) -> bytes:
    """The first bytes of a file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(spark.sparkContext._jvm.org.apache.commons.io.input.BoundedInputStream(stream, size)))
    finally:
        stream.close()


def write_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    fs, p = _fs(spark, path)
    stream = fs.create(p, True)
    try:
        stream.write(content)
    finally:
        stream.close()


#: What a file of a format begins with.
MAGIC = {b"II*\0": "TIFF", b"MM\0*": "TIFF", b"II+\0": "TIFF", b"MM\0+": "TIFF", b"\0\0\x27\x0a": "Shapefile", b"PAR1": "Parquet"}
TEXTS = [
    (r"^\s*<VRTDataset", "VRT"),
    (r'"type"\s*:\s*"Topology"', "TopoJSON"),
    (r'"geometryType"\s*:\s*"esri|"esriFieldType', "ESRIJSON"),
    (r'^\x1e?\s*\{[^\n]*"type"\s*:\s*"Feature"[^\n]*\}\s*\n', "GeoJSONSeq"),
    (r'"type"\s*:\s*"(Feature|FeatureCollection|Point|LineString|Polygon|Multi\w+|GeometryCollection)"', "GeoJSON"),
    (r'"type"\s*:\s*"pipeline"', "Pipeline"),
]


def format_of(first: bytes) -> str | None:
    text = first.decode("latin-1")
    return MAGIC.get(first[:4]) or next((kind for pattern, kind in TEXTS if re.search(pattern, text)), None)


def identify(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """path and format of the files that a reader knows, by their first bytes: nothing else of a file is read."""
    found = [(x["path"], format_of(head(spark, x["path"]))) for x in listing(spark, path, recursive) if not x["directory"]]
    return spark.createDataFrame([x for x in found if x[1]], "path string, format string")


#: Files that stand beside those of a format, by their ending.
BESIDE = {".shp": (".shx", ".dbf", ".prj", ".cpg"), ".tif": (".tfw", ".tif.aux.xml", ".tif.ovr")}


def members(spark: SparkSession, path: str) -> list[str]:
    """A dataset's files: path, and what stands beside it."""
    stem, end = path[: path.rfind(".")], path[path.rfind(".") :].lower()
    beside = [stem + x for x in BESIDE.get(end, ())]
    return [path, *[x for x in beside if _fs(spark, x)[0].exists(_fs(spark, x)[1])]]


def copy_dataset(spark: SparkSession, source: str, target: str, delete_source: bool = False) -> list[str]:
    """Copies (or moves) a dataset with the files beside it."""
    old, new = source[: source.rfind(".")], target[: target.rfind(".")]
    out = []
    for x in members(spark, source):
        out.append(new + x[len(old) :])
        copy(spark, x, out[-1], delete_source)
    return out


def delete_dataset(spark: SparkSession, path: str) -> list[str]:
    own = members(spark, path)
    for x in own:
        delete(spark, x)
    return own


def check(spark: SparkSession, path: str) -> str | None:
    """Why a dataset can't be read to its end, or None: every row or cell is read."""
    from . import geojson, shapefile, tiff, vrt

    kind = format_of(head(spark, path))
    readers = {"TIFF": tiff.read, "VRT": vrt.read, "GeoJSON": geojson.read, "GeoJSONSeq": geojson.read_seq, "ESRIJSON": geojson.read_esri, "Shapefile": shapefile.read}
    if kind == "Parquet":
        frames = [lambda: spark.read.parquet(path)]
    elif kind == "TopoJSON":
        frames = [lambda: next(iter(geojson.read_topojson(spark, path).values())).df]
    elif kind in readers:
        frames = [lambda: readers[kind](spark, path).df]
    else:
        return "no reader knows it"
    try:
        for frame in frames:
            frame().write.format("noop").mode("overwrite").save()
    except Exception as e:  # whatever a reader or a task raises is the finding
        return (str(e).splitlines() or [type(e).__name__])[0]
    return None
