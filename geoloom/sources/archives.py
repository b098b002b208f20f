"""Members of ZIP, TAR and GZIP files as rows."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def _members(name: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    if raw[:2] == b"PK":
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            yield from ((i.filename, z.read(i)) for i in z.infolist() if not i.is_dir())
    elif name.endswith((".tar", ".tgz", ".tar.gz")):
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            yield from ((m.name, t.extractfile(m).read()) for m in t if m.isfile())
    elif raw[:2] == b"\x1f\x8b":
        yield name.rsplit("/", 1)[-1].removesuffix(".gz"), gzip.decompress(raw)
    else:
        yield name.rsplit("/", 1)[-1], raw


def members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, content of every member; an archive per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, raw in zip(b["path"].to_pylist(), b["content"].to_pylist(), strict=True):
                for member, content in _members(name, raw):
                    yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([member]), pa.array([content], pa.binary())], names=["archive", "name", "content"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, name string, content binary")
