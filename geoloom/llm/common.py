"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows a Python kernel turns into Python objects at a time; an Arrow batch is cut into slices of this many.
SLICE_ROWS = 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, on a single machine, one of our own."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return own_dir()


@cache
def own_dir() -> str:
    path = tempfile.mkdtemp(prefix="geoloom-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return f"file://{path}"


class Workspace:
    """Parquet tables in the shared folder that cut lineage; each can be dropped as soon as nothing reads it.

    What is left when the driver ends is removed then: a returned DataFrame may still read it until that moment.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self.close)

    def write(self, df: DataFrame, name: str, batch: int | None = None) -> DataFrame:
        """Writes df and gives it back as read from the shared folder. batch: rows that Python kernels get at a time, where
        rows hold whole texts."""
        path, key = f"{self.root}/{name}", "spark.sql.execution.arrow.maxRecordsPerBatch"
        before = self.spark.conf.get(key)
        try:
            if batch:
                self.spark.conf.set(key, str(batch))
            df.write.parquet(path)
        finally:
            self.spark.conf.set(key, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of plans that nobody holds any more."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, name: str = "") -> None:
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def close(self) -> None:
        try:
            self.drop()
        except Exception:  # the session has ended: its folder is the cluster's to clean
            pass


def by_slices(fn: Callable[[dict[str, list]], dict[str, list]], schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterable[pa.RecordBatch]]:
    """A mapInArrow function from one over columns as Python lists; only a slice of a batch is held as objects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                out = fn(batch.slice(at, SLICE_ROWS).to_pydict())
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], f.type) for f in schema], schema=schema)

    return run


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def id_remainder(column: str, modulus: int):
    """crc32 of an id's decimal text, modulo."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % modulus



def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is computed once a row although use may name it in lambdas."""
    return F.transform(F.array(value), use)[0]


def merged(spans: Column) -> Column:
    """array<struct<start,end>> of the maximal runs that spans (struct<start,end>, any order, end exclusive) cover."""
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform(F.filter(spans, lambda s: s["end"] > s["start"]), lambda s: F.sequence(s["start"], s["end"] - 1)))))

    def runs(at: Column) -> Column:
        starts = F.filter(at, lambda x, i: (i == 0) | (F.get(at, i - 1) + 1 != x))
        ends = F.transform(F.filter(at, lambda x, i: (i == F.size(at) - 1) | (F.get(at, i + 1) - 1 != x)), lambda x: x + 1)
        return F.transform(F.arrays_zip(starts.alias("a"), ends.alias("b")), lambda r: F.struct(r["a"].alias("start"), r["b"].alias("end")))

    return bound(covered, runs)


def clear_of(columns: list[str], name: str) -> str:
    """name, with underscores before it until no column has it (case doesn't count)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: A key with more than this part of the rows is hot, so there are at most as many hot keys as its inverse.
HOT_PART = 1 / 2000


def join_hot(rows: DataFrame, facts: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """rows joined to facts, which has one row per key and in `count` the number of rows with it; total: the number of rows.

    Rows of hot keys meet their facts by broadcast, where they are; there are less than 1 / HOT_PART such keys.
    """
    hot = F.col(count) > total * HOT_PART
    few = facts.filter(hot)
    most = rows.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(facts.filter(~hot), keys)
    return most.unionByName(rows.join(F.broadcast(few), keys))
