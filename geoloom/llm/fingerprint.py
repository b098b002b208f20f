"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (lines). Each paragraph hashes to a wide vector, and a fingerprint is the
sum of its paragraphs' vectors, lane by lane, modulo a power of two:

* 32 lanes modulo 2**64, from SHAKE-128 of the paragraph: these decide equality;
* 128 lanes modulo 2**32, the sum of +1/-1 signs hashed from the paragraph's word pairs: their inner products estimate
  how alike two fingerprints are. A lane is exact for texts of up to 2**31 words.

So the order of paragraphs doesn't matter, and a paragraph is inserted or deleted by adding or subtracting its vector: the
edited text's fingerprint comes from the original one's, less the paragraphs from the first change on, plus those there now.

Defined results: null is the empty text, which has no paragraph and the zero vector; a text that isn't empty has one
paragraph more than it has line feeds (an empty line is a paragraph); likeness is 1.0 for equal fingerprints, else the
cosine of the signed lanes from 0.0, and 0.0 if either has none; rows without an id come last and among equal ids texts
are in code-point order, when the next document is looked up; other columns of the input are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import parallelism, table

EXACT, SIGNED = 32, 128
#: Odd multiplier of the rolling byte hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
UNBASE = pow(BASE, -1, 1 << 64)
#: Bytes of a paragraph hashed at a time.
PIECE = 1 << 20


def _mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x ^ np.uint64(salt)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class Hasher:
    """Vectors of paragraphs; powers of the base are kept for PIECE bytes."""

    def __init__(self) -> None:
        ones = lambda b: np.concatenate([[np.uint64(1)], np.cumprod(np.full(PIECE, np.uint64(b), np.uint64))])
        self.up, self.down = ones(BASE), ones(UNBASE)

    def _words(self, raw: np.ndarray) -> np.ndarray:
        """A hash of each word: what stands between bytes up to 0x20."""
        out, carry = [], np.zeros(0, np.uint8)
        for at in range(0, len(raw), PIECE // 2):
            x = np.concatenate([carry, raw[at : at + PIECE // 2]])
            blank = x <= 32
            if at + PIECE // 2 < len(raw):  # a word at the seam moves to the next piece, unless it fills one
                ends = np.flatnonzero(blank)
                cut = int(ends[-1]) + 1 if len(ends) else (len(x) if len(x) >= PIECE // 2 else 0)
                x, carry, blank = x[:cut], x[cut:], blank[:cut]
            edge = np.diff(np.concatenate([[0], (~blank).astype(np.int8), [0]]))
            start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            total = np.concatenate([[np.uint64(0)], np.cumsum((x.astype(np.uint64) + np.uint64(1)) * self.up[: len(x)])])
            out.append(_mix((total[end] - total[start]) * self.down[start] + (end - start).astype(np.uint64), 0x51ED270B))
        return np.concatenate(out) if out else np.zeros(0, np.uint64)

    def pairs(self, paragraph: bytes) -> np.ndarray:
        w = self._words(np.frombuffer(paragraph, np.uint8))
        return w if len(w) < 2 else w[:-1] * np.uint64(BASE) + w[1:]

    @staticmethod
    def signs(pairs: np.ndarray) -> np.ndarray:
        total = np.zeros(SIGNED, np.int64)
        for at in range(0, len(pairs), 1 << 14):
            p = pairs[at : at + (1 << 14)]
            bits = np.stack([_mix(p, 0x2545F491), _mix(p, 0x6A09E667)], 1).view(np.uint8)
            total += 2 * np.unpackbits(bits, axis=1).sum(0, dtype=np.int64) - len(p)
        return total

    def vector(self, paragraphs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The sums of the vectors of paragraphs: exact lanes and signed lanes."""
        exact = np.zeros(EXACT, np.uint64)
        if not paragraphs:
            return exact, np.zeros(SIGNED, np.int64)
        digest = np.frombuffer(b"".join(hashlib.shake_128(p).digest(8 * EXACT) for p in paragraphs), "<u8").reshape(-1, EXACT)
        exact = digest.sum(0, dtype=np.uint64)
        return exact, self.signs(np.concatenate([self.pairs(p) for p in paragraphs]))


def paragraphs(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


Vector = tuple[np.ndarray, np.ndarray]


def wrap(v: Vector) -> Vector:
    return v[0], v[1].astype(np.int64).astype(np.uint32).astype(np.int32)


def show(v: Vector) -> str:
    return v[0].astype("<u8").tobytes().hex() + v[1].astype("<i4").tobytes().hex()


def parse(fingerprint: str) -> Vector:
    raw = bytes.fromhex(fingerprint)
    return np.frombuffer(raw[: 8 * EXACT], "<u8"), np.frombuffer(raw[8 * EXACT :], "<i4").astype(np.int64)


def add(a: Vector, b: Vector) -> Vector:
    return a[0] + b[0], a[1] + b[1]


def subtract(a: Vector, b: Vector) -> Vector:
    return a[0] - b[0], a[1] - b[1]


def plus(a: str, b: str) -> str:
    """The fingerprint of both multisets together."""
    return show(wrap(add(parse(a), parse(b))))


def minus(a: str, b: str) -> str:
    """The fingerprint of a after b's paragraphs have been deleted."""
    return show(wrap(subtract(parse(a), parse(b))))


def edit(hasher: Hasher, text: str, own: Vector, edited: str, same: int) -> Vector:
    """The vector of edited, whose first `same` characters are those of text: by the paragraphs that change, where these are
    fewer than all."""
    start = text.rfind("\n", 0, same) + 1
    if not start or 2 * start < len(text):
        return hasher.vector(paragraphs(edited))
    old, new = (hasher.vector(x[start:].encode("utf-8", "surrogatepass").split(b"\n")) for x in (text, edited))
    return add(subtract(own, old), new)


def likeness(a: Vector, b: Vector) -> float:
    if np.array_equal(a[0], b[0]):
        return 1.0
    s, t = a[1].astype(np.float64), b[1].astype(np.float64)
    size = float(np.sqrt((s @ s) * (t @ t)))
    return min(1.0, max(0.0, float(s @ t) / size)) if size else 0.0


def in_order(docs: DataFrame, buckets_per_part: int = 6) -> tuple[DataFrame, int]:
    """Rows dealt to partitions by ranges of doc_id and sorted in them: (bucket, tail, doc_id, text).

    A bucket is a range of ids between quantiles; the rows with a bucket's least id go to the bucket before, too, marked
    tail, so that each bucket knows the document after its last. Returns the rows and the number of buckets.
    """
    n = parallelism(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = base.select(F.col("doc_id").cast("double").alias("d"))
    share = [k / (n * buckets_per_part) for k in range(1, n * buckets_per_part)]
    cuts = sorted(set(ids.approxQuantile("d", share, 0.5 / (n * buckets_per_part))))
    last = len(cuts) + 1  # of rows without an id
    bounds = F.from_json(F.lit(json.dumps(cuts)), "array<double>")  # folded to a literal of a number per bucket
    # The number of cuts up to the id, by binary search over the literal.
    d = F.col("doc_id").cast("double")
    steps = [1 << k for k in reversed(range(len(cuts).bit_length()))]
    at = F.lit(0)
    if cuts:
        at = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda acc, x: F.when((acc + x <= len(cuts)) & (F.get(bounds, acc + x - 1) <= d), acc + x).otherwise(acc))
    rows = base.select(F.when(F.col("doc_id").isNull(), last).otherwise(at).alias("bucket"), "doc_id", "text")
    return rows, last + 1


def with_next(docs: DataFrame, fn, schema: str) -> DataFrame:  # noqa: ANN001
    """fn(iterator of (doc_id, text, next text)) over every row in order of id, a partition of the order at a time."""
    spark = docs.sparkSession
    rows, n_buckets = in_order(docs)
    least = rows.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()
    # One row per bucket: (bucket before, least id). The first bucket's goes after the last one.
    full = sorted((r["bucket"], r["first"]) for r in least)
    if not full:
        return spark.createDataFrame([], schema)
    tails = [(b, full[k - 1][0], i) for k, (b, i) in enumerate(full)]
    head = spark.createDataFrame(tails, "bucket int, before int, least long")
    # Every bucket has its row: at most one more copy of the rows that hold a bucket's least id.
    copies = rows.join(F.broadcast(head), "bucket").withColumn("copy", F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("least")), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    dealt = copies.select(F.when(F.col("copy"), F.col("before")).otherwise(F.col("bucket")).alias("bucket"), F.col("copy").alias("tail"), "doc_id", "text")
    dealt = dealt.repartition(parallelism(spark), "bucket").sortWithinPartitions("bucket", "tail", F.col("doc_id").asc_nulls_last(), "text")

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def stream() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    yield from zip(*(part.column(c).to_pylist() for c in ("bucket", "tail", "doc_id", "text")), strict=True)

        def pairs() -> Iterator[tuple]:
            held = None
            for row in stream():
                if held is not None and not held[1]:
                    if held[0] != row[0]:
                        raise RuntimeError("a bucket has no tail")
                    yield held[2], held[3], row[3]
                held = row

        yield from fn(pairs())

    return dealt.mapInArrow(mapped, schema)


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def rows(pairs: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        out: list[tuple] = []
        last: tuple = (None, None)
        names = [part.split()[0] for part in schema.split(", ")]

        def vector(text: str) -> tuple[np.ndarray, np.ndarray]:
            return hasher.vector(paragraphs(text))

        def batch() -> pa.RecordBatch:
            types = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
            cols = [pa.array(c, types[part.split()[1]]) for c, part in zip(zip(*out, strict=True), schema.split(", "), strict=True)]
            return pa.RecordBatch.from_arrays(cols, names=names)

        for doc_id, text, after in pairs:
            n = len(text)
            cut = n - n // 4
            edited = text[:cut] + after[: n // 4]
            own = last[1] if last[0] == text else vector(text)
            of_edited, of_next = edit(hasher, text, own, edited, cut) if n >= 4 else own, vector(after)
            last = (after, of_next)
            sha = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((doc_id, n, sha, show(wrap(own)), show(wrap(of_edited)), likeness(own, of_edited), likeness(own, of_next)))
            if len(out) == 256:
                yield batch()
                out.clear()
        if out:
            yield batch()

    return with_next(table(spark, sf_dir, "documents"), rows, schema)
