"""Removal of repeated 200-byte strings by external induced suffix sorting.

Every 200-byte window of a text has an anchor that depends on its content alone (see anchors), so equal windows have
equal anchors, at equal offsets. Anchors that occur once settle their windows: they can't repeat. An anchor whose whole
context (all bytes that its windows cover, known by 128 bits of two hashes) occurs again settles them, too: they all
repeat. What is left are contexts that share an anchor but differ; they are dealt to shards by the anchor, and each shard
sorts all suffixes of its contexts by induction (see induced: suffixes and common prefixes travel through queues per
byte; the shard's text, names and queues are in scratch files as far as they exceed BUDGET). A window repeats if its
suffix has 200 bytes or more in common with a neighbour in that order. An anchor whose contexts are more than a shard
isn't sorted by one task: its windows are counted by their digests, which deals them out.

A context holds exactly the windows of its anchor, so a window is judged once, and never against itself.

Defined results: null is the empty text; matches never cross rows; windows that overlap in one text count; rows that
agree in id and text repeat each other wholly; a text shorter than 200 bytes is kept; long texts are read in pieces that
overlap by a window; an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .anchors import WINDOW, Anchors
from .common import Workspace, join_hot, parallelism, table
from .induced import repeated

KEY = ["id", "h"]
#: Bytes of contexts sorted at a time, and the most that one anchor may have to be sorted.
SHARD_BYTES = 32 << 20
#: Bytes that a sort holds in memory; its arrays are some 16 times as large as its shard.
BUDGET = 64 << 20


def keyed(docs: DataFrame) -> DataFrame:
    """id, h, doc_id, text ('' for null): (id, h) is a row, but for rows that agree in id and text."""
    text = F.coalesce("text", F.lit(""))
    doc_id = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(doc_id, F.lit(-(1 << 63))).alias("id"), F.xxhash64(text).alias("h"), doc_id.alias("doc_id"), text.alias("text"))


def all_anchors(docs: DataFrame) -> DataFrame:
    """id, h, gram, context and proof (hashes of the context), first, last for every anchor."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = Anchors()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found, proofs = [], []
                for t in part.column("text").to_pylist():
                    raw = t.encode("utf-8", "surrogatepass")
                    found.append(anchors.of(raw))
                    proofs += [hashlib.blake2b(raw[a : b + WINDOW], digest_size=8).digest() for a, b in zip(found[-1][2].tolist(), found[-1][3].tolist(), strict=True)]
                n = [len(x[0]) for x in found]
                if not sum(n):
                    continue
                ids, hs = (np.repeat(part.column(c).to_numpy(zero_copy_only=False), n) for c in KEY)
                gram, context, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
                proof = np.frombuffer(b"".join(proofs), np.int64)
                cols = [pa.array(ids), pa.array(hs), pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(proof), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "gram", "context", "proof", "first", "last"])

    return docs.select(*KEY, "text").mapInArrow(mapped, "id long, h long, gram long, context long, proof long, first int, last int")


class Shard:
    """Contexts put one after another in a scratch file, and where they come from."""

    def __init__(self) -> None:
        self.file = tempfile.TemporaryFile()
        self.at: list[np.ndarray] = []  # id, h, first, last, judge, place in the shard: a row per context
        self.size = 0

    def add(self, rows: list[tuple]) -> None:
        """rows: id, h, first, last, judge, raw."""
        for r in rows:
            body = np.append(np.frombuffer(r[5], np.uint8).astype(np.uint16) + 1, np.uint16(0))
            self.file.write(body.tobytes())
        place = self.size + np.concatenate([[0], np.cumsum([len(r[5]) + 1 for r in rows])])
        self.at.append(np.array([(*r[:5], p) for r, p in zip(rows, place[:-1].tolist(), strict=True)], np.int64).reshape(-1, 6))
        self.size = int(place[-1])

    def judged(self, budget: int) -> Iterator[tuple]:
        """id, h, start, end: the byte ranges of judged windows that repeat."""
        if not self.size:
            return
        self.file.flush()
        flags = repeated(np.memmap(self.file, np.uint16, "r", shape=(self.size,)), WINDOW, budget)
        for block in self.at:
            for i, h, first, last, judge, at in block.tolist():
                if judge:
                    own = np.asarray(flags[at : at + last - first + 1]).astype(np.int8)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], own, [0]])))
                    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                        yield i, h, first + a, first + b - 1 + WINDOW


def sort_shards(contexts: DataFrame) -> DataFrame:
    """id, h, start, end: byte ranges of judged windows that repeat. contexts: gram, id, h, first, last, judge, raw; dealt by gram and sorted by it."""
    shard_bytes, budget = SHARD_BYTES, BUDGET

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, gram = Shard(), None

        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "h", "start", "end"])

        def sorted_out() -> Iterator[pa.RecordBatch]:
            found: list[tuple] = []
            for row in shard.judged(budget):
                found.append(row)
                if len(found) == 50_000:
                    yield out(found)
                    found = []
            yield out(found)

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                grams = part.column("gram").to_pylist()
                rows = list(zip(*(part.column(c).to_pylist() for c in ("id", "h", "first", "last", "judge", "raw")), strict=True))
                done = 0
                if shard.size > shard_bytes:  # a gram's contexts stay together
                    done = next((k for k, g in enumerate(grams) if g != gram), len(grams))
                    if done < len(grams):
                        shard.add(rows[:done])
                        yield from sorted_out()
                        shard = Shard()
                    else:
                        done = 0
                shard.add(rows[done:])
                gram = grams[-1]
        yield from sorted_out()

    return contexts.mapInArrow(mapped, "id long, h long, start int, end int")


def with_asked(docs: DataFrame, asks: DataFrame) -> DataFrame:
    """id, h, text, asked for the rows of docs that have asks (id, h, gram, first, last, judge)."""
    asked = asks.groupBy(*KEY).agg(F.collect_set(F.struct("gram", "first", "last", "judge")).alias("asked"))
    return docs.select(*KEY, "text").join(asked, KEY)


def all_windows(rows: DataFrame) -> DataFrame:
    """id, h, start, judge, digest (128 bits of BLAKE2b of its bytes) for every window of the asked contexts."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.binary()]
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                out = []
                for i, h, text, asked in zip(*(part.column(c).to_pylist() for c in ("id", "h", "text", "asked")), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    for a in asked:
                        out += [(i, h, k, a["judge"], hashlib.blake2b(raw[k : k + WINDOW], digest_size=16).digest()) for k in range(a["first"], a["last"] + 1)]
                cols = list(zip(*out, strict=True)) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["id", "h", "start", "judge", "digest"])

    return rows.mapInArrow(mapped, "id long, h long, start int, judge boolean, digest binary")


def repeated_ranges(docs: DataFrame, space: Workspace) -> DataFrame:
    """id, h, ranges: array<struct<start,end>> of the bytes of repeated windows, for the rows that have any."""
    anchors = space.write(all_anchors(docs), "anchors")
    context = F.struct("context", "proof")
    counts = F.count("*").alias("n"), F.min(context).alias("low"), F.max(context).alias("high")
    grams = anchors.groupBy("gram").agg(*counts).filter("n > 1").select("gram", "n", (F.col("low") < F.col("high")).alias("mixed"))
    grams = space.write(grams, "grams")
    flagged = join_hot(anchors, grams, ["gram"], "n", anchors.count()).drop("n")
    flagged = space.write(flagged, "flagged")
    space.drop("anchors")
    space.drop("grams")
    space.release()
    one = F.struct("id", "h", "first")
    same = ["gram", "context", "proof"]
    contexts = space.write(flagged.groupBy(*same).agg(F.count("*").alias("n"), F.min(one).alias("rep")), "contexts")
    decided = join_hot(flagged, contexts, same, "n", flagged.count())
    full, ask = F.col("n") > 1, F.col("mixed") & ((F.col("n") == 1) | (one == F.col("rep")))
    decided = space.write(decided.select(*KEY, "gram", "first", "last", full.alias("full"), ask.alias("ask")).filter("full or ask"), "decided")
    space.drop("flagged")
    space.drop("contexts")
    space.release()
    asks = decided.filter("ask").select(*KEY, "gram", "first", "last", (~F.col("full")).alias("judge"))
    hot = space.write(asks.groupBy("gram").agg(F.sum(F.col("last") - F.col("first") + WINDOW).alias("size")).filter(F.col("size") > SHARD_BYTES).select("gram"), "hot")
    any_hot = bool(hot.limit(1).count())
    rows = with_asked(docs, asks.join(hot, "gram", "left_anti") if any_hot else asks)
    names = ["gram", "id", "h", "first", "last", "judge", "raw"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for i, h, text, asked in zip(*(part.column(c).to_pylist() for c in ("id", "h", "text", "asked")), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    out += [(a["gram"], i, h, a["first"], a["last"], a["judge"], raw[a["first"] : a["last"] + WINDOW]) for a in asked]
                cols = list(zip(*out, strict=True)) or [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    pieces = rows.mapInArrow(cut, "gram long, id long, h long, first int, last int, judge boolean, raw binary")
    # Rows that agree in id and text bring the same piece; one is enough.
    dealt = pieces.repartition(parallelism(docs.sparkSession), "gram").sortWithinPartitions("gram")
    found = space.write(sort_shards(dealt), "found")
    space.release()
    whole = decided.filter("full").select(*KEY, F.col("first").alias("start"), (F.col("last") + WINDOW).alias("end"))
    if any_hot:
        windows = space.write(all_windows(with_asked(docs, asks.join(hot, "gram"))), "windows")
        often = windows.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1").select("digest")
        found = found.union(windows.filter("judge").join(often, "digest").select(*KEY, "start", (F.col("start") + WINDOW).alias("end")))
    return whole.union(found).groupBy(*KEY).agg(F.collect_set(F.struct("start", "end")).alias("ranges"))


def remove(docs: DataFrame, ranges: DataFrame, bodies: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if bodies, kept (the bytes that stay) for every row of keyed docs."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if bodies else [])]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n_bytes, n_removed, n_spans, digests, kept_bytes = [], [], [], [], []
                for text, own in zip(part.column("text").to_pylist(), part.column("ranges").to_pylist(), strict=True):
                    raw = text.encode("utf-8", "surrogatepass")
                    merged: list[list[int]] = []
                    for r in sorted((r["start"], r["end"]) for r in own or ()):
                        if merged and r[0] <= merged[-1][1]:
                            merged[-1][1] = max(merged[-1][1], r[1])
                        else:
                            merged.append([*r])
                    kept, last = [], 0
                    for a, b in merged:
                        kept.append(raw[last:a])
                        last = b
                    body = b"".join([*kept, raw[last:]])
                    n_bytes.append(len(raw))
                    n_removed.append(len(raw) - len(body))
                    n_spans.append(len(merged))
                    digests.append(hashlib.sha256(body).hexdigest())
                    if bodies:
                        kept_bytes.append(body)
                cols = [part.column("doc_id"), pa.array(n_bytes, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digests, pa.string())]
                yield pa.RecordBatch.from_arrays([*cols, *([pa.array(kept_bytes, pa.binary())] if bodies else [])], names=names)

    rows = docs.join(ranges, KEY, "left").select("doc_id", "text", "ranges")
    return rows.mapInArrow(mapped, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if bodies else ""))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = keyed(table(spark, sf_dir, "documents"))
    return remove(docs, repeated_ranges(docs, Workspace(spark, "op8")), bodies=False)
