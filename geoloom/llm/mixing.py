"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source's documents are dealt by a seeded hash into blocks of about equal size; the order of its block numbers is a random
permutation. Its target (in words) is met by whole passes over its blocks and, for the rest, by a last pass over the first
blocks in that order, the last of which is drawn document by document in hashed order, and the last document only as far as
its words are wanted. So a source's quota is an exact number of block draws: the passes' blocks, one draw each.

The quotas of all sources are dealt over output shards by a tree: each node holds an exact count of draws per source and
splits it between its two halves by a multivariate hypergeometric draw that depends on the seed and the node alone. A
shard then takes its count of each source's draws, in their order, so that shards are disjoint. Within a shard documents
are shuffled by a hash.

Defined results: a null text has size 0; null is a source of its own, last in order; sources of size 0 have target 0.0;
rows that agree in id, text and source are one unit: all its copies are taken alike, so that where the quota ends within a
unit, it may be missed by less than a word a copy; an empty table gives an empty mix; the seed decides every draw, so that
reruns agree; long texts are counted whole; other columns of the input are kept by `mix`, and an added column whose name
is taken gets underscores before it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Workspace, clear_of, table

#: Fixed values of the mix: weights repeat over the sources in order; the mix has this share of all words; no source is
#: taken more than this many times over.
WEIGHTS = (5, 2, 1)
TOTAL_SHARE = 1.5
MAX_PASSES = 2


@dataclass(frozen=True)
class Params:
    seed: int = 20_240_501
    #: Words of a block at least; large corpora have larger blocks, so that there are at most about max_blocks.
    block_words: int = 20_000
    max_blocks: int = 1_000_000
    shard_words: int = 5_000_000
    max_shards: int = 4096
    #: Sources are a controlled vocabulary: one row each comes to the driver, and no more than so many are accepted. So the
    #: tree has no more than MAX_PASSES * (max_blocks + max_sources) draws, which bounds it and what it is written from.
    max_sources: int = 100_000


def targets(sizes: list[int], weights: list[float], share: float = TOTAL_SHARE, most: float = MAX_PASSES) -> list[float]:
    """Target words of each source: by weight, none above `most` times its size; the excess goes to the others by weight."""
    out, left, active = [0.0] * len(sizes), share * sum(sizes), list(range(len(sizes)))
    while active:
        total = sum(weights[k] for k in active)
        over = [k for k in active if left * weights[k] / total > most * sizes[k]]
        if not over:
            for k in active:
                out[k] = left * weights[k] / total
            break
        for k in over:
            out[k] = float(most * sizes[k])
        left -= sum(out[k] for k in over)
        active = [k for k in active if k not in set(over)]
    return out


def split_tree(counts: list[int], shards: int, seed: int) -> list[tuple[int, int, int]]:
    """(source, shard, draws) of each source for each shard, none without a draw: exact in both sums (the shards' totals
    differ by one at most). Nodes hold only the sources that they have draws of, so the tree is no larger than the draws."""
    out: list[tuple[int, int, int]] = []
    have = np.asarray(counts, np.int64)
    todo = [(np.flatnonzero(have), have[have > 0], 0, shards, "r")]
    while todo:
        which, have, at, n, path = todo.pop()
        total = int(have.sum())
        if not total:
            continue
        if n == 1:
            out += [(int(k), at, int(c)) for k, c in zip(which, have, strict=True)]
            continue
        half = n // 2
        want = sum(total * (j + 1) // n - total * j // n for j in range(half))
        key = int.from_bytes(hashlib.sha256(f"{seed}:{path}".encode()).digest()[:8], "little")
        left = np.random.default_rng(key).multivariate_hypergeometric(have, want, method="marginals")
        for part, start, size, side in ((left, at, half, "0"), (have - left, at + half, n - half, "1")):
            own = part > 0
            todo.append((which[own], part[own], start, size, path + side))
    return sorted(out)


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def plan(docs: DataFrame, p: Params, space: Workspace) -> tuple[DataFrame, list[dict]]:
    """Every row of docs (doc_id, source, size, h: a hash of id, text and source) with its draws, and the sources' rows.

    Added columns: source_size, target, block, taken (words), shards: the shard of each draw, one a pass.
    """
    spark = docs.sparkSession
    text = F.col("text")
    doc_id = F.col("doc_id").cast("long")
    sized = docs.select(doc_id.alias("doc_id"), "source", size_of(text).alias("size"), hash_of(p).alias("h"))
    sized = space.write(sized, "sized")  # ids and counts; the text is read once
    sizes = sized.groupBy("source").agg(F.sum("size").alias("n"), F.count("*").alias("rows")).limit(p.max_sources + 1).collect()
    if len(sizes) > p.max_sources:
        raise ValueError(f"more than {p.max_sources} sources")
    sizes = sorted(((r["source"], int(r["n"]), int(r["rows"])) for r in sizes), key=lambda x: (x[0] is None, x[0] or ""))
    total = sum(n + rows for _, n, rows in sizes)
    goal = targets([n for _, n, _ in sizes], [WEIGHTS[k % len(WEIGHTS)] for k in range(len(sizes))])
    block_words = max(p.block_words, total // p.max_blocks + 1)  # an empty text counts for one
    sources = []
    for k, ((name, n, rows), t) in enumerate(zip(sizes, goal, strict=True)):
        want = round(t)
        passes, rest = divmod(want, n) if n else (0, 0)
        sources.append({"source": name, "k": k, "source_size": n, "target": float(t), "passes": passes, "rest": rest, "blocks": max(1, -(-(n + rows) // block_words))})
    named = spark.createDataFrame([tuple(s.values()) for s in sources], "name string, k int, source_size long, target double, passes long, rest long, blocks long")
    known = sized.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("name"))).drop("name")  # at most max_sources rows
    known = known.withColumn("block", F.pmod(F.xxhash64("h"), F.col("blocks")))
    # Where each block stands, and begins, among those of its source: block numbers are in permuted order already.
    order = Window.partitionBy("k").orderBy("block")
    blocks = known.groupBy("k", "block").agg(F.sum("size").alias("block_size"), F.first("rest").alias("rest"), F.first("passes").alias("passes"))
    start = F.coalesce(F.sum("block_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long"))
    blocks = blocks.withColumns({"place": F.row_number().over(order) - 1, "start": start})
    last = (F.col("start") < F.col("rest")) & (F.col("block_size") > 0)  # in the last pass
    blocks = space.write(blocks.select("k", "block", "block_size", "place", "start", "passes", last.alias("last")), "blocks")
    placed = known.join(blocks.join(_draws(blocks, sources, p), ["k", "place"], "left").drop("passes", "place"), ["k", "block"])
    # Only the block in which a source's quota ends is ordered by document.
    whole = ~F.col("last") | (F.col("start") + F.col("block_size") <= F.col("rest"))
    edge = placed.filter(~whole)
    units = edge.groupBy("k", "h", "doc_id", "size").agg(F.count("*").alias("copies"), F.first("start").alias("start"), F.first("rest").alias("rest"))
    inside = Window.partitionBy("k").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("start") + F.coalesce(F.sum(F.col("size") * F.col("copies")).over(inside), F.lit(0).cast("long"))
    share = F.greatest(F.lit(0).cast("long"), F.least(F.col("size") * F.col("copies"), F.col("rest") - before))
    units = units.select(F.col("k").alias("uk"), F.col("h").alias("uh"), F.col("doc_id").alias("ud"), F.floor(share / F.col("copies")).cast("long").alias("extra"))
    same = (F.col("k") == F.col("uk")) & (F.col("h") == F.col("uh")) & F.col("doc_id").eqNullSafe(F.col("ud"))
    edge = edge.join(units, same).drop("uk", "uh", "ud")
    rest = placed.filter(whole).withColumn("extra", F.when(F.col("last"), F.col("size")).otherwise(F.lit(0).cast("long")))
    out = rest.unionByName(edge).withColumn("taken", F.col("passes") * F.col("size") + F.col("extra"))
    some = lambda d: F.when(d["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("extra")) > 0
    shards = F.transform(F.filter(F.coalesce("draws", F.array().cast(DRAWS)), some), lambda d: d["shard"])
    return out.select("doc_id", "source", "size", "h", "source_size", "target", "block", "taken", shards.alias("shards")), sources


DRAWS = "array<struct<pass:bigint,shard:int>>"


def hash_of(p: Params) -> Column:
    return F.xxhash64(F.lit(p.seed), F.col("doc_id").cast("long"), "text", "source")


def _draws(blocks: DataFrame, sources: list[dict], p: Params) -> DataFrame:
    """k, place, draws (pass and shard) of every block that is drawn. The draws of a source are its passes over its blocks,
    one after the other; a shard has a range of them, of as many as the tree gives it."""
    spark = blocks.sparkSession
    quota = {r["k"]: r for r in blocks.groupBy("k").agg(F.count("*").alias("n"), F.sum(F.col("last").cast("long")).alias("m")).collect()}
    counts = [s["passes"] * quota[s["k"]]["n"] + quota[s["k"]]["m"] for s in sources]
    total = sum(s["target"] for s in sources)
    n = int(min(p.max_shards, max(1, -(-int(total) // p.shard_words))))
    own, start, end = split_tree(counts, n, p.seed), [], []
    at: dict[int, int] = {}
    for k, _, c in own:  # in order of source and shard
        start.append(at.get(k, 0))
        end.append(at.get(k, 0) + c)
        at[k] = end[-1]
    # A row for every source and shard that has a draw: no more than there are draws.
    columns = {"k": pa.array([x[0] for x in own], pa.int32()), "shard": pa.array([x[1] for x in own], pa.int32()), "start": pa.array(start, pa.int64()), "end": pa.array(end, pa.int64())}
    ranges = spark.createDataFrame(pa.table(columns))
    sizes = spark.createDataFrame([(r["k"], r["n"]) for r in quota.values()], "k int, n long")
    each = ranges.select("k", "shard", F.explode(F.sequence("start", F.col("end") - 1)).alias("draw")).join(F.broadcast(sizes), "k")
    each = each.select("k", "shard", F.pmod("draw", F.col("n")).cast("int").alias("place"), F.floor(F.col("draw") / F.col("n")).alias("pass"))
    return each.groupBy("k", "place").agg(F.array_sort(F.collect_list(F.struct("pass", "shard"))).cast(DRAWS).alias("draws"))


def mix(docs: DataFrame, p: Params, space: Workspace) -> DataFrame:
    """The mix: every document that is drawn, with all its columns and size, source_size, target, taken, shards, and place:
    its position in the shuffled order of its shards (for these names see clear_of).

    A document that is taken several times is one row with a shard for each draw; the last draw may be a part of it.
    """
    drawn, _ = plan(docs, p, space)
    said = drawn.filter("taken > 0").select("h", F.col("doc_id").alias("id"), F.struct("size", "source_size", "target", "taken", "shards").alias("said")).dropDuplicates(["h", "id"])
    own = docs.select(hash_of(p).alias("h"), F.col("doc_id").cast("long").alias("at"), F.struct(*docs.columns).alias("row"))
    met = own.join(said, (own["h"] == said["h"]) & F.col("at").eqNullSafe(F.col("id"))).drop(said["h"])
    added = {c: F.col(f"said.{c}") for c in ("size", "source_size", "target", "taken", "shards")} | {"place": F.xxhash64(F.lit(p.seed + 1), "h")}
    return met.select(*[F.col(f"row.`{c}`") for c in docs.columns], *[v.alias(clear_of(docs.columns, c)) for c, v in added.items()])


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn, _ = plan(table(spark, sf_dir, "documents"), Params(), Workspace(spark, "op3"))
    return drawn.select("doc_id", "size", "source_size", "target", "taken", "block", "shards")
