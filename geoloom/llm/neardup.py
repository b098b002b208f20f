"""Near-duplicate classes over a table of documents; see omh for the sketches and the alignment."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import HOT_PART, Workspace, join_hot, table
from .omh import BANDS, SIMILARITY, Sketcher, aligned, common_kmers

#: A block of a bucket has about so many texts and k-mers at most (or one text).
BLOCK_TEXTS, BLOCK_KMERS = 256, 1 << 19
#: Texts that are held against one copy of their leader's text.
LED = 256
#: Rows with whole texts that a Python kernel gets at a time.
TEXTS_A_BATCH = 512


def node_of(text: Column) -> Column:
    """The node of a text: 128 bits of its SHA-256."""
    return F.unhex(F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 32))


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, node, n (k-mers), keys (a hash per band) for every row."""
    made: list[Sketcher] = []

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made.append(Sketcher())
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n, keys = [], []
                for t in part.column("text").to_pylist():
                    own = made[-1].kmers(t or "")
                    n.append(len(own))
                    keys.append(made[-1].bands(own).view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(k) for k in keys])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("node"), pa.array(n, pa.int64()), column], names=["doc_id", "node", "n", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), node_of(F.col("text")).alias("node"), "text")
    return rows.mapInArrow(mapped, "doc_id long, node binary, n long, keys array<long>")


def verify(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of nodes whose texts (node, text) are similar. A text a may have very many pairs: they are dealt
    over places, with a copy of its text in each."""

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        held: tuple = (None, None)
        for batch in batches:
            keep = []
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for k, (x, y) in enumerate(zip(part.column("ta").to_pylist(), part.column("tb").to_pylist(), strict=True), at):
                    if held[0] != x:
                        held = (x, sketcher.kmers(x))
                    if aligned(held[1], sketcher.kmers(y)):
                        keep.append(k)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    led = pairs.groupBy("a").agg(F.count("*").alias("led"))
    places = F.ceil(F.col("led") / LED)
    dealt = join_hot(pairs, led, ["a"], "led", pairs.count()).select("a", "b", F.pmod(F.xxhash64("b"), places).alias("place"))
    with_b = dealt.join(texts.toDF("b", "tb"), "b")
    with_a = led.join(texts.toDF("a", "ta"), "a").select("a", "ta", F.explode(F.sequence(F.lit(0).cast("long"), places - 1)).alias("place"))
    return with_b.join(with_a, ["a", "place"]).select("a", "b", "ta", "tb").mapInArrow(mapped, "a binary, b binary")


def components(edges: DataFrame, space: Workspace) -> DataFrame:
    """node, label (the least node of its component) for the nodes of edges (a, b).

    Least labels travel over links and are then shortened by their own labels, until no label changes; links are mostly
    stars, so few rounds do. Nodes with a large part of all links, and labels with a large part of all nodes, meet theirs by
    broadcast: there are few such (see HOT_PART).
    """
    both = space.write(edges.union(edges.select("b", "a")).distinct(), "links").toDF("node", "other")
    hubs = space.write(both.groupBy("other").agg(F.count("*").alias("n")).filter(F.col("n") > both.count() * HOT_PART).select("other"), "hubs")
    far = both.join(F.broadcast(hubs), "other", "left_anti")
    near = both.join(F.broadcast(hubs), "other")
    labels = space.write(both.groupBy("node").agg(F.least("node", F.min("other")).alias("label")), "labels0")
    total = labels.count()
    for k in count(1):
        of_other = labels.toDF("other", "near")
        seen = far.join(of_other, "other").unionByName(near.join(F.broadcast(of_other.join(F.broadcast(hubs), "other")), "other"))
        seen = seen.groupBy("node").agg(F.min("near").alias("near"))
        moved = labels.join(seen, "node").select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        moved = space.write(moved, f"moved{k}")
        up = moved.select(F.col("node").alias("label"), F.col("label").alias("top"))
        tops = moved.groupBy("label").agg(F.count("*").alias("n")).join(up, "label")
        new = join_hot(moved, tops, ["label"], "n", total).select("node", "old", F.least("label", "top").alias("label"))
        new = space.write(new, f"labels{k}")
        changed = new.filter("label <> old").limit(1).count()
        space.drop(f"moved{k}")
        space.drop(f"labels{k - 1}")
        labels = new.select("node", "label")
        if not changed:
            return labels
    return labels


def links(sketches: DataFrame, docs: DataFrame, space: Workspace) -> DataFrame:
    """Verified links (a, b) between nodes: those to leaders, and all that classes which meet in a bucket are joined by."""
    nodes = sketches.dropDuplicates(["node"]).filter(F.size("keys") > 0)
    member = space.write(nodes.select("node", "n", F.explode("keys").alias("key")), "member")
    total = member.count()
    sizes = member.groupBy("key").agg(F.count("*").alias("size"))
    rank = join_hot(member, sizes, ["key"], "size", total).groupBy("node").agg(F.sum("size").alias("weight"))
    rank = space.write(rank, "rank")
    leader = member.join(rank, "node").groupBy("key").agg(F.max(F.struct("weight", "node")).getField("node").alias("leader"), F.count("*").alias("led"))
    pairs = join_hot(member, leader, ["key"], "led", total).filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    pairs = space.write(pairs, "pairs")
    shared = rank.filter(F.col("weight") > BANDS).select("node")  # a text that shares no band needs no look
    own = docs.select(node_of(F.col("text")).alias("node"), "text").join(shared, "node", "left_semi").dropDuplicates(["node"])
    texts = space.write(own, "texts")
    found = space.write(verify(pairs, texts), "found1", TEXTS_A_BATCH)
    labels = components(found, Workspace(space.spark, "near-part"))
    rest = space.write(rest_of(member, nodes, labels, texts, space), "found2", TEXTS_A_BATCH)
    return labels.filter("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).union(rest)


def rest_of(member: DataFrame, nodes: DataFrame, labels: DataFrame, texts: DataFrame, space: Workspace) -> DataFrame:
    """The links (a, b) between classes (node, label) that meet in a bucket: all pairs of different classes are decided.

    The texts of a bucket are dealt to blocks: a class of more than a block there has blocks of its own, the others share
    theirs. Every two blocks that hold two classes are decided in one step (see _links_in); a pair is decided in the bucket
    of its first common band alone.
    """
    total = member.count()
    labelled = space.write(member.join(labels, "node", "left").select("key", "node", "n", F.coalesce("label", "node").alias("label")), "labelled")
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("in_key")).filter("low <> high").select("key", "in_key")
    rows = space.write(join_hot(labelled, mixed, ["key"], "in_key", total).select("key", "node", "n", "label"), "rest")
    space.drop("labelled")
    blocks = lambda t, n: F.ceil(F.greatest(F.col(t) / BLOCK_TEXTS, F.col(n) / BLOCK_KMERS))
    counts = rows.groupBy("key", "label").agg(F.count("*").alias("t"), F.sum("n").alias("m")).withColumn("own", blocks("t", "m"))
    shared = counts.filter("own = 1").groupBy("key").agg(F.sum("t").alias("pool_t"), F.sum("m").alias("pool_m"))
    counts = counts.join(shared, "key", "left").withColumn("blocks", F.when(F.col("own") > 1, F.col("own")).otherwise(blocks("pool_t", "pool_m")))
    dealt = join_hot(rows, counts.select("key", "label", "t", "own", "blocks"), ["key", "label"], "t", rows.count())
    block = F.xxhash64(F.when(F.col("own") > 1, F.col("label")), F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = space.write(dealt.select("key", "node", "label", block.alias("block")), "dealt")
    held = dealt.groupBy("key", "block").agg(F.min("label").alias("low"), F.max("label").alias("high"))
    two = held.join(held.toDF("key", "other", "low2", "high2"), "key").filter("block <= other and least(low, low2) <> greatest(high, high2)")
    two = two.select("key", F.struct("block", "other").alias("two"), F.explode(F.array_distinct(F.array("block", "other"))).alias("block"))
    given = dealt.join(two, ["key", "block"]).join(nodes.select("node", "keys"), "node").join(texts, "node")
    given = given.select("key", F.col("two.block").alias("x"), F.col("two.other").alias("y"), "block", "node", "label", "keys", "text")
    order = ["key", "x", "y"]

    def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketcher = Sketcher()
        group: list[tuple] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                bands = part.column("keys").flatten().to_numpy().reshape(-1, BANDS)
                for k, row in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "x", "y", "block", "node", "label", "text")), strict=True)):
                    if group and row[:3] != group[0][:3]:
                        yield _links_in(group)
                        group = []
                    group.append((*row[:6], bands[k].copy(), sketcher.kmers(row[6])))
        if group:
            yield _links_in(group)

    return given.repartition(*order).sortWithinPartitions(*order).mapInArrow(mapped, "a binary, b binary")


def _links_in(group: list[tuple]) -> pa.RecordBatch:
    """Links that join the classes of two blocks of a bucket: (key, x, y, block, node, label, bands, k-mers).

    Every pair of different classes whose common labelled k-mers allow the similarity is aligned, unless earlier links
    have joined its classes.
    """
    key, x, y = group[0][:3]
    bands = np.stack([g[6] for g in group])
    band = int(np.argmax(bands[0] == key))
    length = np.array([len(g[7]) for g in group], np.float64)
    side = np.array([g[3] == x for g in group])
    _, own = np.unique(np.array([g[5].hex() for g in group]), return_inverse=True)
    common = common_kmers([Sketcher.labelled(g[7]) for g in group]) if len(group) > 8 else None
    out = []
    for i in range(1, len(group)):
        need = SIMILARITY * (length[:i] + length[i]) / (1 + SIMILARITY) - 1e-9
        ok = (own[:i] != own[i]) & (np.minimum(length[:i], length[i]) >= need)
        if x != y:
            ok &= side[:i] != side[i]
        if common is not None:
            ok &= common[i, :i] >= need
        at = np.flatnonzero(ok)
        at = at[np.argmax(bands[at] == bands[i], axis=1) == band]
        if common is not None:
            at = at[np.argsort(-common[i, at], kind="stable")]
        while len(at):
            j, at = int(at[0]), at[1:]
            if aligned(group[i][7], group[j][7]):
                out.append((group[i][4], group[j][4]))
                own[own == own[j]] = own[i]
                at = at[own[at] != own[i]]
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.binary()) for k in (0, 1)], names=["a", "b"])


def classes(docs: DataFrame, space: Workspace) -> DataFrame:
    """doc_id, node, class (a label), class_id, class_size for every row of docs (doc_id, text)."""
    sketches = space.write(sketch(docs), "sketches", TEXTS_A_BATCH)
    labels = components(links(sketches, docs, space), space)
    rows = sketches.select("doc_id", "node").join(labels, "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("class"))
    rows = space.write(rows, "rows")
    heads = rows.groupBy("class").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return join_hot(rows, heads, ["class"], "class_size", rows.count())


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents").select("doc_id", "text"), Workspace(spark, "op10"))
    return found.select("doc_id", "class_id", "class_size")


def keep_one(docs: DataFrame, space: Workspace) -> DataFrame:
    """docs with one document of each class: the least doc_id, and the least text and row among rows with that id."""
    found = classes(docs.select("doc_id", "text"), space)
    first = found.groupBy("class").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "node")).alias("first")).select("first.doc_id", "first.node")
    first = space.write(first, "first").toDF("id", "node")
    rows = docs.select(node_of(F.col("text")).alias("node"), F.col("doc_id").cast("long").alias("at"), F.xxhash64(*docs.columns).alias("h"), F.struct(*docs.columns).alias("row"))
    kept = rows.join(first, "node").filter(F.col("at").eqNullSafe(F.col("id")))
    one = kept.groupBy("node").agg(F.min_by("row", "h").alias("row"))
    return one.select(*[F.col(f"row.`{c}`") for c in docs.columns])
