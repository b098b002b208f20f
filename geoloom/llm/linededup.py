"""Line dedup by a suffix array over line-ID sequences, built by distributed prefix doubling.

Lines get IDs; only lines that occur more than once take part. The rank of a suffix by its first h lines is the place of
its pair (rank of h/2 lines here, rank of h/2 lines from h/2 on) in the sorted order of pairs, so one sort of distinct
pairs doubles the depth; suffixes whose prefix is unique drop out. Suffixes that agree in L lines are an LCP interval of
depth L of the suffix array; it is named by two ranks of the next lower power of two that overlap.

A run of lines is repeated if the same run occurs elsewhere and has `min_words` words or more; every occurrence but the
first, in order of (doc_id, row hash, line), is deleted. Maximal repeated runs are found as unions of the shortest runs
of min_words words that begin or end at each line: these cover a repeated run wholly, and no other line.

Defined results: a null text stays null and has no lines; an empty text has one empty line; rows that agree in all
columns are copies: all but one lose their whole text if it has min_words words; among rows with one id, the order of
their hashes decides which comes first; all columns of the input are kept, and an added column whose name is taken gets
underscores before it; texts of any length are cut in time linear in their lines; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bound, clear_of, join_hot, merged, parallelism, table

#: Runs of fewer words are trivially short.
MIN_WORDS = 5
KEY = ["id", "h"]


def _ranked(pairs: DataFrame, keys: list[str], space: Workspace, name: str) -> DataFrame:
    """The distinct keys that occur more than once, with rank: their place in sorted order (ascending, with gaps)."""
    often = pairs.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1").drop("n")
    return space.write(often.orderBy(*keys).withColumn("rank", F.monotonically_increasing_id()), name)


def shortest_runs(words: list[int], least: int) -> list[tuple[int, int]]:
    """(start, length) of the shortest runs of `least` words that begin or end at each line of a stretch of lines."""
    found, total, at = set(), 0, 0
    for end, n in enumerate(words):  # runs that end here
        total += n
        while total - words[at] >= least:
            total -= words[at]
            at += 1
        if total >= least:
            found.add((at, end + 1 - at))
    total, end = 0, 0
    for start, n in enumerate(words):  # runs that begin here
        while total < least and end < len(words):
            total += words[end]
            end += 1
        if total < least:
            break
        found.add((start, end - start))
        total -= n
    return sorted(found)


def repeated_runs(docs: DataFrame, space: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """id, h, cuts: array<struct<start,end>> of the lines that repeat earlier ones, merged, for rows that have any.

    docs: id, h, text.
    """
    spark = docs.sparkSession
    line = F.split("text", "\n", -1)
    parts = F.transform(line, lambda x: F.struct(F.xxhash64(x).alias("a"), F.xxhash64(F.lit(1), x).alias("b"), F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")).alias("words")))
    lines = docs.filter("text is not null").select(*KEY, F.posexplode(parts).alias("i", "x")).select(*KEY, "i", "x.*")
    lines = space.write(lines, "lines")
    ids = _ranked(lines.select("a", "b"), ["a", "b"], space, "ids0")
    mine = space.write(lines.join(ids, ["a", "b"]).select(*KEY, "i", "words", "rank"), "repeated")
    space.drop("lines")
    space.drop("ids0")

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The shortest runs within stretches of repeated lines; rows come sorted."""
        out: list[tuple] = []
        stretch: list[tuple] = []

        def done() -> None:
            for s, n in shortest_runs([x[3] for x in stretch], min_words):
                out.append((stretch[s][0], stretch[s][1], stretch[s][2], n))
            stretch.clear()

        def batch() -> pa.RecordBatch:
            cols = list(zip(*out, strict=True)) or [[], [], [], []]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["id", "h", "start", "n"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "h", "i", "words")), strict=True):
                if stretch and (row[:2] != stretch[-1][:2] or row[2] > stretch[-1][2] + 1):
                    done()
                if not stretch or row[2] != stretch[-1][2] or row[:2] != stretch[-1][:2]:  # copies of a row give a line twice
                    stretch.append(row)
            if len(out) > 10_000:
                yield batch()
        done()
        if out:
            yield batch()

    dealt = mine.repartition(parallelism(spark), *KEY).sortWithinPartitions(*KEY, "i")
    wanted = space.write(dealt.select(*KEY, "i", "words").mapInArrow(runs, "id long, h long, start int, n int"), "runs")
    longest = wanted.agg(F.max("n")).first()[0]
    if not longest:
        return spark.createDataFrame([], "id long, h long, cuts array<struct<start:int,end:int>>")
    ranks = [mine.select(*KEY, "i", "rank").dropDuplicates([*KEY, "i"])]
    depth = 1
    while 2 * depth <= longest:
        ranks.append(_deeper(ranks[-1], depth, space))
        depth *= 2
    named = None
    for k, rank in enumerate(ranks):
        size = 1 << k
        own = wanted.filter((F.col("n") >= size) & (F.col("n") < 2 * size))
        first = own.join(rank.select(*KEY, F.col("i").alias("start"), F.col("rank").alias("r1")), [*KEY, "start"])
        if size > 1:
            last = rank.select(*KEY, F.col("i").alias("at"), F.col("rank").alias("r2"))
            first = first.withColumn("at", F.col("start") + F.col("n") - size).join(last, [*KEY, "at"]).drop("at")
        else:
            first = first.withColumn("r2", F.col("r1"))
        named = first if named is None else named.unionByName(first)
    named = space.write(named.select(*KEY, "start", "n", "r1", "r2"), "named")
    place = F.struct("id", "h", "start")
    first = named.groupBy("n", "r1", "r2").agg(F.min(place).alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = space.write(first, "first")
    later = join_hot(named, first, ["n", "r1", "r2"], "times", named.count()).filter(place > F.col("first"))
    spans = later.groupBy(*KEY).agg(F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("spans"))
    return spans.select(*KEY, merged(F.col("spans")).alias("cuts"))


def _deeper(now: DataFrame, depth: int, space: Workspace) -> DataFrame:
    """Ranks by twice as many lines, from those by `depth` lines: one more doubling."""
    then = now.select(*KEY, (F.col("i") - depth).alias("i"), F.col("rank").alias("then"))
    pairs = space.write(now.join(then, [*KEY, "i"]), f"pairs{2 * depth}")
    ranks = _ranked(pairs.select(F.col("rank").alias("r"), "then"), ["r", "then"], space, f"ranks{2 * depth}")
    deeper = pairs.join(ranks.toDF("rank", "then", "deeper"), ["rank", "then"])
    out = space.write(deeper.select(*KEY, "i", F.col("deeper").alias("rank")), f"depth{2 * depth}")
    space.drop(f"pairs{2 * depth}")
    space.drop(f"ranks{2 * depth}")
    return out


def dedup_lines(docs: DataFrame, space: Workspace, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the later copies of repeated line runs deleted from text; added: n_lines, n_removed (see clear_of).

    A deleted run takes its line feeds with it; what stays is joined by single line feeds.
    """
    cols = docs.columns
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), F.xxhash64(*cols).alias("h"), F.struct(*cols).alias("row"))
    cuts = repeated_runs(keyed.select(*KEY, "row.text"), space, min_words)
    # Copies of a whole row collapse on the way; the row's count brings them back.
    rows = keyed.groupBy(*KEY).agg(F.first("row").alias("row"), F.count("*").cast("int").alias("copies"))
    rows = rows.join(cuts, KEY, "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies"))))
    line = F.split("row.text", "\n", -1)
    n_lines = F.coalesce(F.size(line), F.lit(0))
    long = F.regexp_count("row.text", F.lit(r"[^\x20\x09-\x0D]+")) >= min_words
    # What stays are the stretches between the cuts.
    froms = F.concat(F.array(F.lit(0)), F.transform("cuts", lambda c: c["end"]))
    tos = F.concat(F.transform("cuts", lambda c: c["start"]), F.array(n_lines))
    work = F.struct(line.alias("line"), F.arrays_zip(froms.alias("a"), tos.alias("b")).alias("stays"))
    kept = bound(work, lambda x: F.concat_ws("\n", F.flatten(F.transform(x["stays"], lambda s: F.slice(x["line"], s["a"] + 1, s["b"] - s["a"])))))
    removed = F.when((F.col("copy") > 1) & long, n_lines).otherwise(F.coalesce(F.aggregate("cuts", F.lit(0), lambda acc, c: acc + c["end"] - c["start"]), F.lit(0)))
    text = F.when(removed == 0, F.col("row.text")).when(removed >= n_lines, F.lit("")).otherwise(kept)
    own = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in cols]
    return rows.select(*own, n_lines.alias(clear_of(cols, "n_lines")), removed.alias(clear_of(cols, "n_removed")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs, Workspace(spark, "op2"))


OP2_SQL = r"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) line, unnest(range(len(string_split(text, chr(10))))) i FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) n, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY doc_id ORDER BY i) s FROM l),
runs AS (
  SELECT a.doc_id, a.i a, min(b.i) b FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.s - a.s + a.n >= 5 GROUP BY 1, 2
  UNION SELECT b.doc_id, max(a.i), b.i FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.s - a.s + a.n >= 5 GROUP BY 1, b.i),
k AS (SELECT r.doc_id, r.a, r.b, string_agg(line, chr(10) ORDER BY i) t FROM runs r JOIN c ON c.doc_id = r.doc_id AND c.i BETWEEN r.a AND r.b GROUP BY 1, 2, 3),
f AS (SELECT *, min((doc_id, a)) OVER (PARTITION BY t) first FROM k),
gone AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) i FROM f WHERE (doc_id, a) > first),
kept AS (SELECT l.doc_id, count(*) n_lines, count(gone.i) n_removed, string_agg(line, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) t FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY 1)
SELECT d.doc_id, CASE WHEN d.text IS NOT NULL THEN coalesce(t, '') END AS text, CAST(coalesce(n_lines, 0) AS INT) n_lines, CAST(coalesce(n_removed, 0) AS INT) n_removed FROM documents d LEFT JOIN kept USING (doc_id)
"""
