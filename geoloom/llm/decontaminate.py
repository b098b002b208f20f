"""Benchmark decontamination by a generalised suffix automaton.

The normalised words of all test items make one automaton. A document's words are streamed through it; the automaton
keeps the longest match that ends at each word. A match of at least `window` words contains that many item words in a
row, so its last `window` words are an occurrence of a window; the state of that suffix names the items. Items shorter
than a window count whole. Hit words form spans, which `clean` removes when they exceed length and coverage limits.

Defined results: null texts have no words; items without words are ignored; repeated items count by id, once each (null
ids are ignored); repeated documents are rows of their own; long texts are streamed word by word; an empty benchmark hits
nothing; an empty table gives an empty result; other columns are ignored, or kept in a struct of their own.

Size: an automaton holds about `max_words` item words. Beyond that, items are dealt over several automata: every
document is streamed through each of them, and the spans and items are united (see `spans`), with the same result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import merged, parallelism, table

WINDOW = 10
MAX_WORDS = 200_000
#: Words after A-Z have been lower-cased, on UTF-8 bytes: digits, letters and all that is not ASCII.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class Automaton:
    """Suffix automaton of several word sequences; states from `window` words up know the items they occur in."""

    def __init__(self, items: list[tuple[str, list[bytes]]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.items: list[set[int]] = [set()]
        self.short: list[dict[int, set[int]]] = [{}]  # of items that are one window: length -> items ending here
        self.names = [name for name, _ in items]
        for k, (_, own) in enumerate(items):
            self._add(k, [self.ids.setdefault(w, len(self.ids)) for w in own])
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):  # an occurrence is one of every suffix
            up = self.link[s]
            if up > 0 and self.length[up] >= self.window:
                self.items[up] |= self.items[s]
        self.by_state: dict[int, frozenset[int]] = {}
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.short[s] = {**self.short[self.link[s]], **self.short[s]} if self.link[s] > 0 and self.short[self.link[s]] else self.short[s]
        self.least = min([window, *(len(own) for _, own in items)]) if items else window

    def _state(self, length: int, link: int, nxt: dict[int, int], items: set[int], short: dict[int, set[int]]) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        self.items.append(items)
        self.short.append(short)
        return len(self.link) - 1

    def _extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            q = self.next[last][c]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, c, q)
        cur, p = self._state(self.length[last] + 1, 0, {}, set(), {}), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.length[q] == self.length[p] + 1 else self._split(p, c, q)
        return cur

    def _split(self, p: int, c: int, q: int) -> int:
        own = self.length[p] + 1
        low = {n: set(x) for n, x in self.short[q].items() if n <= own}
        made = self._state(own, self.link[q], dict(self.next[q]), set(), low)
        self.short[q] = {n: x for n, x in self.short[q].items() if n > own}
        self.link[q] = made
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = made
            p = self.link[p]
        return made

    def _add(self, k: int, own: list[int]) -> None:
        s = 0
        for n, c in enumerate(own, 1):
            s = self._extend(s, c)
            if n >= self.window:
                self.items[s].add(k)
        if 0 < len(own) < self.window:
            self.short[s].setdefault(len(own), set()).add(k)

    def hits(self, own: list[bytes]) -> tuple[np.ndarray, set[int]]:
        """Which words are inside an occurrence of a window, and the items with occurrences."""
        n, w = len(own), self.window
        ids = np.fromiter(map(self.ids.get, own, (-1,) * n), np.int64, n)
        diff, found = np.zeros(n + 1, np.int32), set()
        gaps = np.concatenate([[-1], np.flatnonzero(ids < 0), [n]])
        runs = np.flatnonzero(np.diff(gaps) > self.least)
        nxt, link, length, short = self.next, self.link, self.length, self.short
        for r in runs:
            at = int(gaps[r]) + 1
            s = size = 0
            for j, c in enumerate(ids[at : int(gaps[r + 1])].tolist(), at):
                while s and c not in nxt[s]:
                    s = link[s]
                    size = length[s]
                if c in nxt[s]:
                    s, size = nxt[s][c], size + 1
                if size >= w:
                    top = s
                    while length[link[top]] >= w:
                        top = link[top]
                    diff[j - w + 1] += 1
                    diff[j + 1] -= 1
                    found |= self.items[top]
                if short[s]:
                    for m, x in short[s].items():
                        if m <= size:
                            diff[j - m + 1] += 1
                            diff[j + 1] -= 1
                            found |= x
        return np.cumsum(diff[:n]) > 0, found


def _known(benchmark: DataFrame) -> DataFrame:
    """item_id (text), text, n (words) of the items that count."""
    n = F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").dropna().withColumn("n", n).filter("n > 0")


def spans(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, max_words: int = MAX_WORDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """For every row: doc_id, n_words, n_hit, items (sorted ids), spans array<struct<start,end>> (words, end exclusive), and
    row: a struct of the columns in keep, if any.

    One automaton (the items, at most max_words words, are broadcast): a narrow step. Several: items are dealt to parts by
    their hash, every row goes once to each part, in one of several groups that begin with the part's items, and its parts
    are united by a row number; the driver then sees no item.
    """
    kept = [F.struct(*keep).alias("row")] if keep else []
    base = docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), *kept).alias("kept"), F.col("text").alias("text"))
    kept_type = base.schema["kept"].dataType.simpleString()
    items = _known(benchmark)
    total = items.agg(F.sum("n")).first()[0] or 0
    span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
    schema = f"kept {kept_type}, n_words long, items array<string>, spans array<struct<start:int,end:int>>"

    def matched(texts: list, automata: list[Automaton]) -> list[pa.Array]:
        n_words, names, found_spans = [], [], []
        for text, automaton in zip(texts, automata, strict=True):
            own = words(text)
            hit, found = automaton.hits(own)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], hit.astype(np.int8), [0]])))
            n_words.append(len(own))
            names.append(sorted({automaton.names[k] for k in found}))
            found_spans.append([{"start": int(a), "end": int(b)} for a, b in zip(edge[::2], edge[1::2], strict=True)])
        return [pa.array(n_words, pa.int64()), pa.array(names, pa.list_(pa.string())), pa.array(found_spans, pa.list_(span))]

    if total <= max_words:
        held = docs.sparkSession.sparkContext.broadcast([(r["item_id"], words(r["text"])) for r in items.orderBy("item_id").collect()])

        def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = None
            for batch in batches:
                automaton = automaton or Automaton(held.value, window)
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    cols = matched(part.column("text").to_pylist(), [automaton] * part.num_rows)
                    yield pa.RecordBatch.from_arrays([part.column("kept"), *cols], names=["kept", "n_words", "items", "spans"])

        out = base.mapInArrow(one, schema)
    else:
        n_parts = -(-total * 5 // (4 * max_words))  # parts are filled by hash, so a little more than needed
        tasks = 2 * parallelism(docs.sparkSession)
        salts = -(-tasks // n_parts)
        dealt = items.withColumn("part", F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts))).withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        dealt = dealt.select("part", "salt", F.lit(0).alias("kind"), "item_id", "text", F.lit(None).cast("long").alias("number"), F.lit(None).cast(kept_type).alias("kept"))
        rows = base.withColumn("number", F.monotonically_increasing_id()).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_parts - 1).cast("long"))))
        rows = rows.select("part", F.pmod(F.xxhash64("number"), F.lit(salts)).alias("salt"), F.lit(1).alias("kind"), F.lit(None).cast("string").alias("item_id"), "text", "number", "kept")

        def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own: list[tuple] = []
            group, automaton = None, None
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    at_docs, automata, texts = [], [], part.column("text").to_pylist()
                    for k, (p, salt, kind, item) in enumerate(zip(*(part.column(c).to_pylist() for c in ("part", "salt", "kind", "item_id")), strict=True)):
                        if (p, salt) != group:
                            group, automaton, own = (p, salt), None, []
                        if kind == 0:
                            own.append((item, words(texts[k])))
                        else:
                            if automaton is None:
                                automaton, own = Automaton(own, window), []
                            at_docs.append(k)
                            automata.append(automaton)
                    if at_docs:
                        docs_of = part.take(pa.array(at_docs, pa.int64()))
                        cols = matched([texts[k] for k in at_docs], automata)
                        yield pa.RecordBatch.from_arrays([docs_of.column("kept"), *cols, docs_of.column("number")], names=["kept", "n_words", "items", "spans", "number"])

        both = rows.unionByName(dealt).repartition(tasks, "part", "salt").sortWithinPartitions("part", "salt", "kind", "item_id")
        out = both.mapInArrow(several, f"{schema}, number long")
        agg = out.groupBy("number").agg(F.first("kept").alias("kept"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
        out = agg.select("kept", "n_words", F.array_sort(F.array_distinct("items")).alias("items"), merged(F.col("spans")).alias("spans"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])
    return out.select("kept.*", "n_words", n_hit.alias("n_hit"), "items", "spans")


def clean(text: str | None, found: list[tuple[int, int]], min_span: int = WINDOW, max_coverage: float = 0.5) -> str | None:
    """The text without its hit spans of at least min_span words; None if they cover more than max_coverage of its words.

    A span goes from the first byte of its first word to the last of its last; what stays is joined by a blank.
    """
    if not text or not found:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw.lower())]
    long = [(a, b) for a, b in found if b - a >= min_span]
    if sum(b - a for a, b in found) > max_coverage * len(at):
        return None
    keep, last = [], 0
    for a, b in long:
        keep.append(raw[last : at[a][0]].rstrip(b" "))
        last = at[b - 1][1]
    keep.append(raw[last:].lstrip(b" "))
    return b" ".join(k for k in keep if k).decode("utf-8", "surrogatepass")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') g FROM (
  SELECT item_id, w, least(len(w), 10) n, unnest(range(1, len(w) - least(len(w), 10) + 2)) i FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
pos AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') g FROM (
  SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) i FROM d, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.i, p.n, win.item_id FROM pos p JOIN win USING (n, g)),
words AS (SELECT doc_id, count(DISTINCT j) n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) j FROM (SELECT DISTINCT doc_id, i, n FROM hit)) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) n_items, sha256(string_agg(DISTINCT item_id, ',' ORDER BY item_id)) s FROM hit GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items,
  coalesce(s, sha256('')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
