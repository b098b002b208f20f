"""Toxicity by a factorization machine over hashed terms.

Terms are a text's lower-cased words and the stems (prefixes of 4 to 6 letters) of longer ones, hashed into buckets. The
machine scores w0 + sum w_i + sum_{i<j} <v_i, v_j> over the buckets present, so a pair of terms can say what neither
says alone. Buckets carry weights if their presence depends on the label in the fitting rows, or if that of a pair of them
does beyond what its members say: all pairs of the `pair_terms` most frequent buckets are looked at. The others say
nothing.

Fitting uses at most about `max_rows` labelled rows (a bounded, documented sample by a hash of the id), of which only the
buckets that may carry weights come to the driver; every row is scored, on its whole text.

Defined results: null and empty texts have no terms and get the score of an empty term set; null labels and labels of
unknown documents are ignored, and an id with several labels counts as toxic if one says so; of several texts with one id
the least in order is fitted on; repeated rows are scored alike; without fitting rows of both labels every score is the
share of label 1 (0.0 without any); texts of any length are scored whole; an empty table gives an empty result; other
columns of the inputs are ignored.
"""

from __future__ import annotations

import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, by_slices, id_remainder, table

WORD = re.compile(r"\w+")
STEMS = (4, 5, 6)


@dataclass(frozen=True)
class Params:
    buckets: int = 1 << 20
    max_rows: int = 12_000
    #: A bucket carries weights if it is in this many fitting rows and its presence is this many deviations from chance.
    min_rows: int = 4
    min_z: float = 4.0
    max_terms: int = 2048
    #: Pairs: of so many most frequent buckets, together in this many fitting rows, and as many deviations from what its
    #: members say; the strongest ones' buckets carry weights, too.
    pair_terms: int = 2048
    pair_rows: int = 8
    pair_z: float = 6.0
    max_pairs: int = 256
    factors: int = 6
    epochs: int = 200
    rate: float = 0.05
    decay: float = 1e-5
    seed: int = 11


@dataclass
class Machine:
    buckets: np.ndarray  # sorted bucket numbers that carry weights
    w0: float
    w: np.ndarray
    v: np.ndarray

    def logits(self, x: np.ndarray) -> np.ndarray:
        xv = x @ self.v
        return self.w0 + x @ self.w + 0.5 * ((xv**2) - x @ (self.v**2)).sum(1)


def terms(text: str | None) -> set[str]:
    words = set(WORD.findall(text.lower())) if text else set()
    return words.union(*[{w[:n] + "*" for w in words if len(w) > n} for n in STEMS])


def bucket(term: str, buckets: int) -> int:
    return zlib.crc32(term.encode("utf-8", "surrogatepass")) & (buckets - 1)


def fit(rows: list[np.ndarray], labels: np.ndarray, p: Params) -> Machine:
    """rows: the distinct buckets of each fitting row."""
    n, n_pos = len(rows), int(labels.sum())
    share = n_pos / n if n else 0.0
    prior = float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))) if 0 < share < 1 else (20.0 if share == 1 else -20.0)
    none = Machine(np.zeros(0, np.int64), prior, np.zeros(0), np.zeros((0, p.factors)))
    if not n or n_pos in (0, n):
        return none
    every = np.bincount(np.concatenate(rows), minlength=p.buckets)
    pos = np.bincount(np.concatenate([r for r, y in zip(rows, labels, strict=True) if y] or [np.zeros(0, np.int64)]), minlength=p.buckets)
    z = strength(every, pos, n, n_pos)
    chosen = np.flatnonzero((every >= p.min_rows) & (np.abs(z) >= p.min_z))
    chosen = chosen[np.argsort(-np.abs(z[chosen]), kind="stable")[: p.max_terms]]
    often = np.flatnonzero((every >= p.pair_rows) & (every < n))
    often = np.sort(often[np.argsort(-every[often], kind="stable")[: p.pair_terms]])
    chosen = np.union1d(chosen, often[paired(presence(rows, often), labels, p)])
    if not len(chosen):
        return none
    x = presence(rows, chosen)
    rng = np.random.default_rng(p.seed)
    w0, w, v = prior, np.zeros(len(chosen), np.float32), rng.normal(0, 0.01, (len(chosen), p.factors)).astype(np.float32)
    y = labels.astype(np.float32)
    params = [np.array([w0], np.float32), w, v]
    m1, m2 = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    for step in range(1, p.epochs + 1):
        b, w, v = params
        xv = x @ v
        out = b[0] + x @ w + 0.5 * ((xv**2) - x @ (v**2)).sum(1)
        err = (1 / (1 + np.exp(-np.clip(out, -30, 30))) - y) / n
        seen = err @ x
        grads = [np.array([err.sum()], np.float32), seen + p.decay * w, x.T @ (err[:, None] * xv) - seen[:, None] * v + p.decay * v]
        for a, g, s, q in zip(params, grads, m1, m2, strict=True):
            s += 0.1 * (g - s)
            q += 0.001 * (g * g - q)
            a -= p.rate * (s / (1 - 0.9**step)) / (np.sqrt(q / (1 - 0.999**step)) + 1e-8)
    return Machine(chosen, float(params[0][0]), params[1].astype(np.float64), params[2].astype(np.float64))


def strength(every, pos, n: int, n_pos: int):  # noqa: ANN001, ANN201
    """Deviations from chance of the positive rows among those that have a bucket (arrays or columns)."""
    share = n_pos / n
    spread = every * share * (1 - share)
    return (pos - every * share) / (F.sqrt(spread) if isinstance(spread, Column) else np.sqrt(np.maximum(spread, 1e-9)))


def presence(rows: list[np.ndarray], chosen: np.ndarray) -> np.ndarray:
    x = np.zeros((len(rows), len(chosen)), np.float32)
    if len(chosen):
        for k, r in enumerate(rows):
            at = np.searchsorted(chosen, r)
            x[k, at[(at < len(chosen)) & (chosen[np.minimum(at, len(chosen) - 1)] == r)]] = 1
    return x


def paired(x: np.ndarray, labels: np.ndarray, p: Params) -> np.ndarray:
    """Columns of x in the strongest pairs: the share of positive rows among those with both is held against what the shares
    of those with either say when their logits are added. Pairs that nearly always go together (stems of a word) say nothing."""
    n, m = x.shape
    share = float(labels.mean())
    every, pos = x.sum(0), x[labels == 1].sum(0)
    logit = np.log((pos + share) / (every - pos + 1 - share))
    base = float(np.log(share / (1 - share)))
    positive = np.ascontiguousarray(x[labels == 1])
    found: list[tuple[float, int, int]] = []
    for at in range(0, m, 256):
        own = slice(at, min(at + 256, m))
        both, both_pos = x[:, own].T @ x, positive[:, own].T @ positive
        said = 1 / (1 + np.exp(-np.clip(logit[own, None] + logit[None, :] - base, -30, 30)))
        z = np.abs(both_pos - both * said) / np.sqrt(both * said * (1 - said) + 0.5)
        z[(both < p.pair_rows) | (both > 0.9 * np.minimum(every[own, None], every[None, :]))] = 0
        i, j = np.nonzero(z >= p.pair_z)
        keep = i + at < j
        found += zip((-z[i[keep], j[keep]]).tolist(), (i[keep] + at).tolist(), j[keep].tolist(), strict=True)
        found = sorted(found)[: p.max_pairs]
    return np.unique(np.array([k for _, i, j in found for k in (i, j)], np.int64))


def labelled_terms(docs: DataFrame, labels: DataFrame, p: Params, space: Workspace) -> tuple[list[np.ndarray], np.ndarray]:
    """Labels of at most about p.max_rows labelled rows, by a hash of the id, and those of their buckets that may carry
    weights: no more than max_terms + pair_terms, so what comes to the driver is bounded."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna().filter("toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if not n:
        return [], np.zeros(0, np.int64)
    keep = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, p.max_rows / n))
    sample = known.filter(keep).limit(2 * p.max_rows)  # about max_rows; the limit is the proof of the broadcast's size
    schema = pa.schema([("toxic", pa.int32()), ("b", pa.list_(pa.int32()))])
    size = p.buckets

    def featurise(x: dict[str, list]) -> dict[str, list]:
        return {"toxic": x["toxic"], "b": [sorted({bucket(t, size) for t in terms(text)}) for text in x["text"]]}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id")
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).select("text", "toxic")
    made = space.write(rows.mapInArrow(by_slices(featurise, schema), "toxic int, b array<int>"), "terms")
    n, n_pos = made.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not n:
        return [], np.zeros(0, np.int64)
    counts = made.select("toxic", F.explode("b").alias("b")).groupBy("b").agg(F.count("*").alias("every"), F.sum("toxic").alias("pos"))
    counts = space.write(counts.withColumn("z", F.abs(strength(F.col("every"), F.col("pos"), n, n_pos)) if 0 < n_pos < n else F.lit(0.0)), "counts")
    strong = counts.filter((F.col("every") >= p.min_rows) & (F.col("z") >= p.min_z * 0.999)).orderBy(F.desc("z"), "b").limit(p.max_terms)
    often = counts.filter((F.col("every") >= p.pair_rows) & (F.col("every") < n)).orderBy(F.desc("every"), "b").limit(p.pair_terms)
    wanted = sorted(r["b"] for r in strong.union(often).select("b").distinct().collect())
    got = made.select("toxic", F.array_intersect("b", F.from_json(F.lit(json.dumps(wanted)), "array<int>")).alias("b")).toArrow()
    lists = got["b"].combine_chunks()
    values, ends = lists.flatten().to_numpy(), np.cumsum([0, *lists.value_lengths().to_numpy()])
    found = [np.sort(values[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
    y = got["toxic"].to_numpy().astype(np.int64)
    order = sorted(range(len(found)), key=lambda i: (y[i], found[i].tobytes()))  # the order of arrival says nothing
    return [found[i] for i in order], y[order]


def score(docs: DataFrame, machine: Machine, p: Params) -> DataFrame:
    """doc_id, score for every row of docs."""
    size, m = p.buckets, machine  # at most max_terms weights travel with the kernel
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def kernel() -> object:
        known: dict[str, tuple[int, ...]] = {}
        state: dict[str, object] = {}

        def at(word: str) -> tuple[int, ...]:
            """The weights that a word and its stems touch."""
            where = state["where"]
            own = [word] + [word[:n] + "*" for n in STEMS if len(word) > n]
            return tuple(where[b] for b in {bucket(t, size) for t in own} if b in where)

        def run(x: dict[str, list]) -> dict[str, list]:
            if "where" not in state:
                state["where"] = {int(b): k for k, b in enumerate(m.buckets)}
            if len(known) > 500_000:
                known.clear()
            out = np.zeros((len(x["text"]), len(m.buckets)))
            for k, text in enumerate(x["text"]):
                if text:
                    for word in set(WORD.findall(text.lower())):
                        hit = known.get(word)
                        if hit is None:
                            hit = known[word] = at(word)
                        if hit:
                            out[k, list(hit)] = 1
            z = np.clip(m.logits(out), -40, 40)
            return {"doc_id": x["doc_id"], "score": (1 / (1 + np.exp(-z))).tolist()}

        return run

    def mapped(batches):  # noqa: ANN001, ANN202
        yield from by_slices(kernel(), schema)(batches)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mapped, "doc_id long, score double")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Params()
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows, y = labelled_terms(docs, labels.filter(id_remainder("doc_id", 3) != 1), p, Workspace(spark, "op1"))
    scored = score(docs, fit(rows, y, p), p)
    return scored.select(
        "doc_id",
        F.coalesce(id_remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
    )
