"""Language ID by nearest centroid.

A text becomes a normalised TF-IDF vector over hashed character 1- to 3-grams of its letters. Each language has several
centroids (spherical k-means over its fitting texts); a text takes the language of the nearest by cosine. A text that is
farther from every centroid than nearly all fitting texts are from theirs is rejected.

Fitting uses at most about `per_language` texts of each of the `max_languages` most frequent languages and `max_rows` in
all (a bounded, documented sample by a hash of the id); every row is classified, on its whole text.

Defined results: a null text and one without a letter get `und`, score 0.0 and are rejected; equal similarities go to
the language first in code-point order; repeated rows get equal results; without fitting rows all get `und`; long texts
are counted in pieces; other columns of the input are ignored or kept, and an added column whose name is taken gets
underscores before it; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_slices, clear_of, id_remainder, table

UNDETERMINED = "und"


@dataclass(frozen=True)
class Params:
    dims: int = 1 << 13
    per_language: int = 400
    #: The most frequent languages are learned, and this many texts at most in all.
    max_languages: int = 256
    max_rows: int = 8000
    centroids: int = 4
    rounds: int = 12
    #: Rejection: below this part of the similarity that all but 1 in 200 fitting texts of the centroid reach...
    reject_part: float = 0.2
    #: ...for texts with so many letters as to be judged (shorter ones are only held against reject_floor).
    reject_letters: int = 80
    reject_floor: float = 0.02


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray
    idf: np.ndarray
    reach: np.ndarray  # the similarity below which each centroid rejects


@cache
def packed_letters() -> np.ndarray:
    """Whether each code point is a letter, a bit each."""
    return np.packbits(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def gram_counts(text: str | None, dims: int, letter: np.ndarray, by_sign: bool = False) -> tuple[np.ndarray, int]:
    """Counts of the hashed n-grams, and the number of letters. Runs of other characters are one blank.

    If by_sign, each n-gram counts as 1 or -1 by its hash, so that n-grams which collide cancel: those of a long text of no known
    language fill the dimensions, but are no nearer to a centroid than those of a short one.

    Long texts are counted in pieces that overlap by two code points at a seam without counting an n-gram twice.
    """
    total, n_letters = np.zeros(dims, np.int64), 0
    shift = np.uint32(32 - (dims.bit_length() - 1))
    text = (text or "").lower()

    def counted(h: np.ndarray) -> np.ndarray:
        if not by_sign:
            return np.bincount((h * np.uint32(2654435761)) >> shift, minlength=dims)
        sign = 1 - 2 * (((h ^ (h >> np.uint32(16))) * np.uint32(2246822507)) >> np.uint32(31)).astype(np.int8)
        return np.bincount((h * np.uint32(2654435761)) >> shift, sign, dims).astype(np.int64)

    piece, before = 1 << 20, np.array([32], np.uint32)
    for at in range(0, len(text), piece):
        codes = np.frombuffer(text[at : at + piece].encode("utf-32-le", "surrogatepass"), np.uint32)
        is_letter = letter[codes]
        n_letters += int(is_letter.sum())
        codes = np.where(is_letter, codes, np.uint32(32))
        last = at + piece >= len(text)
        codes = np.concatenate([before, codes, [np.uint32(32)] if last else []]).astype(np.uint32)
        codes = codes[np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])]
        done = len(before) if at else 0
        new1 = codes[done:]
        total += counted(new1)
        for n in (2, 3):
            start = max(0, done - n + 1)
            own = codes[start:]
            if len(own) >= n:
                h = np.zeros(len(own) - n + 1, np.uint32)
                for k in range(n):
                    h = (h ^ own[k : len(own) - n + 1 + k]) * np.uint32(2246822519 + 2 * n)
                    h ^= h >> np.uint32(15)
                total += counted(h)
        before = codes[-2:]
    return total, n_letters


def _weigh(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of counts as normalised TF-IDF."""
    counts = counts.astype(np.float32)
    x = np.sign(counts) * np.log1p(np.abs(counts)) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _cluster(x: np.ndarray, k: int, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart first centres; the centres and each row's similarity to its own."""
    first = [int(np.argmax(x @ x.mean(0)))]
    while len(first) < min(k, len(x)):
        first.append(int(np.argmin((x @ x[first].T).max(1))))
    c = x[first]
    for _ in range(rounds):
        own = (x @ c.T).argmax(1)
        c = np.stack([x[own == j].mean(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, x @ c.T


def fit(docs: DataFrame, p: Params) -> Model:
    """docs: text and a lang that isn't null (rows without a letter are ignored)."""
    docs = docs.filter("lang is not null and text is not null").select("doc_id", "lang", "text")
    often = docs.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(p.max_languages)
    sizes = {r["lang"]: r["n"] for r in often.collect()}
    dims = p.dims
    none = Model([], np.zeros((0, dims), np.float32), np.zeros(dims, np.float32), np.zeros(0))
    if not sizes:
        return none
    each = min(p.per_language, max(1, p.max_rows // len(sizes)))
    shares = docs.sparkSession.createDataFrame([(lang, int((1 << 30) * min(1.0, each / n))) for lang, n in sizes.items()], "lang string, share long")
    sample = docs.join(F.broadcast(shares), "lang").filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("share")).select("lang", "text")
    schema = pa.schema([("lang", pa.string()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    packed = packed_letters()

    def featurise(x: dict[str, list]) -> dict[str, list]:
        letter = np.unpackbits(packed).astype(bool)
        out: dict[str, list] = {"lang": [], "at": [], "n": []}
        for lang, text in zip(x["lang"], x["text"], strict=True):
            counts, letters = gram_counts(text, dims, letter, True)
            if letters:
                at = np.flatnonzero(counts)
                out["lang"].append(lang)
                out["at"].append(at.tolist())
                out["n"].append(np.clip(counts[at], -(2**31) + 1, 2**31 - 1).tolist())
        return out

    got = sample.mapInArrow(by_slices(featurise, schema), "lang string, at array<int>, n array<int>").limit(2 * each * len(sizes)).toArrow()
    rows: dict[str, list] = {}
    for lang, at, n in zip(*(got[c].to_pylist() for c in ("lang", "at", "n")), strict=True):
        rows.setdefault(lang, []).append((at, n))
    if not rows:
        return none
    df = np.zeros(dims)
    for own in rows.values():
        for at, _ in own:
            df[at] += 1
    idf = (np.log((1 + sum(map(len, rows.values()))) / (1 + df)) + 1).astype(np.float32)
    langs, centres, reach = [], [], []
    for lang in sorted(rows):
        own = sorted(rows[lang])
        counts = np.zeros((len(own), dims), np.float32)
        for k, (at, n) in enumerate(own):
            counts[k, at] = n
        c, near = _cluster(_weigh(counts, idf), p.centroids, p.rounds)
        langs += [lang] * len(c)
        centres.append(c)
        best = near.argmax(1)
        reach += [p.reject_part * float(np.quantile(near[best == j, j], 0.005)) if (best == j).any() else 0.0 for j in range(len(c))]
    return Model(langs, np.concatenate(centres).astype(np.float32), idf, np.asarray(reach))


def classify(docs: DataFrame, model: Model, p: Params, keep: list[str]) -> DataFrame:
    """The columns in keep, with lang_pred, score and rejected (see clear_of), for every row of docs."""
    added = [clear_of(keep, c) for c in ("lang_pred", "score", "rejected")]
    source = "text"
    dims, m, packed = p.dims, model, packed_letters()  # centroids x dims travel with the kernel
    fields = [docs.schema[c] for c in keep]
    out_type = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", {added[0]} string, {added[1]} double, {added[2]} boolean"

    def mapped(batches):  # noqa: ANN001, ANN202
        letter = np.unpackbits(packed).astype(bool)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                texts = part.column(source).to_pylist()
                counts, letters = zip(*(gram_counts(t, dims, letter, True) for t in texts), strict=True)
                langs, scores, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if m.languages:
                    near = _weigh(np.stack(counts), m.idf) @ m.centroids.T
                    best = near.argmax(1)
                    for k, j in enumerate(best):
                        if letters[k]:
                            langs[k], scores[k] = m.languages[j], float(min(1.0, max(0.0, near[k, j])))
                            rejected[k] = scores[k] < (m.reach[j] if letters[k] >= p.reject_letters else p.reject_floor)
                cols = [part.column(c) for c in keep] + [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    return docs.select(*keep, *([] if source in keep else [source])).mapInArrow(mapped, out_type)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = Params()
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.filter(id_remainder("doc_id", 4) != 2), p)
    out = classify(docs, model, p, ["doc_id"])
    held_out = F.coalesce(id_remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return out.select("doc_id", held_out, "lang_pred", "score", "rejected")
