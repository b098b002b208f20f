"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination and mixing, in this order.

Every stage takes nulls in any column, repeated rows, an empty table and further columns of any name; all columns of the
input come through, and what the operators add never takes the name of one of them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, langid, linededup, mixing, neardup
from geoloom.llm.common import Workspace, clear_of, id_remainder, table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the classifier doesn't reject: those far from all it knows go, null and empty texts too."""
    p = langid.Params()
    model = langid.fit(docs.filter(id_remainder("doc_id", 4) != 2), p)
    rejected = clear_of(docs.columns, "rejected")
    return langid.classify(docs, model, p, docs.columns).filter(~F.col(rejected)).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the line runs that repeat earlier ones; a document that is wholly such runs goes."""
    found = linededup.dedup_lines(docs, Workspace(spark, "pipeline-lines"))
    n_lines, n_removed = (F.col(clear_of(docs.columns, c)) for c in ("n_lines", "n_removed"))
    kept = found.filter((n_removed == 0) | (n_removed < n_lines))
    size = F.when(n_removed > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", size).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates."""
    return neardup.keep_one(docs, Workspace(spark, "pipeline-near"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without what they share with the benchmark; those that are mostly that go."""
    cols = docs.columns
    at = cols.index("text")
    found = decontaminate.spans(docs, table(spark, sf_dir, "benchmark"), keep=tuple(cols))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                own = part.column("row").flatten()
                texts = own[at].to_pylist()
                gone, changed = [False] * len(texts), [False] * len(texts)
                for k, spans in enumerate(part.column("spans").to_pylist()):
                    if spans:
                        texts[k] = decontaminate.clean(texts[k], [(s["start"], s["end"]) for s in spans], min_span=1)
                        gone[k], changed[k] = not texts[k], True
                row = pa.StructArray.from_arrays([pa.array(texts, pa.string()) if k == at else own[k] for k in range(len(cols))], names=cols)
                yield pa.RecordBatch.from_arrays([row, pa.array(gone), pa.array(changed)], names=["row", "gone", "changed"])

    out_type = f"row {found.schema['row'].dataType.simpleString()}, gone boolean, changed boolean"
    done = found.select("row", "spans").mapInArrow(cut, out_type).filter(~F.col("gone"))
    size = F.when(F.col("changed"), F.length("row.text").cast("long")).otherwise(F.col("row.n_chars"))
    return done.select(*[size.alias(c) if c == "n_chars" else F.col(f"row.`{c}`") for c in cols])


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: documents drawn to the sources' target weights, with the words taken and the output shard."""
    return mixing.mix(docs, mixing.Params(), Workspace(spark, "pipeline-mix"))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing_sources),
]

#: SQL cannot state the classifier, the sketches and the permuted draws; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    space = Workspace(spark, "pipeline")
    before = None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k == len(STAGES) - 1:
            return out
        docs = space.write(out, name)
        if before:
            space.drop(before)
        before = name
    return docs
