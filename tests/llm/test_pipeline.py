from __future__ import annotations

import corpus_pipeline
import oracle
from geoloom.llm import decontaminate


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, oracle.DATA)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        assert 0 < now.count() <= before.count()
        if name == "decontamination":
            found = decontaminate.spans(now, spark.read.parquet(f"{oracle.DATA}/benchmark.parquet"))
            assert found.filter("n_hit > 0").count() == 0
        if k < 4:
            assert now.filter("n_chars <> length(text)").count() == 0
        before = now
    assert corpus_pipeline.run(spark, oracle.DATA).count() == before.count()


def test_odd_documents(spark, tmp_path):
    rows = [(1, None, None, None, None), (None, "", "en", "s", 0), (3, "the cat sat on the mat", "en", None, 22), (3, "the cat sat on the mat", "en", None, 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, oracle.DATA).write.parquet(str(tmp_path / name))
        assert k == 4 or spark.read.parquet(str(tmp_path / name)).columns == docs.columns
    empty = docs.filter("doc_id = 7")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, oracle.DATA).count() == 0


NAMES = "score rejected lang_pred n_lines n_removed n_words n_hit items spans gone changed size source_size target taken shards place row kept h id node key at said label".split()


def test_columns_of_any_name_come_through(spark, tmp_path):
    """Every name that an operator uses itself, as a further column: the stages keep it with its values."""
    docs = spark.read.parquet(f"{oracle.DATA}/documents.parquet").limit(60)
    docs = docs.select("*", *[(docs["doc_id"] * (k + 2)).cast("string").alias(n) for k, n in enumerate(NAMES)])
    docs.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, oracle.DATA)
        assert out.columns[: len(docs.columns)] == docs.columns and (k == 4 or out.columns == docs.columns), name
        assert len({c.lower() for c in out.columns}) == len(out.columns)
        rows = out.collect()
        assert rows and all(r[n] == str(r["doc_id"] * (j + 2)) for r in rows for j, n in enumerate(NAMES)), name
