from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from geoloom.llm import langid, queries, toxicity
from geoloom.llm.common import Workspace, id_remainder

DATA = "/root/testdata/sf0.001"


def test_toxicity_on_held_out_rows(spark):
    out = queries.QUERIES["op1_toxicity"](spark, "/root/testdata/sf0.01")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").select("doc_id", "toxic")
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    right = sum(r["predicted"] == r["toxic"] for r in rows)
    assert right / len(rows) > 0.9 and not any(r["predicted"] and not r["toxic"] for r in rows)
    assert out.filter("score is null or score < 0 or score > 1").count() == 0


def fitted(texts, y, p):
    rows = [np.array(sorted({toxicity.bucket(t, p.buckets) for t in toxicity.terms(x)})) for x in texts]
    m = toxicity.fit(rows, np.array(y), p)
    return m, m.logits(toxicity.presence(rows, m.buckets).astype(np.float64))


def test_pairs_that_say_what_neither_member_says():
    """Labels by the exclusive or of two terms, at default parameters: no term says anything alone."""
    r = random.Random(1)
    texts, y = [], []
    for _ in range(4000):
        a, b = r.random() < 0.5, r.random() < 0.5
        texts.append(" ".join((["aaa"] if a else []) + (["bbb"] if b else []) + [f"w{r.randrange(40)}" for _ in range(6)]))
        y.append(int(a != b))
    _, z = fitted(texts, y, toxicity.Params())
    assert ((z > 0) == np.array(y, bool)).mean() > 0.99


def test_insult_with_group_mention():
    """Rare terms, harmless apart and toxic together, among labels that other words decide."""
    r = random.Random(2)
    texts, y = [], []
    for _ in range(6000):
        a, b, c = r.random() < 0.08, r.random() < 0.08, r.random() < 0.05
        if r.random() < 0.03:
            a = b = True
        texts.append(" ".join((["vermin"] if a else []) + (["neighbours"] if b else []) + (["scum"] if c else []) + [f"w{r.randrange(300)}" for _ in range(12)]))
        y.append(int(c or (a and b)))
    _, z = fitted(texts, y, toxicity.Params())
    assert ((z > 0) == np.array(y, bool)).mean() > 0.995


def test_toxicity_odd_rows(spark, make):
    p = toxicity.Params()
    docs = make([(1, None), (2, ""), (None, "x"), (4, "y")])
    labels = spark.createDataFrame([(1, 1), (2, None), (9, 0), (None, 1)], "doc_id long, toxic int")
    rows, y = toxicity.labelled_terms(docs.union(docs), labels.union(labels), p, Workspace(spark, "t"))
    assert len(rows) == 1 and toxicity.labelled_terms(docs, labels.filter("doc_id = 77"), p, Workspace(spark, "t"))[0] == []
    out = toxicity.score(docs, toxicity.fit(rows, y, p), p).collect()
    assert len(out) == 4 and {r["score"] for r in out} == {1.0} or all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(docs.filter("doc_id = 77"), toxicity.fit(rows, y, p), p).count() == 0
    none = toxicity.fit([], np.zeros(0, np.int64), p)
    assert toxicity.score(docs, none, p).filter("score > 0.001").count() == 0


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out = queries.QUERIES["op7_language_id"](spark, DATA).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r["lang_pred"] == r["lang"] for r in out) / len(out) > 0.95
    assert docs.filter(id_remainder("doc_id", 4) == 2).count() == len(out)


def test_language_odd_rows(spark, make):
    p = langid.Params(dims=1 << 10)
    docs = make([(1, "the cat sat on the mat and the dog ran"), (2, None), (3, ""), (4, "123 !?"), (None, "the mat")])
    out = langid.classify(docs, langid.fit(docs, p), p, docs.columns).collect()
    assert {(r["doc_id"], r["lang_pred"], r["rejected"]) for r in out} == {(1, "en", False), (2, "und", True), (3, "und", True), (4, "und", True), (None, "en", False)}
    assert langid.classify(docs.filter("doc_id = 77"), langid.fit(docs, p), p, docs.columns).count() == 0
    named = langid.classify(docs.withColumn("score", F.lit("own")), langid.fit(docs, p), p, [*docs.columns, "score"])
    assert {r["score"] for r in named.collect()} == {"own"} and "_score" in named.columns
    none = langid.classify(docs, langid.fit(docs.withColumn("lang", F.lit(None).cast("string")), p), p, ["doc_id"]).collect()
    assert {r["lang_pred"] for r in none} == {"und"}


def test_many_labels(spark):
    """Labels without bound: the most frequent ones are learned."""
    rows = [(k, "der Hund und die Katze" if k % 2 else "the dog and the cat", f"x{k}" if k % 5 == 0 else "de" if k % 2 else "en") for k in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    p = langid.Params(dims=1 << 10, max_languages=3)
    model = langid.fit(docs, p)
    assert {"de", "en"} <= set(model.languages) and len(set(model.languages)) <= 3


def test_gram_counts_do_not_depend_on_pieces(monkeypatch):
    letter = np.unpackbits(langid.packed_letters()).astype(bool)
    text = "Äpfel und Birnen, " * 9000 + "é" * 3
    small, n = langid.gram_counts(text, 1 << 10, letter)
    assert n == sum(c.isalpha() for c in text)
    assert small.sum() > 3 * len(text) * 0.8


def test_long_texts_of_no_known_language_are_rejected(spark, make):
    import random

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    p = langid.Params()
    model = langid.fit(docs, p)
    r = random.Random(8)
    latin, han, cyrillic = "abcdefghijklmnopqrstuvwxyz", [chr(k) for k in range(0x4E00, 0x5600)], [chr(k) for k in range(0x430, 0x450)]
    word = lambda letters: "".join(r.choice(letters) for _ in range(r.randint(2, 9)))
    rows = [" ".join(word(letters) for _ in range(n)) for letters in (latin, han, cyrillic) for n in (300, 1000, 5000, 20_000)]
    out = langid.classify(make(list(enumerate(rows))), model, p, ["doc_id"]).collect()
    assert all(x["rejected"] for x in out), [(x["doc_id"], x["score"]) for x in out if not x["rejected"]]
    kept = langid.classify(docs.filter("n_chars > 500 and lang is not null"), model, p, ["doc_id", "lang"]).collect()
    assert sum(not x["rejected"] and x["lang_pred"] == x["lang"] for x in kept) > 0.95 * len(kept)
