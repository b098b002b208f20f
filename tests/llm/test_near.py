from __future__ import annotations

import random
import time

import numpy as np
import pytest

from geoloom.llm import neardup
from geoloom.llm.common import Workspace
from geoloom.llm.omh import Sketcher, aligned, common_kmers


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_alignment_against_dynamic_programme():
    r = random.Random(4)
    for _ in range(200):
        a = np.array([r.randrange(30) for _ in range(r.randint(1, 60))], np.uint64)
        b = a.copy()
        for _ in range(r.randint(0, 6)):
            b = np.insert(np.delete(b, r.randrange(len(b))), r.randrange(len(b)), r.randrange(30)) if len(b) > 1 else b
        n = lcs(a.tolist(), b.tolist())
        want = n / (len(a) + len(b) - n)
        got = aligned(a, b)
        assert abs(got - want) < 1e-9 if want >= 0.8 else got == 0.0


def test_alignment_of_repetitive_texts():
    r = random.Random(2)
    for n in (300, 2500):
        a = np.array([r.randrange(3) for _ in range(n)], np.uint64)
        b = np.delete(a, r.sample(range(n), n // 40))
        got = aligned(a, b)
        m = lcs(a.tolist(), b.tolist()) if n < 1000 else len(b)
        assert abs(got - m / (len(a) + len(b) - m)) < 1e-9
    began = time.time()
    words = np.tile(np.arange(7, dtype=np.uint64), 3000)
    assert aligned(words, np.delete(words, np.arange(0, 15_000, 10))) > 0.9 and time.time() - began < 5


def test_common_kmers():
    r = random.Random(3)
    labels = [np.array(sorted(r.sample(range(200), r.randint(1, 90))), np.uint64) for _ in range(150)]
    got = common_kmers(labels)
    assert all(got[i, j] == len(set(labels[i].tolist()) & set(labels[j].tolist())) for i in range(150) for j in range(150))


def test_kmers_do_not_depend_on_pieces(monkeypatch):
    from geoloom.llm import omh

    text = " ".join(f"w{k % 37}x" for k in range(400))
    whole = Sketcher().kmers(text)
    monkeypatch.setattr(omh, "PIECE", 64)
    assert np.array_equal(Sketcher().kmers(text), whole)


def test_classes_against_all_pairs(spark, make):
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(r.randint(60, 200))]
        texts.append(" ".join(base))
        for _ in range(r.randint(0, 5)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = word()
            texts.append(" ".join(w))
    texts += ["", None, "one two", "one two", "...", texts[0]]
    km = [Sketcher().kmers(t or "") for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if (texts[i] or "") == (texts[j] or "") or aligned(km[i], km[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    docs = make(list(enumerate(texts)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs.select("doc_id", "text"), Workspace(spark, "t")).collect()}
    assert [got[k] for k in range(len(texts))] == label
    kept = neardup.keep_one(docs, Workspace(spark, "t"))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(label)) and kept.columns == docs.columns


def test_odd_rows(spark, make):
    docs = make([(None, "a b c d e f"), (3, "a b c d e f"), (3, "other words are here now"), (3, "a b c d e f")])
    out = neardup.classes(docs.select("doc_id", "text"), Workspace(spark, "t")).collect()
    assert sorted(r["class_size"] for r in out) == [1, 3, 3, 3] and neardup.keep_one(docs, Workspace(spark, "t")).count() == 2
    assert neardup.classes(docs.select("doc_id", "text").filter("doc_id = 8"), Workspace(spark, "t")).count() == 0


def test_links_between_classes_that_meet_in_a_small_bucket(spark, make):
    """A chain of texts, each similar to its neighbours alone, is one class."""
    r = random.Random(5)
    words = ["".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(400)]
    texts = [" ".join(words[at : at + 200]) for at in range(0, 200, 10)]
    km = [Sketcher().kmers(t) for t in texts]
    assert aligned(km[0], km[1]) and not aligned(km[0], km[4])
    docs = make(list(enumerate(texts)))
    got = {r["class_id"] for r in neardup.classes(docs.select("doc_id", "text"), Workspace(spark, "t")).collect()}
    assert got == {0}


@pytest.mark.parametrize("block", [256, 16])
def test_family_without_its_original_against_all_pairs(spark, make, monkeypatch, block):
    """Copies of one text, edited so that many pairs are no links, are classed as by all pairs; most buckets are large."""
    monkeypatch.setattr(neardup, "BLOCK_TEXTS", block)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    base = [word() for _ in range(200)]
    texts = []
    for _ in range(300):
        w = list(base)
        for k in r.sample(range(200), 3):
            w[k] = word()
        texts.append(" ".join(w))
    km = [Sketcher().kmers(t) for t in texts]
    label = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if label[i] != label[j] and aligned(km[i], km[j]):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    docs = make(list(enumerate(texts)))
    got = {r["doc_id"]: r["class_id"] for r in neardup.classes(docs.select("doc_id", "text"), Workspace(spark, "t")).collect()}
    assert len(set(label)) > 1 and [got[k] for k in range(len(texts))] == label
