from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import suffixdedup
from geoloom.llm.anchors import Anchors, sliding_min
from geoloom.llm.common import Workspace
from geoloom.llm.induced import repeated, suffix_order


def brute_order(text):
    raw = text.astype(">u2").tobytes()
    order = sorted((k for k in range(len(text)) if text[k]), key=lambda k: raw[2 * k :])
    lcp = [0]
    for a, b in zip(order, order[1:], strict=False):
        k = 0
        while max(a, b) + k < len(text) and text[a + k] == text[b + k]:
            k += 1
        lcp.append(k)
    return order, lcp if order else []


@pytest.mark.parametrize("budget", [64, 1 << 20])
def test_order_and_common_prefixes(budget):
    rng = np.random.default_rng(7)
    for k in range(120):
        parts = [np.append(rng.integers(1, 2 + k % 4, rng.integers(1, 60)), 0) for _ in range(1 + k % 3)]
        if k % 5 == 0:
            parts.append(parts[0])
        text = np.concatenate(parts).astype(np.uint16)
        order, lcp = suffix_order(text, depth=1000, budget=budget)
        want, common = brute_order(text)
        assert list(order) == want and list(lcp) == (common if want else [])


def test_a_string_far_larger_than_memory():
    """A budget of 64 KB for a string of 600,000 characters: the same flags as in memory, from scratch files."""
    rng = np.random.default_rng(5)
    words = [rng.integers(1, 256, rng.integers(2, 9)) for _ in range(300)]
    parts = [np.append(np.concatenate([words[k] for k in rng.integers(0, 300, 120)]), 0) for _ in range(800)]
    parts += [parts[k] for k in range(0, 800, 9)] + [np.append(parts[3][5:400], 0)]
    text = np.concatenate(parts).astype(np.uint16)
    stats: dict = {}
    got = repeated(text, 200, 64 << 10, stats)
    assert stats["spilled"] > 10 * len(text) and np.array_equal(got, repeated(text, 200, 64 << 20))
    ends = np.flatnonzero(text == 0)
    whole = {bytes(p.astype(">u2").tobytes()) for p in parts[:800:9]}
    first = np.concatenate([[0], ends[:-1] + 1])
    for a, b in zip(first.tolist(), ends.tolist(), strict=True):
        if text[a : b + 1].astype(">u2").tobytes() in whole and b - a >= 200:
            assert got[a : b - 199].all()


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 100, 57).astype(np.uint64)
    for w in (1, 5, 57):
        assert list(sliding_min(x, w)) == [x[k : k + w].min() for k in range(57 - w + 1)]


def test_anchors_depend_on_content_only():
    r = random.Random(2)
    core = bytes(r.randrange(97, 123) for _ in range(1500))
    a, b = Anchors().of(core), Anchors().of(b"xyz" * 90 + core)
    inner = {(g, c) for g, c, f in zip(a[0], a[1], a[2], strict=True) if f > 200}
    assert inner and len(inner - set(zip(b[0], b[1], strict=True))) <= 1
    assert a[3][-1] == len(core) - 200 and (a[2][1:] == a[3][:-1] + 1).all()


def brute_kept(texts):
    raws = [(t or "").encode() for t in texts]
    seen, twice = set(), set()
    for raw in raws:
        for k in range(len(raw) - 199):
            w = raw[k : k + 200]
            (twice if w in seen else seen).add(w)
    out = []
    for raw in raws:
        gone = set()
        for k in range(len(raw) - 199):
            if raw[k : k + 200] in twice:
                gone.update(range(k, k + 200))
        out.append(bytes(v for k, v in enumerate(raw) if k not in gone))
    return out


@pytest.mark.parametrize("budget", [64 << 20, 64 << 10])
def test_removal_against_windows(spark, make, monkeypatch, budget):
    """Also with so little memory that the sorts of the query's path go through scratch files."""
    monkeypatch.setattr(suffixdedup, "BUDGET", budget)
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(r.randint(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60), text(80), text(120)]
    texts = [None, "", "short", "a" * 700, "ab" * 300 + "c"]
    for k in range(40):
        parts = [text(r.randint(5, 60))]
        for s in r.sample(shared, r.randint(0, 3)):
            cut = r.randint(0, len(s) // 2)
            parts += [s[cut : cut + r.randint(100, len(s))], text(r.randint(0, 30))]
        texts.append(" ".join(parts))
    base = texts[-1]
    for k in range(8):  # near copies
        w = base.split(" ")
        w[r.randrange(len(w))] = word()
        texts.append(" ".join(w))
    texts += [texts[10], texts[10]]
    docs = suffixdedup.keyed(make(list(enumerate(texts))))
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixdedup.remove(docs, suffixdedup.repeated_ranges(docs, Workspace(spark, "t"))).collect()}
    assert [got[k] for k in range(len(texts))] == brute_kept(texts)


def test_anchors_larger_than_a_shard(spark, make, monkeypatch):
    """A passage in every text gives each a context of its own at the edges; no anchor of them is sorted by one task."""
    r = random.Random(3)
    text = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    passage, half = text(400), text(150)
    texts = [text(r.randint(150, 250)) + (half if k % 3 else "") + passage + (half if k % 2 else "") + text(r.randint(150, 250)) for k in range(60)]
    sizes, sort = [], suffixdedup.sort_shards

    def spy(contexts):
        sizes.extend(row["size"] for row in contexts.groupBy("gram").agg(F.sum(F.length("raw")).alias("size")).collect())
        return sort(contexts)

    monkeypatch.setattr(suffixdedup, "SHARD_BYTES", 4000)
    monkeypatch.setattr(suffixdedup, "sort_shards", spy)
    docs = suffixdedup.keyed(make(list(enumerate(texts))))
    got = {r["doc_id"]: bytes(r["kept"]) for r in suffixdedup.remove(docs, suffixdedup.repeated_ranges(docs, Workspace(spark, "t"))).collect()}
    assert [got[k] for k in range(len(texts))] == brute_kept(texts)
    assert max(sizes, default=0) <= 4000


def test_empty_table_and_repeated_ids(spark, make):
    docs = suffixdedup.keyed(make([(1, "x" * 250), (1, "y" * 250), (None, "z")]))
    none = docs.filter("doc_id = 9")
    assert suffixdedup.remove(none, suffixdedup.repeated_ranges(none, Workspace(spark, "t"))).count() == 0
    out = suffixdedup.remove(docs, suffixdedup.repeated_ranges(docs, Workspace(spark, "t"))).collect()
    assert sorted(r["n_removed"] for r in out) == [0, 250, 250]
