from __future__ import annotations

import random

import pytest

from geoloom.llm import linededup
from geoloom.llm.common import Workspace


def brute(texts, least):
    first, out = set(), []
    for t in texts:
        x = t.split("\n")
        w, gone = [len(v.split()) for v in x], set()
        for i in range(len(x)):
            for j in range(i, len(x)):
                if sum(w[i : j + 1]) >= least:
                    key = tuple(x[i : j + 1])
                    if key in first:
                        gone.update(range(i, j + 1))
                    first.add(key)
        out.append("\n".join(v for k, v in enumerate(x) if k not in gone))
    return out


@pytest.mark.parametrize(("seed", "least"), [(1, 3), (2, 5), (3, 8)])
def test_against_all_runs(spark, make, seed, least):
    r = random.Random(seed)
    pool = ["", "a", "b c", "d e f", "g h", "i", "j k l m"]
    texts = ["\n".join(r.choice(pool) for _ in range(r.randint(1, 14))) for _ in range(25)]
    docs = make(list(enumerate(texts)))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(docs, Workspace(spark, "t"), least).collect()}
    assert [got[k]["text"] for k in range(25)] == brute(texts, least)
    assert all(got[k]["n_lines"] == t.count("\n") + 1 and got[k]["label"] == "x" for k, t in enumerate(texts))


def test_odd_rows(spark, make):
    long = " ".join(f"w{k}" for k in range(40))
    docs = make([(1, None), (2, ""), (3, long), (4, long), (None, long)]).withColumn("n_lines", linededup.F.lit(7)).withColumn("h", linededup.F.lit("h"))
    docs = docs.union(docs.filter("doc_id = 3"))
    out = linededup.dedup_lines(docs, Workspace(spark, "t")).collect()
    kept = [r for r in out if r["text"] == long]
    assert len(out) == 6 and len(kept) == 1 and sum(r["text"] == "" and r["n_removed"] == 1 for r in out) == 3
    assert next(r for r in out if r["doc_id"] == 1)["text"] is None and {r["n_lines"] for r in out} == {7} and {r["_n_lines"] for r in out} == {0, 1}
    assert linededup.dedup_lines(docs.filter("doc_id = 77"), Workspace(spark, "t")).count() == 0


def test_a_line_in_every_document_and_a_long_text(spark, make):
    """A hot run, and a text of very many lines with many cuts: the same cuts as one by one."""
    rows = [(k, f"own line {k} of this text\nthe license line that all of them have\nanother own line {k} here") for k in range(400)]
    rows.append((1000, "\n".join(f"line {k % 3000} is repeated in this text" if k % 2 else f"line {k} stands once in this text" for k in range(20_000))))
    got = {r["doc_id"]: r for r in linededup.dedup_lines(make(rows), Workspace(spark, "t")).collect()}
    assert [got[k]["n_removed"] for k in range(400)] == [0] + [1] * 399 and got[5]["text"] == "own line 5 of this text\nanother own line 5 here"
    assert got[1000]["n_removed"] == 10_000 - 1500 and got[1000]["text"].count("\n") == 11_499


def test_shortest_runs_cover_long_ones():
    assert linededup.shortest_runs([15, 5, 15], 25) == [(0, 3)]
    assert linededup.shortest_runs([25, 5], 25) == [(0, 1), (0, 2)]
    assert linededup.shortest_runs([1, 1], 3) == []
