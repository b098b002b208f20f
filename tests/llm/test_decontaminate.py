from __future__ import annotations

import random

import pytest

from geoloom.llm import decontaminate as d


def brute(docs, items, window=10):
    wins = {}
    for name, text in items:
        w = d.words(text)
        n = min(window, len(w))
        for k in range(len(w) - n + 1) if n else ():
            wins.setdefault(tuple(w[k : k + n]), set()).add(name)
    out = []
    for text in docs:
        w = d.words(text)
        hit, found = set(), set()
        for n in {len(x) for x in wins}:
            for k in range(len(w) - n + 1):
                own = wins.get(tuple(w[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((len(w), len(hit), sorted(found)))
    return out


@pytest.mark.parametrize("seed", range(6))
def test_automaton_against_windows(seed):
    r = random.Random(seed)
    text = lambda n: " ".join(r.choice("abcd" if seed % 2 else "ab") for _ in range(n))
    items = [(str(k), text(r.randint(1, 25))) for k in range(6)]
    docs = [text(r.randint(0, 80)) for _ in range(30)]
    a = d.Automaton([(n, d.words(t)) for n, t in items])
    for doc, (n, n_hit, found) in zip(docs, brute(docs, items), strict=True):
        hit, own = a.hits(d.words(doc))
        assert (len(hit), int(hit.sum()), sorted(a.names[k] for k in own)) == (n, n_hit, found)


@pytest.mark.parametrize("max_words", [d.MAX_WORDS, 12])
def test_spans(spark, make, max_words):
    item = "The quick brown fox jumps over the lazy dog and then sleeps"
    bench = spark.createDataFrame([(1, item), (2, "Tiny item"), (3, None), (4, "..."), (None, "zz")], "item_id long, text string")
    rows = [(1, f"x {item.upper()}! y"), (1, "a tiny ITEM"), (None, None), (4, ""), (5, "nothing here")]
    got = sorted(((r["doc_id"] or 0, r["n_words"], r["n_hit"], r["items"]) for r in d.spans(make(rows), bench, max_words=max_words).collect()))
    assert got == [(0, 0, 0, []), (1, 3, 2, ["2"]), (1, 14, 12, ["1"]), (4, 0, 0, []), (5, 2, 0, [])]
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r["n_hit"] for r in d.spans(make(rows), empty).collect()} == {0}
    assert d.spans(make([(1, "a")]).filter("doc_id = 2"), bench).count() == 0


def test_repeated_items_count_once_however_many_automata(spark, make):
    item = "the quick brown fox jumps over the lazy dog and then sleeps"
    bench = spark.createDataFrame([("x", item), ("x", f"{item} again"), ("y", "some other words"), ("y", "words of it")], "item_id string, text string")
    rows = make([(1, f"a {item} again b some other words of it"), (2, "none")])
    for max_words in (d.MAX_WORDS, 12, 1):
        got = {r["doc_id"]: r for r in d.spans(rows, bench, max_words=max_words, keep=("doc_id", "label")).collect()}
        assert got[1]["items"] == ["x", "y"] and got[1]["n_hit"] == 18 and got[1]["row"]["label"] == "x"
        assert [(s["start"], s["end"]) for s in got[1]["spans"]] == [(1, 14), (15, 20)] and got[2]["n_hit"] == 0


def test_clean():
    text = "keep this " + "one two three four five six seven eight nine ten" + ", and this too " + "more words " * 10
    assert d.clean(text, [(2, 12)]).startswith("keep this , and this too")
    assert d.clean("one two three", [(0, 3)], min_span=1) is None
    assert d.clean("a", []) == "a" and d.clean(None, []) is None
