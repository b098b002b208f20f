from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, label string"


def sentence(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(2, 8))) for _ in range(n))


@pytest.fixture
def make(spark):
    """Documents from (doc_id, text) with further columns, one of which clashes with a name of the operators."""

    def build(rows):
        return spark.createDataFrame([(i, t, "en", None if k % 3 else "s", len(t or ""), "x") for k, (i, t) in enumerate(rows)], SCHEMA)

    return build
