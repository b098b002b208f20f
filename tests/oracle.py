"""Holds queries against their SQL, as the driver does: same columns, same rows in any order."""

from __future__ import annotations

import math
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v: object) -> object:
        if v is None or (isinstance(v, float) and math.isnan(v)) or v is pd.NaT or v is pd.NA:
            return (0, "")
        if isinstance(v, bool):
            return (1, v)
        if hasattr(v, "item"):
            v = v.item()
        return (2, round(float(v), 5) + 0.0) if isinstance(v, int | float) else (3, str(v))

    cols = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[cols].astype(object).itertuples(index=False)), key=repr)


def differ(spark_df, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:  # noqa: ANN001
    """What differs, if anything."""
    got, want = spark_df.toPandas(), con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    for a, b in zip(_rows(got), _rows(want), strict=True):
        if a != b and not all(x == y or (x[0] == y[0] == 2 and math.isclose(x[1], y[1], rel_tol=1e-9, abs_tol=2e-5)) for x, y in zip(a, b, strict=True)):
            return f"{a} and {b}"
    return None
