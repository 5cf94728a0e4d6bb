"""Holds queries against their SQL on the same tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sf_dir: str, sql: str, tables: list[str] | None = None):
    con = duckdb.connect(config={"memory_limit": "4GB"})
    for t in tables or TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con.execute(sql).df()


def canon(df) -> list[tuple]:
    def cell(x):
        if x is None or (isinstance(x, float) and math.isnan(x)) or str(x) in ("nan", "<NA>", "NaT"):
            return ""
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float) and x.is_integer():
            x = int(x)
        return repr(x)

    cols = sorted(df.columns)
    return sorted(tuple(cell(x) for x in row) for row in df[cols].itertuples(index=False, name=None))
