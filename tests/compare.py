"""Order-free comparison of a Spark result with DuckDB's."""

from __future__ import annotations

import math

import pandas as pd


def plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and math.isnan(value)) or value is pd.NA:
        return ""
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)):
        return f"{float(value):.9g}"
    return str(value)


def rows(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted(tuple(plain(x) for x in r) for r in df.itertuples(index=False))
