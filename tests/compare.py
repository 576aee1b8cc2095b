"""Compares a Spark result with a DuckDB result, whatever the order of rows and columns."""

import pandas as pd


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        if str(df[c].dtype).startswith("datetime") or any(hasattr(v, "isoformat") for v in df[c].dropna().head(3)):
            df[c] = df[c].map(lambda v: None if pd.isna(v) else str(v)[:10])
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def differences(a: pd.DataFrame, b: pd.DataFrame) -> list:
    a, b = normal(a), normal(b)
    if list(a.columns) != list(b.columns):
        return [("columns", list(a.columns), list(b.columns))]
    if len(a) != len(b):
        return [("rows", len(a), len(b))]
    bad = []
    for c in a.columns:
        same = (a[c] == b[c]) | (a[c].isna() & b[c].isna())
        if not same.all():
            i = same[~same].index[0]
            bad.append((c, int((~same).sum()), a[c][i], b[c][i]))
    return bad
