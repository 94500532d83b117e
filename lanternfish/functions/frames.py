"""Pandas frames as Arrow wants them from tasks."""

from __future__ import annotations

import pandas as pd


def object_frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    """Columns of plain Python objects: strings never become chunked Arrow arrays, and an empty list keeps its columns."""
    values = list(zip(*rows)) if rows else [()] * len(columns)
    return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(columns, values)})
