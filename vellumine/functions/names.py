"""Column names that clash with none."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(name: str, *dfs: DataFrame) -> str:
    """name, or the like of it, that none of the DataFrames has as a column."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
