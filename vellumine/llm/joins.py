"""Joins that survive hot keys, and names that clash with no column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tables of ids up to this many rows are sent to all executors; more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: The tasks that a key of unknown size is dealt to where its partner is not broadcast.
SALTS = 8


def dealt(n: int | Column) -> Column:
    """A row for each number below n, to copy a small side to n tasks."""
    return F.explode(F.sequence(F.lit(0).cast("long"), (F.lit(n) if isinstance(n, int) else n).cast("long") - 1))


def beside(big: DataFrame, small: DataFrame, on: str | list[str], rows: int, how: str = "left", most: int = BROADCAST_IDS) -> DataFrame:
    """big with the columns of small, which has so many rows and few a key: by broadcast up to `most`; beyond, each key is dealt to SALTS tasks, so that one with many rows of big is not one task's."""
    on = [on] if isinstance(on, str) else on
    if rows <= most:
        return big.join(F.broadcast(small), on, how)
    return big.withColumn("salt", F.pmod(F.xxhash64(*big.columns), F.lit(SALTS))).join(small.withColumn("salt", dealt(SALTS)), [*on, "salt"], how).drop("salt")


def unused(docs: DataFrame, name: str) -> str:
    """A column name that docs has not."""
    while name.lower() in {c.lower() for c in docs.columns}:
        name = f"_{name}"
    return name
