"""Names of helper columns that no column of a user's table bears."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(df: DataFrame, name: str) -> str:
    """``__name``, with as many underscores at its end as it takes to differ from every column of ``df``, in whatever case."""
    taken, own = {c.lower() for c in df.columns}, f"__{name}"
    while own.lower() in taken:
        own += "_"
    return own
