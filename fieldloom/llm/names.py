"""Names of working columns that no column of the caller's has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def fresh(df: DataFrame, *names: str) -> dict[str, str]:
    """For each name one like it that isn't a column of ``df``, whatever the case of letters."""
    taken = {c.lower() for c in df.columns}
    out = {}
    for name in names:
        own = f"_{name}"
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        out[name] = own
    return out
