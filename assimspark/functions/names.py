"""Names for helper columns that no table has."""

from __future__ import annotations

from pyspark.sql import DataFrame


def own_names(df: DataFrame, *what: str) -> dict[str, str]:
    """A column name for each purpose, lengthened until the table has no such column."""
    taken, out = {c.lower() for c in df.columns}, {}
    for w in what:
        name = f"__{w}"
        while name.lower() in taken:
            name += "_"
        out[w] = name
        taken.add(name.lower())
    return out
