"""Names of helper columns."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(rows: DataFrame, *names: str) -> list[str]:
    """The names, or longer ones where rows has them already, whatever their case."""
    taken = {c.lower() for c in rows.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out
