"""Column names that an operator adds to a table which may have them already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def aside(docs: DataFrame, names: list[str]) -> DataFrame:
    """``docs`` with each column named like one of ``names`` (in any case) renamed to that name and ``_in``, as often as needed."""
    taken, wanted = {c.lower() for c in docs.columns}, {n.lower() for n in names}
    out = []
    for c in docs.columns:
        name = c
        while name.lower() in wanted or (name != c and name.lower() in taken):
            name += "_in"
        taken.add(name.lower())
        out.append(F.col(f"`{c}`").alias(name))
    return docs.select(*out)
