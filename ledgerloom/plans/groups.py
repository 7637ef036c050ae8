"""Python steps on groups of rows, many small groups to a batch: one call of Python for each would cost more than its work."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def each_group(df: DataFrame, keys: list[str], order: list[str], step: Callable[[list[dict]], list[tuple]], schema: str) -> DataFrame:
    """What step makes of the rows of each group, which it gets in order (nulls last); a task holds a batch and one group.

    schema names and types the values of the tuples.
    """
    names = [part.split()[0] for part in schema.split(", ")]

    def walk(tables: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        group, last = [], None
        for table in tables:
            out = []
            for row in table.to_dict("records"):
                key = tuple(None if pd.isna(row[k]) else row[k] for k in keys)
                if group and key != last:
                    out += step(group)
                    group = []
                last = key
                group.append(row)
            yield pd.DataFrame(out, columns=names)
        if group:
            yield pd.DataFrame(step(group), columns=names)

    placed = df.repartition(*keys).sortWithinPartitions(*keys, *[F.col(c).asc_nulls_last() for c in order])
    return placed.mapInPandas(walk, schema)
