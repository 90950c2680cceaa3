"""Folds over small ordered groups, many groups to an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame


def fold_groups(df: DataFrame, keys: list[str], order: list[str], fold: Callable[[tuple, list[tuple]], list[tuple]], schema: str) -> DataFrame:
    """Rows of a key stand together and in order; `fold` gets the key and its rows (tuples in column order) and gives
    the rows of the result. One shuffle and one sort; unlike a call for each group, batches are shared by groups."""
    at, names = [df.columns.index(k) for k in keys], [part.split()[0] for part in schema.split(", ")]

    def run(batches):
        key, rows, out = None, [], []
        for b in batches:
            for r in zip(*[b[c].tolist() for c in b.columns], strict=True):
                own = tuple(r[i] for i in at)
                if own != key:
                    if rows:
                        out.extend(fold(key, rows))
                    key, rows = own, []
                rows.append(r)
            if out:
                yield pd.DataFrame(out, columns=names)
                out = []
        if rows:
            out.extend(fold(key, rows))
        if out:
            yield pd.DataFrame(out, columns=names)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)
