"""Walks along ordered rows, for states that no window expresses."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame


class Walk:
    """The state of one key. step() and end() return rows of the result without the key's columns."""

    def step(self, rows: pd.DataFrame) -> list[tuple]:
        """The key's next rows, in order: any number of them at a time."""
        raise NotImplementedError

    def end(self) -> list[tuple]:
        return []


def _plain(v):
    return None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v


def ordered_walk(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], make: Callable[[], Walk], out: str) -> DataFrame:
    """The rows that a Walk per key returns, with the keys before them; out: the names and types of the other columns.

    A key's rows are sorted on disk where needed and reach its Walk batch by batch (spark.sql.execution.arrow's bounds), the
    state handed on from one to the next: however long a key is, memory holds a batch and a state. Null keys are keys. A
    lost executor's partitions are walked again from their start."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), out])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, key, walk = None, None, None
        for rows in batches:
            if not len(rows):
                continue
            k = rows[list(keys)]
            same = ((k == k.shift()) | (k.isna() & k.shift().isna())).all(axis=1).to_numpy()
            same[0] = False
            cuts = [i for i, x in enumerate(same) if not x] + [len(rows)]
            found: list[tuple] = []
            for a, b in zip(cuts, cuts[1:], strict=False):
                mine = tuple(_plain(v) for v in k.iloc[a])
                if walk is None or mine != key:
                    if walk is not None:
                        found += [(*key, *r) for r in walk.end()]
                    key, walk = mine, make()
                found += [(*key, *r) for r in walk.step(rows.iloc[a:b])]
            if found:
                names = names or _names(schema)
                yield pd.DataFrame(found, columns=names, dtype=object)
        if walk is not None and (found := [(*key, *r) for r in walk.end()]):
            yield pd.DataFrame(found, columns=names or _names(schema), dtype=object)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0].strip("`") for c in schema.split(", ")]
