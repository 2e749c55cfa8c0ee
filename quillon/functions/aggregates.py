"""User-defined aggregates in two phases.

A definition says how a buffer starts, takes in a row, joins another buffer and ends.  Rows are taken
in where they are, partition by partition, so that a key travels as one buffer from each partition,
however many rows it has.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Keys that a partition holds buffers of before it passes them on.
HELD = 100_000


@dataclass(frozen=True)
class Aggregate:
    """``iterate(buffer, *values)`` and ``merge(buffer, other)`` return the buffer; a buffer can be pickled."""

    init: Callable[[], Any]
    iterate: Callable[..., Any]
    merge: Callable[[Any, Any], Any]
    terminate: Callable[[Any], Any]
    returns: str = "double"


def aggregate(df: DataFrame, keys: Sequence[str], values: Sequence[str], definition: Aggregate, alias: str) -> DataFrame:
    """One row a key with the aggregate of its rows; null keys are a key; without rows there is no result.

    Nulls among the values are passed on as None: the definition decides what they mean.
    """
    keys, values = list(keys), list(values)
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def partial(batches: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        buffers: dict[tuple, Any] = {}

        def passed() -> pd.DataFrame:
            out = pd.DataFrame(list(buffers), columns=keys, dtype=object)
            out["buffer"] = [pickle.dumps(b) for b in buffers.values()]
            buffers.clear()
            return out

        for batch in batches:
            plain = batch.astype(object).where(batch.notna(), None)
            for key, row in zip(zip(*(plain[k] for k in keys)), zip(*(plain[v] for v in values))):
                if key not in buffers:
                    buffers[key] = definition.init()
                buffers[key] = definition.iterate(buffers[key], *row)
            if len(buffers) > HELD:
                yield passed()
        yield passed()

    def final(group: pd.DataFrame) -> pd.DataFrame:
        buffer = definition.init()
        for b in group["buffer"]:
            buffer = definition.merge(buffer, pickle.loads(b))
        out = group[keys].head(1).copy()
        out[alias] = [definition.terminate(buffer)]
        return out

    parts = df.select(*keys, *[F.col(v) for v in values if v not in keys]).mapInPandas(partial, f"{schema}, buffer binary")
    return parts.groupBy(*keys).applyInPandas(final, f"{schema}, `{alias}` {definition.returns}")
