"""A keyed table in the shared folder: what an index of vertices is for.

Each change gives a new version, written once and sorted by key within files, so that point and range
searches skip files and row groups by their statistics.  Old versions stay readable until the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.session import materialize


class KeyedTable:
    """Rows of unique keys."""

    def __init__(self, rows: DataFrame, key: str = "id"):
        self.key = key
        self.rows = self._loaded(rows)

    def _loaded(self, rows: DataFrame) -> DataFrame:
        return materialize(rows.repartitionByRange(self.key).sortWithinPartitions(self.key), "keyed")

    def reload(self, rows: DataFrame) -> None:
        """Replace everything."""
        self.rows = self._loaded(rows)

    def search(self, key) -> DataFrame:
        return self.rows.where(F.col(self.key) == F.lit(key))

    def range(self, low=None, high=None) -> DataFrame:
        """Rows with ``low <= key <= high``, in order; an open end is None."""
        out = self.rows
        if low is not None:
            out = out.where(F.col(self.key) >= F.lit(low))
        if high is not None:
            out = out.where(F.col(self.key) <= F.lit(high))
        return out.orderBy(self.key)

    def insert(self, rows: DataFrame) -> None:
        """Add rows; those whose key is there already are left out."""
        new = rows.select(*self.rows.columns).dropDuplicates([self.key])
        self.rows = self._loaded(self.rows.union(new.join(self.rows.select(self.key), self.key, "left_anti").select(*self.rows.columns)))

    def update(self, condition: Column, **values: Column) -> None:
        """New values for the rows that meet a condition; each is cast to its column's type."""
        kinds = dict(self.rows.dtypes)
        self.rows = self._loaded(self.rows.withColumns({c: F.when(condition, v.cast(kinds[c])).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, keys: DataFrame) -> None:
        self.rows = self._loaded(self.rows.join(keys.select(self.key), self.key, "left_anti"))

    def drop(self) -> None:
        self.rows = self.rows.limit(0)
