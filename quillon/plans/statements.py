"""A statement surface: DDL, INSERT OVERWRITE, multi-insert, SET with substitution, EXPLAIN and queries."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.session import materialize
from quillon.sources.files import read_delimited

_CREATE = re.compile(r"create\s+(external\s+)?table\s+(if\s+not\s+exists\s+)?(\w+)\s*\((.*?)\)\s*(?:row\s+format\s+delimited\s+fields\s+terminated\s+by\s+'(.+?)'\s*)?(?:stored\s+as\s+(\w+)\s*)?(?:location\s+'(.+?)'\s*)?$", re.I | re.S)
_INSERT = re.compile(r"insert\s+overwrite\s+table\s+(\w+)\s+", re.I)


class Runner:
    """Runs statements one after another; its tables are temporary views over files in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.variables: dict[str, str] = {}
        self.schemas: dict[str, str] = {}
        self.tables: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        return self.tables[name.lower()]

    def script(self, text: str) -> DataFrame | None:
        """The result of the last query of a script."""
        last = None
        for statement in _split(text):
            last = self.run(statement)
        return last

    def run(self, text: str) -> DataFrame | None:
        text = self._substituted(text.strip())
        low = text.lower()
        if low.startswith("set "):
            key, _, value = text[4:].partition("=")
            self.variables[key.strip()] = value.strip()
            return None
        if low.startswith("drop table"):
            self._put(text.split()[-1], None)
            return None
        if low.startswith("create"):
            return self._create(text)
        if low.startswith("explain"):
            return self.spark.createDataFrame([(self.spark.sql(text[7:])._jdf.queryExecution().toString(),)], "plan string")
        if low.startswith("from ") and _INSERT.search(text):
            return self._multi_insert(text)
        if m := _INSERT.match(text):
            self._overwrite(m[1], self.spark.sql(text[m.end() :]))
            return None
        return self.spark.sql(text)

    def _substituted(self, text: str) -> str:
        return re.sub(r"\$\{(?:hiveconf:|hivevar:)?([\w.]+)\}", lambda m: self.variables.get(m[1], m[0]), text)

    def _put(self, name: str, df: DataFrame | None) -> None:
        name = name.lower()
        if df is None:
            self.tables.pop(name, None)
            self.schemas.pop(name, None)
            self.spark.catalog.dropTempView(name)
        else:
            self.tables[name] = df
            df.createOrReplaceTempView(name)

    def _create(self, text: str) -> None:
        m = _CREATE.match(text)
        if not m:
            raise SyntaxError(text[:80])
        name, columns, sep, location = m[3], " ".join(m[4].split()), m[5], m[7]
        if m[2] and name.lower() in self.tables:
            return
        self.schemas[name.lower()] = columns
        sep = {"\\t": "\t", "\\001": "\x01"}.get(sep, sep)
        self._put(name, read_delimited(self.spark, location, columns, sep or "\x01") if location else self.spark.createDataFrame([], columns))

    def _overwrite(self, name: str, df: DataFrame) -> None:
        """Replace a table by a result, whose columns are cast to the table's by position."""
        schema = self.spark.createDataFrame([], self.schemas[name.lower()]).schema
        if len(schema) != len(df.columns):
            raise ValueError(f"{name} has {len(schema)} columns, the query {len(df.columns)}")
        cast = df.toDF(*[f"c{i}" for i in range(len(schema))]).select(*[F.col(f"c{i}").try_cast(f.dataType).alias(f.name) for i, f in enumerate(schema)])
        self._put(name, materialize(cast, f"table-{name.lower()}"))

    def _multi_insert(self, text: str) -> None:
        """``FROM source INSERT ... INSERT ...``: the source is computed once for all inserts."""
        marks = list(_INSERT.finditer(text))
        source = text[5 : marks[0].start()].strip()
        shared = materialize(self.spark.sql(f"SELECT * FROM {source}"), "shared-scan")
        shared.createOrReplaceTempView("__shared")
        for m, after in zip(marks, [*marks[1:], None]):
            body = text[m.end() : after.start() if after else len(text)]
            cut = re.search(r"\s(where|group\s+by|order\s+by|having|limit)\s", body, re.I)
            at = cut.start() if cut else len(body)
            self._overwrite(m[1], self.spark.sql(f"{body[:at]} FROM __shared {body[at:]}"))
        self.spark.catalog.dropTempView("__shared")


def _split(text: str) -> list[str]:
    """Statements between semicolons that are not inside quotes; comment lines are dropped."""
    text = "\n".join(x for x in text.splitlines() if not x.lstrip().startswith("--"))
    return [s for s in (x.strip() for x in re.findall(r"(?:[^;'\"]|'[^']*'|\"[^\"]*\")+", text)) if s]
