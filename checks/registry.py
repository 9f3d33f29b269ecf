"""Registration of a query together with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from checks.inputs import INPUTS

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


@dataclass
class Tables:
    """The driver tables of one folder, and the inputs Spark derives from them."""

    spark: SparkSession
    folder: str
    _seen: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def parts(self) -> int:
        """Tasks to deal an input to before costly work on each row: each of these tables is one row group."""
        return self.spark.sparkContext.defaultParallelism

    def __call__(self, name: str) -> DataFrame:
        if name not in self._seen:
            if name in INPUTS:
                sql = INPUTS[name]
                used = {t: self(t) for t in [*TABLES, *INPUTS] if "{" + t + "}" in sql}
                self._seen[name] = self.spark.sql(sql, **used)
            else:
                self._seen[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
        return self._seen[name]


Query = Callable[[Tables], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def as_sql(sql: str) -> str:
    """Replaces {name} of a driver table by its name and {name} of a derived input by its subquery."""
    for name, text in INPUTS.items():
        if "{" + name + "}" in sql:
            sql = sql.replace("{" + name + "}", "(" + as_sql(text) + ")")
    for name in TABLES:
        sql = sql.replace("{" + name + "}", name)
    return sql


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        assert name not in QUERIES, name
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = as_sql(sql)
        return fn

    return register
