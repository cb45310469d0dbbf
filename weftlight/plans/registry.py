"""How a query is registered: a callable over the tables of a folder, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftlight.sources.places import shared_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


class Tables:
    """The parquet tables of a folder by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def sql(self, text: str, *names: str) -> DataFrame:
        return self.spark.sql(text, **{n: getattr(self, n) for n in names})

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A frame that a query needs in several places: computed once, into the shared folder, and read from there."""
        if name not in self._kept:
            df, place = make(), shared_folder(self.spark, name)
            df.write.parquet(place)
            self._kept[name] = self.spark.read.schema(df.schema).parquet(place)
        return self._kept[name]


def query(name: str, sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add
