"""Registry of queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusbank.session import spread

TEXT_TABLES = ("documents", "pages")  # heavy work per row

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables)`` under a name; ``tables`` is a :class:`Tables`."""
    def register(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(Tables(spark, sf_dir))

        run.__name__ = name
        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return fn
    return register


class Tables:
    """Parquet tables of one folder as attributes: ``t.documents``, ``t.orders`` .."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return spread(df) if name in TEXT_TABLES else df

    def values(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small literal table (targets, overrides, price list) of known size."""
        fields = [field.split() for field in schema.split(",")]
        structs = [
            F.struct(*[F.lit(v).cast(kind).alias(name) for v, (name, kind) in zip(row, fields)])
            for row in rows
        ]
        return self.spark.range(1).select(F.inline(F.array(*structs)))
