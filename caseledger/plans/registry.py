"""Registry of the queries that run over the given tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Plan = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    run: Plan
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(sql: str | None = None) -> Callable[[Plan], Plan]:
    """Register a plan under its function name; ``sql`` states the same result."""

    def register(plan: Plan) -> Plan:
        if plan.__name__ in REGISTRY:
            raise ValueError(f"{plan.__name__} is registered twice")
        REGISTRY[plan.__name__] = Query(plan.__name__, plan, sql)
        return plan

    return register


class Tables:
    """The given tables as attributes: ``Tables(spark, folder).orders``."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")
