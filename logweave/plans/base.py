"""Registration of queries with their SQL twins."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..functions.storage import bucketed, shared_dir
from ..sources.run_log import derive, partitions
from .log_sql import over_log

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def stored(log: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The log, or some columns of it, written once to the shared folder: for queries that read several parts of it."""
    spark = log.sparkSession
    path = f"{shared_dir(spark)}/log-{uuid.uuid4().hex}"
    log = log.select(*columns) if columns else log
    log.write.parquet(path)
    return spark.read.schema(log.schema).parquet(path)


def on_log(name: str, build: Callable[[DataFrame], DataFrame], body: str | None = None, ctes: str = "", store: list[str] | None = None, deal: bool = False) -> None:
    """A query over the derived log and its twin: `body` after the log's CTEs. store: columns of the log to write once, where the query reads the log more than once; deal: write it (whole, or those columns) in buckets by run, where what it reads meets by run again."""
    sql = None if body is None else over_log(body, ctes)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        log = derive(spark, sf_dir)
        return build(bucketed(log.select(*(store or log.columns)), partitions(spark, sf_dir)) if deal else stored(log, store) if store else log)

    query(name, sql)(run)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
