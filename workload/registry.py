"""Where the queries and their oracles are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table, spread over the cores if its files are fewer than those.

    A large table arrives in many partitions and is left alone.
    """
    df = table(spark, sf_dir, name)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def rounded(value: Column, digits: int = 6) -> Column:
    """Rounded, with no negative zero: engines print that one differently."""
    r = F.round(value, digits)
    return F.when(r == 0, F.lit(0.0)).otherwise(r)


def sql_rounded(value: str, digits: int = 6) -> str:
    return f"CASE WHEN round({value}, {digits}) = 0 THEN 0.0 ELSE round({value}, {digits}) END"
