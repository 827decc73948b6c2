"""Helpers shared by the training-data operators: registry, shared storage, table reading."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kandle.session import ship_package
from kandle.sources.scratch import discard, materialize, scratch_path  # noqa: F401
from kandle.sources.tables import table

Q: dict = {}
SQL: dict = {}

#: ASCII white space; words are maximal runs of other characters.
WS = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    def deco(fn):
        Q[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def python_ready(spark: SparkSession) -> None:
    """Executors can import this package (Arrow functions refer to it)."""
    ship_package(spark)
