"""Connections: in_memory(), connect(folder), and statements that give Arrow tables."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .plans.sqlfront import Engine
from .session import session


class Connection:
    """One engine: its tables, its settings, and results as Arrow."""

    def __init__(self, spark: SparkSession, folder: str | None = None):
        self.engine = Engine(spark, folder)

    def query(self, text: str) -> DataFrame:
        """A query's rows as a DataFrame, not yet computed."""
        return self.engine.sql(text)

    def sql(self, text: str) -> pa.Table:
        """A query's rows, all of them, on the driver."""
        return self.engine.sql(text).toArrow()

    def execute(self, text: str) -> None:
        """Statements that change tables or settings, separated by semicolons."""
        self.engine.script(text)

    def create_table(self, name: str, table: pa.Table | DataFrame) -> None:
        self.engine.add_table(name, table)

    def append(self, name: str, table: pa.Table | DataFrame) -> None:
        self.engine.append_table(name, table)


def in_memory(spark: SparkSession | None = None) -> Connection:
    """Nothing but what is added."""
    return Connection(spark or session())


def connect(folder: str, spark: SparkSession | None = None) -> Connection:
    """The tables of a data folder."""
    return Connection(spark or session(), folder)
