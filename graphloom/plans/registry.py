"""Where the queries register: a callable on Spark, and SQL for a second engine where it can say the same."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import storage
from . import fixtures

Query = Callable[[SparkSession, str], DataFrame]
found_queries: dict[str, Query] = {}
found_sql: dict[str, str] = {}


def query(sql: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Registers a query under its name; ``sql`` may use the fixtures' tables and goes behind them."""

    def register(f: Query) -> Query:
        found_queries[f.__name__] = f
        if sql:
            body = sql.strip()
            more = "" if not body.startswith(",") else body
            found_sql[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{fixtures.SQL.strip()}{more or chr(10) + body}"
        return f

    return register


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below ``spark.checkpoint.dir``, in local mode where that is unset a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    path = f"{named.rstrip('/')}/graphloom/{name}-{uuid.uuid4().hex}"
    storage.make_temporary(spark, path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table written and read again: what follows starts from files, however often it reads them."""
    path = scratch(df.sparkSession, name) + "/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
