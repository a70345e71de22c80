"""The registered queries and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from namewright.plans.identifiers import GOLD_SQL, IDS_SQL, RENAMES_SQL
from namewright.sources.shared import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

IDS, REN = f"WITH {IDS_SQL} ", f"WITH {IDS_SQL}, {RENAMES_SQL} "
GOLD = f"WITH {IDS_SQL}, {RENAMES_SQL}, {GOLD_SQL} "


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) under its name, with its SQL."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def rounded(df: DataFrame, columns) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), 9) for c in columns})


def place(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"
