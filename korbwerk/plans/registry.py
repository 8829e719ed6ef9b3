"""Queries by name, each with its DuckDB counterpart where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from korbwerk.plans.views import SQL, Views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, dates: str = "", lists: str = ""):
    """Registers a function of Views; `sql` continues the CTEs of the views. Columns named in `dates` and `lists` are returned as text, which compares alike everywhere."""
    days, arrays = dates.split(), lists.split()

    def put(f: Callable[[Views], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            found = f(Views(spark, sf_dir))
            return found.withColumns({c: F.col(c).cast("string") for c in days} | {c: F.array_join(c, ",") for c in arrays})

        QUERIES[name] = run
        if sql:
            put_as = [f"CAST({c} AS VARCHAR) AS {c}" for c in days] + [f"array_to_string({c}, ',') AS {c}" for c in arrays]
            ORACLES[name] = f"SELECT * REPLACE ({', '.join(put_as)}) FROM (WITH {SQL}{sql})" if put_as else f"WITH {SQL}{sql}"
        return f

    return put
