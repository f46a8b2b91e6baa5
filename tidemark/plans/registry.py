"""Registry of the named queries and their SQL equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its SQL."""

    def keep(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def r(c: Column | str, digits: int = 6) -> Column:
    """Rounded for comparison across engines, without a negative zero; scaled in doubles as in the SQL, half away from zero.

    `F.round` takes the decimal that a double is written as, so values on a half would go the other way at times.
    """
    c = (F.col(c) if isinstance(c, str) else c).cast("double")
    scaled = F.abs(c) * 10.0**digits
    whole = F.floor(scaled)
    up = (whole + F.when(scaled - whole >= 0.5, 1).otherwise(0)).cast("double")
    # doubles from 2^52 on are whole
    out = F.when(scaled == float("inf"), c).otherwise(F.signum(c) * F.when(scaled < 2.0**52, up).otherwise(scaled) / 10.0**digits)
    return out + F.lit(0.0)


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: r(F.col(n).cast("double"), digits) for n in names})


def R(expression: str, digits: int = 6) -> str:  # noqa: N802
    return f"(round(CAST({expression} AS DOUBLE), {digits}) + 0.0)"
