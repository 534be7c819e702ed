"""What all registered queries share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from solargrid.operators.density import Grid

#: The grid of the fixtures' area.
GRID = Grid(60.0, 24.0)
#: Doubles leave a query as scaled integers, so that engines compare equal.
SCALE = 1_000_000


def scaled(c: Column | str, by: int = SCALE) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * by + F.lit(0.5)).cast("long")


def six_digits(prefix: str, number: Column) -> Column:
    """The SQL's lpad(number, 6, '0'), which also cuts longer numbers to their first six digits."""
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), 6, "0"))


def scale(df: DataFrame, *cols: str, by: int = SCALE) -> DataFrame:
    return df.withColumns({c: scaled(c, by) for c in cols})


def sql_scaled(expr: str, name: str, by: str = "1E6") -> str:
    return f"CAST(floor(({expr})*{by}+0.5E0) AS BIGINT) AS {name}"
