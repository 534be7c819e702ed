"""Ids of rows: a doc_id may be null or stand on several rows, and a decision about one row must not reach another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def row_id(docs: DataFrame, id_col: str = "doc_id") -> Column:
    """A struct that sorts by id (null last) and then by a hash of all columns: only rows that are equal throughout share it."""
    whole = F.xxhash64(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x00")) for c in docs.columns])
    return F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).alias("id"), whole.alias("row"))


def carried(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """q_id and q_row, the whole row as one struct: whatever the columns are called, none can clash with a helper's name."""
    return docs.select(row_id(docs, id_col).alias("q_id"), F.struct("*").alias("q_row"))
