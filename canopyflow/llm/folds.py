"""Folds by crc32 of the decimal doc_id, and helpers for plans over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: str | Column, modulus: int) -> Column:
    """crc32(doc_id as text) mod modulus; a null id counts as remainder of the empty text (0)."""
    column = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)).cast("int")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, by exact name; other columns, whatever their names, stay behind."""
    return df.select(*[F.col(f"`{n}`") for n in names])
