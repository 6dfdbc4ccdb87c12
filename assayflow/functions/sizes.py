"""Tables that are small enough to broadcast."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tables of up to so many bytes are broadcast.
MOST_BROADCAST_BYTES = 32_000_000


def _width(column: Column, kind: T.DataType) -> Column:
    """About how many bytes a value takes in memory."""
    if isinstance(kind, T.StringType):
        return F.coalesce(F.octet_length(column), F.lit(0)) + 16
    if isinstance(kind, T.BinaryType):
        return F.coalesce(F.length(column), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        return F.aggregate(F.coalesce(column, F.array().cast(kind)), F.lit(16).cast("long"), lambda a, x: a + _width(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return sum((_width(column[f.name], f.dataType) for f in kind.fields), F.lit(16))
    return F.lit(8)


def table_bytes(table: DataFrame) -> int:
    """About how many bytes the table's rows take in memory; reads the table once."""
    width = sum((_width(F.col(f"`{f.name}`"), f.dataType) for f in table.schema.fields), F.lit(16).cast("long"))
    return table.agg(F.sum(width)).first()[0] or 0


def few(table: DataFrame, most: int = MOST_BROADCAST_BYTES) -> DataFrame:
    """The table, marked for broadcast if its rows take ``most`` bytes of memory at most; else joins with it shuffle."""
    return F.broadcast(table) if table_bytes(table) <= most else table
