"""Whole rows carried through Arrow tasks as one struct column, whatever their columns are called."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def nullable(kind: T.DataType) -> T.DataType:
    """The same type with every part nullable, as Arrow tasks return it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


def named(column: str) -> F.Column:
    return F.col("`" + column.replace("`", "``") + "`")


def field(column: str) -> F.Column:
    return F.col("row").getField(column).alias(column)


def row_type(df: DataFrame, columns: list[str]) -> T.StructType:
    return nullable(T.StructType([df.schema[c] for c in columns]))


def row_of(df: DataFrame, columns: list[str]) -> F.Column:
    return F.struct(*[named(c) for c in columns]).cast(row_type(df, columns)).alias("row")


def with_row(kind: T.DataType, ddl: str) -> T.StructType:
    """Schema of a column row of this type, then the columns of a DDL string."""
    return T.StructType([T.StructField("row", kind), *T.StructType.fromDDL(ddl).fields])
