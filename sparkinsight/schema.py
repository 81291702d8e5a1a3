"""Column kinds (the pandas dtype classes the operators select on) and NaN handling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType,
                 T.FloatType, T.DoubleType, T.DecimalType)
INTEGRAL_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DATETIME_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def named(c: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + c.replace("`", "``") + "`")


def kind_of(dt: T.DataType) -> str:
    if isinstance(dt, T.BooleanType):
        return "boolean"
    if isinstance(dt, NUMERIC_TYPES):
        return "numeric"
    if isinstance(dt, T.StringType):
        return "categorical"
    if isinstance(dt, DATETIME_TYPES):
        return "datetime"
    return "other"


def columns_of(df: DataFrame, *kinds: str) -> list[str]:
    """Columns of the given kinds, in schema order."""
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "numeric")


def string_columns(df: DataFrame) -> list[str]:
    return columns_of(df, "categorical")


def is_integral(df: DataFrame, c: str) -> bool:
    return isinstance(df.schema[c].dataType, INTEGRAL_TYPES)


# Pandas dtype names shown for each Spark type.
PANDAS_DTYPE_NAMES = {
    "byte": "int8", "short": "int16", "integer": "int32", "long": "int64",
    "float": "float32", "double": "float64", "string": "object", "boolean": "bool",
    "timestamp": "datetime64[ns]", "timestamp_ntz": "datetime64[ns]", "date": "datetime64[ns]",
}


def dtype_name(dt: T.DataType) -> str:
    if isinstance(dt, T.DecimalType):
        return "float64"
    return PANDAS_DTYPE_NAMES.get(dt.typeName(), dt.simpleString())


def normalise(df: DataFrame) -> DataFrame:
    """Map floating NaN to NULL once at ingest (pandas conflates the two)."""
    exprs = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            exprs.append(F.when(F.isnan(f.name), F.lit(None)).otherwise(F.col(f.name)).alias(f.name))
        else:
            exprs.append(F.col(f.name))
    return df.select(*exprs)
