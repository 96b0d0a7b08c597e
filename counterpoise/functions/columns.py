"""Column predicates and type rules shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
CONTINUOUS_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
TEXT_TYPES = (T.StringType, T.BooleanType)


def type_of(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column."""
    missing = F.col(name).isNull()
    if isinstance(type_of(df, name), (T.FloatType, T.DoubleType)):
        missing = missing | F.isnan(F.col(name))
    return missing


def categorical_for_balancing(df: DataFrame, names) -> list[str]:
    return [c for c in names if isinstance(type_of(df, c), TEXT_TYPES + INTEGER_TYPES)]


def categorical_for_models(df: DataFrame, names) -> list[str]:
    return [c for c in names if isinstance(type_of(df, c), TEXT_TYPES)]


def continuous(df: DataFrame, names) -> list[str]:
    return [c for c in names if isinstance(type_of(df, c), CONTINUOUS_TYPES)]


def is_vector(df: DataFrame, name: str) -> bool:
    return isinstance(type_of(df, name), T.ArrayType)
