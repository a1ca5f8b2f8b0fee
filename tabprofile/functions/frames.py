"""Column typing, missing-value normalisation and wide-to-long aggregation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Aggregates per pass; wider tables take several passes so that generated code stays compilable.
AGGREGATES_PER_PASS = 100
# A table joined by broadcast has at most this many rows, counted before the hint is given.
BROADCAST_ROWS = 20_000

_INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATS = (T.FloatType, T.DoubleType, T.DecimalType)
_DATES = (T.TimestampType, T.TimestampNTZType, T.DateType)
_NESTED = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.VariantType)


def col(name: str) -> Column:
    """A column by its literal name, also when the name holds dots or spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def type_of(df: DataFrame, name: str) -> T.DataType:
    require_columns(df, [name])
    return df.schema[name].dataType


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    for name in names:
        if name not in df.columns:
            raise ValueError(f"unknown column '{name}'")


def is_numeric(dtype: T.DataType) -> bool:
    """Numbers and booleans; a boolean counts as 0/1 in every statistic."""
    return isinstance(dtype, _INTEGERS + _FLOATS + (T.BooleanType,))


def is_integer(dtype: T.DataType) -> bool:
    return isinstance(dtype, _INTEGERS)


def is_datetime(dtype: T.DataType) -> bool:
    return isinstance(dtype, _DATES)


def is_string(dtype: T.DataType) -> bool:
    return isinstance(dtype, T.StringType)


def is_nested(dtype: T.DataType) -> bool:
    return isinstance(dtype, _NESTED)


def numeric_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if is_numeric(f.dataType) and f.name not in skip]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if is_string(f.dataType)]


def normalise(df: DataFrame) -> DataFrame:
    """Missing is NULL everywhere: floating NaN becomes NULL, other columns pass through."""
    floats = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))]
    return df.withColumns({name: F.when(~F.isnan(col(name)), col(name)) for name in floats}) if floats else df


def as_double(df: DataFrame, name: str) -> Column:
    """The numeric view of a column (booleans become 0/1)."""
    dtype = type_of(df, name)
    if isinstance(dtype, T.DoubleType):
        return col(name)
    if isinstance(dtype, T.BooleanType):
        return col(name).cast("int").cast("double")
    return col(name).cast("double")


def display_type(dtype: T.DataType, has_nulls: Column) -> Column:
    """Type label as a flat-file reader would report it: integers holding nulls become floats."""
    if isinstance(dtype, T.BooleanType):
        return F.when(has_nulls, "object").otherwise("bool")
    if is_integer(dtype):
        width = {"byte": "int8", "short": "int16", "integer": "int32", "long": "int64"}[dtype.typeName()]
        return F.when(has_nulls, "float64").otherwise(width)
    if isinstance(dtype, T.FloatType):
        return F.lit("float32")
    if isinstance(dtype, (T.DoubleType, T.DecimalType)):
        return F.lit("float64")
    if is_datetime(dtype):
        return F.lit("datetime64[ns]")
    return F.lit("object")


def chunks(items: Sequence[str], size: int) -> list[list[str]]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def per_column(
    df: DataFrame,
    names: Sequence[str],
    stats: dict[str, Callable[[str], Column]],
) -> DataFrame:
    """One row per column: ``column, position`` and one field per entry of ``stats``.

    Each entry builds an aggregate expression from a column name.  All of them run in a single
    pass without a shuffle of the data; very wide tables take one pass per group of columns, each
    reading only its own columns.
    """
    if not names:
        raise ValueError("no columns to aggregate")
    place = {name: i for i, name in enumerate(df.columns)}
    parts = []
    for group in chunks(names, max(1, AGGREGATES_PER_PASS // len(stats))):
        wide = df.agg(*[
            stats[stat](name).alias(f"s{i}_{j}")
            for i, name in enumerate(group)
            for j, stat in enumerate(stats)
        ])
        rows = [
            F.struct(
                F.lit(name).alias("column"),
                F.lit(place[name]).alias("position"),
                *[F.col(f"s{i}_{j}").alias(stat) for j, stat in enumerate(stats)],
            )
            for i, name in enumerate(group)
        ]
        parts.append(wide.select(F.inline(F.array(*rows))))
    return union_all(parts)


def scalars(df: DataFrame, exprs: dict[str, Column], per_pass: int = AGGREGATES_PER_PASS) -> dict[str, object]:
    """Evaluate named aggregates and bring the single result row to the driver."""
    out: dict[str, object] = {}
    for group in chunks(list(exprs), per_pass):
        row = df.agg(*[exprs[name].alias(f"v{i}") for i, name in enumerate(group)]).first()
        out.update({name: row[i] for i, name in enumerate(group)})
    return out


def fetched(df: DataFrame) -> DataFrame:
    """The rows as a local table, for frames with one row per column: whoever reads it again does not compute it again."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def small_or_same(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The frame's rows as a broadcast table if there are few, else the frame unchanged.

    The rows are fetched once, so a small lookup table is also not computed again by each use.
    """
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def _family(dtype: T.DataType) -> str:
    if isinstance(dtype, T.BooleanType) or is_integer(dtype):
        return "bigint"
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return "double"
    if isinstance(dtype, T.DecimalType):
        return dtype.simpleString()
    if is_datetime(dtype):
        return dtype.simpleString()
    if is_string(dtype):
        return "string"
    return "nested"


def _comparable(df: DataFrame, name: str, family: str) -> Column:
    dtype = type_of(df, name)
    if family == "bigint" and isinstance(dtype, T.BooleanType):
        return col(name).cast("int").cast("bigint")
    if family == "nested":
        value = F.array_sort(F.map_entries(col(name))) if isinstance(dtype, T.MapType) else col(name)
        return F.when(col(name).isNotNull(), F.xxhash64(value))
    return col(name).cast(family)


def long_form(df: DataFrame, names: Sequence[str], carry: dict[str, Column] | None = None) -> list[DataFrame]:
    """``(carried…, column, value)`` frames, one per value type, without the null values.

    Columns are grouped by type so no value is turned into text just to share a column; each frame
    scans only its own columns, so the bytes read in total are those of one scan.
    """
    carry = carry or {}
    groups: dict[str, list[str]] = {}
    for name in names:
        groups.setdefault(_family(type_of(df, name)), []).append(name)
    frames = []
    for family, members in groups.items():
        kept = df.select(
            *[expr.alias(alias) for alias, expr in carry.items()],
            *[_comparable(df, name, family).alias(f"v{i}") for i, name in enumerate(members)],
        )
        cases = F.element_at(F.array(*[F.lit(m) for m in members]), F.col("slot").cast("int") + 1)
        frames.append(
            kept.unpivot(list(carry), [f"v{i}" for i in range(len(members))], "slot", "value")
            .where(F.col("value").isNotNull())
            .withColumn("slot", F.substring("slot", 2, 10).cast("int"))
            .select(*carry, cases.alias("column"), "value")
        )
    return frames


def value_counts(df: DataFrame, names: Sequence[str]) -> list[DataFrame]:
    """``(column, value, n)`` per value type.  Repeated values collapse before the shuffle."""
    return [f.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")) for f in long_form(df, names)]


def distinct_counts(df: DataFrame, names: Sequence[str], exact: bool = True, rsd: float = 0.02) -> DataFrame:
    """``(column, n_unique, is_approx)`` ignoring nulls; columns with no values are absent when exact."""
    if not exact:
        return per_column(df, names, {
            "n_unique": lambda c: F.approx_count_distinct(_comparable(df, c, _family(type_of(df, c))), rsd)
        }).select("column", "n_unique", F.lit(True).alias("is_approx"))
    counted = [f.groupBy("column").agg(F.count(F.lit(1)).alias("n_unique")) for f in value_counts(df, names)]
    return union_all(counted).withColumn("is_approx", F.lit(False))
