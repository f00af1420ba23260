"""Input checks. Each reads the data once, in one aggregate, and returns or raises on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from tessella.functions.arrays import INFINITY, clip, is_finite


def as_table(spark: SparkSession, source, columns: Sequence[str] | None = None) -> DataFrame:
    """Any table form as a DataFrame: a DataFrame, a parquet path, pandas, or a list of rows.

    Columns without usable names become ``x0, x1, ...``; array-typed columns are refused.
    """
    if isinstance(source, DataFrame):
        df = source
    elif isinstance(source, str):
        df = spark.read.parquet(source)
    elif isinstance(source, pd.DataFrame):
        frame = source.reset_index(drop=True)
        if not all(isinstance(c, str) for c in frame.columns):
            frame.columns = [f"x{i}" for i in range(frame.shape[1])]
        df = spark.createDataFrame(frame)
    else:
        rows = [list(r) if isinstance(r, (list, tuple)) else [r] for r in source]
        names = list(columns) if columns else [f"x{i}" for i in range(len(rows[0]))]
        df = spark.createDataFrame([[float(v) for v in r] for r in rows], ", ".join(f"`{n}` double" for n in names))
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    if nested:
        raise ValueError(f"one value per cell: {nested}")
    return df


def not_numeric(df: DataFrame, features: Sequence[str]) -> list[str]:
    """Feature columns that are not numbers, with strings tried cell by cell."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    strings = [c for c in features if isinstance(kinds[c], T.StringType)]
    bad = [c for c in features if not isinstance(kinds[c], (T.NumericType, T.BooleanType, T.StringType))]
    if strings:
        lost = df.agg(*[F.count_if(F.col(c).isNotNull() & F.expr(f"try_cast(`{c}` as double)").isNull()).alias(c) for c in strings]).first()
        bad += [c for c in strings if lost[c]]
    return bad


def feature_table(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Every feature as double; NULL and NaN both mean missing and become NULL."""
    bad = not_numeric(df, features)
    if bad:
        raise TypeError(f"columns are not numeric: {bad}")
    return df.select(*keep, *[F.nanvl(F.expr(f"try_cast(`{c}` as double)"), F.lit(None).cast("double")).alias(c) for c in features])


def infinite_columns(df: DataFrame, features: Sequence[str]) -> list[str]:
    row = df.agg(*[F.max((F.abs(F.col(c)) == INFINITY).cast("int")).alias(c) for c in features]).first()
    return [c for c in features if row[c]]


def column_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: rows, missing and infinite cells, one row each, from one pass."""
    row = df.agg(F.count("*").alias("_n"), *[a for c in columns for a in (
        F.count_if(F.col(c).isNull() | F.isnan(F.col(c).cast("double"))).alias(f"m_{c}"),
        F.count_if(F.abs(F.col(c).cast("double")) == INFINITY).alias(f"i_{c}"))])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_n").alias("n"), F.col(f"m_{c}").alias("n_missing"),
                               F.col(f"i_{c}").alias("n_infinite")) for c in columns])
    return row.select(F.explode(cells).alias("c")).select("c.*")


def masked(value: Column, mask: Column) -> Column:
    """A masked cell becomes missing."""
    return F.when(~F.coalesce(mask, F.lit(False)), value)


def check_target(df: DataFrame, y: str) -> int:
    """The row count of a target that is finite everywhere; raises otherwise."""
    row = df.agg(F.count("*").alias("n"), F.count_if(~is_finite(F.col(y).cast("double"))).alias("bad")).first()
    if row["n"] == 0:
        raise ValueError("the table is empty")
    if row["bad"]:
        raise ValueError(f"{row['bad']} of {row['n']} targets are missing or infinite")
    return row["n"]


def align_columns(df: DataFrame, fitted: Sequence[str], given: Sequence[str] | None = None) -> DataFrame:
    """Features in fit order: by name when the names match, by position when one side is unnamed."""
    names = list(given if given is not None else df.columns)
    if len(names) != len(fitted):
        raise ValueError(f"expected {len(fitted)} features, got {len(names)}")
    if set(names) == set(fitted):
        return df.select(*fitted)
    unnamed = lambda cs: all(c == f"x{i}" for i, c in enumerate(cs))
    if unnamed(names) or unnamed(list(fitted)):
        return df.select(*[F.col(a).alias(b) for a, b in zip(names, fitted)])
    raise ValueError(f"feature names differ: missing {sorted(set(fitted) - set(names))}")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def check_subset(rows: DataFrame, table: DataFrame, id_col: str) -> None:
    """Row ids must be unique and present in the table."""
    if not duplicate_keys(rows, [id_col]).isEmpty():
        raise ValueError("a row is given more than once")
    if not rows.join(table, id_col, "left_anti").isEmpty():
        raise ValueError("a row is not in the table")


def take(df: DataFrame, rows: DataFrame | Column, id_col: str = "id") -> DataFrame:
    """A subset by mask or by a table of ids."""
    return df.where(rows) if isinstance(rows, Column) else df.join(rows.select(id_col), id_col, "left_semi")


def clip_target(df: DataFrame, y: str, low: float, high: float, out: str = "y_clipped", seen: Observation | None = None) -> DataFrame:
    """Targets cut to a support, with a flag for those outside.

    ``seen`` gets the numbers ``below``, ``above`` and ``n`` from the first action
    on the result: no pass of its own.
    """
    if seen is not None:
        df = df.observe(seen, F.count_if(F.col(y) < low).alias("below"), F.count_if(F.col(y) > high).alias("above"), F.count("*").alias("n"))
    return df.withColumns({out: clip(F.col(y), low, high), "outside": (F.col(y) < low) | (F.col(y) > high)})


def require_columns(df: DataFrame, names: Sequence[str]) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise KeyError(f"columns are missing: {missing}")


def bad_score_rows(df: DataFrame, tests: Mapping[str, Column]) -> dict[str, int]:
    """How many rows fail each named test, in one pass."""
    row = df.agg(*[F.count_if(test).alias(name) for name, test in tests.items()]).first()
    return {name: row[name] for name in tests}
