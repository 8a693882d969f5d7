"""Scaling and encoding whose statistics are aggregates and whose application is column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from downfield.operators.windows import quantiles


@dataclass
class Scaler:
    """(x - centre) / scale by column; a scale of 0 counts as 1."""

    centre: dict[str, float]
    scale: dict[str, float]

    def column(self, c: str) -> Column:
        return (F.col(c) - F.lit(self.centre[c])) / F.lit(self.scale[c] or 1.0)

    def transform(self, df: DataFrame, prefix: str = "") -> DataFrame:
        return df.withColumns({f"{prefix}{c}": self.column(c) for c in self.centre})


def _scaler(df: DataFrame, columns: Sequence[str], centre, scale) -> Scaler:
    r = df.agg(*(f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", centre), ("s", scale)))).first()
    return Scaler({c: r[f"m{i}"] if r[f"m{i}"] is not None else 0.0 for i, c in enumerate(columns)}, {c: r[f"s{i}"] if r[f"s{i}"] is not None else 1.0 for i, c in enumerate(columns)})


def standard_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Mean and population standard deviation."""
    return _scaler(df, columns, F.avg, F.stddev_pop)


def zscore_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Mean and sample standard deviation."""
    return _scaler(df, columns, F.avg, F.stddev_samp)


def robust_scaler(df: DataFrame, columns: Sequence[str]) -> Scaler:
    """Exact median and interquartile range."""
    found = {c: quantiles(df, c, (0.25, 0.5, 0.75)).first() for c in columns}
    return Scaler({c: r["q1"] if r else 0.0 for c, r in found.items()}, {c: r["q2"] - r["q0"] if r else 1.0 for c, r in found.items()})


def robust_scaled(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Scaling by exact medians and interquartile ranges in one lazy plan."""
    out = df
    for i, c in enumerate(columns):
        one = quantiles(df, c, (0.25, 0.5, 0.75)).select(F.col("q1").alias(f"__m{i}"), (F.col("q2") - F.col("q0")).alias(f"__s{i}"))
        out = out.join(F.broadcast(one), how="left")  # one row
    value = lambda i, c: (F.col(c) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") == 0, 1.0).otherwise(F.col(f"__s{i}"))
    return out.withColumns({c: value(i, c) for i, c in enumerate(columns)}).select(*df.columns)


def scaled(df: DataFrame, columns: Sequence[str], centre, scale) -> DataFrame:
    """Scaling in one lazy plan: the statistics are one row that is broadcast."""
    one = df.agg(*(f(c).alias(f"__{k}{i}") for i, c in enumerate(columns) for k, f in (("m", centre), ("s", scale))))
    out = df.crossJoin(F.broadcast(one))
    value = lambda i, c: (F.col(c) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") == 0, 1.0).otherwise(F.col(f"__s{i}"))
    return out.withColumns({c: value(i, c) for i, c in enumerate(columns)}).select(*df.columns)


def vocabulary(df: DataFrame, column: str) -> list:
    """Sorted distinct values; for columns of few categories."""
    return [r[0] for r in df.select(column).dropna().distinct().orderBy(column).collect()]


def one_hot(df: DataFrame, column: str, values: Sequence, prefix: str | None = None) -> DataFrame:
    """A 0/1 column for each value; unknown values and nulls are 0 in all."""
    name = lambda v: f"{prefix or column}_{v}"
    return df.withColumns({name(v): F.when(F.col(column) == F.lit(v), 1.0).otherwise(0.0) for v in values})


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """Place among the sorted distinct values, by a join with the few values rather than a window over all rows."""
    codes = df.select(column).distinct().withColumn(out, F.row_number().over(Window.orderBy(column)) - 1)
    codes = codes.withColumnRenamed(column, "__v")
    return df.join(codes, F.col(column).eqNullSafe(F.col("__v")), "left").drop("__v")
