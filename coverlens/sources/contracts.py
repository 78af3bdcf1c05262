"""What a record table must and may contain."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession

from coverlens.sources import files


def require_columns(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    for name in columns:
        if name not in df.columns:
            raise ValueError(f"Column '{name}' is required.")
    return df


def require_path(spark: SparkSession, path: str) -> str:
    if not files.exists(spark, path):
        raise FileNotFoundError(f"Input not found: {path}")
    return path


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Adds the columns that are absent; present ones stay as they are."""
    missing = {name: value for name, value in defaults.items() if name not in df.columns}
    return df.withColumns(missing) if missing else df
