"""The tidy table (one row per study) as Parquet or CSV."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coverlens import schema
from coverlens.functions.labels import parse_flag
from coverlens.functions.text import null_if_na
from coverlens.sources.contracts import require_columns, require_path

# Arrival order of CSV rows: file, then place in the file.
CSV_ORDER = ["csv_file", "csv_block", "csv_row"]


_CSV = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}


def csv_options(multi_line: bool = True) -> dict:
    """Doubled quotes inside quoted fields, and nothing trimmed."""
    return {**_CSV, "multiLine": multi_line, "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_csv_table(
    spark: SparkSession, path: str, columns: list[str], multi_line: bool = True, required: Iterable[str] = ()
) -> DataFrame:
    """The named columns of a headed CSV as text, wherever the header has them, plus ``CSV_ORDER``.

    A required column that the header lacks is an error, as is a file whose header differs from the others'; other absent
    columns are null. ``multi_line=False`` lets Spark split large files, and is right whenever no field holds a line break.
    """
    require_path(spark, path)
    raw = spark.read.options(enforceSchema=False, **csv_options(multi_line)).csv(path)
    require_columns(raw, required)
    return raw.select(
        *[F.col(f"`{c}`") if c in raw.columns else F.lit(schema.DEFAULTS.get(c)).cast("string").alias(c) for c in columns],
        F.col("_metadata.file_path").alias("csv_file"),
        F.col("_metadata.file_block_start").alias("csv_block"),
        F.monotonically_increasing_id().alias("csv_row"),
    )


def nulls_for_na(df: DataFrame, columns: Iterable[str] | None = None) -> DataFrame:
    """Missing-value texts to null in all (or the given) string columns."""
    names = columns or [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: null_if_na(c) for c in names})


def read_tidy_csv(spark: SparkSession, path: str, na_tokens: bool = True, multi_line: bool = True) -> DataFrame:
    """The tidy table from CSV, typed, with ``CSV_ORDER`` for first-wins de-duplication.

    ``na_tokens`` reads ``N/A``, ``None`` and the like as null, as a pandas reader does; without it the
    ``N/A`` phase stays apart from a missing phase. Lists are JSON text, or Python text of quoted items; a list with
    an unquoted ``None`` in it reads as null. Columns are found by name; ``schema.REQUIRED`` must be there, others default.
    """
    df = read_csv_table(spark, path, schema.TIDY_COLUMNS, multi_line, schema.REQUIRED)
    if na_tokens:
        df = nulls_for_na(df, schema.TIDY_COLUMNS)
    lists = {"allowSingleQuotes": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return df.withColumns(
        {
            "has_dmc": parse_flag("has_dmc"),
            "start_year": F.col("start_year").try_cast("double").cast("int"),
            "conditions": F.from_json("conditions", "array<string>", lists),
        }
    )


def write_tidy_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Lists become JSON text; the flag is written as ``True`` / ``False``."""
    ready = df.select(schema.TIDY_COLUMNS).withColumns(
        {"has_dmc": F.initcap(F.col("has_dmc").cast("string")), "conditions": F.to_json("conditions")}
    )
    ready.write.mode(mode).options(**csv_options()).csv(path)


def read_tidy(spark: SparkSession, path: str) -> DataFrame:
    """The tidy table; columns that the files must have are checked, absent others get their defaults."""
    require_path(spark, path)
    raw = require_columns(spark.read.parquet(path), schema.REQUIRED)
    types = T.StructType.fromDDL(schema.TIDY)
    columns = [F.col(c) if c in raw.columns else F.lit(schema.DEFAULTS.get(c)).alias(c) for c in schema.TIDY_COLUMNS]
    return raw.select(*columns).to(types)


def write_tidy(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.select(schema.TIDY_COLUMNS).write.mode(mode).parquet(path)
