"""Delimited text in and out, with every column as text or with a schema, and the tokens that mean missing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Texts that readers of statistics files take for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType | str | None = None,
    columns: Sequence[str] | None = None,
    encoding: str = "UTF-8",
    missing: Sequence[str] = MISSING,
    infer: bool = False,
    multi_line: bool = True,
    torn: str | None = None,
) -> DataFrame:
    """A table with a header line. Without ``schema`` every column is text, or of the type its values have (``infer``: one more
    pass); ``columns`` are the only ones given.

    Texts in ``missing`` become null. Numbers and dates of a schema that cannot be read become null. Quoted values may go over
    several lines; where none does, ``multi_line`` off lets one file be read by many tasks. ``torn`` names a column that holds the
    text of records that do not fit the columns or the schema, else null.
    """
    reader = spark.read.option("header", True).option("encoding", encoding).option("quote", '"').option("escape", '"').option("multiLine", multi_line).option("mode", "PERMISSIVE").option("inferSchema", infer)
    df = reader.schema(schema).csv(path) if schema is not None else reader.csv(path)
    if torn:
        df = reader.option("columnNameOfCorruptRecord", torn).schema(T.StructType([*df.schema.fields, T.StructField(torn, T.StringType())])).csv(path)
    if columns:
        df = df.select(*[F.col(f"`{c}`") for c in [*columns, *([torn] if torn else [])]])
    kept = lambda f: not isinstance(f.dataType, T.StringType) or f.name == torn
    return df.select(*[F.col(f"`{f.name}`") if kept(f) else F.when(F.col(f"`{f.name}`").isin(*missing), None).otherwise(F.col(f"`{f.name}`")).alias(f.name) for f in df.schema])


def table_text(df: DataFrame, rows: int = 20) -> str:
    """The first rows as an aligned table for a console, values in full."""
    return df._show_string(rows, False, False)


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, low: int, high: int, partitions: int, **options: str) -> DataFrame:
    """A table of a database, read in ranges of a numeric key in parallel; filters and columns are pushed to the database."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, partitionColumn=key, lowerBound=str(low), upperBound=str(high), numPartitions=str(partitions), **options).load()


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    """With a header line; ``single`` writes one file, for small results only."""
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def report_lines(df: DataFrame, template: str, columns: Sequence[str]) -> DataFrame:
    """One formatted line for each row, as column ``line``."""
    return df.select(F.format_string(template, *[F.col(c) for c in columns]).alias("line"))
