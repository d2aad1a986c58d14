"""Reading raw and staged tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header row, plain or gzipped. Columns are matched by header name.

    Spark binds a schema to CSV columns by position, so the file's columns are
    read as text and only the wanted ones are selected and converted. Text that
    is not a number becomes NULL. In a folder all files must have the first one's
    header; another is an error.
    """
    raw = spark.read.csv(path, header=True, quote='"', escape='"', enforceSchema=False)
    wanted = T.StructType.fromDDL(schema)
    return raw.select(
        *[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) for f in wanted.fields]
    )


def read_table_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Result table: 'NA' is missing and an unnamed row-number column is dropped."""
    reader = spark.read.option("nullValue", "NA").option("escape", '"')
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    df = reader.csv(path, header=True)
    first = df.columns[0]
    return df.drop(first) if first in ("", "_c0") else df


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Parquet table. A given schema saves the job that reads footers to find it."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.parquet(path)


def read_fixed_width(
    spark: SparkSession, path: str, layout: list[tuple[str, int, int, str]], scale: dict[str, int] | None = None
) -> DataFrame:
    """Fixed-width text. ``layout`` rows are (column, first position, width, type).

    Positions count from 1. ``scale`` gives implied decimal places by column.
    Blank or unparsable fields become NULL.
    """
    lines = spark.read.text(path)
    cols = []
    for name, start, width, dtype in layout:
        c = F.nullif(F.trim(F.substring("value", start, width)), F.lit(""))
        if dtype != "string":
            places = (scale or {}).get(name, 0)
            c = (c.try_cast("double") / 10**places).cast(dtype) if places else c.try_cast(dtype)
        cols.append(c.alias(name))
    return lines.select(*cols)


def read_query(
    spark: SparkSession,
    url: str,
    sql: str,
    partition_column: str | None = None,
    bounds: tuple[int, int] | None = None,
    partitions: int = 1,
    **options: str,
) -> DataFrame:
    """Result of a SQL query on a database.

    With a numeric ``partition_column`` and its ``bounds`` the query is read in
    ``partitions`` parallel ranges; without one it is a single connection.
    """
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", f"({sql}) q")
    if partition_column:
        if bounds is None:
            raise ValueError("partition_column needs its bounds")
        reader = reader.options(
            partitionColumn=partition_column,
            lowerBound=bounds[0],
            upperBound=bounds[1],
            numPartitions=partitions,
        )
    return reader.options(**options).load()
