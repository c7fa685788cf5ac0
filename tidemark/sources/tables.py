"""Table readers and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.keyed import latest_per_key
from ..schemas import PRICES


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None, columns: list | None = None,
               predicate: Column | None = None, fmt: str = "parquet") -> DataFrame:
    """Selected columns and rows of a stored table; both reach the scan."""
    reader = spark.read.format(fmt)
    df = (reader.schema(schema) if schema is not None else reader).load(path)
    df = df.where(predicate) if predicate is not None else df
    return df.select(*columns) if columns else df


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PRICES).parquet(path)


def write_prices(bars: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Bars sorted by (symbol, date), range-partitioned so files carry tight symbol statistics."""
    (bars.select("date", "symbol", "close", "volume").repartitionByRange("symbol", "date")
     .sortWithinPartitions("symbol", "date").write.mode(mode).parquet(path))


def merge_prices(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new bars, the newest batch winning per (date, symbol)."""
    both = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)))
    return latest_per_key(both, ["date", "symbol"], ["__batch"])


def align_to_schema(df: DataFrame, known_cols: list[str]) -> DataFrame:
    """Only the columns the target knows."""
    known = set(known_cols)
    return df.select(*[c for c in df.columns if c in known])


def report_json(df: DataFrame, name: str = "report") -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns)).alias(name))


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A report as JSON lines, a file per partition that has rows."""
    df.write.mode(mode).json(path)


def candles(bars: DataFrame, symbol: str, days: int | None = None, now: Column | None = None) -> DataFrame:
    """Complete OHLC rows of one symbol at two decimals."""
    px = ["open", "high", "low", "close"]
    df = bars.where(F.col("symbol") == symbol).na.drop(subset=px)
    if days is not None:
        df = df.where(F.col("date") >= F.date_sub(F.to_date(now), days))
    return df.select("date", *[F.round(c, 2).alias(c) for c in px])
