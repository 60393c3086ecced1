"""Readers and writers of plan logs and learnt parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans import schema

CSV = "seqid bigint, starttime timestamp, endtime timestamp, database string, pid int, nested_level int, queryid string, planid string"


def read_since(log: DataFrame, cursor: int = 0, upto: int | None = None) -> DataFrame:
    """Log rows after the cursor; the comparison reaches the Parquet scan."""
    out = log.where(F.col("seqid") > cursor)
    return out if upto is None else out.where(F.col("seqid") <= upto)


def max_seqid(log: DataFrame) -> int:
    return log.agg(F.coalesce(F.max("seqid"), F.lit(0))).first()[0]


def read_jdbc(spark: SparkSession, url: str, log_table: str, cursor: int = 0, **options) -> DataFrame:
    """The log table of a database, from the cursor on (needs that database's JDBC driver).

    The comparison reaches the database with the column's name quoted as it stands there, in capitals or not.
    """
    return read_since(spark.read.format("jdbc").option("url", url).option("dbtable", log_table).options(**options).load(), int(cursor))


def write_csv(log: DataFrame, path: str) -> None:
    log.select([c.split(" ")[0] for c in CSV.split(", ")]).write.mode("overwrite").csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CSV).csv(path)


def append_log(log: DataFrame, path: str) -> None:
    log.write.mode("append").parquet(path)


def write_parameters(reg: DataFrame, path: str) -> None:
    """Replace the parameters of the databases that ``reg`` holds; those of others stay."""
    reg.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("database").parquet(path)


def read_parameters(spark: SparkSession, path: str, database: str) -> DataFrame:
    return spark.read.schema(f"{schema.REG}, database string").parquet(path).where(F.col("database") == database).drop("database")
