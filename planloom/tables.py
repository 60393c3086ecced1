"""Input tables by name, and SQL over them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def over(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """Spark SQL in which ``{name}`` stands for the table of that name."""
    return spark.sql(text, **{name: table(spark, sf_dir, name) for name in set(re.findall(r"{(\w+)}", text))})


def plain(text: str) -> str:
    """The same text for an engine that knows the tables by name."""
    return re.sub(r"{(\w+)}", r"\1", text)
