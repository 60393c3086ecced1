"""A custom scan: whole numbers from a first to a last one, as a Python data source.

``spark.read.format("series").option("first", 1).option("last", 10).load()`` has the columns n and square; comparisons of
n with a constant narrow what is generated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

BATCH = 65_536


@dataclass
class Stretch(InputPartition):
    first: int
    last: int


class SeriesReader(DataSourceReader):
    def __init__(self, first: int, last: int, parts: int):
        self.first, self.last, self.parts = first, last, parts

    def pushFilters(self, filters):
        for f in filters:
            if f.attribute != ("n",) or not isinstance(getattr(f, "value", None), int):
                yield f
            elif isinstance(f, (EqualTo, GreaterThanOrEqual, GreaterThan)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
                if isinstance(f, EqualTo):
                    self.last = min(self.last, f.value)
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.last = min(self.last, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self):
        size = max(1, -(-(self.last - self.first + 1) // self.parts))
        return [Stretch(a, min(a + size - 1, self.last)) for a in range(self.first, self.last + 1, size)] or [Stretch(1, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        for a in range(partition.first, partition.last + 1, BATCH):
            n = range(a, min(a + BATCH, partition.last + 1))
            yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array([k * k for k in n], pa.int64())], names=["n", "square"])


class SeriesSource(DataSource):
    @classmethod
    def name(cls):
        return "series"

    def schema(self):
        return "n bigint, square bigint"

    def reader(self, schema):
        return SeriesReader(int(self.options["first"]), int(self.options["last"]), int(self.options.get("parts", 8)))


def series(spark: SparkSession, first: int, last: int) -> DataFrame:
    spark.dataSource.register(SeriesSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("series").option("first", first).option("last", last).load()
