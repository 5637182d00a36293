"""What the operators share: passing texts through Python workers in bounded pieces, keys of texts."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path

#: Rows handed to Python at a time, and rows and bytes worked on at a time inside a task.
ARROW_ROWS = "512"
STEP_ROWS = 128

_ARROW = {
    T.LongType: pa.int64(),
    T.IntegerType: pa.int32(),
    T.DoubleType: pa.float64(),
    T.StringType: pa.string(),
    T.BinaryType: pa.binary(),
    T.BooleanType: pa.bool_(),
}


def arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(arrow_type(kind.elementType))
    return _ARROW[type(kind)]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches small enough that a batch of very long texts still fits a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def whole_row(df: DataFrame) -> Column:
    """All columns as one struct, whatever their names."""
    return F.struct(*[df[f"`{c}`"].alias(c) for c in df.columns])


def over_texts(df: DataFrame, text: Column, make: Callable[[], Callable[[list], list]], fields: str) -> DataFrame:
    """``row`` (all columns of ``df`` as one struct, so that no name can clash) and what ``make()`` finds in each text.

    ``make`` runs once per task and returns a function from a list of UTF-8 texts (None where NULL)
    to one list per field of ``fields``. Rows stream through: a task holds a few texts at a time.
    """
    small_batches(df.sparkSession)
    found = T.StructType.fromDDL(fields)
    packed = df.select(whole_row(df).alias("row"), text.cast("binary").alias("text"))
    schema = T.StructType([packed.schema["row"], *found.fields])
    kinds = [arrow_type(f.dataType) for f in found.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            for at in range(0, batch.num_rows, STEP_ROWS):
                part = batch.slice(at, STEP_ROWS)
                lists = work(part.column(1).to_pylist())
                arrays = [pa.array(values, kind) for values, kind in zip(lists, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *arrays], names=["row", *found.names])

    return packed.mapInArrow(run, schema)


class Stages:
    """Tables written in the shared folder for the steps of one operator, and removed when later ones need them no more.

    What a later step reads must itself be written by then, so a lost executor never needs a removed table.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, label: str) -> DataFrame:
        path = scratch_path(self.spark, label)
        df.write.parquet(path)
        self.paths.setdefault(label, []).append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *labels: str) -> None:
        """Removes these tables, and lets Spark delete the shuffle files of finished steps now, not when the driver next collects its garbage."""
        for label in labels:
            for path in self.paths.pop(label, []):
                folder = self.spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
        gc.collect()
        self.spark._jvm.System.gc()


def text_key(text: Column) -> Column:
    """128 bits that stand for a text (NULL as the empty text); equal texts, and in practice only those, share it."""
    data = F.coalesce(text, F.lit("")).cast("binary")
    return F.md5(data)
