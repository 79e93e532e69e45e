"""What the operators of this subpackage share: written tables, work that gives memory back, shipping of the code."""

from __future__ import annotations

import ctypes
import os
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from .. import runtime
from ..runtime import delete, new_folder


BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def stash(df: DataFrame, tag: str, compression: str = "zstd", narrow: bool = False) -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and lost executors lose nothing.

    narrow: df's last step is a shuffle and its rows are a few numbers, so that an eighth of the tasks that documents
    need will do; it saves as many small files and the processes that set up each of them.
    """
    path = new_folder(df.sparkSession, tag)
    if narrow:
        df = df.coalesce(max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8))
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_stash(df: DataFrame) -> None:
    """Deletes the files of a stashed table that no later plan reads."""
    for folder in {os.path.dirname(f) for f in df.inputFiles()}:
        delete(df.sparkSession, folder)


def trim() -> None:
    """Gives memory that has been freed back to the system."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def lean(work: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The same work; memory that a task has freed goes back to the system when it ends, as workers live on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers. Where the numbers of rows and bytes in an Arrow batch have been left at
    their defaults, they are lowered: rows are whole documents here, and both sides of a worker's socket hold batches."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    if spark.conf.get(BATCH_BYTES) == "67108864b":
        spark.conf.set(BATCH_BYTES, "8m")
    runtime.ship(spark)


def join_counted(rows: DataFrame, table: DataFrame, key: str, count: str, share: int = 1000) -> DataFrame:
    """rows left join table, a written table with one row a key, whose column count (left out of the result) says how many
    rows have that key. Keys that have a share-th of all counted rows or more go to every task, as there can be share of
    them at most; the others meet by a shuffle in which no key is hot. Rows with a null key are not shuffled."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = table.where(F.col(count) * share >= total).drop(count)
    cold = table.where(F.col(count) * share < total).drop(count)
    found = rows.where(F.col(key).isNotNull())
    near = found.join(F.broadcast(hot), key)
    far = found.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, "left")
    alone = rows.where(F.col(key).isNull()).withColumns({f.name: F.lit(None).cast(f.dataType) for f in cold.schema if f.name != key})
    return near.unionByName(far).unionByName(alone)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(column: str) -> Column:
    """A column by its name, whatever characters are in it."""
    return F.col("`" + column.replace("`", "``") + "`")


def whole_row(df: DataFrame, columns: list[str] | None = None) -> Column:
    """All columns of a row, or those given, as one struct."""
    return F.struct(*[named(c) for c in (df.columns if columns is None else columns)])


def text_field(df: DataFrame, column: str) -> int | None:
    """Where a column stands in whole_row(df), if it is one of strings by that very name; None if not."""
    found = [i for i, f in enumerate(df.schema) if f.name == column and f.dataType == StringType()]
    return found[0] if len(found) == 1 and "." not in column and "`" not in column else None


def with_carried(fields: str, df: DataFrame | None) -> StructType:
    """A schema from its text, and the struct of df's rows behind it as carried, if df is given."""
    found = StructType.fromDDL(fields)
    return found if df is None else found.add("carried", df.schema)


def id_type(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()
