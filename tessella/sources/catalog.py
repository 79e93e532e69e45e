"""Tile files of folders, and their configuration texts."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import leaf
from ..operators.placement import nested_fallback
from ..runtime import ship, spread
from ..sinks.store import split
from .tiff import with_header_columns

CONFIG_NAME = "TileConfiguration.txt"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, at = _fs(spark, path)
    return at.exists(p)


def _some(spark: SparkSession, glob: str) -> bool:
    p, at = _fs(spark, glob)
    found = at.globStatus(p)
    return found is not None and len(found) > 0


def _inside(folders: DataFrame, kind: fs.FileType) -> DataFrame:
    """(path) of the files that are not empty, or of the folders, in folders (path). A task lists a folder at a time: the
    driver holds no names, and tasks are no more for many small files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, at = split(path)
                found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
                for i in range(0, len(found), 10_000):
                    names = [f.base_name for f in found[i : i + 10_000] if f.type == kind and (f.size or kind == fs.FileType.Directory)]
                    yield pa.RecordBatch.from_arrays([pa.array([f"{path.rstrip('/')}/{n}" for n in names], pa.string())], names=["path"])

    return spread(folders).mapInArrow(run, "path string")


def tile_files(spark: SparkSession, root: str, depth: int = 1) -> DataFrame:
    """(path, file_name, subdir) of *.tif* files exactly depth folders below root; depth 0 is root itself, whose name is
    then the group. subdir is the folder just below root. Contents are not read. No file gives no rows; names that begin
    with a dot or underscore are hidden, as from Spark's readers."""
    p, at = _fs(spark, root.rstrip("/") or "/")
    folders = spark.createDataFrame([(s.getPath().toString(),) for s in at.globStatus(p) or [] if s.isDirectory()], "path string")
    for _ in range(depth):
        folders = _inside(folders, fs.FileType.Directory)
    name = leaf(F.col("path"))
    found = _inside(folders, fs.FileType.File).where(name.contains(".tif") & ~name.rlike("^[.]|^_[^=]*$|[.]_COPYING_$"))
    return found.select("path", name.alias("file_name"), F.element_at(F.split("path", "/"), -2 if depth < 2 else -1 - depth).alias("subdir"))


def group_files(spark: SparkSession, root: str) -> DataFrame:
    """Files of the groups below root; a group without any takes those one folder deeper."""
    return nested_fallback(tile_files(spark, root, 1), tile_files(spark, root, 2))


def with_headers(files: DataFrame) -> DataFrame:
    """Adds header columns to files (path, ...): tasks read the ranges that hold the tags, whatever folder they are in."""
    ship(files.sparkSession)
    return with_header_columns(spread(files))


def config_lines(spark: SparkSession, root: str, in_root: bool = False) -> DataFrame:
    """(config_dir, line_no, line) of the configuration texts of root's groups, or of root itself. Line numbers begin at
    0; a configuration is one row while it is split."""
    glob = f"{root.rstrip('/')}/{'' if in_root else '*/'}{CONFIG_NAME}"
    if not _some(spark, glob):
        return spark.createDataFrame([], "config_dir string, line_no int, line string")
    text = spark.read.text(glob, wholetext=True).select("value", F.expr("url_decode(replace(_metadata.file_path, '+', '%2B'))").alias("p"))
    return text.select(F.element_at(F.split("p", "/"), -2).alias("config_dir"), F.posexplode(F.split("value", "\\r\\n|\\n|\\r")).alias("line_no", "line"))
