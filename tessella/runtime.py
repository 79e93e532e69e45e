"""What work on a cluster needs: a folder that all machines see, tables written there, and this package on the workers."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Where that is unset, a new local folder
    will do in local mode; on a cluster each executor would write to its own disk, so that it is refused."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("tessella.shared.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.shared.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, tag: str) -> str:
    """A folder of its own below the shared one, which release() deletes."""
    path = f"{shared_dir(spark)}/tessella-{tag}-{uuid.uuid4().hex}"
    _written.append(path)
    return path


def stash(df: DataFrame, tag: str, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it again: lineage ends there, and lost executors lose nothing."""
    path = new_folder(df.sparkSession, tag)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(files: DataFrame) -> DataFrame:
    """Rows that name files or folders (path), dealt to as many tasks as there are shuffle partitions, however small: rows
    are small, what they name is not, and the engine would put them all into one task."""
    return files.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")), "path")


def delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Deletes all that this process has written to the shared folder; results that still read from it are void."""
    while _written:
        delete(spark, _written.pop())


class Scratch:
    """The length of a block: what is written to the shared folder in it is deleted at its end, but for what is kept."""

    def __init__(self, spark: SparkSession):
        self.spark = spark

    def __enter__(self) -> Scratch:
        self.begin = len(_written)
        return self

    def keep(self, made: DataFrame) -> DataFrame:
        """made, whose table was the last to be written: it stays."""
        _written.insert(self.begin, _written.pop())
        self.begin += 1
        return made

    def __exit__(self, *_) -> None:
        while len(_written) > self.begin:
            delete(self.spark, _written.pop())


def ship(spark: SparkSession) -> None:
    """Gives this package to the Python workers, once a context, wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    top = os.path.dirname(os.path.abspath(__file__))
    name = os.path.basename(top)
    target = os.path.join(tempfile.mkdtemp(prefix="tessella-zip-"), f"{name}_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, files in os.walk(top):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join(name, os.path.relpath(full, top)))
    sc.addPyFile(target)
    sc._tessella_shipped = True
