"""The whole job (E5, E7, K1): from a folder of tiles to pyramids, all groups at once."""

from __future__ import annotations

import logging
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import OutputFormat, StitchConfig
from ..functions.text import TIFF_CODECS, numbered_name, output_base, output_name, zarr_codec
from ..operators import raster
from ..operators.mosaic import group_bounds, level_depth
from ..operators.placement import numbers_taken, translate_origin
from ..runtime import Scratch, ship, spread, stash
from ..sinks import store, tiff, zarr
from .strategies import strategy

log = logging.getLogger(__name__)
OUTPUT = "subdir string, n_tiles bigint, status string, path string, error string"
#: Levels of an array whose base downsample is not 1.
BASE_LEVELS = 4


def place(spark: SparkSession, cfg: StitchConfig) -> DataFrame:
    ship(spark)
    return strategy(cfg.stitching_type)(spark, cfg)


def _with_levels(groups: DataFrame, base: float, edge: int, step: int, fixed: int | None) -> DataFrame:
    """Adds heights and widths of each group's levels; a level has a pixel for each block that begins in the image."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes: list[list[list[int]]] = [[], []]
            for h, w in zip(batch.column("height").to_pylist(), batch.column("width").to_pylist(), strict=True):
                h, w = (int((n - 1) // base) + 1 if n > 0 else 0 for n in (h, w))
                depth = level_depth(w, h, edge, step, fixed)
                for out, n in zip(sizes, (h, w), strict=True):
                    out.append([-(-n // step**k) for k in range(depth)])
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(x, pa.list_(pa.int64())) for x in sizes)], names=[*batch.schema.names, "heights", "widths"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in groups.schema)
    return groups.mapInArrow(run, f"{fields}, heights array<bigint>, widths array<bigint>")


def _with_paths(groups: DataFrame, cfg: StitchConfig, extension: str) -> DataFrame:
    """Adds each group's path: its name, or the next number that neither a file that is there nor another group has."""
    spark, folder = groups.sparkSession, cfg.output_path.rstrip("/")
    there = [n[: -len(extension) - 1] for n in store.names(folder) if n.endswith(f".{extension}")]
    file = output_name(output_base(F.col("subdir"), cfg.output_filename), F.lit(float(cfg.base_downsample)), extension)
    named = groups.withColumn("title", F.regexp_replace(file, f"\\.{extension.replace('.', chr(92) + '.')}$", ""))
    if there:
        known = spark.createDataFrame([(n, True) for n in there], "title string, there boolean")
        taken = numbers_taken(known.select("title").unionByName(named.select("title")), "title")
        named = named.join(known, "title", "left").join(taken, named["title"] == taken["prefix"], "left")
        free = F.get(F.filter(F.sequence(F.lit(2), F.size("numbers") + 2), lambda k: ~F.array_contains("numbers", k)), F.lit(0))
        number = F.when(F.col("there").isNull(), 1).otherwise(F.coalesce(free, F.lit(2)))
    else:
        number = F.lit(1)
    path = F.concat(F.lit(f"{folder}/"), numbered_name(F.col("title"), number, extension))
    return named.select(*groups.columns, path.alias("path"))


def _few(images: DataFrame, n: int) -> DataFrame:
    """A table of one row a group, n rows, sent to all tasks if its size is known to be small."""
    return F.broadcast(images) if n <= 100_000 else images


def _finish(images: DataFrame, chunk: int, codec: str | None, scales: list[float], pixel_size_um: float, z_spacing_um: float) -> DataFrame:
    """Writes the metadata of arrays whose chunks are there and gives them their names; takes the others away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                error = r["error"]
                try:
                    if error is None:
                        if not store.exists(r["path"]):  # a task that runs again has done this
                            levels = list(zip(r["heights"], r["widths"], strict=True))
                            zarr.write_metadata(r["folder"], levels, chunk, r["bands"], r["dtype"], codec, scales[: len(levels)], pixel_size_um, z_spacing_um)
                            store.move(r["folder"], r["path"])
                    else:
                        store.remove(r["folder"])
                except OSError as e:
                    error = f"{type(e).__name__}: {e}"
                rows.append((r["subdir"], error))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())], names=["subdir", "error"])

    return images.mapInArrow(run, "subdir string, error string")


def level_zero(spark: SparkSession, cfg: StitchConfig, chunk: int = 1024, fill_background: bool = True) -> DataFrame:
    """The composed image of every group in chunks, at full size and without writing it: what region reads and thumbnails
    work on (E4, E5). Groups that cannot be composed are left out."""
    tiles = stash(place(spark, cfg), "tiles")  # headers are read once
    images = group_bounds(tiles).join(raster.group_shapes(tiles, fill_background), "subdir").where("error is null")
    return _composed(tiles, images, chunk)


def _composed(tiles: DataFrame, images: DataFrame, chunk: int) -> DataFrame:
    cut = spread(translate_origin(tiles).join(images.select("subdir"), "subdir", "left_semi"))
    return raster.compose(raster.cut_tiles(cut, chunk), images, chunk)


def run(spark: SparkSession, cfg: StitchConfig, chunk: int = 1024, edge: int = 512, fill_background: bool = True, progress: Callable[[float], None] | None = None, max_chunks: int = 1 << 24) -> DataFrame:
    """Places, composes and writes every group; (subdir, n_tiles, status, path, error) ordered by subdir.

    Gaps of a colour image are white, of others 0 (see group_shapes: each group is looked at by itself). The base downsample
    is any number from 1 on: level 0 is the image made that many times smaller. Levels are four times apart in TIFF, twice in
    arrays, until one fits into a chunk; arrays with a base downsample other than 1 have four. No tiles give no rows. Without
    an output format it is TIFF.

    What a group cannot be written for is in its error, and the others go on: unreadable or damaged files, tiles that differ
    in bands, an extent of more than max_chunks chunks, a codec that is not at hand, a store that refuses. Outputs have
    another name until they are complete. progress is told the share of steps done, after each.
    """
    began = time.monotonic()
    if not cfg.base_downsample >= 1:
        raise ValueError("the base downsample must be 1 at least")
    base, is_tiff = float(cfg.base_downsample), cfg.output_format in (None, OutputFormat.OME_TIFF)
    step, extension = (4, "ome.tif") if is_tiff else (2, "ome.zarr")
    refused: Column = F.lit(None).cast("string")
    if is_tiff and (cfg.compression_type not in TIFF_CODECS or cfg.compression_type not in tiff.CODECS):
        refused = F.lit(f"no such compression here: {cfg.compression_type}")
    codec = None if is_tiff else zarr.known_codec(spark.range(1).select(zarr_codec(F.lit(cfg.compression_type))).first()[0])
    mark = uuid.uuid4().hex
    with Scratch(spark) as scratch:
        tiles = stash(place(spark, cfg), "tiles")  # headers are read once
        groups = group_bounds(tiles).join(raster.group_shapes(tiles, fill_background), "subdir")
        big = F.ceil(F.col("width") / chunk).cast("double") * F.ceil(F.col("height") / chunk) > max_chunks
        groups = groups.withColumn("error", F.coalesce("error", refused, F.when(big, F.format_string("an extent of %s by %s pixels", F.col("width").cast("string"), F.col("height").cast("string")))))
        images = _with_paths(_with_levels(groups, base, chunk, step, None if is_tiff or base == 1 else BASE_LEVELS), cfg, extension)
        images = stash(images.withColumn("folder", F.concat("path", F.lit(f".{mark}.part"))), "images")
        n, depth = images.agg(F.count(F.lit(1)), F.max(F.when(F.col("error").isNull(), F.size("heights")))).first()
        good = images.where("error is null")
        outcomes, encoded = [], []
        level = None
        for k in range(depth or 0):
            if level is None:
                level = stash(_composed(tiles, good, chunk), "level")
                if base != 1:
                    level = stash(raster.resample(level, chunk, base, 0), "level")
            else:
                deeper = good.where(F.size("heights") > k).select("subdir")
                level = stash(raster.resample(level.join(_few(deeper, n), "subdir", "left_semi"), chunk, step, k), "level")
            if is_tiff:
                encoded.append(stash(tiff.encode_tiles(level, chunk, edge, cfg.compression_type), "encoded", "none"))
            else:
                outcomes.append(stash(zarr.write_chunks(level.join(_few(good.select("subdir", "folder"), n), "subdir"), chunk, codec), "written"))
            if progress:
                progress((k + 1) / (depth + 1))
        if encoded:
            whole = encoded[0]
            for more in encoded[1:]:
                whole = whole.unionByName(more)
            done = tiff.write_files(whole, good.select("subdir", "path", "heights", "widths", "bands", "dtype"), edge, cfg.compression_type, cfg.pixel_size_um * base, step, mark=mark)
        elif outcomes:
            whole = outcomes[0]
            for more in outcomes[1:]:
                whole = whole.unionByName(more)
            failed = whole.groupBy("subdir").agg(F.min("error").alias("error"))
            ready = good.select("subdir", "path", "folder", "heights", "widths", "bands", "dtype").join(failed, "subdir")
            done = _finish(ready, chunk, codec, [base * step**i for i in range(64)], cfg.pixel_size_um, cfg.z_spacing_um)
        else:
            done = spark.createDataFrame([], "subdir string, error string")
        done = stash(done.withColumnRenamed("error", "failed").withColumn("done", F.lit(True)), "done")
        why = F.coalesce("error", "failed", F.when(F.col("done").isNull(), "nothing was written"))
        found = images.join(done, "subdir", "left").select("subdir", F.col("n").alias("n_tiles"), F.when(why.isNull(), "ok").otherwise("failed").alias("status"), F.when(why.isNull(), F.col("path")).alias("path"), why.alias("error"))
        for name in store.names(cfg.output_path):
            if f".{mark}" in name and name.endswith(".part"):  # of attempts that died
                store.remove(f"{cfg.output_path.rstrip('/')}/{name}")
        result = scratch.keep(stash(found, "outputs"))
    if progress:
        progress(1.0)
    log.info("%d groups in %.1f s", n, time.monotonic() - began)
    return result.orderBy("subdir")
