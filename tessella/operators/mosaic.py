"""Groups, bounds, metadata and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import level_size, level_tiles


def group_bounds(tiles: DataFrame) -> DataFrame:
    """(subdir, n, x0, y0 int, width, height long): one pass, partial sums before the shuffle. Sizes are longs, so that
    tiles at both ends of the int range do not fail."""
    return tiles.groupBy("subdir").agg(
        F.count(F.lit(1)).alias("n"),
        F.min("x").alias("x0"),
        F.min("y").alias("y0"),
        (F.max(F.col("x").cast("bigint") + F.col("w")) - F.min("x")).alias("width"),
        (F.max(F.col("y").cast("bigint") + F.col("h")) - F.min("y")).alias("height"),
    )


def group_counts(tiles: DataFrame) -> DataFrame:
    """(n_groups, n_tiles) of the whole catalog."""
    return tiles.groupBy("subdir").agg(F.count(F.lit(1)).alias("n")).agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_tiles"))


def override_metadata(bounds: DataFrame, pixel_size_um: float, z_spacing_um: float, kind: Column) -> DataFrame:
    """Pixel size, the same on both axes, z spacing, and the server's type."""
    return bounds.withColumns({"px_um": F.lit(float(pixel_size_um)), "z_um": F.lit(float(z_spacing_um)), "type": kind})


def level_tile_counts(bounds: DataFrame, downsamples: list[float], channels: int = 1, planes: int = 1, edge: int = 1024) -> DataFrame:
    """(subdir, level, tiles): tiles of each pyramid level."""
    levels = F.posexplode(F.array(*[F.lit(float(d)) for d in downsamples])).alias("level", "ds")
    found = bounds.select("subdir", "width", "height", levels)
    across, down = (level_tiles(level_size(F.col(c), F.col("ds")), edge) for c in ("width", "height"))
    return found.select("subdir", "level", (across * down * F.lit(channels * planes)).cast("bigint").alias("tiles"))


def level_depth(width: int, height: int, edge: int, step: int, fixed: int | None = None) -> int:
    """How many levels, each step times smaller than the one before, until one fits into edge; or the fixed number."""
    n, size = 1, max(width, height)
    while size > edge:
        n, size = n + 1, -(-size // step)
    return fixed or n


def run_status(outputs: DataFrame) -> DataFrame:
    """(n_ok, n_failed)."""
    return outputs.agg(F.count_if(F.col("path").isNotNull()).alias("n_ok"), F.count_if(F.col("path").isNull()).alias("n_failed"))


def last_output(outputs: DataFrame) -> DataFrame:
    """The path of the last group, by name, that has one; null if none has (A10, order made explicit)."""
    return outputs.where(F.col("path").isNotNull()).agg(F.max_by("path", "subdir").alias("path"))
