"""Placement strategies: table functions from a folder to tiles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FILE_NAME, TILE_CONFIG, VECTRA, StitchConfig
from ..functions.text import matches_group
from ..operators import placement as P
from ..sources import catalog as C

Strategy = Callable[[SparkSession, StitchConfig], DataFrame]


def by_name(spark: SparkSession, cfg: StitchConfig) -> DataFrame:
    """Names are tested before headers are read."""
    files = C.tile_files(spark, cfg.folder_path)
    ok, _, _ = P.named_coordinates(F.col("file_name"))
    wanted = files.where(matches_group(F.col("subdir"), cfg.matching_string) & ok)
    return P.place_by_name(C.with_headers(wanted), cfg.pixel_size_um, cfg.matching_string)


def by_config(spark: SparkSession, cfg: StitchConfig) -> DataFrame:
    """Positions are joined before headers are read."""
    root = cfg.folder_path.rstrip("/")
    has = C.exists(spark, f"{root}/{C.CONFIG_NAME}")
    alone = has and cfg.matching_string in root.rsplit("/", 1)[-1]
    files = P.root_or_subdirs(C.tile_files(spark, root, 0) if alone else spark.createDataFrame([], "path string, file_name string, subdir string"), C.group_files(spark, root), has, root.rsplit("/", 1)[-1], cfg.matching_string)
    lines = C.config_lines(spark, root, in_root=alone)
    positions = P.last_wins(P.keep_prefix(P.parse_config(lines, cfg.pixel_size_um, cfg.base_downsample)))
    known = files.join(positions.select(F.col("config_dir").alias("subdir"), F.col("image_name").alias("file_name")), ["subdir", "file_name"], "left_semi")
    return P.place_by_config(C.with_headers(known), positions)


def by_tags(spark: SparkSession, cfg: StitchConfig) -> DataFrame:
    files = C.tile_files(spark, cfg.folder_path).where(matches_group(F.col("subdir"), cfg.matching_string))
    return P.place_by_tags(C.with_headers(files), cfg.x_fudge, cfg.y_fudge, cfg.matching_string)


#: Open to further strategies.
STRATEGIES: dict[str, Strategy] = {FILE_NAME: by_name, TILE_CONFIG: by_config, VECTRA: by_tags}


def discover(group: str = "tessella.strategies") -> list[str]:
    """Adds the strategies that installed packages offer as entry points (E3); the names that were new."""
    from importlib.metadata import entry_points

    found = {e.name: e for e in entry_points(group=group) if e.name not in STRATEGIES}
    STRATEGIES.update((name, e.load()) for name, e in found.items())
    return sorted(found)


def strategy(name: str) -> Strategy:
    if name not in STRATEGIES:
        discover()
    if name not in STRATEGIES:
        raise ValueError(f"no such strategy: {name}")
    return STRATEGIES[name]
