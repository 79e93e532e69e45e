"""Placement of tiles as they arrive. The operators on single rows are the same; sums grow with the stream."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.mosaic import group_bounds
from ..operators.placement import place_by_name


def stream_bounds(files: DataFrame, pixel_size_um: float, match: str = "") -> DataFrame:
    """Bounds of each group of a stream of files (subdir, file_name, w, h), for complete or update output: the state is
    one row for each group."""
    return group_bounds(place_by_name(files, pixel_size_um, match))
