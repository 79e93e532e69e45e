"""The job's configuration record."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum


class OutputFormat(Enum):
    OME_TIFF = "OME_TIFF"
    OME_ZARR = "OME_ZARR"


#: Names of the placement strategies.
FILE_NAME = "Filename[x,y] with coordinates in microns"
TILE_CONFIG = "Coordinates in TileConfiguration.txt file"
VECTRA = "Vectra tiles with metadata"


@dataclass(frozen=True)
class Preferences:
    """What a form starts from (S14): fixed values, texts as they are typed."""

    folder_location: str = "C:/"
    image_pixel_size_um: str = "7.2"
    downsample: str = "1"
    search_string: str = "20x"
    compression_type: str = "J2K"
    stitching_method: str = TILE_CONFIG


@dataclass(frozen=True)
class StitchConfig:
    """What to stitch, and how. Nothing is checked here: a null format and unknown names are only refused where used.

    Without an output format it is OME_TIFF; an explicit None is kept. output_filename, if given, is put before group
    names (P7).
    """

    stitching_type: str
    folder_path: str
    output_path: str
    compression_type: str
    pixel_size_um: float
    base_downsample: float
    matching_string: str
    z_spacing_um: float
    x_fudge: float = 1.0
    y_fudge: float = 1.0
    output_format: OutputFormat | None = OutputFormat.OME_TIFF
    output_filename: str | None = None
