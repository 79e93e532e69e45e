"""Rules on names and texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File names with coordinates; the last pair of brackets counts.
NAME_PATTERN = "^.*\\[(\\d+),(\\d+)\\].*\\.(tif|tiff|ome\\.tif)$"
#: Parts of channel names that mean fluorescence.
FLUORESCENCE = ("dapi", "fitc", "cy", "alexa", "rhodamine", "gfp", "rfp", "yfp", "cfp", "hoechst", "sytox")
#: Names of TIFF compression.
TIFF_CODECS = ("DEFAULT", "UNCOMPRESSED", "JPEG", "J2K", "J2K_LOSSY", "LZW", "ZLIB")
#: Array codecs that other names stand for.
ZARR_CODECS = {"lzw": "zlib", "deflate": "zlib", "zlib": "zlib", "jpeg": "zstd", "jpeg-2000": "zstd", "jpeg-2000-lossy": "zstd", "j2k": "zstd", "j2k_lossy": "zstd"}
ZARR_LEVEL, ZARR_SHUFFLE, ZARR_DEFAULT = 5, 1, "zstd"
WHITE_LABEL = " (white background)"


def leaf(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def matches_group(name: Column, part: str) -> Column:
    """A literal part of the name, case counts; the empty one matches all."""
    return F.contains(name, F.lit(part))


def named_coordinates(file_name: Column) -> tuple[Column, Column, Column]:
    """Whether a name has coordinates, and both numbers (null beyond an int)."""
    return F.rlike(file_name, F.lit(NAME_PATTERN)), F.regexp_extract(file_name, NAME_PATTERN, 1).try_cast("int"), F.regexp_extract(file_name, NAME_PATTERN, 2).try_cast("int")


def split_dropping_trailing(s: Column, mark: str) -> Column:
    """Fields between marks without the empty ones at the end."""
    return F.split(F.regexp_replace(s, f"{mark}+$", ""), mark)


def is_fluorescence(channels: Column) -> Column:
    """Whether any channel's name tells of fluorescence; false for null or no channels and null names."""
    return F.coalesce(F.exists(channels, lambda c: F.coalesce(F.rlike(F.lower(c["name"]), F.lit("|".join(FLUORESCENCE))), F.lit(False))), F.lit(False))


def is_colour(is_rgb: Column, n_channels: Column, channels: Column) -> Column:
    """What is filled with white."""
    return is_rgb | ((n_channels == 3) & ~is_fluorescence(channels))


def is_wrapped(is_rgb: Column, n_channels: Column) -> Column:
    """What carries the white-background label: fluorescence is not looked at here."""
    return is_rgb | (n_channels == 3)


def server_type(kind: Column, is_rgb: Column, n_channels: Column) -> Column:
    return F.when(is_wrapped(is_rgb, n_channels), F.concat(kind, F.lit(WHITE_LABEL))).otherwise(kind)


def white_value(max_value: Column, pixel_type: Column) -> Column:
    """The metadata's maximum, else the type's upper bound, else 255 (P10)."""
    bound = F.when(pixel_type == "uint8", 255.0).when(pixel_type == "int8", 127.0).when(pixel_type == "uint16", 65535.0).when(pixel_type == "int16", 32767.0)
    bound = bound.when(pixel_type == "uint32", 4294967295.0).when(pixel_type == "int32", 2147483647.0)
    return F.coalesce(max_value, bound, F.lit(255.0))


def zarr_codec(name: Column) -> Column:
    """The array codec for a compression name: null for none (K5)."""
    low = F.lower(name)
    chosen = F.when(name.isNull() | (name == ""), F.lit(ZARR_DEFAULT)).when(low.isin("uncompressed", "none"), F.lit(None).cast("string"))
    for k, v in ZARR_CODECS.items():
        chosen = chosen.when(low == k, F.lit(v))
    return chosen.otherwise(low)


def tiff_codec_valid(name: Column) -> Column:
    """Whether a name is a TIFF compression; case counts, null is not (K4)."""
    return F.coalesce(name.isin(*TIFF_CODECS), F.lit(False))


def output_base(subdir: Column, prefix: str | None) -> Column:
    return F.concat(F.lit(f"{prefix}_"), subdir) if prefix and prefix.strip() else subdir


def output_name(base: Column, downsample: Column, extension: str) -> Column:
    """The downsample is in the name if it is not 1, truncated."""
    return F.when(downsample == 1, F.concat(base, F.lit(f".{extension}"))).otherwise(F.concat(base, F.lit("_"), downsample.cast("int").cast("string"), F.lit(f"x_downsample.{extension}")))


def numbered_name(name: Column, place: Column, extension: str) -> Column:
    """The name itself at place 1, else with _place before the extension (K6, K7)."""
    base = F.regexp_replace(name, f"\\.{extension.replace('.', chr(92) + '.')}$", "")
    return F.when(place == 1, F.concat(base, F.lit(f".{extension}"))).otherwise(F.concat(base, F.lit("_"), place.cast("string"), F.lit(f".{extension}")))
