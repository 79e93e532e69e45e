"""Numbers as the reference's runtime has them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Text edges that a trim takes off: all characters up to the blank (X11).
EDGES = "^[\\x00-\\x20]+|[\\x00-\\x20]+$"


def java_int(x: Column) -> Column:
    """The low 32 bits of a long, as an int: what narrowing does, without an error."""
    return F.shiftright(F.shiftleft(x.cast("bigint"), 32), 32).cast("int")


def java_round(x: Column) -> Column:
    """Half up towards positive infinity, exact next to .5: to a long, which is 0 for NaN and ends at its range, and then
    to its low 32 bits as an int."""
    return java_int(F.when(F.isnan(x), F.lit(0).cast("bigint")).when(x - F.floor(x) >= F.lit(0.5), F.ceil(x)).otherwise(F.floor(x)))


def java_trim(s: Column) -> Column:
    return F.regexp_replace(s, EDGES, "")


def try_int(s: Column) -> Column:
    """Null beyond the range of an int."""
    return s.try_cast("int")


def try_double(s: Column) -> Column:
    return java_trim(s).try_cast("double")


def parse_default(s: Column, default: float) -> Column:
    """A number from text; null, blank and malformed texts are the default."""
    return F.coalesce(try_double(F.when(java_trim(s) != "", s)), F.lit(float(default)))


def clamp(x: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(x, high))


def level_size(size: Column, downsample: Column) -> Column:
    """Size of a pyramid level: truncated (P11), and at the int range's end beyond it."""
    return clamp(size / downsample, F.lit(-2147483648.0), F.lit(2147483647.0)).cast("int")


def level_tiles(size: Column, edge: int = 1024) -> Column:
    return F.ceil(size / F.lit(float(edge))).cast("bigint")
