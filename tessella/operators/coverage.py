"""Overlaps, coverage and background fill.

Interval joins go through a grid: rectangles are dealt into the cells that they touch, pairs meet in cells, and each pair
is counted in one cell only, that of its upper left corner, so that no distinct is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import clamp, java_round


def _cells(df: DataFrame, cell: int, x: str, y: str, w: str, h: str) -> DataFrame:
    """A row for each cell that a rectangle touches; empty rectangles touch none. Coordinates become longs."""
    found = df.where((F.col(w) > 0) & (F.col(h) > 0)).withColumns({c: F.col(c).cast("bigint") for c in (x, y, w, h)})
    found = found.withColumn("_cx", F.explode(F.expr(f"sequence(cast(floor({x} / {cell}) as int), cast(floor(({x} + {w} - 1) / {cell}) as int))")))
    return found.withColumn("_cy", F.explode(F.expr(f"sequence(cast(floor({y} / {cell}) as int), cast(floor(({y} + {h} - 1) / {cell}) as int))")))


def _dealt(kept: DataFrame, share: int) -> tuple[DataFrame, DataFrame]:
    """Both sides of a join within cells, with a part number: what lies in a cell beyond share rows is dealt into parts on
    the left and repeated for each of them on the right, so that a crowded cell is many tasks."""
    keys = ["subdir", "_cx", "_cy"]
    full = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share).select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_parts"))
    few = full.limit(100_001).count() <= 100_000
    known = kept.join(F.broadcast(full) if few else full, keys, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1)))
    left = known.withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("file_name", "x", "y"), F.col("_parts"))).otherwise(F.lit(0)).cast("int"))
    return left.drop("_parts"), known.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")


def overlap_pairs(tiles: DataFrame, cell: int = 512, share: int = 2000) -> DataFrame:
    """(subdir, fa, fb, area) of tiles of one group that overlap, fa before fb. Cells spread a large group over many
    tasks, and so do the parts of a cell with more than share tiles."""
    kept = _cells(tiles.select("subdir", "file_name", "x", "y", "w", "h"), cell, "x", "y", "w", "h")
    one, other = _dealt(kept, share)
    a = one.select("subdir", "_cx", "_cy", "_part", *[F.col(c).alias(f"a_{c}") for c in ("file_name", "x", "y", "w", "h")])
    b = other.select("subdir", "_cx", "_cy", "_part", *[F.col(c).alias(f"b_{c}") for c in ("file_name", "x", "y", "w", "h")])
    left, top = F.greatest("a_x", "b_x"), F.greatest("a_y", "b_y")
    right, bottom = F.least(F.expr("a_x + a_w"), F.expr("b_x + b_w")), F.least(F.expr("a_y + a_h"), F.expr("b_y + b_h"))
    met = a.join(b, ["subdir", "_cx", "_cy", "_part"]).where((F.col("a_file_name") < F.col("b_file_name")) & (left < right) & (top < bottom))
    met = met.where((F.floor(left / cell) == F.col("_cx")) & (F.floor(top / cell) == F.col("_cy")))
    return met.select("subdir", F.col("a_file_name").alias("fa"), F.col("b_file_name").alias("fb"), ((right - left) * (bottom - top)).alias("area"))


def intersects(x: int, y: int, w: int, h: int) -> Column:
    """Whether a tile meets a request (F11); a plain range predicate, so that it is pushed into the scan."""
    return (F.col("x") < x + w) & (F.col("x").cast("bigint") + F.col("w") > x) & (F.col("y") < y + h) & (F.col("y").cast("bigint") + F.col("h") > y)


def read_region(tiles: DataFrame, downsample: float, x: int, y: int, w: int, h: int) -> DataFrame:
    """Tiles that a request meets, with what they cover of its output, px1 to px2 and py1 to py2."""
    out_w, out_h = max(1, int(w / downsample)), max(1, int(h / downsample))

    def edge(c: Column, begin: int, size: int, out: int) -> Column:
        clipped = clamp(c, F.lit(begin), F.lit(begin + size))
        return clamp(java_round((clipped - F.lit(begin)) / F.lit(float(downsample))), F.lit(0), F.lit(out))

    met = tiles.where(intersects(x, y, w, h))
    return met.withColumns(
        {
            "px1": edge(F.col("x"), x, w, out_w),
            "py1": edge(F.col("y"), y, h, out_h),
            "px2": edge(F.col("x").cast("bigint") + F.col("w"), x, w, out_w),
            "py2": edge(F.col("y").cast("bigint") + F.col("h"), y, h, out_h),
        }
    )


def _strips(tiles: DataFrame, cell: int) -> DataFrame:
    """Each tile cut along the cells it touches: (subdir, _cx, _cy, x1, y1, x2, y2) within the cell."""
    cut = _cells(tiles.select("subdir", "x", "y", "w", "h"), cell, "x", "y", "w", "h")
    return cut.select(
        "subdir",
        "_cx",
        "_cy",
        F.greatest(F.col("x"), F.col("_cx") * cell).alias("x1"),
        F.greatest(F.col("y"), F.col("_cy") * cell).alias("y1"),
        F.least(F.col("x") + F.col("w"), (F.col("_cx") + 1) * cell).alias("x2"),
        F.least(F.col("y") + F.col("h"), (F.col("_cy") + 1) * cell).alias("y2"),
    )


def coverage_area(tiles: DataFrame, cell: int = 128) -> DataFrame:
    """(subdir, covered_px): pixels under at least one tile (A9). Tiles are cut along a grid, equal pieces collapse
    before the shuffle; in each cell every row of pixels counts its covered columns by merging sorted spans."""
    cut = _strips(tiles, cell).distinct()
    rows = cut.select("subdir", "_cx", F.explode(F.expr("sequence(y1, y2 - 1)")).alias("py"), "x1", "x2")
    # A row of a cell has cell * cell different spans at most.
    spans = rows.groupBy("subdir", "_cx", "py").agg(F.sort_array(F.collect_set(F.struct("x1", "x2"))).alias("s"))
    merged = F.expr("aggregate(s, named_struct('n', 0L, 'end', -9223372036854775807L), (a, v) -> named_struct('n', a.n + greatest(0L, v.x2 - greatest(v.x1, a.end)), 'end', greatest(a.end, v.x2)), a -> a.n)")
    return spans.select("subdir", merged.alias("n")).groupBy("subdir").agg(F.sum("n").alias("covered_px"))


def fill_white(canvas: DataFrame, pixels: DataFrame, white: int, keys: list[str], value: str = "v") -> DataFrame:
    """Every place of the canvas, with its pixel or white."""
    return canvas.join(pixels, keys, "left").select(*keys, F.coalesce(F.col(value), F.lit(white)).alias(value))


def fill_black(pixels: DataFrame, white: int, bands: str = "bands") -> DataFrame:
    """Pixels whose bands are all 0 become white in all bands (F13): used for thumbnails, and where no region is known."""
    return pixels.withColumn(bands, F.expr(f"if(forall({bands}, b -> b = 0), transform({bands}, b -> {white}), {bands})"))
