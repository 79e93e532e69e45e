"""Pixels and their pyramid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def explode_blocks(blocks: DataFrame, values: Column, edge: int, x: Column, y: Column, keep: list[str]) -> DataFrame:
    """(keep, px, py, v) of blocks of edge by edge values at x, y."""
    cell = F.posexplode(values).alias("i", "v")
    return blocks.select(*keep, x.alias("_x"), y.alias("_y"), cell).select(*keep, (F.col("_x") + F.col("i") % edge).cast("int").alias("px"), (F.col("_y") + F.expr(f"i div {edge}")).cast("int").alias("py"), "v")


def downsample(pixels: DataFrame, factor: int, by: list[str] | None = None) -> DataFrame:
    """(by, gx, gy, s, n): sum and number of the pixels of each factor by factor block; the kernel is their integer mean,
    s div n. Sums are taken before the shuffle, and levels can be made from levels: pass s and n on."""
    keys = by or []
    return pixels.groupBy(*keys, F.floor(F.col("px") / factor).cast("int").alias("gx"), F.floor(F.col("py") / factor).cast("int").alias("gy")).agg(F.sum("v").cast("bigint").alias("s"), F.count(F.lit(1)).alias("n"))
