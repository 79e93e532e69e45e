"""Chunks of pixels: composition, fill and resampling on a grid.

A chunk is one row: subdir, level, cx, cy, h, w, bands, dtype, data, error. Groups are no unit of work: tasks hold one chunk.
What goes wrong in one group is a row with an error, and empty data from there on; other groups do not notice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.tiff import decode_region, open_tile

PIECE = "subdir string, file_name string, cx int, cy int, x int, y int, h int, w int, bands int, dtype string, data binary, error string"
CHUNK = "subdir string, level int, cx int, cy int, h int, w int, bands int, dtype string, data binary, error string"
PART = "subdir string, cx int, cy int, sx int, sy int, x int, y int, h int, w int, bands int, dtype string, nx binary, ny binary, data binary, error string"
COLUMNS = [c.split()[0] for c in CHUNK.split(", ")]
#: Of pixels in a batch that a task gives back, beside the row that goes beyond it.
BATCH_BYTES = 1 << 22


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _batches(rows: Iterator[tuple], schema: str) -> Iterator[pa.RecordBatch]:
    """Rows in batches of some MB, as a batch for each small one costs more than its pixels."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if size > BATCH_BYTES or len(held) == 10_000:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _by_chunk(rows: DataFrame, order: list[str], merge: Callable[[Iterator[dict]], Iterator[tuple]], schema: str) -> DataFrame:
    """merge over the rows of each (subdir, cx, cy), in that order. They come sorted and stream through their task; tasks are
    as many as shuffle partitions, as small chunks are work too."""
    key = ["subdir", "cx", "cy"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (r for batch in batches for r in batch.to_pylist())
        return _batches((out for _, same in groupby(found, itemgetter(*key)) for out in merge(same)), schema)

    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, *key).sortWithinPartitions(*key, *order).mapInArrow(run, schema)


def group_shapes(tiles: DataFrame, fill_background: bool = True) -> DataFrame:
    """(subdir, bands, dtype, white, error) of each group, from what headers say of its tiles.

    bands is their number in every tile that can be read; the type is the widest. white is the fill of a colour image
    (F12: three 8-bit bands, or three bands none of which is a fluorescence channel), the tiles' maximum if one is given,
    else the type's upper bound (P10); null for others, whose gaps are 0. Groups whose tiles differ in bands, or of which
    none can be read, have an error.
    """
    from ..functions.text import is_colour, white_value

    held = tiles.groupBy("subdir").agg(
        F.min("bands").alias("least"),
        F.max("bands").alias("bands"),
        F.max("bits").alias("bits"),
        F.coalesce(F.bool_and("rgb"), F.lit(False)).alias("rgb"),
        F.max("max_value").alias("max_value"),
        F.max_by("channels", F.size("channels")).alias("names"),
    )
    kind = F.when(F.col("bits") > 8, "uint16").otherwise("uint8")
    channels = F.transform("names", lambda c: F.struct(c.alias("name")))
    colour = is_colour(F.col("rgb") & (F.col("bits") == 8), F.col("bands"), channels)
    error = F.when(F.col("bands").isNull(), "no tile of this group could be read").when(F.col("least") != F.col("bands"), F.format_string("tiles of %s and of %s bands", F.col("least").cast("string"), F.col("bands").cast("string")))
    white = F.when(colour, F.least(white_value(F.col("max_value"), kind), F.when(F.col("bits") > 8, 65535.0).otherwise(255.0)).cast("int")) if fill_background else F.lit(None).cast("int")
    return held.select("subdir", "bands", kind.alias("dtype"), white.alias("white"), error.alias("error"))


def cut_tiles(tiles: DataFrame, chunk: int) -> DataFrame:
    """Pieces of tiles (subdir, file_name, path, x, y, w, h), one for each chunk that a tile touches. A task opens the file
    and reads what a piece needs; contents are not shuffled before they are cut. Files that cannot be decoded give none (F10)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                tile = open_tile(r["path"])
                if tile is None:
                    continue
                x, y, w, h = r["x"], r["y"], tile.width, tile.height
                with tile:
                    for cy in range(y // chunk, (y + h - 1) // chunk + 1):
                        y1, y2 = max(y, cy * chunk), min(y + h, (cy + 1) * chunk)
                        rows = decode_region(tile, y1 - y, y2 - y)
                        if rows is None:
                            yield r["subdir"], r["file_name"], max(0, x // chunk), max(0, cy), 0, 0, 0, 0, 0, "uint8", b"", f"{r['file_name']} is damaged"
                            break
                        for cx in range(x // chunk, (x + w - 1) // chunk + 1):
                            x1, x2 = max(x, cx * chunk), min(x + w, (cx + 1) * chunk)
                            part = np.ascontiguousarray(rows[:, x1 - x : x2 - x])
                            yield r["subdir"], r["file_name"], cx, cy, x1 - cx * chunk, y1 - cy * chunk, *part.shape, str(part.dtype), part.tobytes(), None

    return tiles.select("subdir", "file_name", "path", "x", "y").mapInArrow(lambda batches: _batches(cut(batches), PIECE), PIECE)


def compose(pieces: DataFrame, bounds: DataFrame, chunk: int) -> DataFrame:
    """Chunks of every group (subdir, width, height, bands, dtype, white), all of its grid, gaps too. Of pieces that overlap,
    the last by name wins; uncovered pixels are white in all bands, or 0 where white is null (F16)."""
    grid = bounds.withColumn("cx", F.explode(F.expr(f"sequence(0, cast(ceil(width / {chunk}) as int) - 1)"))).withColumn("cy", F.explode(F.expr(f"sequence(0, cast(ceil(height / {chunk}) as int) - 1)")))
    grid = grid.select("subdir", "cx", "cy", "width", "height", F.col("bands").alias("g_bands"), F.col("dtype").alias("g_dtype"), "white")

    def fill(found: Iterator[dict]) -> Iterator[tuple]:
        g = next(found)
        if g["file_name"] is not None:
            return
        h, w = min(chunk, g["height"] - chunk * g["cy"]), min(chunk, g["width"] - chunk * g["cx"])
        out, mask = np.zeros((h, w, g["g_bands"]), g["g_dtype"]), np.zeros((h, w), bool)
        damaged, error = [], None
        for p in found:
            try:
                if p["error"] is not None:
                    damaged.append(p["error"])
                    continue
                x, y = p["x"], p["y"]
                part = np.frombuffer(p["data"], p["dtype"]).reshape(p["h"], p["w"], p["bands"])
                out[y : y + p["h"], x : x + p["w"]] = part[: h - y, : w - x]
                mask[y : y + p["h"], x : x + p["w"]] = True
            except ValueError as e:
                error = error or str(e)
        if g["white"] is not None:
            out[~mask] = g["white"]
        error = min(damaged, default=error)
        yield g["subdir"], 0, g["cx"], g["cy"], h, w, g["g_bands"], g["g_dtype"], b"" if error else out.tobytes(), error

    # A chunk's pieces are what was laid over it: they meet in one task, as they have to. Its place in the grid has no name, and so comes first.
    return _by_chunk(grid.unionByName(pieces, allowMissingColumns=True), ["file_name"], fill, CHUNK)


def _runs(begin: int, n: int, factor: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pixels begin to begin + n - 1 on an axis: where a new output pixel begins, and its number (pixel p belongs
    to output floor(p / factor))."""
    of = np.floor(np.arange(begin, begin + n) / factor).astype(np.int64)
    at = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
    return at, of[at]


def resample(chunks: DataFrame, chunk: int, factor: float, level: int, crop: tuple[int, int, int, int] | None = None) -> DataFrame:
    """A smaller image in chunks of the same edge: output pixel i is the integer mean of the pixels p with floor(p / factor)
    = i on both axes, for any factor from 1 on (A11). crop (x, y, w, h) takes that part of the image, whose corner is then
    its origin.

    Each chunk is summed where it lies; blocks of sums, with the pixels of each row and column that went into them, meet
    in the output chunks. A factor that divides the chunk leaves no pixel to two of them.
    """
    x0, y0 = crop[:2] if crop else (0, 0)

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            for r in batch.to_pylist():
                if r["error"] is not None:
                    yield r["subdir"], *[0] * 8, r["bands"], r["dtype"], b"", b"", b"", r["error"]
                    continue
                pixels = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["bands"])
                left, top = r["cx"] * chunk - x0, r["cy"] * chunk - y0
                if crop:
                    pixels = pixels[max(0, -top) : max(0, crop[3] - top), max(0, -left) : max(0, crop[2] - left)]
                    left, top = max(0, left), max(0, top)
                h, w, bands = pixels.shape
                if not h or not w:
                    continue
                rows, ry = _runs(top, h, factor)
                columns, rx = _runs(left, w, factor)
                sums = np.add.reduceat(np.add.reduceat(pixels, rows, 0, dtype=np.int64), columns, 1)
                ny, nx = np.diff(np.append(rows, h)), np.diff(np.append(columns, w))
                for cy in range(int(ry[0]) // chunk, int(ry[-1]) // chunk + 1):
                    a, b = np.searchsorted(ry, [cy * chunk, (cy + 1) * chunk])
                    for cx in range(int(rx[0]) // chunk, int(rx[-1]) // chunk + 1):
                        c, d = np.searchsorted(rx, [cx * chunk, (cx + 1) * chunk])
                        part = sums[a:b, c:d]
                        part = np.ascontiguousarray(part, np.int32 if int(part.max(initial=0)) < 2**31 else np.int64)
                        yield r["subdir"], cx, cy, r["cx"], r["cy"], int(rx[c]) - cx * chunk, int(ry[a]) - cy * chunk, *part.shape, r["dtype"], nx[c:d].astype(np.int32).tobytes(), ny[a:b].astype(np.int32).tobytes(), part.tobytes(), None

    def merge(same: Iterator[dict]) -> Iterator[tuple]:
        found = list(same)
        first = found[0]
        head = (first["subdir"], level, first["cx"], first["cy"])
        failed = [p["error"] for p in found if p["error"] is not None]
        if failed:
            yield *head, 0, 0, first["bands"], first["dtype"], b"", min(failed)
            return
        h, w, bands = max(p["y"] + p["h"] for p in found), max(p["x"] + p["w"] for p in found), first["bands"]
        total, ny, nx = np.zeros((h, w, bands), np.int64), np.zeros(h, np.int64), np.zeros(w, np.int64)
        left, top = min(p["sx"] for p in found), min(p["sy"] for p in found)
        for p in found:
            x, y, data = p["x"], p["y"], p["data"]
            total[y : y + p["h"], x : x + p["w"]] += np.frombuffer(data, np.int32 if len(data) == 4 * p["h"] * p["w"] * bands else np.int64).reshape(p["h"], p["w"], bands)
            if p["sx"] == left:
                ny[y : y + p["h"]] += np.frombuffer(p["ny"], np.int32)
            if p["sy"] == top:
                nx[x : x + p["w"]] += np.frombuffer(p["nx"], np.int32)
        yield *head, h, w, bands, first["dtype"], (total // (ny[:, None, None] * nx[None, :, None])).astype(first["dtype"]).tobytes(), None

    parts = chunks.select(*[c for c in COLUMNS if c != "level"]).mapInArrow(lambda batches: _batches(shrink(batches), PART), PART)
    return _by_chunk(parts, [], merge, CHUNK)


def read_region(chunks: DataFrame, chunk: int, downsample: float, x: int, y: int, w: int, h: int) -> DataFrame:
    """The pixels of a request on each group's level 0 (S10, P9): (subdir, h, w, bands, dtype, data), one row a group whose
    image the request meets. The request is clipped to the image; gaps have been filled when chunks were composed (D17).
    Chunks beside the request are left out before their data are read; a result must fit a task, as an image must."""
    if not downsample >= 1 or w <= 0 or h <= 0:
        raise ValueError("a request needs a downsample of 1 at least and a size")
    met = chunks.where((F.col("level") == 0) & (F.col("cx") * chunk < x + w) & ((F.col("cx") + 1) * chunk > x) & (F.col("cy") * chunk < y + h) & ((F.col("cy") + 1) * chunk > y))
    x1, y1 = max(0, x), max(0, y)
    small = resample(met, chunk, downsample, 0, (x1, y1, x + w - x1, y + h - y1)).where("error is null")

    def join(found: pd.DataFrame) -> pd.DataFrame:
        first = found.iloc[0]
        out = np.zeros((int((found.cy * chunk + found.h).max()), int((found.cx * chunk + found.w).max()), int(first.bands)), first["dtype"])
        for p in found.itertuples():
            out[p.cy * chunk : p.cy * chunk + p.h, p.cx * chunk : p.cx * chunk + p.w] = np.frombuffer(p.data, p.dtype).reshape(p.h, p.w, p.bands)
        return pd.DataFrame([(first.subdir, *out.shape, first["dtype"], out.tobytes())], columns=["subdir", "h", "w", "bands", "dtype", "data"])

    return small.groupBy("subdir").applyInPandas(join, "subdir string, h int, w int, bands int, dtype string, data binary")


def thumbnail(images: DataFrame, white: int = 255) -> DataFrame:
    """Images (dtype, h, w, bands, data) with black pixels white: what a thumbnail shows of gaps, and of true black (S11,
    F13, D16)."""

    at = images.columns.index("data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                x = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["bands"]).copy()
                x[(x == 0).all(2)] = white
                out.append(x.tobytes())
            yield batch.set_column(at, "data", pa.array(out, pa.binary()))

    return images.mapInArrow(run, images.schema)
