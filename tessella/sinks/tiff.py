"""Pyramidal tiled TIFF, a file for each group (K2).

Tiles are compressed where chunks are. A file's layout follows from the sizes of its tiles alone, so that one task then
streams it from front to back, one tile at a time; files beyond 4 GB are of the big kind.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.jpeg import jpeg_encode
from ..functions.lzw import lzw_encode
from ..sources import tiff as T
from . import store

#: Compression tags. The other codecs need encoders that are not at hand, and are refused.
CODECS = {"UNCOMPRESSED": 1, "LZW": 5, "JPEG": 7, "ZLIB": 8, "DEFAULT": 8}
#: Bytes of tiles beyond which a file is big, as places of the classic kind have 32 bits.
CLASSIC = 0xFFFFFFFF - (1 << 24)
TILE = "subdir string, level int, ty int, tx int, size bigint, data binary, error string"


def compress(pixels: np.ndarray, compression: str) -> bytes:
    """A tile's stored form. Raises ValueError for pixels that the codec does not hold."""
    tag = CODECS[compression]
    if tag == 7:
        return jpeg_encode(pixels)
    raw = pixels.tobytes()
    return raw if tag == 1 else lzw_encode(raw) if tag == 5 else zlib.compress(raw, 6)


def encode_tiles(chunks: DataFrame, chunk: int, edge: int, compression: str) -> DataFrame:
    """(subdir, level, ty, tx, size, data, error) of all tiles of edge by edge; chunk is a multiple of it."""
    if chunk % edge:
        raise ValueError("a chunk must hold whole tiles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                rows = []
                if r["error"] is not None:
                    rows.append((r["subdir"], r["level"], 0, 0, 0, b"", r["error"]))
                else:
                    x = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["bands"])
                    for ty in range(-(-r["h"] // edge)):
                        for tx in range(-(-r["w"] // edge)):
                            full = np.zeros((edge, edge, r["bands"]), np.dtype(r["dtype"]).newbyteorder("<"))
                            part = x[ty * edge : (ty + 1) * edge, tx * edge : (tx + 1) * edge]
                            full[: part.shape[0], : part.shape[1]] = part
                            try:
                                raw = compress(full, compression)
                            except ValueError as e:
                                rows.append((r["subdir"], r["level"], 0, 0, 0, b"", str(e)))
                                continue
                            rows.append((r["subdir"], r["level"], r["cy"] * (chunk // edge) + ty, r["cx"] * (chunk // edge) + tx, len(raw), raw, None))
                kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[f.split()[0] for f in TILE.split(", ")])

    return chunks.select("subdir", "level", "cx", "cy", "h", "w", "bands", "dtype", "data", "error").mapInArrow(run, TILE)


def write_files(tiles: DataFrame, images: DataFrame, edge: int, compression: str, pixel_size_um: float, step: int = 4, classic: int = CLASSIC, mark: str = "") -> DataFrame:
    """Streams each group's tiles, in the order of level, row and column, behind a header that says where the directories
    will be. images: (subdir, path, heights, widths array<int>, bands, dtype). A file has another name until it is
    complete, one for each attempt of a task, that holds mark: what a dead attempt leaves can be told by it. Returns
    (subdir, error)."""
    total = tiles.groupBy("subdir").agg(F.sum("size").alias("total"), F.min("error").alias("failed"))
    known = images.join(total, "subdir")  # a row for each group
    rows = tiles.drop("error").join(known, "subdir").repartition("subdir").sortWithinPartitions("subdir", "level", "ty", "tx")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None
        f, at, held, sizes, error = None, "", None, [], None

        def close() -> pa.RecordBatch:
            nonlocal error
            if f is not None and error is None:
                try:
                    f.write(_directories(now, sizes, edge, compression, pixel_size_um, step, now["total"] > classic))
                    f.close()
                    held.move(at, store.split(now["path"])[1])
                except (OSError, ValueError, struct.error) as e:
                    error = f"{type(e).__name__}: {e}"
            return pa.RecordBatch.from_arrays([pa.array([now["subdir"]], pa.string()), pa.array([error], pa.string())], names=["subdir", "error"])

        for batch in batches:
            for i in range(len(batch)):
                r = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
                if now is None or r["subdir"] != now["subdir"]:
                    if now is not None:
                        yield close()
                    now, f, sizes, error = {k: v for k, v in r.items() if k != "data"}, None, [], r["failed"]
                    if error is None:
                        try:
                            held, place = store.split(r["path"])
                            at = f"{place}.{mark}{uuid.uuid4().hex}.part"
                            held.create_dir(place.rsplit("/", 1)[0], recursive=True)
                            f = held.open_output_stream(at)
                            end = r["total"] + r["total"] % 2
                            f.write(struct.pack("<2sHHHQ", b"II", 43, 8, 0, 16 + end) if r["total"] > classic else struct.pack("<2sHI", b"II", 42, 8 + end))
                        except OSError as e:
                            error = f"{type(e).__name__}: {e}"
                if error is None:
                    try:
                        f.write(r["data"])
                        sizes.append(r["size"])
                    except OSError as e:
                        error = f"{type(e).__name__}: {e}"
        if now is not None:
            yield close()

    return rows.mapInArrow(run, "subdir string, error string")


def _directories(image: dict, sizes: list[int], edge: int, compression: str, pixel_size_um: float, step: int, big: bool) -> bytes:
    """Padding to an even place, then a directory for each level, smaller ones marked as such. pixel_size_um is that of
    level 0, whose base downsample it includes."""
    offsets = ((16 if big else 8) + np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))])).tolist()
    at = offsets[-1] + offsets[-1] % 2
    out = b"\0" * (offsets[-1] % 2)
    place, kind, long = 0, np.dtype(image["dtype"]), 16 if big else 4
    levels = list(zip(image["heights"], image["widths"], strict=True))
    for level, (h, w) in enumerate(levels):
        n = -(-h // edge) * -(-w // edge)
        per_cm = (max(1, round(10_000_000 / (pixel_size_um * step**level))), 1000)
        entries: list[tuple[int, int, tuple]] = [(254, 4, (int(level > 0),)), (T.WIDTH, 4, (w,)), (T.HEIGHT, 4, (h,)), (T.BITS, 3, (8 * kind.itemsize,) * image["bands"]), (T.COMPRESSION, 3, (CODECS[compression],))]
        entries += [(T.PHOTOMETRIC, 3, (6 if CODECS[compression] == 7 and image["bands"] == 3 else 2 if image["bands"] == 3 else 1,)), (T.SAMPLES, 3, (image["bands"],)), (T.PLANAR, 3, (1,)), (296, 3, (3,)), (T.X_RES, 5, per_cm), (T.Y_RES, 5, per_cm)]
        entries += [(T.TILE_W, 4, (edge,)), (T.TILE_H, 4, (edge,)), (T.TILE_OFFSETS, long, tuple(offsets[place : place + n])), (T.TILE_COUNTS, long, tuple(sizes[place : place + n]))]
        entries += [(530, 3, (1, 1))] if CODECS[compression] == 7 and image["bands"] == 3 else []  # colour is not subsampled
        size = T.directory_size(entries, big)
        last = level == len(levels) - 1
        out += T.directory(entries, at, 0 if last else at + size + size % 2, big) + b"\0" * (size % 2)
        at += size + size % 2
        place += n
    return out
