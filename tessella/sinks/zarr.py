"""Chunked-array pyramids, a folder for each group and a file for each chunk (K3)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blosc import FORMATS, blosc_decode, blosc_encode
from ..functions.text import ZARR_LEVEL, ZARR_SHUFFLE
from . import store


def compressor(codec: str | None) -> dict | None:
    """What the metadata says of a codec: Blosc, level 5, shuffled by bytes."""
    return None if codec is None else {"id": "blosc", "cname": codec, "clevel": ZARR_LEVEL, "shuffle": ZARR_SHUFFLE, "blocksize": 0}


def known_codec(codec: str | None) -> str | None:
    """The codec, or zstd for a name that Blosc does not have (K5: what fails becomes zstd)."""
    return codec if codec is None or codec in FORMATS else "zstd"


def compress(raw: bytes, codec: str | None, size: int = 1) -> bytes:
    return raw if codec is None else blosc_encode(raw, codec, ZARR_LEVEL, size)


def decompress(raw: bytes, codec: str | None) -> bytes:
    return raw if codec is None else blosc_decode(raw)


def write_chunks(chunks: DataFrame, chunk: int, codec: str | None) -> DataFrame:
    """Writes each chunk (with the column folder) where it is, padded to the full chunk as the format has it. Returns
    (subdir, error), a row for each chunk; a retried or doubled task writes the same under the same name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                error = r["error"]
                if error is None:
                    try:
                        kind = np.dtype(r["dtype"]).newbyteorder("<")
                        full = np.zeros((chunk, chunk, r["bands"]), kind)
                        full[: r["h"], : r["w"]] = np.frombuffer(r["data"], r["dtype"]).reshape(r["h"], r["w"], r["bands"])
                        store.write(f"{r['folder']}/{r['level']}/{r['cy']}.{r['cx']}.0", compress(full.tobytes(), codec, kind.itemsize))
                    except (OSError, ValueError) as e:
                        error = f"{type(e).__name__}: {e}"
                rows.append((r["subdir"], error))
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in rows], pa.string()), pa.array([b for _, b in rows], pa.string())], names=["subdir", "error"])

    return chunks.mapInArrow(run, "subdir string, error string").groupBy("subdir").agg(F.min("error").alias("error"))


def write_metadata(folder: str, levels: list[tuple[int, int]], chunk: int, bands: int, dtype: str, codec: str | None, downsamples: list[float], pixel_size_um: float, z_spacing_um: float) -> None:
    """The group's metadata, written last: a folder without it is not a finished image."""
    for i, (h, w) in enumerate(levels):
        meta = {"zarr_format": 2, "shape": [h, w, bands], "chunks": [chunk, chunk, bands], "dtype": np.dtype(dtype).newbyteorder("<").str, "compressor": compressor(codec), "fill_value": 0, "order": "C", "filters": None}
        store.write(f"{folder}/{i}/.zarray", json.dumps(meta).encode())
    scales = [{"path": str(i), "coordinateTransformations": [{"type": "scale", "scale": [pixel_size_um * d, pixel_size_um * d, 1]}]} for i, d in enumerate(downsamples)]
    axes = [{"name": "y", "type": "space", "unit": "micrometer"}, {"name": "x", "type": "space", "unit": "micrometer"}, {"name": "c", "type": "channel"}]
    store.write(f"{folder}/.zattrs", json.dumps({"multiscales": [{"version": "0.4", "axes": axes, "datasets": scales}], "zSpacingMicrons": z_spacing_um}).encode())
    store.write(f"{folder}/.zgroup", json.dumps({"zarr_format": 2}).encode())


def read_level(folder: str, level: int) -> np.ndarray:
    """A level as it was written: rows, columns, bands."""

    def content(path: str) -> bytes:
        at, name = store.split(path)
        with at.open_input_stream(name) as f:
            return f.read()

    meta = json.loads(content(f"{folder}/{level}/.zarray"))
    h, w, bands = meta["shape"]
    edge, kind = meta["chunks"][0], np.dtype(meta["dtype"])
    codec = meta["compressor"] and meta["compressor"]["cname"]
    out = np.zeros((-(-h // edge) * edge, -(-w // edge) * edge, bands), kind)
    for cy in range(out.shape[0] // edge):
        for cx in range(out.shape[1] // edge):
            raw = decompress(content(f"{folder}/{level}/{cy}.{cx}.0"), codec)
            out[cy * edge : (cy + 1) * edge, cx * edge : (cx + 1) * edge] = np.frombuffer(raw, kind).reshape(edge, edge, bands)
    return out[:h, :w]
