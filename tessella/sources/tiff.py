"""TIFF headers and pixels from bytes."""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions.lzw import lzw_decode
from ..sinks.store import split

#: Tags of the format.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, ROWS, COUNTS = 256, 257, 258, 259, 273, 277, 278, 279
X_RES, Y_RES, PLANAR, X_POS, Y_POS = 282, 283, 284, 286, 287
TILE_W, TILE_H, TILE_OFFSETS, TILE_COUNTS, SAMPLE_FORMAT, PREDICTOR = 322, 323, 324, 325, 339, 317
DESCRIPTION, MAX_SAMPLE, PHOTOMETRIC, SUBFILE = 270, 281, 262, 254
TYPES = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 8: "h", 9: "i", 10: "ii", 11: "f", 12: "d", 16: "Q", 17: "q", 18: "Q"}
#: What a header needs: the tags of places alone are as long as the file has tiles.
HEADER_TAGS = frozenset((WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, X_RES, Y_RES, X_POS, Y_POS, PLANAR, SAMPLE_FORMAT, DESCRIPTION, MAX_SAMPLE, PHOTOMETRIC, PREDICTOR))
#: Bytes of a tag's value beyond which a file is taken for damaged.
LONGEST = 1 << 28

HEADER = "x_res double, y_res double, x_pos double, y_pos double, w int, h int, bands int, bits int, rgb boolean, max_value double, channels array<string>"
_HEADER_KINDS = [*[pa.float64()] * 4, *[pa.int32()] * 4, pa.bool_(), pa.float64(), pa.list_(pa.string())]
Read = Callable[[int, int], bytes]


def _reader(raw: bytes) -> Read:
    return lambda at, n: raw[at : at + n]


def directories(raw: bytes | Read, wanted: frozenset[int] | None = None) -> Iterator[dict[int, tuple]]:
    """The tags of each image of a file, all or those wanted, in the file's order; none if this is no TIFF, classic or big.
    Only the ranges that hold them are read. What follows a damaged directory is left out."""
    read = _reader(raw) if isinstance(raw, bytes) else raw
    try:
        start = read(0, 16)
        order = {b"II": "<", b"MM": ">"}.get(start[:2])
        if order is None:
            return
        (magic,) = struct.unpack(f"{order}H", start[2:4])
        if magic == 42:
            (at,), head, entry_size, count_form, place = struct.unpack(f"{order}I", start[4:8]), 2, 12, "H", "I"
        elif magic == 43 and struct.unpack(f"{order}HH", start[4:8]) == (8, 0):
            (at,), head, entry_size, count_form, place = struct.unpack(f"{order}Q", start[8:16]), 8, 20, "Q", "Q"
        else:
            return
        inline, seen = struct.calcsize(place), set()
        while at and at not in seen:
            seen.add(at)
            (n_entries,) = struct.unpack(f"{order}{count_form}", read(at, head))
            if n_entries > 1 << 16:
                return
            entries = read(at + head, entry_size * n_entries)
            found: dict[int, tuple] = {}
            for i in range(n_entries):
                entry = entries[entry_size * i : entry_size * (i + 1)]
                tag, kind, n = struct.unpack(f"{order}HH{place}", entry[: 4 + inline])
                if kind not in TYPES or (wanted is not None and tag not in wanted):
                    continue
                size = n * struct.calcsize(f"={TYPES[kind]}")
                if size > LONGEST:
                    return
                value = entry[4 + inline : 4 + inline + size]
                if size > inline:
                    (where,) = struct.unpack(f"{order}{place}", entry[4 + inline :])
                    value = read(where, size)
                found[tag] = (value,) if kind == 2 else struct.unpack(f"{order}{n * len(TYPES[kind])}{TYPES[kind][0]}", value)
            yield found
            (at,) = struct.unpack(f"{order}{place}", read(at + head + entry_size * n_entries, inline))
    except (struct.error, OSError):
        return


def read_tags(raw: bytes | Read, wanted: frozenset[int] | None = None) -> dict[int, tuple] | None:
    """Tags of the first image, or None if there is none."""
    return next(directories(raw, wanted), None)


def ratio(tags: dict[int, tuple], tag: int) -> float:
    """A rational tag's value: 0 if it is missing or malformed; no error for a zero denominator."""
    value = tags.get(tag)
    if value is None or len(value) < 2:
        return 0.0
    with np.errstate(divide="ignore", invalid="ignore"):
        return float(np.float64(value[0]) / np.float64(value[1]))


def channel_names(tags: dict[int, tuple]) -> list[str]:
    """Names of the channels in an image description of the OME kind; others name none."""
    text = (tags.get(DESCRIPTION) or (b"",))[0].decode("utf-8", "replace")
    return re.findall(r"<Channel\b[^>]*\bName=\"([^\"]*)\"", text)


def _layout(tags: dict[int, tuple]) -> tuple[int, int] | None:
    """Bands and bits of what decode_region reads: chunky, unsigned, 8 or 16 bits, plain, deflated or LZW."""
    bits = tags.get(BITS, (1,))
    known = WIDTH in tags and HEIGHT in tags and tags.get(PLANAR, (1,))[0] == 1 and bits[0] in (8, 16) and len(set(bits)) == 1
    known = known and tags.get(COMPRESSION, (1,))[0] in (1, 5, 8, 32946) and tags.get(PREDICTOR, (1,))[0] in (1, 2) and tags.get(SAMPLE_FORMAT, (1,))[0] == 1
    return (tags.get(SAMPLES, (1,))[0], bits[0]) if known else None


def header(tags: dict[int, tuple]) -> tuple:
    """A row of HEADER. Dimensions are null where a file is no image; bands and bits where its pixels are not read here."""
    size = [tags[t][0] if tags.get(t) else None for t in (WIDTH, HEIGHT)]
    if None in size:
        size = [None, None]
    layout = _layout(tags)
    most = tags.get(MAX_SAMPLE)
    rgb = layout is not None and layout[0] == 3 and tags.get(PHOTOMETRIC, (1,))[0] == 2
    return (*(ratio(tags, t) for t in (X_RES, Y_RES, X_POS, Y_POS)), *size, *(layout or (None, None)), rgb if layout else None, float(max(most)) if most else None, channel_names(tags))


def with_header_columns(files: DataFrame) -> DataFrame:
    """Adds the columns of HEADER to files (path, ...). A task reads the ranges that hold the tags, no pixels, and nothing is
    joined. Files that are gone or no image have null dimensions (S6, S7)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                tags: dict[int, tuple] | None = None
                try:
                    store, at = split(path)
                    with store.open_input_file(at) as f:
                        tags = read_tags(lambda begin, n: f.read_at(n, begin), HEADER_TAGS)
                except OSError:
                    pass
                rows.append(header(tags or {}))
            columns = list(zip(*rows, strict=True)) if rows else [[] for _ in _HEADER_KINDS]
            names = [c.split()[0] for c in HEADER.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(list(c), k) for c, k in zip(columns, _HEADER_KINDS, strict=True))], names=[*batch.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema)
    return files.mapInArrow(run, f"{fields}, {HEADER}")


class Tile:
    """An image whose strips or tiles are read when they are asked for; a context that closes its file."""

    def __init__(self, read: Read, close: Callable[[], None] = lambda: None, tags: dict[int, tuple] | None = None):
        self.read, self.close = read, close
        self.tags = tags or read_tags(read) or {}
        self.layout = _layout(self.tags)
        self.width, self.height = (self.tags.get(t, (0,))[0] for t in (WIDTH, HEIGHT))
        self.held: tuple[int, np.ndarray] | None = None
        self.big_endian = read(0, 2) == b"MM"

    def __enter__(self) -> Tile:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def block(self, i: int, width: int, rows: int) -> np.ndarray:
        """Strip or tile number i, rows of width pixels; the last one is kept, as a strip may be the whole image."""
        if self.held is not None and self.held[0] == i:
            return self.held[1]
        tiled = TILE_OFFSETS in self.tags
        at, n = (self.tags[t][i] for t in ((TILE_OFFSETS, TILE_COUNTS) if tiled else (OFFSETS, COUNTS)))
        bands, bits = self.layout
        kind = np.dtype("u1") if bits == 8 else np.dtype(">u2" if self.big_endian else "<u2")
        codec, raw = self.tags.get(COMPRESSION, (1,))[0], self.read(at, n)
        data = np.frombuffer(raw if codec == 1 else lzw_decode(raw) if codec == 5 else zlib.decompress(raw), kind)
        data = data[: rows * width * bands].reshape(rows, width, bands).astype(kind.newbyteorder("="))
        if self.tags.get(PREDICTOR, (1,))[0] == 2 and codec != 1:
            data = np.cumsum(data, 1, dtype=data.dtype)
        self.held = (i, data)
        return data


def open_tile(path: str) -> Tile | None:
    """The image at a path, or None if it is gone, no image, or of a kind that is not read."""
    try:
        store, at = split(path)
        f = store.open_input_file(at)
    except OSError:
        return None
    tile = Tile(lambda begin, n: f.read_at(n, begin), f.close)
    if tile.layout is None:
        f.close()
        return None
    return tile


def decode_region(tile: Tile, y1: int, y2: int) -> np.ndarray | None:
    """Rows y1 to y2 - 1 of an image as rows, columns, bands; only the strips or tiles that hold them are read. None for
    damaged ones."""
    tags, (bands, bits) = tile.tags, tile.layout
    tiled = TILE_OFFSETS in tags
    try:
        tw, th = (tags[TILE_W][0], tags[TILE_H][0]) if tiled else (tile.width, min(tile.height, tags.get(ROWS, (tile.height,))[0]))
        across = -(-tile.width // tw)
        out = np.zeros((y2 - y1, tile.width, bands), np.uint8 if bits == 8 else np.uint16)
        for row in range(y1 // th, (y2 - 1) // th + 1):
            top = row * th
            for column in range(across):
                data = tile.block(row * across + column, tw, th if tiled else min(th, tile.height - top))
                a, b, x = max(y1, top), min(y2, top + len(data)), column * tw
                out[a - y1 : b - y1, x : x + tw] = data[a - top : b - top, : tile.width - x]
        return out
    except (KeyError, IndexError, ValueError, OSError, zlib.error):
        return None


def decode(raw: bytes) -> np.ndarray | None:
    """All pixels of an image in memory. None for what is not read."""
    tile = Tile(_reader(raw))
    return None if tile.layout is None else decode_region(tile, 0, tile.height)


def read_image(path: str, level: int = 0) -> np.ndarray | None:
    """A level of a pyramid, all of it: the first image, or the level-th one behind it. None for what is not read."""
    store, at = split(path)
    with store.open_input_file(at) as f:
        return _image(lambda begin, n: f.read_at(n, begin), level)


def _image(read: Read, number: int) -> np.ndarray | None:
    tags = next(islice(directories(read), number, None), None)
    tile = Tile(read, tags=tags) if tags else None
    return None if tile is None or tile.layout is None else decode_region(tile, 0, tile.height)


def associated_images(path: str) -> dict[str, int]:
    """Images of a file that are neither its first nor a smaller one of it, by name (S12): the first line of their
    description, or image and a number. The number is what read_image takes."""
    store, at = split(path)
    out: dict[str, int] = {}
    with store.open_input_file(at) as f:
        for i, tags in enumerate(directories(lambda begin, n: f.read_at(n, begin), HEADER_TAGS | {SUBFILE})):
            if i and not tags.get(SUBFILE, (0,))[0] & 1:
                name = (tags.get(DESCRIPTION) or (b"",))[0].decode("utf-8", "replace").strip("\0").split("\n")[0].strip()
                out.setdefault(name or f"image {i}", i)
    return out


def encode(pixels: np.ndarray, x_res: tuple[int, int] | None = None, y_res: tuple[int, int] | None = None, x_pos: tuple[int, int] | None = None, y_pos: tuple[int, int] | None = None, description: str | None = None, max_value: int | None = None) -> bytes:
    """A plain one-strip TIFF of rows, columns, bands, with position tags, a description and a maximum if given."""
    pixels = pixels if pixels.ndim == 3 else pixels[:, :, None]
    h, w, bands = pixels.shape
    body = pixels.astype(pixels.dtype.newbyteorder("<")).tobytes()
    entries: list[tuple[int, int, tuple]] = [(WIDTH, 4, (w,)), (HEIGHT, 4, (h,)), (BITS, 3, (8 * pixels.itemsize,) * bands), (COMPRESSION, 3, (1,)), (PHOTOMETRIC, 3, (2 if bands == 3 else 1,)), (OFFSETS, 4, (8,)), (SAMPLES, 3, (bands,)), (ROWS, 4, (h,)), (COUNTS, 4, (len(body),))]
    entries += [(t, 5, v) for t, v in ((X_RES, x_res), (Y_RES, y_res), (X_POS, x_pos), (Y_POS, y_pos)) if v]
    entries += [(DESCRIPTION, 2, (description.encode() + b"\0",))] if description is not None else []
    entries += [(MAX_SAMPLE, 3, (max_value,) * bands)] if max_value is not None else []
    return struct.pack("<2sHI", b"II", 42, 8 + len(body)) + body + directory(entries, 8 + len(body), 0)


def directory(entries: list[tuple[int, int, tuple]], at: int, following: int, big: bool = False) -> bytes:
    """An image file directory at place at, its longer values behind it; following is the place of the next one."""
    place, count, inline = ("Q", "Q", 8) if big else ("I", "H", 4)
    entries = sorted(entries, key=lambda e: e[0])
    extra_at = at + struct.calcsize(f"={count}") + (4 + 2 * inline) * len(entries) + inline
    head, extra = struct.pack(f"<{count}", len(entries)), b""
    for tag, kind, value in entries:
        data = value[0] if kind == 2 else struct.pack(f"<{len(value)}{TYPES[kind][0]}", *value)
        n = len(data) if kind == 2 else len(value) // len(TYPES[kind])
        head += struct.pack(f"<HH{place}", tag, kind, n)
        if len(data) > inline:
            head += struct.pack(f"<{place}", extra_at + len(extra))
            extra += data + b"\0" * (len(data) % 2)
        else:
            head += data.ljust(inline, b"\0")
    return head + struct.pack(f"<{place}", following) + extra


def directory_size(entries: list[tuple[int, int, tuple]], big: bool = False) -> int:
    return len(directory(entries, 0, 0, big))
