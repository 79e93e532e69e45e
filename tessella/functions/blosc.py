"""The first Blosc container: a header, the place of each block, and blocks whose bytes may be shuffled by significance."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa

#: Fixed values of the format: numbers of the codecs, and bits of the flags.
FORMATS = {"blosclz": 0, "lz4": 1, "lz4hc": 1, "zlib": 3, "zstd": 4}
SHUFFLED, COPIED, WHOLE_BLOCKS = 0x01, 0x02, 0x10
VERSION, CODEC_VERSION, HEAD = 2, 1, 16
BLOCK = 1 << 18


def _squeeze(raw: bytes, codec: str, level: int) -> bytes:
    """raw in the codec's own format. For blosclz no encoder is at hand: its blocks are stored as they are, which its
    readers accept; lz4hc differs from lz4 in effort only."""
    if codec == "zlib":
        return zlib.compress(raw, level)
    if codec == "zstd":
        return pa.Codec("zstd", level).compress(raw, asbytes=True)
    return raw if codec == "blosclz" else pa.Codec("lz4_raw").compress(raw, asbytes=True)


def blosc_encode(raw: bytes, codec: str, level: int = 5, size: int = 1) -> bytes:
    """raw, whole items of size bytes, in blocks; blocks that do not shrink are stored."""
    flags = FORMATS[codec] << 5 | WHOLE_BLOCKS | (SHUFFLED if size > 1 else 0)
    block = max(size, min(len(raw), BLOCK) // size * size)
    parts, at, starts = [], HEAD + 4 * -(-len(raw) // block), []
    for begin in range(0, len(raw), block):
        plain = raw[begin : begin + block]
        if size > 1:
            plain = np.frombuffer(plain, np.uint8).reshape(-1, size).T.tobytes()
        packed = _squeeze(plain, codec, level)
        packed = plain if len(packed) >= len(plain) else packed
        starts.append(at)
        parts.append(struct.pack("<i", len(packed)) + packed)
        at += 4 + len(packed)
    return struct.pack("<BBBBIII", VERSION, CODEC_VERSION, flags, size, len(raw), block, at) + struct.pack(f"<{len(starts)}i", *starts) + b"".join(parts)


def blosc_decode(stored: bytes) -> bytes:
    """The bytes of a container whose blocks are whole, as blosc_encode writes them, or copied. Raises ValueError for others."""
    if len(stored) < HEAD:
        raise ValueError("no container")
    version, _, flags, size, n, block, total = struct.unpack("<BBBBIII", stored[:HEAD])
    if version != VERSION or total != len(stored):
        raise ValueError("not a whole container of this version")
    if flags & COPIED:
        return stored[HEAD : HEAD + n]
    if not flags & WHOLE_BLOCKS:
        raise ValueError("blocks are split")
    out = []
    for i in range(-(-n // block) if n else 0):
        (at,) = struct.unpack("<i", stored[HEAD + 4 * i : HEAD + 4 * i + 4])
        (packed,) = struct.unpack("<i", stored[at : at + 4])
        want, data = min(block, n - i * block), stored[at + 4 : at + 4 + packed]
        if packed != want:
            kind = flags >> 5
            if kind == FORMATS["zlib"]:
                data = zlib.decompress(data)
            elif kind in (FORMATS["lz4"], FORMATS["zstd"]):
                data = pa.Codec("lz4_raw" if kind == 1 else "zstd").decompress(data, want, asbytes=True)
            else:
                raise ValueError(f"no decoder for format {kind}")
        if flags & SHUFFLED and size > 1:
            data = np.frombuffer(data, np.uint8).reshape(size, -1).T.tobytes()
        out.append(data)
    return b"".join(out)
