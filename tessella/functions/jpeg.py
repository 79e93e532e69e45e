"""A baseline JPEG encoder: 8-bit grey or colour, no subsampling, Huffman codes made for each image."""

from __future__ import annotations

import heapq
import struct

import numpy as np

#: Fixed values of the format: the usual quantisation of brightness and of colour, row by row, at quality 50.
LUMA = (
    (16, 11, 10, 16, 24, 40, 51, 61),
    (12, 12, 14, 19, 26, 58, 60, 55),
    (14, 13, 16, 24, 40, 57, 69, 56),
    (14, 17, 22, 29, 51, 87, 80, 62),
    (18, 22, 37, 56, 68, 109, 103, 77),
    (24, 35, 55, 64, 81, 104, 113, 92),
    (49, 64, 78, 87, 103, 121, 120, 101),
    (72, 92, 95, 98, 112, 100, 103, 99),
)
CHROMA = ((17, 18, 24, 47), (18, 21, 26, 66), (24, 26, 56, 99), (47, 66, 99, 99))
FILL = 99  # of the rest of CHROMA
END_OF_BLOCK, SIXTEEN_ZEROS = 0x00, 0xF0
LONGEST_CODE = 16

_u, _x = np.meshgrid(np.arange(8), np.arange(8), indexing="ij")
_COSINES = np.where(_u == 0, np.sqrt(0.125), 0.5 * np.cos((2 * _x + 1) * _u * np.pi / 16))
#: Places of a block by ascending diagonals, in turn downwards and upwards.
_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))


def _quantisers(quality: int) -> list[np.ndarray]:
    chroma = np.full((8, 8), FILL)
    chroma[:4, :4] = CHROMA
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMA, chroma)]


def code_lengths(counts: np.ndarray) -> np.ndarray:
    """Lengths of a Huffman code for 256 symbols, 0 for those that do not occur; none longer than LONGEST_CODE, and no code
    of ones only, which the format keeps free."""
    heap = [(int(n), i, (i,)) for i, n in enumerate(counts) if n] + [(0, 256, (256,))]  # the last takes the ones
    heapq.heapify(heap)
    length = np.zeros(257, np.int64)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        both = a[2] + b[2]
        length[list(both)] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), both))
    per = np.bincount(length[length > 0], minlength=LONGEST_CODE + 1).tolist()
    for n in range(len(per) - 1, LONGEST_CODE, -1):  # two of the longest make room by a shorter one growing
        while per[n]:
            shorter = max(j for j in range(1, n - 1) if per[j])
            per[n] -= 2
            per[n - 1] += 1
            per[shorter + 1] += 2
            per[shorter] -= 1
    order = sorted(np.flatnonzero(length).tolist(), key=lambda i: (length[i], i == 256, i))
    out = np.zeros(257, np.int64)
    out[order] = np.repeat(np.arange(len(per)), per)
    return out[:256]


def _codes(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The codes of symbols by their lengths, and the symbols in the order of their codes."""
    order = np.array(sorted(np.flatnonzero(length).tolist(), key=lambda i: (length[i], i)), np.int64)
    codes, code, last = np.zeros(256, np.int64), -1, 0
    for s in order.tolist():
        code = (code + 1) << (int(length[s]) - last)
        codes[s], last = code, int(length[s])
    return codes, order


def _packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """Numbers of 1 to 32 bits one behind the other, filled up with ones."""
    total = int(widths.sum())
    values, widths = np.append(values, (1 << (-total % 8)) - 1), np.append(widths, -total % 8)
    values, widths = values[widths > 0].astype(np.uint64), widths[widths > 0]
    place = np.cumsum(widths) - widths
    word = place >> 5
    wide = values << (64 - (place & 31) - widths).astype(np.uint64)
    runs = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(-(-total // 32) + 2, np.uint64)
    out[word[runs]] = np.bitwise_or.reduceat(wide >> np.uint64(32), runs)
    out[word[runs] + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), runs)
    return out.astype(">u4").tobytes()[: -(-total // 8)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _bits(v: np.ndarray) -> np.ndarray:
    return np.frexp(np.abs(v).astype(np.float64))[1].astype(np.int64)


def jpeg_encode(pixels: np.ndarray, quality: int = 90) -> bytes:
    """Rows, columns, bands as a whole stream: one band grey, three as brightness and two differences of colour. Edges are
    multiples of 8. Raises ValueError for other images."""
    h, w, bands = pixels.shape
    if pixels.dtype.itemsize != 1 or bands not in (1, 3) or h % 8 or w % 8:
        raise ValueError("JPEG holds one or three bands of 8 bits")
    x = pixels.astype(np.float64)
    if bands == 3:
        r, g, b = (x[:, :, i] for i in range(3))
        light = 0.299 * r + 0.587 * g + 0.114 * b
        x = np.stack([light, (b - light) / 1.772 + 128, (r - light) / 1.402 + 128], 2)
    blocks = np.rint(x).clip(0, 255).reshape(h // 8, 8, w // 8, 8, bands).transpose(0, 2, 4, 1, 3).reshape(-1, bands, 8, 8) - 128
    tables = _quantisers(quality)
    waves = _COSINES @ blocks @ _COSINES.T
    levels = np.stack([np.rint(waves[:, i] / tables[min(i, 1)]) for i in range(bands)], 1).astype(np.int64).reshape(-1, 64)[:, _ZIGZAG]
    n, component = len(levels), np.tile(np.arange(bands), len(blocks))
    first = levels[:, 0].reshape(-1, bands)
    levels[:, 0] = np.diff(first, axis=0, prepend=np.zeros((1, bands), np.int64)).ravel()

    # Symbols: (place in the stream, symbol, value, is it the first of a block).
    block, at = np.nonzero(levels[:, 1:])
    value = levels[:, 1:][block, at]
    new = np.concatenate([[True], block[1:] != block[:-1]]) if len(block) else np.zeros(0, bool)
    run = at - np.where(new, -1, np.concatenate([[0], at[:-1]])[: len(at)]) - 1
    long = np.repeat(np.arange(len(at)), run // 16)
    last = np.full(n, -1)
    last[block] = at
    short = np.flatnonzero(last < 62)
    key = np.concatenate([np.arange(n) * 256, block[long] * 256 + 2 * at[long] + 1, block * 256 + 2 * at + 2, short * 256 + 255])
    symbol = np.concatenate([_bits(levels[:, 0]), np.full(len(long), SIXTEEN_ZEROS), (run % 16) << 4 | _bits(value), np.full(len(short), END_OF_BLOCK)])
    number = np.concatenate([levels[:, 0], np.zeros(len(long), np.int64), value, np.zeros(len(short), np.int64)])
    order = np.argsort(key, kind="stable")
    key, symbol, number = key[order], symbol[order], number[order]
    kind = 2 * np.minimum(component[key >> 8], 1) + (key & 255 > 0)  # tables: first and others, of brightness and colour

    size = _bits(number)
    extra = np.where(number < 0, number + (1 << size) - 1, number)
    codes, width, huffman = np.zeros(len(key), np.int64), np.zeros(len(key), np.int64), b""
    for k in range(4 if bands == 3 else 2):
        mine = kind == k
        length = code_lengths(np.bincount(symbol[mine], minlength=256))
        code, symbols = _codes(length)
        codes[mine], width[mine] = code[symbol[mine]], length[symbol[mine]]
        per = np.bincount(length[length > 0], minlength=LONGEST_CODE + 1)[1:]
        huffman += _segment(0xC4, bytes([(k & 1) << 4 | k >> 1]) + per.astype(np.uint8).tobytes() + symbols.astype(np.uint8).tobytes())
    data = _packed(codes << size | extra, width + size).replace(b"\xff", b"\xff\x00")
    quantisers = b"".join(_segment(0xDB, bytes([i]) + t.ravel()[_ZIGZAG].astype(np.uint8).tobytes()) for i, t in enumerate(tables[: min(bands, 2)]))
    frame = _segment(0xC0, struct.pack(">BHHB", 8, h, w, bands) + b"".join(bytes([i + 1, 0x11, min(i, 1)]) for i in range(bands)))
    scan = _segment(0xDA, bytes([bands]) + b"".join(bytes([i + 1, 0x11 * min(i, 1)]) for i in range(bands)) + bytes([0, 63, 0]))
    return b"\xff\xd8" + quantisers + frame + huffman + scan + data + b"\xff\xd9"
