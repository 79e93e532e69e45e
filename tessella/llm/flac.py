"""FLAC streams of 8-bit samples: a vectorised encoder, a decoder that verifies every checksum, and seekable PCM blocks.

The encoder writes one channel, blocks of equal size, and for each block the cheapest of a constant, verbatim samples,
a fixed predictor of order 0 to 4, or a linear predictor of order LPC_ORDER, with Rice-coded residuals. The decoder
reads all of these, and partitioned and escaped residuals as well. Both work on many frames at a time: each frame is a
lane, and all lanes take a step together.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, id_type, lean, ship, stash
from .textkit import slices

BLOCK = 2048
LPC_ORDER, PRECISION = 8, 12
RATE = 8000
#: Fixed values of the format: the marker, polynomials of the checksums, the sync code, fixed predictors by order.
MARKER = b"fLaC"
CRC8_POLY, CRC16_POLY = 0x07, 0x8005
SYNC = 0x3FFE
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
RATE_CODES = {8000: 4, 16000: 5, 22050: 6, 24000: 7, 32000: 8, 44100: 9, 48000: 10, 96000: 11}
BLOCK_CODES = {1: 192, 2: 576, 3: 1152, 4: 2304, 5: 4608, **{c: 1 << c for c in range(8, 16)}}
SEEK_PLACEHOLDER = (1 << 64) - 1


def _crc_table(poly: int, bits: int) -> np.ndarray:
    out = np.zeros(256, np.int64)
    for byte in range(256):
        c = byte << (bits - 8)
        for _ in range(8):
            c = (c << 1 ^ (poly if c >> (bits - 1) & 1 else 0)) & ((1 << bits) - 1)
        out[byte] = c
    return out


_CRC8, _CRC16 = _crc_table(CRC8_POLY, 8), _crc_table(CRC16_POLY, 16)


def crc_lanes(data: np.ndarray, begin: np.ndarray, size: np.ndarray, table: np.ndarray, bits: int) -> np.ndarray:
    """The checksum of each range of bytes, all ranges at a time."""
    order = np.argsort(-size, kind="stable")
    at, left = begin[order], size[order]
    c = np.zeros(len(at), np.int64)
    mask = (1 << bits) - 1
    alive = len(at)
    for step in range(int(left[0]) if len(left) else 0):
        if left[alive - 1] <= step:
            alive = int(np.searchsorted(-left, -step, "left"))
        head = c[:alive]
        c[:alive] = (head << 8 & mask) ^ table[(head >> (bits - 8)) ^ data[at[:alive] + step]]
    out = np.empty_like(c)
    out[order] = c
    return out


def coded_number(n: int) -> bytes:
    """A frame's number in the variable form of the format (that of UTF-8, up to 36 bits)."""
    if n < 0x80:
        return bytes([n])
    tail = []
    limit = 0x20
    while n >= limit * 2 or not tail:
        tail.append(n & 0x3F | 0x80)
        n >>= 6
        if n < limit:
            break
        limit >>= 1
    return bytes([(0xFF00 >> (len(tail) + 1)) & 0xFF | n, *reversed(tail)])


def pack_bits(values: np.ndarray, widths: np.ndarray) -> list[bytes]:
    """Each row's values, of 1 to 32 bits each, one behind the other, padded with 0 to whole bytes.

    Every value falls into one or two 32-bit words; the words are put together by or over runs of equal places.
    """
    total = widths.sum(1)
    words = -(-total // 32)
    first = np.cumsum(words) - words
    place = (np.cumsum(widths, axis=1) - widths + (first * 32)[:, None]).ravel()
    word = place >> 5
    wide = values.astype(np.uint64).ravel() << (64 - (place & 31) - widths.ravel()).astype(np.uint64)
    runs = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    out = np.zeros(int(words.sum()) + 1, np.uint64)
    at = word[runs]
    out[at] = np.bitwise_or.reduceat(wide >> np.uint64(32), runs)
    out[at + 1] |= np.bitwise_or.reduceat(wide & np.uint64(0xFFFFFFFF), runs)
    raw = out.astype(">u4").tobytes()
    return [raw[4 * f : 4 * f + n] for f, n in zip(first.tolist(), (-(-total // 8)).tolist(), strict=True)]


def _linear(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Quantised coefficients of order LPC_ORDER, by the Levinson recursion, and the shift of each frame. Every step is
    exact or element by element, so that equal frames give equal coefficients whatever they are encoded with."""
    n, size = x.shape
    auto = np.stack([(x[:, : size - lag] * x[:, lag:]).sum(1, dtype=np.int64) for lag in range(LPC_ORDER + 1)], 1).astype(np.float64)
    a = np.zeros((n, LPC_ORDER))
    error = auto[:, 0] + 1e-9
    for i in range(LPC_ORDER):
        acc = auto[:, i + 1].copy()
        for j in range(i):
            acc -= a[:, j] * auto[:, i - j]
        k = acc / np.maximum(error, 1e-9)
        before = a.copy()
        a[:, i] = k
        for j in range(i):
            a[:, j] = before[:, j] - k * before[:, i - 1 - j]
        error = error * (1 - k * k)
    top = np.abs(a).max(1)
    shift = np.clip(PRECISION - 2 - np.ceil(np.log2(np.maximum(top, 1e-9))).astype(np.int64), 0, 14)
    limit = (1 << (PRECISION - 1)) - 1
    return np.clip(np.rint(a * (1 << shift)[:, None]), -limit, limit).astype(np.int32), shift.astype(np.int32)


def _rough_bits(residuals: np.ndarray) -> np.ndarray:
    """About how many bits the Rice codes of residuals take, from the sum of their sizes."""
    folded = 2 * np.abs(residuals).sum(1, dtype=np.int64)
    n = residuals.shape[1]
    k = np.log2(np.maximum(folded / max(n, 1), 1)).astype(np.int64)
    return n * (1 + k) + (folded >> k)


def _rice(residuals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded residuals and the best Rice parameter near the logarithm of their mean; so large that no code has more
    than 16 leading zeros."""
    u = (residuals << 1) ^ (residuals >> 31)
    most = u.max(1)
    least = np.maximum(0, np.ceil(np.log2((most + 1) / 16.0)).astype(np.int32))
    middle = np.log2(np.maximum(u.mean(1), 1)).astype(np.int32)
    best, bits = least.copy(), np.full(len(u), np.iinfo(np.int64).max)
    for near in (-1, 0, 1):
        k = np.clip(np.maximum(middle + near, least), 0, 14)
        cost = (u >> k[:, None]).sum(1, dtype=np.int64) + u.shape[1] * (1 + k)
        better = cost < bits
        best[better], bits[better] = k[better], cost[better]
    return u, best


def encode_frames(samples: np.ndarray, numbers: np.ndarray) -> list[bytes]:
    """The frames of blocks of one size, rows of samples from -128 to 127, without the checksum behind them."""
    n, size = samples.shape
    x = samples.astype(np.int32)
    kinds = np.ones(n, np.int64)  # 0 constant, 1 verbatim, 8 + order fixed, 31 + order linear: the codes of the format
    cost = np.full(n, 8 * size)
    difference = x
    for order in range(min(5, size)):
        if order:
            difference = np.diff(difference, axis=1)
        bits = _rough_bits(difference) + 8 * order + 10
        better = bits < cost
        kinds[better], cost[better] = 8 + order, bits[better]
    if size > 4 * LPC_ORDER:
        coefficients, shift = _linear(x)
        guess = coefficients[:, :1] * x[:, LPC_ORDER - 1 : size - 1]
        for j in range(1, LPC_ORDER):
            guess += coefficients[:, j : j + 1] * x[:, LPC_ORDER - 1 - j : size - 1 - j]
        predicted = x[:, LPC_ORDER:] - (guess >> shift[:, None])
        bits = _rough_bits(predicted) + 8 * LPC_ORDER + 9 + PRECISION * LPC_ORDER + 10
        better = bits < cost
        kinds[better], cost[better] = 31 + LPC_ORDER, bits[better]
    kinds[(x == x[:, :1]).all(1)] = 0

    bodies: list[bytes] = [b""] * n
    for kind in np.unique(kinds).tolist():
        mine = np.flatnonzero(kinds == kind)
        m = len(mine)
        values, widths = [np.full((m, 1), kind << 1)], [np.full((m, 1), 8)]

        def field(v: np.ndarray, w: int, values: list = values, widths: list = widths) -> None:
            values.append(v & ((1 << w) - 1))
            widths.append(np.full(v.shape, w))

        if kind <= 1:
            field(x[mine][:, : size if kind else 1], 8)
        else:
            order = kind - 8 if kind < 32 else kind - 31
            if order:
                field(x[mine][:, :order], 8)
            if kind >= 32:
                field(np.full((m, 1), PRECISION - 1), 4)
                field(shift[mine][:, None], 5)
                field(coefficients[mine], PRECISION)
            u, k = _rice(predicted[mine] if kind >= 32 else np.diff(x[mine], n=order, axis=1))
            field(k[:, None], 10)  # method 0, partition order 0, parameter
            values.append((u & ((1 << k) - 1)[:, None]) | (1 << k)[:, None])
            widths.append((u >> k[:, None]) + (1 + k)[:, None])
        for i, body in zip(mine.tolist(), pack_bits(np.concatenate(values, 1), np.concatenate(widths, 1).astype(np.int64)), strict=True):
            bodies[i] = body
    whole = []
    for i, body in zip(numbers.tolist(), bodies, strict=True):
        head = bytes([SYNC >> 6, SYNC << 2 & 0xFF, 0x70 | RATE_CODES[RATE], 1 << 1]) + coded_number(i) + (size - 1).to_bytes(2, "big")
        c = 0
        for b in head:
            c = int(_CRC8[c ^ b])
        whole.append(head + bytes([c]) + body)
    return whole


def encode_streams(payloads: list[bytes], block: int = BLOCK, seek_every: int = 1) -> list[bytes]:
    """A FLAC stream for each payload, a byte b as the sample b - 128, with a seek point for every seek_every blocks: as
    many lanes can be decoded at a time as there are seek points."""
    data = np.frombuffer(b"".join(payloads), np.uint8).astype(np.int16) - 128
    owner, begin, long = [], [], []
    at = 0
    for i, p in enumerate(payloads):
        for b in range(0, len(p), block):
            owner.append(i)
            begin.append(at + b)
            long.append(min(block, len(p) - b))
        at += len(p)
    owner_, begin_, long_ = (np.array(v, np.int64) for v in (owner, begin, long))
    number = np.arange(len(owner_)) - np.searchsorted(owner_, owner_)
    frames: list[bytes] = [b""] * len(owner_)
    for size in np.unique(long_).tolist():
        mine = np.flatnonzero(long_ == size)
        for part in np.array_split(mine, -(-len(mine) * size // (1 << 20))):
            for i, f in zip(part.tolist(), encode_frames(data[begin_[part][:, None] + np.arange(size)], number[part]), strict=True):
                frames[i] = f
    size_ = np.array([len(f) for f in frames], np.int64)
    crc = crc_lanes(np.frombuffer(b"".join(frames), np.uint8), np.cumsum(size_) - size_, size_, _CRC16, 16)
    frames = [f + c.to_bytes(2, "big") for f, c in zip(frames, crc.tolist(), strict=True)]
    first = np.searchsorted(owner_, np.arange(len(payloads) + 1))
    out = []
    for i, p in enumerate(payloads):
        own = frames[first[i] : first[i + 1]]
        sizes = [len(f) for f in own]
        signed = (np.frombuffer(p, np.uint8) ^ 0x80).tobytes()  # the checksum is over signed samples
        info = block.to_bytes(2, "big") * 2 + min(sizes, default=0).to_bytes(3, "big") + max(sizes, default=0).to_bytes(3, "big")
        info += (RATE << 44 | 0 << 41 | 7 << 36 | len(p)).to_bytes(8, "big") + hashlib.md5(signed).digest()
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        points = b"".join((b * block).to_bytes(8, "big") + int(offsets[b]).to_bytes(8, "big") + min(block, len(p) - b * block).to_bytes(2, "big") for b in range(0, len(own), seek_every))
        head = MARKER + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points
        out.append(head + b"".join(own))
    return out


class CorruptStream(ValueError):
    """A marker, header or checksum is not what it must be."""


def read_header(stream: bytes) -> dict:
    """The stream's properties, its seek points (sample, offset, samples) and where its frames begin."""
    if stream[:4] != MARKER:
        raise CorruptStream("no marker")
    at, last, out = 4, False, {"seek": []}
    while not last:
        last, kind, size = stream[at] >> 7 == 1, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            packed = int.from_bytes(body[10:18], "big")
            out |= {"block": int.from_bytes(body[2:4], "big"), "rate": packed >> 44, "channels": (packed >> 41 & 7) + 1, "bits": (packed >> 36 & 31) + 1, "samples": packed & (1 << 36) - 1, "md5": body[18:34]}
        elif kind == 3:
            for p in range(0, size, 18):
                sample = int.from_bytes(body[p : p + 8], "big")
                if sample != SEEK_PLACEHOLDER:
                    out["seek"].append((sample, int.from_bytes(body[p + 8 : p + 16], "big"), int.from_bytes(body[p + 16 : p + 18], "big")))
        at += 4 + size
    if "block" not in out:
        raise CorruptStream("no stream info")
    return out | {"frames": at}


class _Reader:
    """Reads bits for many lanes at once, most significant first, from places in one buffer."""

    def __init__(self, words: np.ndarray, at: np.ndarray):
        self.words = words
        self.bit = at.astype(np.int64) * 8

    @staticmethod
    def look_ahead(data: np.ndarray) -> np.ndarray:
        """Eight bytes from every place on, as one number."""
        padded = np.concatenate([data, np.zeros(16, np.uint8)])
        words = np.zeros(len(data) + 8, np.uint64)
        for j in range(8):
            words |= padded[j : j + len(words)].astype(np.uint64) << np.uint64(56 - 8 * j)
        return words

    def peek(self, lanes: np.ndarray) -> np.ndarray:
        """57 valid bits at least, from the top."""
        bit = self.bit[lanes]
        return self.words[bit >> 3] << (bit & 7).astype(np.uint64)

    def take(self, lanes: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        """Unsigned numbers of up to 32 bits."""
        w = np.broadcast_to(np.asarray(width, np.int64), lanes.shape)
        top = self.peek(lanes)
        self.bit[lanes] += w
        return np.where(w > 0, top >> (np.uint64(64) - np.maximum(w, 1).astype(np.uint64)), 0).astype(np.int64)

    def signed(self, lanes: np.ndarray, width: np.ndarray | int) -> np.ndarray:
        w = np.broadcast_to(np.asarray(width, np.int64), lanes.shape)
        v = self.take(lanes, w)
        return np.where(w > 0, v - ((v >> np.maximum(w - 1, 0) & 1) << w), 0)

    def unary(self, lanes: np.ndarray) -> np.ndarray:
        """Zeros up to the next one."""
        out = np.zeros(len(lanes), np.int64)
        todo = np.arange(len(lanes))
        while len(todo):
            if (self.bit[lanes[todo]] >> 3 >= len(self.words) - 8).any():
                raise CorruptStream("a code does not end")
            zeros = _ZEROS[self.peek(lanes[todo]) >> np.uint64(48)]
            found = zeros < 16
            out[todo] += zeros
            self.bit[lanes[todo]] += zeros + found
            todo = todo[~found]
        return out


#: Leading zeros of 16 bits.
_ZEROS = 16 - np.frexp(np.arange(1 << 16).astype(np.float64))[1].astype(np.int64)
_ZEROS_U = _ZEROS.astype(np.uint64)


def _frame_starts(streams: list[bytes], heads: list[dict]) -> None:
    """Checks that seek points lie within the frames."""
    for s, h in zip(streams, heads, strict=True):
        for _, offset, _ in h["seek"]:
            if h["frames"] + offset >= len(s) and h["samples"]:
                raise CorruptStream("a seek point lies behind the end")


def decode_streams(streams: list[bytes]) -> list[bytes]:
    """The payloads of streams; raises CorruptStream where a header, frame or whole checksum is wrong.

    Frames are found one behind the other, the k-th of all streams at a time, starting from every seek point at once.
    """
    heads = [read_header(s) for s in streams]
    _frame_starts(streams, heads)
    base = np.concatenate([[0], np.cumsum([len(s) for s in streams])]).astype(np.int64)
    data = np.frombuffer(b"".join(streams), np.uint8)
    sample_base = np.concatenate([[0], np.cumsum([h["samples"] for h in heads])]).astype(np.int64)
    out = np.zeros(int(sample_base[-1]), np.int16)
    # Chains of frames: from a seek point up to the next, or the end of the samples.
    chain_at, chain_sample, chain_end, chain_block, chain_first = [], [], [], [], []
    for i, h in enumerate(heads):
        if h["bits"] != 8 or h["channels"] != 1:
            raise CorruptStream("one channel of 8 bits is read")
        points = [(s, o) for s, o, _ in h["seek"]] or [(0, 0)]
        if points[0][0] != 0:
            points.insert(0, (0, 0))
        for (s, o), nxt in zip(points, [*[p[0] for p in points[1:]], h["samples"]], strict=True):
            if s < h["samples"]:
                chain_at.append(base[i] + h["frames"] + o)
                chain_sample.append(sample_base[i] + s)
                chain_end.append(sample_base[i] + nxt)
                chain_block.append(h["block"])
                chain_first.append(sample_base[i])
    at, sample, end, block, first = (np.array(v, np.int64) for v in (chain_at, chain_sample, chain_end, chain_block, chain_first))
    words = _Reader.look_ahead(data)
    while len(at):
        size, length = _decode_frames(data, words, at, sample - first, block, end - sample, out, sample)
        at, sample = at + length, sample + size
        if (sample > end).any():
            raise CorruptStream("blocks overlap")
        go = sample < end
        at, sample, end, block, first = at[go], sample[go], end[go], block[go], first[go]
    payload = (out + 128).astype(np.uint8)
    found = []
    for i, h in enumerate(heads):
        own = payload[sample_base[i] : sample_base[i + 1]]
        if hashlib.md5((own ^ 0x80).tobytes()).digest() != h["md5"]:
            raise CorruptStream("the checksum of the samples is wrong")
        found.append(own.tobytes())
    return found


def _decode_frames(data: np.ndarray, words: np.ndarray, at: np.ndarray, sample: np.ndarray, block: np.ndarray, room: np.ndarray, out: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Decodes a frame at each place into out; gives the samples and the bytes of each."""
    n = len(at)
    every = np.arange(n)
    reader = _Reader(words, at)
    if (reader.take(every, 14) != SYNC).any():
        raise CorruptStream("no frame where one must be")
    variable = reader.take(every, 2)
    block_code, rate_code = reader.take(every, 4), reader.take(every, 4)
    channel, bits = reader.take(every, 4), reader.take(every, 3)
    if (variable > 1).any() or (channel != 0).any() or (reader.take(every, 1) != 0).any() or not np.isin(bits, (0, 1)).all():
        raise CorruptStream("one channel of 8 bits is read")
    lead = reader.take(every, 8)
    more = np.select([lead < 0x80, lead < 0xC0, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC, lead < 0xFE], [0, -1, 1, 2, 3, 4, 5], 6)
    if (more < 0).any():
        raise CorruptStream("a frame number is malformed")
    number = np.where(more == 0, lead, lead & ((1 << np.maximum(6 - more, 0)) - 1))
    for j in range(int(more.max(initial=0))):
        some = np.flatnonzero(more > j)
        number[some] = number[some] << 6 | reader.take(some, 8) & 0x3F
    if (np.where(variable == 1, number, number * block) != sample).any():
        raise CorruptStream("a frame is out of place")
    size = np.zeros(n, np.int64)
    for code, s in BLOCK_CODES.items():
        size[block_code == code] = s
    for code, width in ((6, 8), (7, 16)):
        some = np.flatnonzero(block_code == code)
        size[some] = reader.take(some, width) + 1
    for code, width in ((12, 8), (13, 16), (14, 16)):
        reader.take(np.flatnonzero(rate_code == code), width)
    if (size == 0).any() or (size > room).any():
        raise CorruptStream("a block has no valid size")
    length = (reader.bit >> 3) - at
    if (crc_lanes(data, at, length, _CRC8, 8) != reader.take(every, 8)).any():
        raise CorruptStream("the checksum of a frame header is wrong")
    if (reader.take(every, 1) != 0).any():
        raise CorruptStream("a subframe does not begin with 0")
    kind = reader.take(every, 6)
    wasted = reader.take(every, 1)
    some = np.flatnonzero(wasted)
    wasted[some] = reader.unary(some) + 1
    width = 8 - wasted
    whole = np.zeros((int(size.max()), n), np.int32)

    constant, verbatim = np.flatnonzero(kind == 0), np.flatnonzero(kind == 1)
    whole[:, constant] = reader.signed(constant, width[constant])
    for j in range(int(size[verbatim].max(initial=0))):
        some = verbatim[size[verbatim] > j]
        whole[j, some] = reader.signed(some, width[some])
    fixed, linear = (kind >= 8) & (kind <= 12), kind >= 32
    if not (fixed | linear | (kind <= 1)).all():
        raise CorruptStream("a reserved subframe type")
    order = np.where(fixed, kind - 8, np.where(linear, kind - 31, 0))
    coded = np.flatnonzero(fixed | linear)
    if len(coded):
        for j in range(int(order.max())):
            some = coded[order[coded] > j]
            whole[j, some] = reader.signed(some, width[some])
        most = int(order.max())
        weights, shift = np.zeros((max(most, 4), n), np.int64), np.zeros(n, np.int64)
        for o, w in enumerate(FIXED):
            for j, v in enumerate(w):
                weights[j, fixed & (order == o)] = v
        some = np.flatnonzero(linear)
        if len(some):
            precision = reader.take(some, 4) + 1
            shift[some] = reader.signed(some, 5)
            if (shift < 0).any() or (precision == 16).any():
                raise CorruptStream("a predictor is malformed")
            for j in range(most):
                left = order[some] > j
                weights[j, some[left]] = reader.signed(some[left], precision[left])
        _residuals(reader, coded, size, order, whole)
        _predict(whole, coded, size, order, weights, shift)
    whole = whole << wasted.astype(np.int32)
    reader.bit += -reader.bit % 8
    length = (reader.bit >> 3) - at
    if (at + length + 2 > len(data)).any():
        raise CorruptStream("a frame is cut off")
    if (crc_lanes(data, at, length, _CRC16, 16) != reader.take(every, 16)).any():
        raise CorruptStream("the checksum of a frame is wrong")
    for s in np.unique(size).tolist():
        mine = np.flatnonzero(size == s)
        out[to[mine][:, None] + np.arange(s)] = whole[:s, mine].T
    return size, length + 2


def _residuals(reader: _Reader, lanes: np.ndarray, size: np.ndarray, order: np.ndarray, whole: np.ndarray) -> None:
    """Reads the Rice-coded residuals of lanes into whole, behind the warm-up samples; partitions may be escaped."""
    method = reader.take(lanes, 2)
    if (method > 1).any():
        raise CorruptStream("a reserved residual coding")
    parts = reader.take(lanes, 4)
    if (size[lanes] & ((1 << parts) - 1)).any():
        raise CorruptStream("a block does not divide into its partitions")
    if (size[lanes] >> parts < order[lanes]).any():
        raise CorruptStream("a partition is shorter than the predictor")
    bits = np.where(method == 0, 4, 5)
    single = parts == 0
    if single.any():
        mine = lanes[single]
        k = reader.take(mine, bits[single])
        plain = k != (1 << bits[single]) - 1
        _codes(reader, mine[plain], k[plain], order[mine[plain]], size[mine[plain]] - order[mine[plain]], whole)
        _escaped(reader, mine[~plain], order[mine[~plain]], size[mine[~plain]] - order[mine[~plain]], whole)
    # Lanes that have as many partitions as each other take one partition after the other.
    for p in np.unique(parts[~single]).tolist():
        of = parts == p
        mine, width = lanes[of], bits[of]
        step = size[mine] >> p
        for part in range(1 << p):
            begin = np.where(part == 0, order[mine], part * step)
            count = (part + 1) * step - begin
            k = reader.take(mine, width)
            plain = k != (1 << width) - 1
            _codes(reader, mine[plain], k[plain], begin[plain], count[plain], whole)
            _escaped(reader, mine[~plain], begin[~plain], count[~plain], whole)


def _escaped(reader: _Reader, lanes: np.ndarray, begin: np.ndarray, count: np.ndarray, whole: np.ndarray) -> None:
    """Reads residuals that are stored as they are, with a width for each lane."""
    if not len(lanes):
        return
    raw = reader.take(lanes, 5)
    for i in range(int(count.max())):
        some = np.flatnonzero(count > i)
        whole[begin[some] + i, lanes[some]] = reader.signed(lanes[some], raw[some])


def _codes(reader: _Reader, lanes: np.ndarray, k: np.ndarray, begin: np.ndarray, count: np.ndarray, whole: np.ndarray) -> None:
    """Reads count Rice codes of parameter k for each lane, into its samples from begin on; longest lanes first, so
    that those at work are always the first ones."""
    if not len(lanes):
        return
    by_size = np.argsort(-count, kind="stable")
    lanes, k, begin, count = lanes[by_size], k[by_size], begin[by_size], count[by_size]
    words, last = reader.words, np.uint64(len(reader.words) - 1)
    bit = reader.bit[lanes].astype(np.uint64)
    k_u = k.astype(np.uint64)
    one, seven, three, top_bits = np.uint64(1), np.uint64(7), np.uint64(3), np.uint64(48)
    drop, more = np.uint64(63) - k_u, k_u + one
    small = bool((k <= 30).all())
    to = begin * whole.shape[1] + lanes
    flat = whole.reshape(-1)
    alive = len(lanes)
    for i in range(int(count[0])):
        if count[alive - 1] <= i:
            alive = int(np.searchsorted(-count, -i, "left"))
        b = bit[:alive]
        top = words[np.minimum(b >> three, last)] << (b & seven)
        zeros = _ZEROS_U[top >> top_bits]
        if small and int(zeros.max()) < 16:
            u = zeros << k_u[:alive] | (top << zeros << one) >> one >> drop[:alive]
            b += zeros + more[:alive]
        else:
            some = lanes[:alive]
            reader.bit[some] = b.astype(np.int64)
            u = reader.unary(some).astype(np.uint64) << k_u[:alive] | reader.take(some, k[:alive]).astype(np.uint64)
            b[:] = reader.bit[some].astype(np.uint64)
        s = u.astype(np.int64)
        flat[to[:alive]] = (s >> 1) ^ -(s & 1)
        to[:alive] += whole.shape[1]
    reader.bit[lanes] = bit.astype(np.int64)


def _predict(whole: np.ndarray, lanes: np.ndarray, size: np.ndarray, order: np.ndarray, weights: np.ndarray, shift: np.ndarray) -> None:
    """Adds to residuals what the samples before predict, sample by sample, all lanes of one order at a time."""
    for o in np.unique(order[lanes]).tolist():
        if not o:
            continue
        mine = lanes[order[lanes] == o]
        x = whole[:, mine].astype(np.int64)
        w, s = weights[:o, mine], shift[mine]
        for j in range(o, int(size[mine].max())):
            x[j] += (w * x[j - o : j][::-1]).sum(0) >> s
        whole[:, mine] = x


def pcm_blocks(payload: bytes, samples: int = 4096) -> list[tuple[int, bytes]]:
    """Blocks of PCM bytes, each with the offset of its first sample; a seek is a division."""
    return [(at, payload[at : at + samples]) for at in range(0, len(payload), samples)]


def media_payload(text: str | None, unit: int = 64) -> bytes:
    """A text's UTF-8 bytes with bytes 0 up to a positive multiple of unit."""
    raw = (text or "").encode()
    return raw + bytes(max(unit, -(-len(raw) // unit) * unit) - len(raw))


def features(payload: bytes) -> str:
    """What is computed from decoded samples: their number, sum, energy and crossings of the middle."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    return f"n={len(x)};sum={int(x.sum())};energy={int((x * x).sum())};crossings={int(((x[1:] < 0) != (x[:-1] < 0)).sum())}"


def _encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column(1), 1 << 21):
            texts = batch.column(1).slice(a, b - a)
            media = encode_streams([media_payload(t) for t in texts.to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pc.fill_null(pc.binary_length(texts), 0).cast(pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each whole text losslessly as a media column: (id_col, n_bytes long, media binary), media a FLAC stream.

    A text is its UTF-8 bytes and bytes 0 up to a positive multiple of 64; null is empty. Equal texts give equal
    streams, whatever else is in a batch. Repeated rows give repeated results; other columns are ignored.
    """
    ship(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return picked.mapInArrow(lean(_encoded), f"id {id_type(docs, id_col)}, n_bytes bigint, media binary").withColumnRenamed("id", id_col)


def read_media(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """Decodes a column of streams, verifying all checksums: (id_col, n_samples long, payload binary, feature string).
    A null stream gives nulls; a damaged one raises CorruptStream."""
    ship(media.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1), 1 << 21):
                some = batch.column(1).slice(a, b - a).to_pylist()
                found = iter(decode_streams([s for s in some if s is not None]))
                payload = [None if s is None else next(found) for s in some]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), pa.array([None if p is None else len(p) for p in payload], pa.int64()), pa.array(payload, pa.binary()), pa.array([None if p is None else features(p) for p in payload], pa.string())],
                    names=["id", "n_samples", "payload", "feature"],
                )

    picked = media.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    return picked.mapInArrow(lean(run), f"id {id_type(media, id_col)}, n_samples bigint, payload binary, feature string").withColumnRenamed("id", id_col)


def read_pcm(media: DataFrame, id_col: str = "doc_id", media_col: str = "media", samples: int = 4096) -> DataFrame:
    """Decoded streams as PCM blocks: (id_col, block int, first_sample long, pcm binary). A sample s lies in block
    s div samples, so that a seek reads one row."""
    decoded = read_media(media, id_col, media_col)
    cut = F.expr(f"transform(sequence(0, cast((n_samples - 1) div {samples} as int)), b -> struct(b as block, cast(b as bigint) * {samples} as first_sample, substring(payload, b * {samples} + 1, {samples}) as pcm))")
    return decoded.where("n_samples > 0").select(id_col, F.inline(cut))


def to_pcm(stored: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Decodes a stored table to PCM: (id_col, n_bytes, media_bytes long, media_sha256 string, blocks), blocks an array of
    (first_sample long, pcm binary); sample s lies in blocks[s div 4096]."""
    ship(stored.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(2), 1 << 21):
                part = batch.slice(a, b - a)
                media = part.column(2).to_pylist()
                cut = [pcm_blocks(p) for p in decode_streams(media)]
                ends = np.cumsum([0, *map(len, cut)]).astype(np.int32)
                blocks = pa.StructArray.from_arrays([pa.array([x for c in cut for x, _ in c], pa.int64()), pa.array([x for c in cut for _, x in c], pa.binary())], names=["first_sample", "pcm"])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([len(m) for m in media], pa.int64()), pa.array([hashlib.sha256(m).hexdigest() for m in media]), pa.ListArray.from_arrays(pa.array(ends), blocks)],
                    names=["id", "n_bytes", "media_bytes", "media_sha256", "blocks"],
                )

    picked = stored.select(F.col(id_col).alias("id"), "n_bytes", "media")
    fields = f"id {id_type(stored, id_col)}, n_bytes bigint, media_bytes bigint, media_sha256 string, blocks array<struct<first_sample: bigint, pcm: binary>>"
    return picked.mapInArrow(lean(run), fields).withColumnRenamed("id", id_col)


def media_blocks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int = 4) -> DataFrame:
    """Stores all texts as streams, reads these back and writes PCM blocks: the columns of to_pcm.

    One part of the rows after the other, dealt by a hash of id and text, so that beside the blocks no more than a part of
    the streams is on disk: a part's streams are deleted when its blocks are written. Nothing else depends on parts.
    """
    of = F.pmod(F.xxhash64(id_col, text_col), F.lit(parts))
    written = []
    for part in range(parts):
        streams = stash(to_media(docs.where(of == part), id_col, text_col), "media")
        written.append(stash(to_pcm(streams, id_col), "pcm"))
        drop_stash(streams)
    whole = written[0]
    for more in written[1:]:
        whole = whole.unionByName(more)
    return whole


def media_digests(blocks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Digest columns of what is read back from written PCM blocks, and of the streams they were decoded from."""
    ship(blocks.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zlib

        for batch in batches:
            column = batch.column(4)
            for a in range(0, len(batch), 256):
                part = batch.slice(a, 256)
                payload = [b"".join(x["pcm"] for x in sorted(row, key=lambda x: x["first_sample"])) for row in column.slice(a, 256).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        part.column(1),
                        pa.array([len(p) for p in payload], pa.int64()),
                        pa.array([hashlib.sha256(p).hexdigest() for p in payload]),
                        pa.array([zlib.crc32(p[-64:]) for p in payload], pa.int64()),
                        part.column(2),
                        part.column(3),
                        pa.array([features(p) for p in payload]),
                    ],
                    names=["id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )

    picked = blocks.select(F.col(id_col).alias("id"), "n_bytes", "media_bytes", "media_sha256", "blocks")
    fields = f"id {id_type(blocks, id_col)}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return picked.mapInArrow(lean(run), fields).withColumnRenamed("id", id_col)
