"""The LZW variant of TIFF: codes from the highest bit on, and a width that grows one code early."""

from __future__ import annotations

#: Fixed values of the format.
CLEAR, END, FIRST, LEAST_BITS, MOST_BITS = 256, 257, 258, 9, 12
#: The table is cleared when this entry has been made.
FULL = (1 << MOST_BITS) - 2


def lzw_encode(raw: bytes) -> bytes:
    """raw as one strip or tile; empty bytes give the two control codes alone."""
    out = bytearray()
    held, n, width = CLEAR, LEAST_BITS, LEAST_BITS
    table: dict[int, int] = {}
    free, now = FIRST, -1
    for byte in raw:
        if now < 0:
            now = byte
            continue
        step = now << 8 | byte
        known = table.get(step)
        if known is not None:
            now = known
            continue
        held, n = held << width | now, n + width
        table[step] = free
        if free == FULL:
            held, n = held << width | CLEAR, n + width
            table.clear()
            free, width = FIRST, LEAST_BITS
        else:
            if free == (1 << width) - 1:
                width += 1
            free += 1
        now = byte
        if n >= 4096:
            rest = n % 8
            out += (held >> rest).to_bytes(n // 8, "big")
            held, n = held & ((1 << rest) - 1), rest
    if now >= 0:
        held, n = held << width | now, n + width
        if free == (1 << width) - 1 and width < MOST_BITS:
            width += 1
    held, n = held << width | END, n + width
    pad = -n % 8
    return bytes(out + (held << pad).to_bytes((n + pad) // 8, "big"))


def lzw_decode(raw: bytes) -> bytes:
    """The bytes of one strip or tile; a stream that stops without an end code gives what it holds. Raises ValueError
    for codes that cannot be."""
    parts: list[bytes] = []
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    held = n = 0
    width, last = LEAST_BITS, b""
    for byte in raw:
        held, n = (held << 8 | byte) & 0xFFFFFF, n + 8
        if n < width:
            continue
        n -= width
        code = held >> n & ((1 << width) - 1)
        if code == END:
            break
        if code == CLEAR:
            del table[FIRST:]
            width, last = LEAST_BITS, b""
            continue
        if code < len(table):
            found = table[code]
        elif code == len(table) and last:
            found = last + last[:1]
        else:
            raise ValueError(f"no such code: {code}")
        parts.append(found)
        if last:
            table.append(last + found[:1])
        if len(table) + 1 >= 1 << width and width < MOST_BITS:
            width += 1
        last = found
    return b"".join(parts)
