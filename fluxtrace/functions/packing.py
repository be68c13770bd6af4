"""Strips of packed TIFF frames: PackBits, LZW and Deflate, with or without differences along rows."""

from __future__ import annotations

import zlib

import numpy as np


def unpack_bits(data: bytes) -> bytes:
    """Runs: a count below 128 copies so many bytes and one, one above 128 repeats the next byte 257 less the count times."""
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        if n < 128:
            out += data[i + 1 : i + 2 + n]
            i += n + 2
        elif n > 128:
            out += data[i + 1 : i + 2] * (257 - n)
            i += 2
        else:
            i += 1
    return bytes(out)


# LZW codes that empty the table and that end a strip, the first free one, and the widths of codes in bits.
CLEAR, END, FIRST, NARROW, WIDE = 256, 257, 258, 9, 12


def unpack_lzw(data: bytes) -> bytes:
    """Codes from the highest bit on, which widen one entry before the table needs it."""
    single = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, before = list(single), NARROW, b""
    out, held, bits = [], 0, 0
    for byte in data:
        held, bits = held << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & (1 << bits) - 1
        if code == END:
            break
        if code == CLEAR:
            table, width, before = list(single), NARROW, b""
            continue
        if code > len(table) or (code == len(table) and not before):
            raise ValueError("an LZW strip with a code that no entry has")
        now = table[code] if code < len(table) else before + before[:1]
        out.append(now)
        if before and len(table) < 1 << WIDE:
            table.append(before + now[:1])
            width = min(max(width, (len(table) + 1).bit_length()), WIDE)
        before = now
    return b"".join(out)


#: By the number of the compression in a page's tags.
UNPACK = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32946: zlib.decompress, 32773: unpack_bits}


def undifferenced(frame: np.ndarray) -> np.ndarray:
    """Samples of rows that hold differences to the left neighbour, which wrap around."""
    return np.cumsum(frame, axis=1, dtype=frame.dtype.newbyteorder("="))
