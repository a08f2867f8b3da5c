"""Encoders that the filters undo; for queries and tests."""

from __future__ import annotations

import zlib


def flate(data: bytes) -> bytes:
    return zlib.compress(data, 1)


def lzw(data: bytes) -> bytes:
    """Codes of growing width, most significant bit first, one code early."""
    table, width, out, have, bits = {bytes([i]): i for i in range(256)}, 9, bytearray(), 0, 0

    def put(code: int) -> None:
        nonlocal bits, have
        bits, have = (bits << width) | code, have + width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    put(256)
    size, word = 258, b""
    for i in range(len(data)):
        more = word + data[i : i + 1]
        if more in table:
            word = more
            continue
        put(table[word])
        table[more] = size
        size += 1
        word = data[i : i + 1]
        if size == 4094:
            put(256)
            table, size, width = {bytes([k]): k for k in range(256)}, 258, 9
        elif size + 1 > 1 << width:
            width += 1
    if word:
        put(table[word])
        size += 1
        if size + 1 > 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def ascii85(data: bytes) -> bytes:
    import base64

    return b"<~" + base64.a85encode(data) + b"~>"


def run_length(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = 1
        while n < 128 and data[i : i + 1] == data[i + n : i + n + 1]:
            n += 1
        if n > 1:
            out += bytes([257 - n]) + data[i : i + 1]
        else:
            while n < 128 and i + n < len(data) and data[i + n] != data[i + n - 1]:
                n += 1
            out += bytes([n - 1]) + data[i : i + n]
        i += n
    return bytes(out) + b"\x80"


def _rows(data: bytes, width: int) -> list[bytes]:
    return [data[i : i + width].ljust(width, b"\0") for i in range(0, len(data), width)]


def png(data: bytes, width: int) -> bytes:
    """Rows with the five row filters in turn, one byte a pixel."""
    out, above = bytearray(), bytes(width)
    for k, row in enumerate(_rows(data, width)):
        kind = k % 5
        out.append(kind)
        for i, x in enumerate(row):
            left, up, corner = (row[i - 1], above[i], above[i - 1]) if i else (0, above[i], 0)
            p = left + up - corner
            paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
            out.append((x - (0, left, up, (left + up) // 2, paeth)[kind]) & 255)
        above = row
    return bytes(out)


def tiff(data: bytes, width: int) -> bytes:
    return b"".join(bytes((x - (row[i - 1] if i else 0)) & 255 for i, x in enumerate(row)) for row in _rows(data, width))
