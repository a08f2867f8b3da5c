"""Stream filters and predictors, bytes to bytes."""

from __future__ import annotations

import re
import zlib

import numpy as np


class FilterFault(ValueError):
    pass


def flate(data: bytes) -> bytes:
    """Inflate; of damaged data whatever comes before the damage, nothing if not even a start can be read."""
    engine, out = zlib.decompressobj(), []
    try:
        out.append(engine.decompress(data))
        return b"".join(out) + engine.flush()
    except zlib.error:
        engine, out = zlib.decompressobj(), []
        for i in range(len(data)):
            try:
                out.append(engine.decompress(data[i : i + 1]))
            except zlib.error:
                break
        return b"".join(out)


def lzw(data: bytes) -> bytes:
    """Most significant bits first, codes widen one early; stops at a code that can't occur."""
    table = [bytes([i]) for i in range(256)] + [b"", b""]
    out, width, before = [], 9, b""
    bits = have = 0
    for byte in data:
        bits, have = (bits << 8) | byte, have + 8
        if have < width:
            continue
        have -= width
        code = bits >> have
        bits &= (1 << have) - 1
        if code == 256:
            del table[258:]
            width, before = 9, b""
        elif code == 257:
            break
        else:
            if not before:
                if code >= 256:
                    break
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                table.append(before + entry[:1])
            elif code == len(table):
                entry = before + before[:1]
                table.append(entry)
            else:
                break
            out.append(entry)
            before = entry
            if len(table) + 1 >= 1 << width and width < 12:
                width += 1
    return b"".join(out)


def ascii85(data: bytes) -> bytes:
    body = re.sub(rb"\s+", b"", data)
    body = body.removeprefix(b"<~")
    body = body.split(b"~")[0]
    out, group = bytearray(), []
    for c in body:
        if c == 122 and not group:
            out += bytes(4)
        elif 33 <= c <= 117:
            group.append(c - 33)
            if len(group) == 5:
                out += _word85(group)
                group = []
    if len(group) > 1:
        out += _word85(group + [84] * (5 - len(group)))[: len(group) - 1]
    return bytes(out)


def _word85(group: list[int]) -> bytes:
    value = 0
    for d in group:
        value = value * 85 + d
    return (value & 0xFFFFFFFF).to_bytes(4, "big")


def ascii_hex(data: bytes) -> bytes:
    digits = re.sub(rb"[^0-9A-Fa-f]", b"", data.split(b">")[0])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())


def run_length(data: bytes) -> bytes:
    out, i = [], 0
    while i < len(data) and data[i] != 128:
        n = data[i]
        if n < 128:
            out.append(data[i + 1 : i + 2 + n])
            i += n + 2
        else:
            out.append(data[i + 1 : i + 2] * (257 - n))
            i += 2
    return b"".join(out)


def tiff_predictor(data: bytes, colors: int, columns: int, bits: int) -> bytes:
    if bits != 8:
        raise FilterFault(f"TIFF predictor with {bits} bits")
    line = colors * columns
    rows = np.frombuffer(data[: len(data) // line * line], np.uint8).reshape(-1, columns, colors)
    return np.cumsum(rows, axis=1, dtype=np.uint8).tobytes()


def png_predictor(data: bytes, colors: int, columns: int, bits: int) -> bytes:
    """Rows of a filter byte and ``columns * colors * bits`` bits; each filter's row is undone with the row above it."""
    if bits not in (1, 8):
        raise FilterFault(f"PNG predictor with {bits} bits")
    line = -(-colors * columns * bits // 8)
    step = max(1, colors * bits // 8)
    above, out = np.zeros(line, np.uint8), []
    for at in range(0, len(data), line + 1):
        kind, raw = data[at], np.frombuffer(data[at + 1 : at + 1 + line], np.uint8)
        if len(raw) < line:
            raw = np.concatenate([raw, np.zeros(line - len(raw), np.uint8)])
        if kind == 0:
            row = raw
        elif kind == 1:
            pad = np.concatenate([raw, np.zeros(-line % step, np.uint8)]).reshape(-1, step)
            row = np.cumsum(pad, axis=0, dtype=np.uint8).ravel()[:line]
        elif kind == 2:
            row = raw + above
        elif kind in (3, 4):
            row = _sequential(kind, raw.tolist(), above.tolist(), step)
        else:
            raise FilterFault(f"PNG filter {kind}")
        out.append(row)
        above = row
    return np.concatenate(out).tobytes() if out else b""


def _sequential(kind: int, raw: list[int], above: list[int], step: int) -> np.ndarray:
    row: list[int] = []
    for i, x in enumerate(raw):
        left, up, corner = (row[i - step], above[i], above[i - step]) if i >= step else (0, above[i], 0)
        if kind == 3:
            guess = (left + up) // 2
        else:
            p = left + up - corner
            guess = min((left, up, corner), key=lambda v: abs(p - v))  # ties: left, above, corner
        row.append((x + guess) & 255)
    return np.array(row, np.uint8)


def predict(data: bytes, params: dict) -> bytes:
    kind = params.get("Predictor", 1)
    colors, columns, bits = (params.get(k, d) for k, d in (("Colors", 1), ("Columns", 1), ("BitsPerComponent", 8)))
    if kind == 2:
        return tiff_predictor(data, colors, columns, bits)
    if kind >= 10:
        return png_predictor(data, colors, columns, bits)
    if kind != 1:
        raise FilterFault(f"predictor {kind}")
    return data


# -- CCITT group 4 ---------------------------------------------------------------------------------------------

# Fixed values of the fax code: modes of two-dimensional coding.
MODES = {"0001": "pass", "001": "horizontal", "1": 0, "011": 1, "000011": 2, "0000011": 3, "010": -1, "000010": -2, "0000010": -3}
# Fixed values of the fax code: terminating codes of runs 0 to 63, white and black.
WHITE_SHORT = """00110101 000111 0111 1000 1011 1100 1110 1111 10011 10100 00111 01000 001000 000011 110100 110101
101010 101011 0100111 0001100 0001000 0010111 0000011 0000100 0101000 0101011 0010011 0100100 0011000 00000010 00000011 00011010
00011011 00010010 00010011 00010100 00010101 00010110 00010111 00101000 00101001 00101010 00101011 00101100 00101101 00000100 00000101 00001010
00001011 01010010 01010011 01010100 01010101 00100100 00100101 01011000 01011001 01011010 01011011 01001010 01001011 00110010 00110011 00110100""".split()
BLACK_SHORT = """0000110111 010 11 10 011 0011 0010 00011 000101 000100 0000100 0000101 0000111 00000100 00000111 000011000
0000010111 0000011000 0000001000 00001100111 00001101000 00001101100 00000110111 00000101000 00000010111 00000011000 000011001010 000011001011 000011001100 000011001101 000001101000 000001101001
000001101010 000001101011 000011010010 000011010011 000011010100 000011010101 000011010110 000011010111 000001101100 000001101101 000011011010 000011011011 000001010100 000001010101 000001010110 000001010111
000001100100 000001100101 000001010010 000001010011 000000100100 000000110111 000000111000 000000100111 000000101000 000001011000 000001011001 000000101011 000000101100 000001011010 000001100110 000001100111""".split()
# Fixed values of the fax code: make-up codes of 64, 128, ... 1728, white and black, then 1792, 1856, ... 2560 of both.
WHITE_LONG = """11011 10010 010111 0110111 00110110 00110111 01100100 01100101 01101000 01100111 011001100 011001101 011010010 011010011
011010100 011010101 011010110 011010111 011011000 011011001 011011010 011011011 010011000 010011001 010011010 011000 010011011""".split()
BLACK_LONG = """0000001111 000011001000 000011001001 000001011011 000000110011 000000110100 000000110101 0000001101100 0000001101101 0000001001010 0000001001011 0000001001100 0000001001101 0000001110010
0000001110011 0000001110100 0000001110101 0000001110110 0000001110111 0000001010010 0000001010011 0000001010100 0000001010101 0000001011010 0000001011011 0000001100100 0000001100101""".split()
BOTH_LONG = "00000001000 00000001100 00000001101 000000010010 000000010011 000000010100 000000010101 000000010110 000000010111 000000011100 000000011101 000000011110 000000011111".split()


def _runs(short: list[str], long: list[str]) -> dict[str, int]:
    return {c: i for i, c in enumerate(short)} | {c: 64 * (i + 1) for i, c in enumerate(long)} | {c: 1792 + 64 * i for i, c in enumerate(BOTH_LONG)}


_RUNS = (_runs(WHITE_SHORT, WHITE_LONG), _runs(BLACK_SHORT, BLACK_LONG))


class _Bits:
    def __init__(self, data: bytes):
        self.text = bin(int.from_bytes(b"\1" + data, "big"))[3:]
        self.at = 0

    def code(self, table: dict):
        for n in range(1, 14):
            found = table.get(self.text[self.at : self.at + n])
            if found is not None:
                self.at += n
                return found
        return None


def ccitt(data: bytes, params: dict) -> bytes:
    """Group 4 lines as changing elements: a line is the list of columns where the colour changes, white first."""
    if params.get("K", 0) != -1:
        raise FilterFault("only group 4 fax data")
    width, rows = params.get("Columns", 1728), params.get("Rows", 0)
    align, black_is_1 = params.get("EncodedByteAlign", False), params.get("BlackIs1", False)
    bits, above, out = _Bits(data), [width], []
    while bits.at < len(bits.text) and (not rows or len(out) < rows):
        line = _fax_line(bits, above, width)
        if line is None:
            break
        out.append(_pixels(line, width, black_is_1))
        above = line
        if align:
            bits.at += -bits.at % 8
    return b"".join(out)


def _fax_line(bits: _Bits, above: list[int], width: int) -> list[int] | None:
    line: list[int] = []
    at, color = 0, 0
    first = True
    while at < width:
        mode = bits.code(MODES)
        if mode is None:
            return None
        # b1: first change above right of at, to the other colour than ours; index parity is the colour that it ends
        k = next((i for i, x in enumerate(above) if (x > at or first and x >= at) and i % 2 == color), None)
        b1 = above[k] if k is not None else width
        if mode == "pass":
            at = above[k + 1] if k is not None and k + 1 < len(above) else width
        elif mode == "horizontal":
            for c in (color, 1 - color):
                run = 0
                while True:
                    part = bits.code(_RUNS[c])
                    if part is None:
                        return None
                    run += part
                    if part < 64:
                        break
                at = min(width, at + run)
                line.append(at)
        else:
            at = max(0, min(width, b1 + mode))
            line.append(at)
            color = 1 - color
        first = False
    return line


def _pixels(line: list[int], width: int, black_is_1: bool) -> bytes:
    row, color, at = np.zeros(width, np.uint8), 0, 0
    for x in line:
        row[at:x] = color
        color, at = 1 - color, x
    return np.packbits(row if black_is_1 else 1 - row).tobytes()


# Filter names and their short forms in inline images.
DECODERS = {"FlateDecode": flate, "Fl": flate, "LZWDecode": lzw, "LZW": lzw, "ASCII85Decode": ascii85, "A85": ascii85, "ASCIIHexDecode": ascii_hex, "AHx": ascii_hex, "RunLengthDecode": run_length, "RL": run_length}
FAX = ("CCITTFaxDecode", "CCF")
KEPT = ("DCTDecode", "DCT", "JBIG2Decode", "JPXDecode")


def decode(data: bytes, chain: list[tuple[str, dict]]) -> bytes:
    """Apply filters in order, each with its predictor. Image payloads stay encoded."""
    for name, params in chain:
        if name in DECODERS:
            data = DECODERS[name](data)
        elif name in FAX:
            data = ccitt(data, params)
            continue
        elif name in KEPT:
            continue
        else:
            raise FilterFault(f"unsupported filter {name}")
        if params.get("Predictor", 1) != 1:
            data = predict(data, params)
    return data
