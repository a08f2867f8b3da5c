"""PDF syntax: one regular expression cuts bytes into tokens, a small stack machine builds values from them.

Python values stand for PDF values: int, float, bool, None, bytes (strings), Name, list, dict, Ref, Stream; Op is an operator or keyword.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any, NamedTuple


class Name(str):
    __slots__ = ()


class Op(str):
    __slots__ = ()


class Ref(NamedTuple):
    num: int


class Stream:
    __slots__ = ("attrs", "raw", "key")

    def __init__(self, attrs: dict, raw: bytes, key: tuple[int, int] | None = None):
        self.attrs, self.raw, self.key = attrs, raw, key


class SyntaxFault(ValueError):
    """Malformed input; carried as an error column unless strict."""


# White space and delimiters of the format.
_SPACE, _DELIM = rb"\x00\t\n\f\r ", rb"()<>\[\]{}/%"
_TOKEN = re.compile(
    rb"[%(s)s]+|%%[^\r\n]*"
    rb"|(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[%(s)s%(d)s]|$))"
    rb"|/(?P<name>[^%(s)s%(d)s]*)"
    rb"|(?P<mark><<|>>|[\[\]{}])"
    rb"|<(?P<hex>[^>]*)>"
    rb"|(?P<open>\()"
    rb"|(?P<word>[^%(s)s%(d)s]+)"
    rb"|(?P<stray>[)>])" % {b"s": _SPACE, b"d": _DELIM}
)
_PAREN = re.compile(rb"[()\\\r]")
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_OCTAL = re.compile(rb"[0-7]{1,3}")
_NOT_HEX = re.compile(rb"[^0-9A-Fa-f]")


def literal_string(data: bytes, at: int) -> tuple[bytes, int]:
    """The string whose opening parenthesis is just before ``at``, and where it ends."""
    out, depth = [], 1
    while True:
        m = _PAREN.search(data, at)
        if m is None:
            out.append(data[at:])
            return b"".join(out), len(data)
        out.append(data[at : m.start()])
        sign, at = m.group(), m.end()
        if sign == b"\r":  # any end of line reads as a line feed
            out.append(b"\n")
            at += data[at : at + 1] == b"\n"
        elif sign == b"\\":
            if o := _OCTAL.match(data, at):
                out.append(bytes([int(o.group(), 8) & 255]))
                at = o.end()
            else:
                c = data[at : at + 1]
                at += 1
                if c == b"\r":
                    at += data[at : at + 1] == b"\n"
                elif c != b"\n":
                    out.append(_ESCAPES.get(c, c))
        else:
            depth += 1 if sign == b"(" else -1
            if not depth:
                return b"".join(out), at
            out.append(sign)


def hex_string(body: bytes) -> bytes:
    """Pairs of digits; a single last one is a byte of its own."""
    digits = _NOT_HEX.sub(b"", body)
    return bytes(int(digits[i : i + 2], 16) for i in range(0, len(digits), 2))


def _name(raw: bytes) -> Name:
    if b"#" in raw:
        raw = re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), raw)
    try:
        return Name(raw.decode())
    except UnicodeDecodeError:
        return Name(raw.decode("latin-1"))


# Words that are values.
_WORDS = {b"true": True, b"false": False}


def tokens(data: bytes, at: int = 0, end: int | None = None) -> Iterator[tuple[int, Any, int]]:
    """(place, value or Op, place after it). Brackets are Ops."""
    end = len(data) if end is None else end
    while at < end:
        m = _TOKEN.match(data, at, end)
        if m is None:
            at += 1
            continue
        start, at, kind = at, m.end(), m.lastgroup
        if kind == "number":
            raw = m["number"]
            yield start, float(raw) if b"." in raw else int(raw), at
        elif kind == "name":
            yield start, _name(m["name"]), at
        elif kind == "mark":
            yield start, Op(m["mark"].decode()), at
        elif kind == "hex":
            yield start, hex_string(m["hex"]), at
        elif kind == "open":
            value, at = literal_string(data, at)
            yield start, value, at
        elif kind == "word":
            raw = m["word"]
            yield start, _WORDS[raw] if raw in _WORDS else Op(raw.decode("latin-1")), at


_CLOSERS = {"]": "[", ">>": "<<", "}": "{"}


def values(data: bytes, at: int = 0, end: int | None = None, strict: bool = False) -> Iterator[tuple[int, Any, int]]:
    """Like tokens(), with arrays, dictionaries and procedures as whole values, ``n g R`` as Ref and null as None."""
    open_: list[tuple[str, int, list]] = []
    row: list[tuple[int, Any, int]] = []  # values at the top level that may still become part of a reference

    def put(start: int, value: Any, stop: int):
        if open_:
            open_[-1][2].append(value)
        else:
            row.append((start, value, stop))

    for start, value, stop in tokens(data, at, end):
        if type(value) is Op:
            if value in ("[", "<<", "{"):
                open_.append((value, start, []))
                continue
            if value in _CLOSERS:
                if not open_ or open_[-1][0] != _CLOSERS[value]:
                    if strict:
                        raise SyntaxFault(f"unexpected {value}")
                    continue
                kind, begun, items = open_.pop()
                if kind == "<<":
                    if len(items) % 2:
                        if strict:
                            raise SyntaxFault("a dictionary with a key without a value")
                        items = items[:-1]
                    whole: Any = {str(k): v for k, v in zip(items[::2], items[1::2], strict=True) if v is not None}
                else:
                    whole = items
                put(begun, whole, stop)
            elif value == "R":
                held = open_[-1][2] if open_ else row
                pick = (lambda x: x) if open_ else (lambda x: x[1])
                if len(held) >= 2 and type(pick(held[-1])) is int and type(pick(held[-2])) is int:
                    first = held[-2]
                    del held[-2:]
                    put(start if open_ else first[0], Ref(pick(first)), stop)
            elif value == "null":
                put(start, None, stop)
            else:
                put(start, value, stop)
        else:
            put(start, value, stop)
        if not open_ and (len(row) > 2 or type(value) is Op):
            keep = 0 if type(row[-1][1] if row else None) is not int else 2
            yield from row[: len(row) - keep]
            del row[: len(row) - keep]
    yield from row


def first_value(data: bytes, at: int = 0) -> tuple[Any, int]:
    for _, value, stop in values(data, at):
        return value, stop
    raise SyntaxFault("no object")
