"""One PDF file in memory: cross-reference sections, objects, pages, outline, labels and names, as plain rows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from inkwell.functions.crypto import Handler
from inkwell.functions.filters import decode
from inkwell.functions.syntax import Name, Op, Ref, Stream, SyntaxFault, first_value, tokens, values

_HEAD = re.compile(rb"(?:^|(?<=[\r\n]))[ \t]*(\d+)[ \t]+(\d+)[ \t]+obj\b")
_ENTRY = re.compile(rb"[\t\n\f\r ]++(?:([0-9]++)[\t\n\f\r ]++[0-9]++[\t\n\f\r ]++)?([0-9]++)[\t\n\f\r ]++([0-9]++)[\t\n\f\r ]++([nf])(?=[\t\n\f\r ])")
#: References that are followed one after another, and levels of trees, before a cycle is assumed.
DEEPEST = 200


class NoDocument(SyntaxFault):
    pass


class Section:
    """A cross-reference section: {object number: (container number or None, offset or index, generation)}."""

    def __init__(self, kind: str, trailer: dict, entries: dict[int, tuple[int | None, int, int]]):
        self.kind, self.trailer, self.entries = kind, trailer, entries


class Document:
    def __init__(self, data: bytes, password: str = "", strict: bool = False, compat: bool = False):
        self.data, self.strict, self.compat = data, strict, compat
        self._cache: dict[int, Any] = {}
        self._members: dict[int, list[tuple[int, Any]]] = {}
        self._open: set[int] = set()
        self.handler: Handler | None = None
        self.sections = self._sections()
        self.info: list[dict] = []
        self.root: dict = {}
        encrypt = None
        for s in self.sections:
            if encrypt is None and "Encrypt" in s.trailer:
                encrypt = s.trailer
            if "Info" in s.trailer:
                self.info.append(s.trailer["Info"])
            if not self.root and "Root" in s.trailer:
                self.root = self.dict(s.trailer["Root"])
        if encrypt is not None:
            ids = self.list(encrypt.get("ID"))
            self.handler = Handler(self.plain(encrypt["Encrypt"]), self.value(ids[0]) if ids else b"", password)
            self._cache.clear()
            self._members.clear()
            self.root = next((self.dict(s.trailer["Root"]) for s in self.sections if "Root" in s.trailer), {})
        self.info = [self.dict(i) for i in self.info]
        if not self.root:
            self.root = next((v for n in self.numbers() if isinstance(v := self.get(n), dict) and v.get("Type") == "Catalog"), {})
        if not self.root and strict:
            raise NoDocument("no catalog")

    # -- cross references ------------------------------------------------------------------------------------------

    def _sections(self) -> list[Section]:
        found: list[Section] = []
        try:
            tail = self.data.rfind(b"startxref")
            m = re.match(rb"startxref\s+(\d+)", self.data[tail : tail + 40]) if tail >= 0 else None
            if m is None:
                raise NoDocument("no startxref")
            self._chain(int(m[1]), found, set())
            if not any("Root" in s.trailer for s in found):
                raise NoDocument("no trailer with a root")
        except (SyntaxFault, ValueError, KeyError, TypeError, IndexError):
            found = [self._scan()]
        return found

    def _chain(self, at: int, found: list[Section], seen: set[int]) -> None:
        while at not in seen:
            seen.add(at)
            section = self._table(at) if re.match(rb"\s*xref", self.data[at : at + 16]) else self._stream_section(at)
            found.append(section)
            if isinstance(side := section.trailer.get("XRefStm"), int):
                self._chain(side, found, seen)
            if not isinstance(before := section.trailer.get("Prev"), int):
                return
            at = before
        raise NoDocument("cross-reference sections in a circle")

    def _table(self, at: int) -> Section:
        entries: dict[int, tuple[int | None, int, int]] = {}
        at, start = self.data.index(b"xref", at) + 4, None
        while m := _ENTRY.match(self.data, at):  # plain entries, the first of a range with its head; the rest goes by tokens
            first, place, gen, kind = m.groups()
            if first is not None:
                start = int(first)
            if start is None:
                break
            if kind == b"n":
                entries.setdefault(start, (None, int(place), int(gen)))
            start, at = start + 1, m.end()
        stream = tokens(self.data, at)
        held: list[int] = []
        for _, value, stop in stream:
            if value == "trailer" and type(value) is Op:
                trailer, _ = first_value(self.data, stop)
                return Section("table", trailer if isinstance(trailer, dict) else {}, entries)
            if type(value) is int:
                held.append(value)
            elif type(value) is Op and value in ("n", "f") and len(held) >= 2:
                if len(held) >= 4:
                    start = held[-4]
                if start is None:
                    raise SyntaxFault("entries without a range")
                if value == "n":
                    entries.setdefault(start, (None, held[-2], held[-1]))
                start += 1
                held = []
            else:
                raise SyntaxFault(f"{value!r} in a cross-reference table")
        raise SyntaxFault("no trailer")

    def _stream_section(self, at: int) -> Section:
        value = self._object_at(at)[1]
        if not isinstance(value, Stream) or value.attrs.get("Type") != "XRef":
            raise NoDocument("no cross-reference stream")
        attrs, data = value.attrs, self.decoded(value, plain=True)
        widths = [w if isinstance(w, int) else 0 for w in attrs["W"]]
        index = attrs.get("Index") or [0, attrs.get("Size", 0)]
        step, place, entries = sum(widths), 0, {}
        for first, count in zip(index[::2], index[1::2], strict=False):
            for num in range(first, first + count):
                row = data[place : place + step]
                if len(row) < step or not step:
                    break
                place += step
                cut, fields = 0, []
                for w in widths:
                    fields.append(int.from_bytes(row[cut : cut + w], "big") if w else None)
                    cut += w
                kind = 1 if fields[0] is None else fields[0]
                if kind == 1:
                    entries.setdefault(num, (None, fields[1] or 0, fields[2] or 0))
                elif kind == 2:
                    entries.setdefault(num, (fields[1], fields[2] or 0, 0))
        return Section("stream", attrs, entries)

    def _scan(self) -> Section:
        """Without usable sections: every ``n g obj`` at the start of a line up to the first trailer, and members of object streams."""
        entries: dict[int, tuple[int | None, int, int]] = {}
        stop = re.search(rb"(?:^|[\r\n])trailer\b", self.data)
        trailer: dict = {}
        if stop:
            try:
                got, _ = first_value(self.data, stop.end())
                trailer = got if isinstance(got, dict) else {}
            except SyntaxFault:
                pass
        self.sections = [Section("scan", trailer, entries)]
        for m in _HEAD.finditer(self.data, 0, stop.start() if stop else len(self.data)):
            num = int(m[1])
            entries[num] = (None, m.start(1), int(m[2]))
            if self.data.find(b"/ObjStm", m.end(), m.end() + 400) >= 0:
                value = self.get(num)
                if isinstance(value, Stream) and value.attrs.get("Type") == "ObjStm":
                    for i, (member, _) in enumerate(self._inside(num)):
                        entries.setdefault(member, (num, i, 0))
        self._cache.clear()
        return self.sections[0]

    # -- objects ---------------------------------------------------------------------------------------------------

    def numbers(self) -> list[int]:
        return sorted({n for s in self.sections for n in s.entries})

    def _object_at(self, at: int) -> tuple[int, Any]:
        """(number, value) of ``n g obj …`` at or after an offset."""
        m = re.compile(rb"\s*(\d+)\s+(\d+)\s+obj").match(self.data, at)
        if m is None:
            raise SyntaxFault("no object at this offset")
        num, gen = int(m[1]), int(m[2])
        items = values(self.data, m.end())
        _, value, stop = next(items)
        if type(value) is Op:
            return num, None
        if isinstance(value, dict):
            follow = re.compile(rb"[\x00\t\f ]*(?:%[^\r\n]*)?\s*stream(\r\n|\n|\r)?").match(self.data, stop)
            if follow:
                value = Stream(value, self._payload(value, follow.end()), (num, gen))
        return num, value

    def _payload(self, attrs: dict, at: int) -> bytes:
        length = attrs.get("Length")
        if isinstance(length, Ref):
            length = self.value(length) if hasattr(self, "sections") else None
        if isinstance(length, int) and length >= 0 and re.match(rb"\s*endstream", self.data[at + length : at + length + 20]):
            return self.data[at : at + length]
        end = self.data.find(b"endstream", at)
        end = len(self.data) if end < 0 else end
        raw = self.data[at:end]
        return raw[:-2] if raw.endswith(b"\r\n") else raw[:-1] if raw[-1:] in (b"\n", b"\r") else raw

    def _inside(self, container: int) -> list[tuple[int, Any]]:
        if container not in self._members:
            stream = self.get(container)
            if not isinstance(stream, Stream):
                return []
            data, first = self.decoded(stream), self.int(stream.attrs.get("First"))
            heads = [v for _, v, _ in tokens(data, 0, first) if type(v) is int]
            out = []
            for num, at in zip(heads[::2], heads[1::2], strict=False):
                try:
                    out.append((num, first_value(data, first + at)[0]))
                except SyntaxFault:
                    out.append((num, None))
            self._members[container] = out
        return self._members[container]

    def get(self, num: int) -> Any:
        """The object of a number: the first section that yields it; None if none does."""
        if num in self._cache:
            return self._cache[num]
        if num in self._open:
            return None
        self._open.add(num)
        try:
            for s in self.sections:
                if num not in s.entries:
                    continue
                container, at, gen = s.entries[num]
                try:
                    if container is not None:
                        members = self._inside(container)
                        value = members[at][1] if at < len(members) and members[at][0] == num else dict(members)[num]
                    else:
                        value = self._at_offset(num, at)
                        if self.handler is not None:
                            value = self._deciphered(value, num, gen)
                    self._cache[num] = value
                    return value
                except (SyntaxFault, KeyError, StopIteration, ValueError):
                    continue
            return None
        finally:
            self._open.discard(num)

    def _at_offset(self, num: int, at: int) -> Any:
        try:
            found, value = self._object_at(at)
            if found == num:
                return value
        except (SyntaxFault, StopIteration):
            pass
        m = re.compile(rb"(?<!\d)%d\s+\d+\s+obj" % num).search(self.data, max(0, at - 20)) or re.compile(rb"(?<!\d)%d\s+\d+\s+obj" % num).search(self.data)
        if m is None:
            raise SyntaxFault(f"object {num} not found")
        return self._object_at(m.start())[1]

    def _deciphered(self, value: Any, num: int, gen: int) -> Any:
        if isinstance(value, bytes):
            return self.handler.decrypt(value, num, gen)
        if isinstance(value, list):
            return [self._deciphered(v, num, gen) for v in value]
        if isinstance(value, dict):
            return {k: self._deciphered(v, num, gen) for k, v in value.items()}
        if isinstance(value, Stream):
            if value.attrs.get("Type") == "XRef":
                return value
            return Stream(self._deciphered(value.attrs, num, gen), self.handler.decrypt(value.raw, num, gen, value.attrs), value.key)
        return value

    # -- values, with references followed; a wrong type gives a neutral value unless strict --------------------------

    def value(self, x: Any) -> Any:
        for _ in range(DEEPEST):
            if not isinstance(x, Ref):
                return x
            x = self.get(x.num)
        return None

    def _as(self, x: Any, kinds, neutral):
        x = self.value(x)
        if isinstance(x, kinds) and not isinstance(x, bool):
            return x
        if self.strict and x is not None:
            raise SyntaxFault(f"{x!r} instead of {kinds}")
        return neutral

    def dict(self, x: Any) -> dict:
        x = self.value(x)
        return x.attrs if isinstance(x, Stream) else self._as(x, dict, {})

    def list(self, x: Any) -> list:
        return self._as(x, list, [])

    def int(self, x: Any) -> int:
        return self._as(x, int, 0)

    def number(self, x: Any) -> float:
        return self._as(x, (int, float), 0)

    def plain(self, x: Any, depth: int = 0) -> Any:
        """x with all references replaced, each branch at most DEEPEST levels deep."""
        x = self.value(x)
        if depth > DEEPEST:
            return None
        if isinstance(x, list):
            return [self.plain(v, depth + 1) for v in x]
        if isinstance(x, dict):
            return {k: self.plain(v, depth + 1) for k, v in x.items()}
        return x

    def chain(self, attrs: dict) -> list[tuple[str, dict]]:
        names, params = self.value(attrs.get("Filter", attrs.get("F"))), self.value(attrs.get("DecodeParms", attrs.get("DP", attrs.get("FDecodeParms"))))
        names = [] if names is None else names if isinstance(names, list) else [names]
        params = params if isinstance(params, list) else [params] * len(names)
        return [(str(self.value(n)), self.dict(p) if p is not None else {}) for n, p in zip(names, params + [None] * len(names), strict=False)]

    def decoded(self, stream: Stream, plain: bool = False) -> bytes:
        return decode(stream.raw, [(n, {k: self.value(v) for k, v in p.items()}) for n, p in self.chain(stream.attrs)])

    # -- pages -----------------------------------------------------------------------------------------------------

    def pages(self) -> Iterator[tuple[int | None, dict]]:
        """(object number, attributes with what is inherited) in reading order; without a page tree, all page objects."""
        inherit = ("Resources", "MediaBox", "CropBox", "Rotate")
        stack: list[tuple[Any, dict, int]] = [(self.root.get("Pages"), {}, 0)]
        seen: set[int] = set()
        found = False
        while stack:
            node, above, depth = stack.pop()
            num = node.num if isinstance(node, Ref) else None
            if num in seen and num is not None or depth > DEEPEST:
                continue
            if num is not None:
                seen.add(num)
            attrs = self.dict(node)
            kind = self.value(attrs.get("Type", attrs.get("type")))
            own = {k: above[k] for k in inherit if k in above} | attrs
            if kind == "Pages" or "Kids" in attrs:
                stack.extend((kid, own, depth + 1) for kid in reversed(self.list(attrs.get("Kids"))))
            elif kind == "Page":
                found = True
                yield num, own
        if not found:
            for n in self.numbers():
                attrs = self.get(n)
                if isinstance(attrs, dict) and attrs.get("Type") == "Page":
                    yield n, attrs

    def box(self, x: Any) -> tuple[float, float, float, float] | None:
        items = [self.value(v) for v in self.list(x)]
        if len(items) == 4 and all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in items):
            return tuple(map(float, items))
        return None

    def contents(self, page: dict) -> list[Stream]:
        x = self.value(page.get("Contents"))
        return [s for s in (map(self.value, x) if isinstance(x, list) else [x]) if isinstance(s, Stream)]

    # -- outline, destinations, labels, forms, files ---------------------------------------------------------------

    def outline(self) -> Iterator[tuple[int, str, Any, Any, Any]]:
        """(level, title, destination, action, structure element) of entries with a title and a target, depth first."""
        seen: set[int] = set()

        def walk(x: Any, level: int) -> Iterator[tuple]:
            while isinstance(x, Ref) and x.num not in seen or isinstance(x, dict):
                if isinstance(x, Ref):
                    seen.add(x.num)
                entry = self.dict(x)
                if "Title" in entry and ("A" in entry or "Dest" in entry):
                    yield level, text_string(self.value(entry["Title"])), entry.get("Dest"), entry.get("A"), entry.get("SE")
                if "First" in entry and "Last" in entry and level < DEEPEST:
                    yield from walk(entry["First"], level + 1)
                x = entry.get("Next")

        if "Outlines" in self.root:
            yield from walk(self.dict(self.root["Outlines"]).get("First"), 1)

    def destinations(self) -> Iterator[tuple[bytes | str, Any]]:
        """(name, destination): the old dictionary, then the name tree flattened."""
        yield from self.dict(self.root.get("Dests")).items()
        yield from self._tree(self.dict(self.root.get("Names")).get("Dests"), "Names")

    def _tree(self, x: Any, leaf: str, depth: int = 0) -> Iterator[tuple[Any, Any]]:
        node = self.dict(x)
        items = self.list(node.get(leaf))
        for k, v in zip(items[::2], items[1::2], strict=False):
            yield self.value(k), v
        if depth < DEEPEST:
            for kid in self.list(node.get("Kids")):
                yield from self._tree(kid, leaf, depth + 1)

    def page_of(self, target: Any, numbers: dict[int, int], names: dict | None = None, depth: int = 0) -> int | None:
        """The page index that a destination, action or name leads to."""
        if depth > 20:
            return None
        if isinstance(target, Ref) and target.num in numbers:
            return numbers[target.num]
        target = self.value(target)
        if isinstance(target, list) and target:
            return numbers.get(target[0].num) if isinstance(target[0], Ref) else target[0] if type(target[0]) is int else None
        if isinstance(target, dict):
            return self.page_of(target.get("D"), numbers, names, depth + 1)
        if isinstance(target, (bytes, str)):
            names = dict(self.destinations()) if names is None else names
            for k in (target, target.encode() if isinstance(target, str) else target.decode("latin-1")):
                if k in names:
                    return self.page_of(names[k], numbers, names, depth + 1)
        return None

    def label_ranges(self) -> list[tuple[int, str | None, str, int]]:
        """(first page, style, prefix, first value), by page."""
        rows = []
        for at, x in self._tree(self.root.get("PageLabels"), "Nums"):
            d = self.dict(x)
            style = self.value(d.get("S"))
            rows.append((self.int(at), str(style) if style is not None else None, text_string(self.value(d.get("P", b""))), self.int(d.get("St", 1))))
        if self.strict and rows != sorted(rows, key=lambda r: r[0]):
            raise SyntaxFault("page labels out of order")
        return sorted(rows, key=lambda r: r[0])

    def form_fields(self) -> Iterator[tuple[str, Any]]:
        for x in self.list(self.dict(self.root.get("AcroForm")).get("Fields")):
            field = self.dict(x)
            value = self.value(field.get("V"))
            yield text_string(self.value(field.get("T"))), [self._field_value(v) for v in value] if isinstance(value, list) else self._field_value(value)

    def _field_value(self, v: Any) -> Any:
        v = self.value(v)
        return text_string(v) if isinstance(v, bytes) else v

    def attachments(self) -> Iterator[tuple[int, str, bytes]]:
        for n in self.numbers():
            spec = self.get(n)
            if isinstance(spec, dict) and spec.get("Type") in ("Filespec", "F"):
                name = self.value(spec.get("UF") or spec.get("F"))
                stream = self.value(self.dict(spec.get("EF")).get("UF") or self.dict(spec.get("EF")).get("F"))
                if isinstance(stream, Stream):
                    yield n, text_string(name), self.decoded(stream)


# Code points of the document encoding where it isn't Latin-1 (0x18 on, 0x80 on).
_LOW = "˘ˇˆ˙˝˛˚˜"
_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"
DOC_ENCODING = {i: chr(i) for i in range(256)} | {0x16: chr(0x17)} | {0x18 + i: c for i, c in enumerate(_LOW)} | {0x80 + i: c for i, c in enumerate(_HIGH)} | {0xA0: "€"}


def text_string(x: Any) -> str:
    """A text string of the format: UTF-16 with a byte-order mark, else the document encoding."""
    if isinstance(x, bytes):
        return x[2:].decode("utf-16-be", "ignore") if x[:2] == b"\xfe\xff" else "".join(map(DOC_ENCODING.__getitem__, x))
    return "" if x is None else str(x)


def tagged(x: Any) -> Any:
    """A value as JSON for a VARIANT column: names {"n"}, references {"r"}, operators {"k"}, bytes {"b": base64}, streams {"s": attributes}."""
    import base64

    if isinstance(x, Name):
        return {"n": str(x)}
    if isinstance(x, Op):
        return {"k": str(x)}
    if isinstance(x, Ref):
        return {"r": x.num}
    if isinstance(x, bytes):
        return {"b": base64.b64encode(x).decode()}
    if isinstance(x, Stream):
        return {"s": tagged(x.attrs)}
    if isinstance(x, list):
        return [tagged(v) for v in x]
    if isinstance(x, dict):
        return {"d": {k: tagged(v) for k, v in x.items()}}
    if isinstance(x, float) and (x != x or x in (float("inf"), float("-inf"))):
        return str(x)
    return x
