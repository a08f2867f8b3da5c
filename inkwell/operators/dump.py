"""Objects as XML text, for looking into a file's structure."""

from __future__ import annotations

import re
from typing import Any

from inkwell.functions.syntax import Name, Op, Ref, Stream

_SPECIAL = re.compile("[\x00-\x1f&<>()\"'\\\\\x7f-\xff]")


def numeric_entities(s: str | bytes) -> str:
    return _SPECIAL.sub(lambda m: f"&#{ord(m[0])};", s.decode("latin-1") if isinstance(s, bytes) else s)


def object_xml(x: Any, data_of=None) -> str:
    """``data_of`` gives a stream's bytes to put them in; without it only attributes are shown."""
    match x:
        case None:
            return "<null />"
        case Ref():
            return f'<ref id="{x.num}" />'
        case Name():
            return f"<literal>{x}</literal>"
        case Op():
            return f"<keyword>{x}</keyword>"
        case dict():
            inner = "".join(f"<key>{k}</key>\n<value>{object_xml(v)}</value>\n" for k, v in x.items())
            return f'<dict size="{len(x)}">\n{inner}</dict>'
        case list():
            return f'<list size="{len(x)}">\n' + "".join(object_xml(v) + "\n" for v in x) + "</list>"
        case str() | bytes():
            return f'<string size="{len(x)}">{numeric_entities(x)}</string>'
        case Stream():
            data = data_of(x) if data_of else None
            shown = f'<data size="{len(data)}">{numeric_entities(data)}</data>\n' if data is not None else ""
            return f"<stream>\n<props>\n{object_xml(x.attrs)}\n</props>\n{shown}</stream>"
        case _:
            return f"<number>{x}</number>"


def document_xml(doc, with_data: bool = False) -> str:
    """All objects and trailers of a document; of an object that stands in several sections the newest counts."""
    data_of = doc.decoded if with_data else None
    objects = "".join(f'<object id="{n}">\n{object_xml(v, data_of)}\n</object>\n\n' for n in doc.numbers() if (v := doc.get(n)) is not None)
    trailers = "".join(f"<trailer>\n{object_xml(s.trailer)}\n</trailer>\n\n" for s in doc.sections if s.kind != "scan")
    return f"<pdf>{objects}{trailers}</pdf>"


def outline_xml(entries: list[tuple]) -> str:
    """(level, title, destination, page) rows as a table of contents."""
    rows = "".join(
        f'<outline level="{level!r}" title="{numeric_entities(title)}">\n' + (f"<dest>{object_xml(dest)}</dest>\n" if dest is not None else "") + (f"<pageno>{page}</pageno>\n" if page is not None else "") + "</outline>\n"
        for level, title, dest, page in entries
    )
    return f"<outlines>\n{rows}</outlines>\n"
