"""Packages as relations of their XML: parts, errors, elements and namespaces, in one pass (IO4, IO6).

Validation and other questions that cross parts are joins over these. Names and
attributes carry the usual prefix of their namespace whatever prefix the file has,
so a rule reads w:p, r:id or m:oMath; the package's own elements have none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame

from palimpsest.sources.docx import PackageError, _mapped, parts_of, safe_events

#: Namespaces and the prefixes that names are given here; "" stands for names without one.
NAMESPACES = {
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main": "w",
    "http://schemas.openxmlformats.org/officeDocument/2006/relationships": "r",
    "http://schemas.openxmlformats.org/officeDocument/2006/math": "m",
    "http://schemas.openxmlformats.org/markup-compatibility/2006": "mc",
    "http://schemas.openxmlformats.org/drawingml/2006/main": "a",
    "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing": "wp",
    "http://schemas.openxmlformats.org/drawingml/2006/picture": "pic",
    "urn:schemas-microsoft-com:vml": "v",
    "urn:schemas-microsoft-com:office:office": "o",
    "urn:schemas-microsoft-com:office:word": "w10",
    "http://www.w3.org/XML/1998/namespace": "xml",
    "http://schemas.microsoft.com/office/word/2010/wordml": "w14",
    "http://schemas.microsoft.com/office/word/2012/wordml": "w15",
    "http://schemas.openxmlformats.org/package/2006/relationships": "",
    "http://schemas.openxmlformats.org/package/2006/content-types": "",
}

FACTS = "doc_id string, fact string, part string, seq int, parent int, name string, path string, attributes string, value string"


def short(name: str) -> str:
    """A name as prefix:local; of unknown namespaces with x."""
    uri, _, local = name.rpartition("}")
    if not uri:
        return local
    prefix = NAMESPACES.get(uri[1:], "x")
    return f"{prefix}:{local}" if prefix else local


def listed(attributes: dict[str, str]) -> str:
    """Attributes as one string, to be read with str_to_map by the signs 1e and 1f."""
    return "\x1e".join(f"{short(k)}\x1f{re.sub('[\x1e\x1f]', ' ', v)}" for k, v in attributes.items())


def element_rows(data: bytes) -> Iterator[tuple]:
    """(fact, seq, parent, name, path, attributes, value) of a part's elements and of its namespaces (prefix as name)."""
    trail: list[tuple[int, str]] = []
    prefixes, used = {}, set()
    seq = -1
    for event, found, _ in safe_events(data, ("start", "end", "start-ns")):
        if event == "start-ns":
            prefixes.setdefault(found[0], found[1])
            continue
        if event == "end":
            trail.pop()
            found.clear()
            continue
        seq += 1
        name = short(found.tag)
        path = f"{trail[-1][1] if trail else ''}/{name}"
        used.update(x[1:].partition("}")[0] for x in (found.tag, *found.attrib) if x.startswith("{"))
        yield "element", seq, trail[-1][0] if trail else None, name, path, listed(found.attrib), None
        trail.append((seq, path))
    for prefix, uri in prefixes.items():
        if prefix and uri in used:
            yield "namespace", None, None, prefix, None, None, uri


def package_facts(packages: DataFrame) -> DataFrame:
    """The relations of all packages as one table; ``fact`` is part, error, element or namespace.

    A part has its name and bytes. An error has the rule that it breaks as its name.
    """

    def rows(doc: str, content: bytes):
        out: list[tuple] = []
        try:
            for name, data in parts_of(content):
                out.append((doc, "part", name, None, None, name, None, None, str(len(data))))
                if not name.endswith((".xml", ".rels")):
                    continue
                try:
                    out += [(doc, r[0], name, *r[1:]) for r in element_rows(data)]
                except PackageError as e:
                    out.append((doc, "error", name, None, None, "I-NS-002" if "unbound prefix" in str(e) else "I-XML-001", None, None, str(e)))
        except PackageError as e:
            return [(doc, "error", None, None, None, "I-PKG-003" if str(e) == "repeated name" else "I-PKG-000", None, None, str(e))]
        return out

    return _mapped(packages, FACTS, rows)

