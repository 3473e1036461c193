"""Other parts of packages as tables (IO13, IO14, R14-R16, R22, C5, C7, C10, C11, J15, F25): styles, numbering, comments, settings, themes, fields, controls."""

from __future__ import annotations

import copy
import io
import re
from xml.etree import ElementTree

from pyspark.sql import DataFrame

from palimpsest.functions.kernels import parse_field
from palimpsest.sources.docx import MAIN_PART, W, PackageError, _mapped, body_blocks, parts_of, tree, without_doctype

#: The namespaces of comment threads and of drawings.
W15 = "{http://schemas.microsoft.com/office/word/2012/wordml}"
W14 = "{http://schemas.microsoft.com/office/word/2010/wordml}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"

STYLES = "doc_id string, style_id string, style_type string, based_on string, is_default string, bold string, italic string, size long, align string"
LEVELS = "doc_id string, num_id long, abstract_id long, ilvl int, start int, start_override int, kind string, lvl_text string, restart int"
COMMENTS = "doc_id string, comment_id long, author string, para_id string, parent_para_id string, done string, text string"
OPAQUE = "doc_id string, pos int, kind string, name string, value string, width long, height long"


def _part(content: bytes, name: str) -> ElementTree.Element | None:
    try:
        data = next((d for n, d in parts_of(content) if n.lower() == name), None)
        return None if data is None else tree(data)
    except PackageError:
        return None


def _val(node: ElementTree.Element | None, path: str) -> str | None:
    found = None if node is None else node.find("/".join(W + p for p in path.split("/")))
    return None if found is None else found.get(f"{W}val")


def _int(value: str | None) -> int | None:
    return int(value) if value and re.fullmatch(r"-?[0-9]+", value) else None


def toggle(node: ElementTree.Element | None, path: str) -> str | None:
    """A three-state property: null inherits, else on or off."""
    found = None if node is None else node.find("/".join(W + p for p in path.split("/")))
    if found is None:
        return None
    return "off" if found.get(f"{W}val") in ("0", "false", "off", "none") else "on"


def styles(packages: DataFrame) -> DataFrame:
    """A row per style; its chain is flattened by :func:`palimpsest.operators.cascade.flattened`."""

    def rows(doc: str, content: bytes):
        root = _part(content, "word/styles.xml")
        return [] if root is None else [
            (doc, s.get(f"{W}styleId"), s.get(f"{W}type"), _val(s, "basedOn"), s.get(f"{W}default"), toggle(s, "rPr/b"), toggle(s, "rPr/i"), _int(_val(s, "rPr/sz")), _val(s, "pPr/jc"))
            for s in root.iter(f"{W}style")
        ]

    return _mapped(packages, STYLES, rows)


def numbering(packages: DataFrame) -> DataFrame:
    """A row per list instance and level, with the instance's start override."""

    def rows(doc: str, content: bytes):
        root = _part(content, "word/numbering.xml")
        if root is None:
            return []
        levels = {_int(a.get(f"{W}abstractNumId")): list(a.iter(f"{W}lvl")) for a in root.iter(f"{W}abstractNum")}
        out = []
        for num in root.iter(f"{W}num"):
            abstract = _int(_val(num, "abstractNumId"))
            overrides = {_int(o.get(f"{W}ilvl")): _int(_val(o, "startOverride")) for o in num.iter(f"{W}lvlOverride")}
            for lvl in levels.get(abstract, []):
                at = _int(lvl.get(f"{W}ilvl"))
                out.append((doc, _int(num.get(f"{W}numId")), abstract, at, _int(_val(lvl, "start")), overrides.get(at), _val(lvl, "numFmt"), _val(lvl, "lvlText"), _int(_val(lvl, "lvlRestart"))))
        return out

    return _mapped(packages, LEVELS, rows)


def comments(packages: DataFrame) -> DataFrame:
    """Comments with their thread edges."""

    def rows(doc: str, content: bytes):
        root, extended = _part(content, "word/comments.xml"), _part(content, "word/commentsextended.xml")
        edges = {} if extended is None else {e.get(f"{W15}paraId"): (e.get(f"{W15}paraIdParent"), e.get(f"{W15}done")) for e in extended}
        out = []
        for c in [] if root is None else root.iter(f"{W}comment"):
            last = [p.get(f"{W14}paraId") for p in c.iter(f"{W}p")][-1:] or [None]
            parent, done = edges.get(last[0], (None, None))
            out.append((doc, _int(c.get(f"{W}id")), c.get(f"{W}author"), last[0], parent, done, "".join(t.text or "" for t in c.iter(f"{W}t"))))
        return out

    return _mapped(packages, COMMENTS, rows)


def opaque(packages: DataFrame) -> DataFrame:
    """Fields, content controls and drawings of the body, with name, value and size."""

    def rows(doc: str, content: bytes):
        out = []
        try:
            main = next((d for n, d in parts_of(content) if n.lower() == MAIN_PART), b"<x/>")
            for pos, block in enumerate(body_blocks(main)):
                for f in block.iter(f"{W}fldSimple"):
                    out.append((doc, pos, "field", parse_field(f.get(f"{W}instr") or "")["name"], "".join(t.text or "" for t in f.iter(f"{W}t")), None, None))
                code = "".join(t.text or "" for t in block.iter(f"{W}instrText"))
                if code.strip():
                    out.append((doc, pos, "field", parse_field(code)["name"], code.strip(), None, None))
                for s in [block] * (block.tag == f"{W}sdt") + list(block.iter(f"{W}sdt") if block.tag != f"{W}sdt" else ()):
                    out.append((doc, pos, "control", _val(s, "sdtPr/tag") or _val(s, "sdtPr/alias"), "".join(t.text or "" for t in s.iter(f"{W}t")), None, None))
                for d in block.iter(f"{W}drawing"):
                    extent, props = next(d.iter(f"{WP}extent"), None), next(d.iter(f"{WP}docPr"), None)
                    size = (None, None) if extent is None else (_int(extent.get("cx")), _int(extent.get("cy")))
                    out.append((doc, pos, "drawing", None if props is None else props.get("name"), None if props is None else props.get("descr"), *size))
        except PackageError:
            pass
        return out

    return _mapped(packages, OPAQUE, rows)


SETTINGS = "doc_id string, even_and_odd boolean, update_fields boolean, tab_stop int, protection string, protection_enforced boolean, compat string, error string"


def on_off(node: ElementTree.Element | None) -> bool | None:
    """A setting of three states: null where it is not stated; what is neither on nor off is an error."""
    if node is None:
        return None
    value = node.get(f"{W}val")
    if value in (None, "1", "true", "on"):
        return True
    if value in ("0", "false", "off"):
        return False
    raise PackageError(f"{node.tag.removeprefix(W)}: neither on nor off")


def settings(packages: DataFrame) -> DataFrame:
    """IO14: settings of each package; a package without the part has nulls, one that cannot be read an error."""

    def rows(doc: str, content: bytes):
        try:
            data = next((d for n, d in parts_of(content) if n.lower() == "word/settings.xml"), None)
            if data is None:
                return [(doc, *[None] * 7)]
            root = tree(data)
            protection = root.find(f"{W}documentProtection")
            compat = sorted(f"{c.get(f'{W}name')}={c.get(f'{W}val')}" for c in root.iter(f"{W}compatSetting"))
            kind, enforced = (None, None) if protection is None else (protection.get(f"{W}edit"), protection.get(f"{W}enforcement") in ("1", "true", "on"))
            return [(doc, on_off(root.find(f"{W}evenAndOddHeaders")), on_off(root.find(f"{W}updateFields")), _int(_val(root, "defaultTabStop")), kind, enforced, ",".join(compat), None)]
        except PackageError as e:
            return [(doc, *[None] * 6, str(e))]

    return _mapped(packages, SETTINGS, rows)


A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"


def theme_fonts(packages: DataFrame) -> DataFrame:
    """(doc_id, slot, font): the fonts that a theme has for Latin, East Asian and complex scripts, in headings (major) and text (minor)."""

    def rows(doc: str, content: bytes):
        root = _part(content, "word/theme/theme1.xml")
        out = []
        for size in ("major", "minor"):
            for script in ("latin", "ea", "cs"):
                found = None if root is None else next(root.iter(f"{A}{size}Font"), None)
                font = None if found is None else found.find(f"{A}{script}")
                if font is not None and font.get("typeface"):
                    out.append((doc, f"{size}_{script}", font.get("typeface")))
        return out

    return _mapped(packages, "doc_id string, slot string, font string", rows)


M = "{http://schemas.openxmlformats.org/officeDocument/2006/math}"


def _body(content: bytes):
    main = next((d for n, d in parts_of(content) if n.lower() == MAIN_PART), b"<x/>")
    return enumerate(body_blocks(main))


def equations(packages: DataFrame) -> DataFrame:
    """(doc_id, pos, nth, xml): the equations of the body's blocks."""

    def rows(doc: str, content: bytes):
        try:
            return [(doc, pos, n, ElementTree.tostring(m, encoding="unicode")) for pos, block in _body(content) for n, m in enumerate(block.iter(f"{M}oMath"))]
        except PackageError:
            return []

    return _mapped(packages, "doc_id string, pos int, nth int, xml string", rows)


def editable_interiors(packages: DataFrame) -> DataFrame:
    """(doc_id, pos, kind, nth, tag, text): what lies inside the body's text boxes and content controls and can be edited there.

    Of nested ones the inner are listed too; a control that is locked against edits is not.
    """

    def rows(doc: str, content: bytes):
        out = []
        try:
            for pos, block in _body(content):
                nth = 0
                for node in block.iter():
                    if node.tag not in (f"{W}txbxContent", f"{W}sdt"):
                        continue
                    control = node.tag == f"{W}sdt"
                    if control and _val(node, "sdtPr/lock") in ("contentLocked", "sdtContentLocked"):
                        continue
                    paragraphs = ["".join(t.text or "" for t in p.iter(f"{W}t")) for p in node.iter(f"{W}p")] or ["".join(t.text or "" for t in node.iter(f"{W}t"))]
                    out.append((doc, pos, "control" if control else "textbox", nth, (_val(node, "sdtPr/tag") or _val(node, "sdtPr/alias")) if control else None, "\n".join(paragraphs)))
                    nth += 1
        except PackageError:
            return []
        return out

    return _mapped(packages, "doc_id string, pos int, kind string, nth int, tag string, text string", rows)


MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
#: Namespaces whose content is understood here.
UNDERSTOOD = frozenset(
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main http://schemas.openxmlformats.org/officeDocument/2006/relationships http://schemas.openxmlformats.org/officeDocument/2006/math "
    "http://schemas.openxmlformats.org/drawingml/2006/main http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing http://schemas.microsoft.com/office/word/2010/wordml "
    "http://schemas.microsoft.com/office/word/2010/wordprocessingShape".split()
)


def with_chosen_branches(data: bytes, understood: frozenset[str] = UNDERSTOOD) -> bytes:
    """A part with each choice of markup decided: the first branch all of whose namespaces are understood, else the fallback, else nothing.

    A branch that requires a prefix without a namespace is an error.
    """
    without_doctype(data)
    root, bound, scopes = None, {}, []
    choices: dict[ElementTree.Element, list[str]] = {}
    for event, found in ElementTree.iterparse(io.BytesIO(data), events=("start-ns", "start", "end", "end-ns")):
        if event == "start-ns":
            scopes.append((found[0], bound.get(found[0])))
            bound[found[0]] = found[1]
        elif event == "end-ns":
            prefix, before = scopes.pop()
            bound[prefix] = before
        elif event == "start":
            root = found if root is None else root
            if found.tag == f"{MC}Choice":
                needs = [bound.get(p) for p in (found.get("Requires") or "").split()]
                if None in needs:
                    raise PackageError("choice requires an unbound prefix")
                choices[found] = needs

    def decide(node: ElementTree.Element) -> None:
        out = []
        for child in list(node):
            if child.tag == f"{MC}AlternateContent":
                branch = next((c for c in child if c.tag == f"{MC}Choice" and understood.issuperset(choices[c])), None)
                branch = child.find(f"{MC}Fallback") if branch is None else branch
                if branch is not None:
                    decide(branch)
                    out += list(branch)
            else:
                decide(child)
                out.append(child)
        for child in list(node):
            node.remove(child)
        node.extend(out)

    decide(root)
    return ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)


def normalized_shapes(block: ElementTree.Element) -> list[str]:
    """C11: shapes that break the schema and that consumers open all the same, made regular in place; what was done, in order.

    A run inside a run becomes its neighbour; a shading pattern "none" is taken
    away, and the shading with it if nothing else is said; a table inside a
    paragraph follows the paragraph.
    """
    said: list[str] = []

    def parts_of_run(run: ElementTree.Element) -> list[ElementTree.Element]:
        out, props = [], run.find(f"{W}rPr")
        now = None
        for child in list(run):
            if child.tag == f"{W}r":
                out += parts_of_run(child) if child.find(f"{W}r") is not None else [child]
                now = None
            elif child.tag != f"{W}rPr":
                if now is None:
                    now = ElementTree.Element(run.tag, run.attrib)
                    if props is not None:
                        now.append(copy.deepcopy(props))
                    out.append(now)
                now.append(child)
        return out

    def rewrite(node: ElementTree.Element) -> None:
        out: list[ElementTree.Element] = []
        for child in list(node):
            if child.tag == f"{W}r" and child.find(f"{W}r") is not None:
                said.append("nested_run")
                flat = parts_of_run(child)
                for r in flat:
                    rewrite(r)
                out += flat
                continue
            if child.tag == f"{W}shd" and child.get(f"{W}val") == "none":
                said.append("shading_none")
                del child.attrib[f"{W}val"]
                if not child.attrib and not len(child):
                    continue
            rewrite(child)
            out.append(child)
            if child.tag == f"{W}p":
                for table in child.findall(f"{W}tbl"):
                    said.append("table_in_paragraph")
                    child.remove(table)
                    out.append(table)
        for child in list(node):
            node.remove(child)
        node.extend(out)

    rewrite(block)
    return said


MARKUP = re.compile(r"<(/?)(b|i|u|s|a)((?:\s+[a-z]+=\"[^\"]*\")*)\s*>")


def markup_runs(text: str) -> list[tuple[str, tuple[str, ...], str | None]]:
    """(text, marks, link) runs of inline markup. Tags that do not nest are an error; a lone "<" is text."""
    out: list[tuple[str, tuple[str, ...], str | None]] = []
    stack: list[str] = []
    link, at = None, 0
    for m in MARKUP.finditer(text):
        if text[at : m.start()]:
            out.append((text[at : m.start()], tuple(x for x in stack if x != "a"), link))
        at = m.end()
        if m[1]:
            if not stack or stack.pop() != m[2]:
                raise ValueError(f"</{m[2]}> closes nothing")
            link = None if m[2] == "a" else link
        else:
            stack.append(m[2])
            if m[2] == "a":
                link = (re.search(r'href="([^"]*)"', m[3]) or [None, None])[1]
    if stack:
        raise ValueError(f"<{stack[-1]}> is not closed")
    return out + ([(text[at:], (), None)] if text[at:] else [])
