"""Word packages as tables (IO1-IO9, IO12, M18, A1): parts, relationships, blocks and tracked spans.

Packages are read with the binaryFile source, so any store that Spark reads will do;
archives are opened on the executors, one at a time. Bodies are parsed as a stream,
with one block in memory. Limits against hostile archives make a row with an error,
not a failed job.
"""

from __future__ import annotations

import io
import itertools
import re
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.session import share_package

#: Entries, bytes in all and bytes of a part at most; depth of elements at most.
MOST_ENTRIES, MOST_BYTES, MOST_PART_BYTES, MOST_DEPTH = 1000, 500 << 20, 200 << 20, 512
MAIN_PART = "word/document.xml"
#: Fixed value: what stands for an object in a text.
OBJECT = "\ufffc"

#: Namespaces of WordprocessingML and of packages.
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
TYPES = "{http://schemas.openxmlformats.org/package/2006/content-types}"

PARTS = "doc_id string, part_name string, bytes long, data binary, error string"
BLOCKS = "doc_id string, pos int, block_type string, style_id string, num_id long, ilvl int, mark string, text string"
SPANS = "doc_id string, pos int, seq int, status string, revision_id long, author string, date string, text string"


class PackageError(ValueError):
    pass


def parts_of(content: bytes) -> Iterator[tuple[str, bytes]]:
    """IO1: the parts of an archive within the limits; names that repeat, go up or start at a root are refused."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except (zipfile.BadZipFile, ValueError, OSError) as e:
        raise PackageError("not a package") from e
    entries = [e for e in archive.infolist() if not e.is_dir()]
    if len(entries) > MOST_ENTRIES:
        raise PackageError("too many entries")
    if sum(e.file_size for e in entries) > MOST_BYTES or any(e.file_size > MOST_PART_BYTES for e in entries):
        raise PackageError("too large")
    seen: set[str] = set()
    for e in entries:
        name = e.filename
        if name.startswith("/") or ".." in name.split("/"):
            raise PackageError("path leaves the package")
        if name.lower() in seen:
            raise PackageError("repeated name")
        seen.add(name.lower())
        try:
            with archive.open(e) as f:
                data = f.read(MOST_PART_BYTES + 1)
        except (zipfile.BadZipFile, zlib.error, NotImplementedError, RuntimeError, EOFError, OSError) as e:
            raise PackageError("damaged entry") from e
        if len(data) > MOST_PART_BYTES:
            raise PackageError("too large")
        yield name, data


def packed(parts: dict[str, bytes]) -> bytes:
    """IO2: an archive whose bytes depend on the parts alone: their order and one date."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as archive:
        for name, data in parts.items():
            archive.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), data, zipfile.ZIP_DEFLATED)
    return out.getvalue()


def _refused_doctype(*_) -> None:
    raise PackageError("document type")


def without_doctype(data: bytes) -> None:
    """Refuses a document type wherever it stands and however the bytes are encoded, before any entity is read."""
    parser = expat.ParserCreate()
    parser.StartDoctypeDeclHandler = _refused_doctype
    try:
        parser.Parse(data, True)
    except expat.ExpatError as e:
        raise PackageError(f"malformed: {e}") from e


def safe_events(data: bytes, events: tuple[str, ...] = ("start", "end")) -> Iterator[tuple[str, ElementTree.Element, int]]:
    """IO6: parse events with depth; document types, deep nesting and malformed text are refused."""
    without_doctype(data)
    depth = 0
    try:
        for event, element in ElementTree.iterparse(io.BytesIO(data), events=("start", "end", *(e for e in events if e not in ("start", "end")))):
            depth += event == "start"
            if depth > MOST_DEPTH:
                raise PackageError("too deep")
            if event in events:
                yield event, element, depth
            depth -= event == "end"
    except ElementTree.ParseError as e:
        raise PackageError(f"malformed: {e}") from e


def tree(data: bytes) -> ElementTree.Element:
    """IO6: the root of a part, within the limits; all parts are read through this or through :func:`safe_events`."""
    root = None
    for _, element, _ in safe_events(data, ("start",)):
        root = element if root is None else root
    if root is None:
        raise PackageError("malformed: no element")
    return root


def body_blocks(data: bytes) -> Iterator[ElementTree.Element]:
    """IO5: the body's paragraphs and tables, each freed after use."""
    trail: list[ElementTree.Element] = []
    for event, element, _ in safe_events(data):
        if event == "start":
            trail.append(element)
            continue
        trail.pop()
        if trail and trail[-1].tag == f"{W}body":
            yield element
            trail[-1].remove(element)


def _number(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isdigit() else None


#: Fields whose shown result depends on when or where it is read.
VOLATILE = ("DATE", "TIME", "NOW", "CREATEDATE", "SAVEDATE", "PRINTDATE")


def is_volatile(instruction: str) -> bool:
    """Whether a field's shown result is no part of the text."""
    return instruction.split()[:1] != [] and instruction.split()[0].upper() in VOLATILE


def settled_fields(block: ElementTree.Element) -> ElementTree.Element:
    """``block`` with one place holder for the shown result of each volatile field."""
    state, instruction, put = None, "", False
    for run in block.iter(f"{W}r"):
        for child in list(run):
            name = child.tag.removeprefix(W)
            if name == "fldChar":
                kind = child.get(f"{W}fldCharType")
                state = {"begin": "code", "separate": "result"}.get(kind or "")
                if kind == "begin":
                    instruction, put = "", False
            elif name in ("instrText", "delInstrText") and state == "code":
                instruction += child.text or ""
            elif name in ("t", "delText") and state == "result" and is_volatile(instruction):
                child.text, put = ("" if put else OBJECT), True
    for field in block.iter(f"{W}fldSimple"):
        if is_volatile(field.get(f"{W}instr") or ""):
            for n, text in enumerate(field.iter(f"{W}t")):
                text.text = "" if n else OBJECT
    return block


def spans_of(block: ElementTree.Element) -> Iterator[tuple[str, int | None, str | None, str | None, str]]:
    """IO9, M18: (status, revision id, author, date, text) of a block, in order; what is inside of both is stacked."""

    def walk(node: ElementTree.Element, ins, gone) -> Iterator[tuple[str, int | None, str | None, str | None, str]]:
        for child in node:
            name = child.tag.removeprefix(W)
            who = (_number(child.get(f"{W}id")), child.get(f"{W}author"), child.get(f"{W}date"))
            if name in ("ins", "moveTo"):
                yield from walk(child, who, gone)
            elif name in ("del", "moveFrom"):
                yield from walk(child, ins, who)
            elif name in ("t", "delText"):
                owner = gone or ins or (None, None, None)
                yield ("stacked" if ins and gone else "inserted" if ins else "deleted" if gone else "normal", *owner, child.text or "")
            elif name in ("tab", "br", "cr"):
                owner = gone or ins or (None, None, None)
                yield ("stacked" if ins and gone else "inserted" if ins else "deleted" if gone else "normal", *owner, "\t" if name == "tab" else "\n")
            elif name == "tc":
                yield from walk(child, ins, gone)
                yield ("normal", None, None, None, "\t")
            elif not name.endswith("Pr"):
                yield from walk(child, ins, gone)

    yield from walk(block, None, None)


def merged_spans(block: ElementTree.Element) -> list[tuple]:
    """Adjacent spans of one status and revision as one."""
    out: list[list] = []
    for *head, text in spans_of(block):
        if out and out[-1][:-1] == head:
            out[-1][-1] += text
        else:
            out.append([*head, text])
    return [tuple(x) for x in out]


def block_row(block: ElementTree.Element) -> tuple[str, str | None, int | None, int | None, str | None, str]:
    """(type, style, list id, list level, mark's status, text as it reads when all is accepted)."""
    kind = {"p": "paragraph", "tbl": "table"}.get(block.tag.removeprefix(W), "opaque")
    props = block.find(f"{W}pPr")
    style = num = level = mark = None
    if props is not None:
        if (s := props.find(f"{W}pStyle")) is not None:
            style = s.get(f"{W}val")
        if (n := props.find(f"{W}numPr")) is not None:
            num, level = (_number(x.get(f"{W}val")) if (x := n.find(f"{W}{k}")) is not None else None for k in ("numId", "ilvl"))
        marks = props.find(f"{W}rPr")
        if marks is not None:
            mark = "inserted" if marks.find(f"{W}ins") is not None else "deleted" if marks.find(f"{W}del") is not None else None
    text = "".join(t for status, *_, t in spans_of(block) if status in ("normal", "inserted"))
    return kind, style, num, level, mark, text


def read_packages(spark: SparkSession, path: str) -> DataFrame:
    """Packages under ``path`` as (doc_id, content): the file's path from there on is the id, so that folders may hold equal names."""
    share_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.docx").option("recursiveFileLookup", "true").load(path)
    root = re.sub(r"^[a-z0-9]+:/*", "/", path).rstrip("/")
    above = "^.*" + re.sub(r"([^A-Za-z0-9_/])", r"\\\1", root) + "/"
    return files.select(F.regexp_replace("path", above, "").alias("doc_id"), "content")


def _mapped(packages: DataFrame, schema: str, rows) -> DataFrame:
    fields = schema.split(", ")
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, content in zip(batch.column(0).to_pylist(), batch.column(1)):  # a package at a time
                columns = list(zip(*rows(doc, content.as_py() or b""))) or [()] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, fields)], [f.split()[0] for f in fields])

    share_package(packages.sparkSession)
    return packages.select("doc_id", "content").mapInArrow(run, schema)


def parts(packages: DataFrame) -> DataFrame:
    """IO1, IO3: a row per part, or one with an error."""

    def rows(doc: str, content: bytes):
        try:
            return [(doc, name, len(data), data, None) for name, data in parts_of(content)]
        except PackageError as e:
            return [(doc, None, None, None, str(e))]

    return _mapped(packages, PARTS, rows)


def parts_or_none(content: bytes) -> list[tuple[str, bytes]]:
    """The parts, or none of a package that :func:`parts` has an error row for; parts that do not parse are left out if they are XML."""
    out = []
    try:
        for name, data in parts_of(content):
            if name.endswith((".xml", ".rels")):
                try:
                    without_doctype(data)
                except PackageError:
                    continue
            out.append((name, data))
    except PackageError:
        return []
    return out


def _main(content: bytes) -> bytes | None:
    return next((data for name, data in parts_of(content) if name.lower() == MAIN_PART), None)


def blocks(packages: DataFrame) -> DataFrame:
    """IO5, IO7: the body's blocks; packages that cannot be read have one row of type error."""

    def rows(doc: str, content: bytes):
        try:
            main = _main(content)
            if main is None:
                raise PackageError("no main part")
            return [(doc, n, *block_row(b)) for n, b in enumerate(x for x in body_blocks(main) if x.tag != f"{W}sectPr")]
        except PackageError as e:
            return [(doc, -1, "error", None, None, None, None, str(e))]

    return _mapped(packages, BLOCKS, rows)


def spans(packages: DataFrame) -> DataFrame:
    """IO9: tracked spans of the body's blocks."""

    def rows(doc: str, content: bytes):
        try:
            main = _main(content)
            found = enumerate(x for x in body_blocks(main or b"<x/>") if x.tag != f"{W}sectPr")
            return [(doc, n, k, *s) for n, b in found for k, s in enumerate(merged_spans(settled_fields(b)))]
        except PackageError:
            return []

    return _mapped(packages, SPANS, rows)


def relationships(package_parts: DataFrame) -> DataFrame:
    """IO4: (doc_id, source, rel_id, rel_type, target, external) of all parts' relationships."""
    schema = "doc_id string, source string, rel_id string, rel_type string, target string, external string"

    def rows(doc: str, content: bytes):
        out = []
        for name, data in parts_or_none(content):
            if name.endswith(".rels"):
                folder, _, base = name.rpartition("_rels/")
                for r in tree(data).iter(f"{RELS}Relationship"):
                    out.append((doc, folder + base.removesuffix(".rels"), r.get("Id"), (r.get("Type") or "").rpartition("/")[2], r.get("Target"), r.get("TargetMode")))
        return out

    return _mapped(package_parts, schema, rows)


def content_types(packages: DataFrame) -> DataFrame:
    """IO4: (doc_id, sort, name, content_type): defaults by extension and overrides by part."""
    schema = "doc_id string, sort string, name string, content_type string"

    def rows(doc: str, content: bytes):
        data = next((d for n, d in parts_or_none(content) if n == "[Content_Types].xml"), None)
        if data is None:
            return []
        return [(doc, "default" if e.tag.endswith("Default") else "override", e.get("Extension") or e.get("PartName"), e.get("ContentType")) for e in tree(data)]

    return _mapped(packages, schema, rows)


def properties(packages: DataFrame) -> DataFrame:
    """IO13, IO14: core properties and settings as (doc_id, part, name, value)."""
    schema = "doc_id string, part string, name string, value string"

    def rows(doc: str, content: bytes):
        out = []
        for name, data in parts_or_none(content):
            if name.lower() in ("docprops/core.xml", "word/settings.xml"):
                for e in tree(data):
                    out.append((doc, name, e.tag.rpartition("}")[2], e.text or e.get(f"{W}val")))
        return out

    return _mapped(packages, schema, rows)


def paragraph_xml(segments: list[tuple[str, str]], author: str = "", date: str = "", mark: str = "normal") -> str:
    """IO8 for one paragraph: (status, text) segments as runs; insertions and deletions carry the author, and so does its mark's status."""
    from xml.sax.saxutils import escape, quoteattr

    who = f"w:author={quoteattr(author)}" + (f" w:date={quoteattr(date)}" if date else "")
    marks = "".join(f'<w:{k} w:id="0" {who}/>' for k, some in (("ins", ("inserted", "stacked")), ("del", ("deleted", "stacked"))) if mark in some)
    out = f"<w:pPr><w:rPr>{marks}</w:rPr></w:pPr>" if marks else ""
    for n, (status, text) in enumerate(segments):
        if not text:
            continue
        who = f"w:id={quoteattr(str(n + 1))} w:author={quoteattr(author)}" + (f" w:date={quoteattr(date)}" if date else "")
        gone = status in ("deleted", "stacked")
        run = f'<w:r><w:{"delText" if gone else "t"} xml:space="preserve">{escape(text)}</w:{"delText" if gone else "t"}></w:r>'
        run = f"<w:del {who}>{run}</w:del>" if gone else run
        out += f"<w:ins {who}>{run}</w:ins>" if status in ("inserted", "stacked") else run
    return f"<w:p>{out}</w:p>"


def document_xml(paragraphs: list[str]) -> bytes:
    return (f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>' + "".join(paragraphs) + "<w:sectPr/></w:body></w:document>").encode()


def package(paragraphs: list[str]) -> bytes:
    """IO2, IO8: a smallest valid package of these paragraphs."""
    types = (
        '<?xml version="1.0" encoding="UTF-8"?><Types xmlns="%s"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" '
        'ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>' % TYPES[1:-1]
    )
    rels = (
        '<?xml version="1.0" encoding="UTF-8"?><Relationships xmlns="%s"><Relationship Id="rId1" '
        'Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>' % RELS[1:-1]
    )
    return packed({"[Content_Types].xml": types.encode(), "_rels/.rels": rels.encode(), MAIN_PART: document_xml(paragraphs)})


def write_parts(documents: DataFrame) -> DataFrame:
    """IO2: (doc_id, content) of (doc_id, parts): an array of structs (name, text), in the archive's order."""
    share_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [packed({p["name"]: p["text"].encode() for p in doc or []}) for doc in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["doc_id", "content"])

    return documents.select(F.col("doc_id").cast("string").alias("doc_id"), "parts").mapInArrow(run, "doc_id string, content binary")


def with_parts(packages: DataFrame, changes: DataFrame) -> DataFrame:
    """IO3: packages with parts replaced or added: ``changes`` (doc_id, part_name, data); names are compared without case.

    A part keeps its place and the name that it had; new ones follow in order of name. Rows: (doc_id, content, outcome).
    """
    share_package(packages.sparkSession)
    wanted = changes.groupBy(F.col("doc_id")).agg(F.array_sort(F.collect_list(F.struct("part_name", "data"))).alias("changes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, said = [], []
            for content, changed in zip(batch.column(1), batch.column(2).to_pylist()):
                try:
                    parts, own = dict(parts_of(content.as_py() or b"")), {}
                    own = {n.lower(): n for n in parts}
                    for c in changed or []:
                        parts[own.get(c["part_name"].lower(), c["part_name"])] = c["data"]
                    out.append(packed(parts))
                    said.append("written" if changed else "unchanged")
                except PackageError as e:
                    out.append(None)
                    said.append(str(e))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary()), pa.array(said, pa.string())], ["doc_id", "content", "outcome"])

    return packages.select("doc_id", "content").join(wanted, "doc_id", "left").mapInArrow(run, "doc_id string, content binary, outcome string")


def numbered_revisions(xml: str) -> str:
    """The ids of revisions counted through a document, so that each has its own."""
    ids = itertools.count(1)
    return re.sub(r'(<w:(?:ins|del) )w:id="[0-9]+"', lambda m: f'{m[1]}w:id="{next(ids)}"', xml)


def write_redlines(redlines: DataFrame, author: str = "", date: str = "") -> DataFrame:
    """D29, IO8: (doc_id, content): packages of (doc_id, paragraphs) as :func:`palimpsest.operators.diffing.redline` has them."""
    share_package(redlines.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [package([numbered_revisions("".join(paragraph_xml([(s["status"], s["text"]) for s in p["segments"]], author, date, p["mark"]) for p in doc or []))]) for doc in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["doc_id", "content"])

    return redlines.select(F.col("doc_id").cast("string").alias("doc_id"), "paragraphs").mapInArrow(run, "doc_id string, content binary")


def write_packages(texts: DataFrame) -> DataFrame:
    """IO8: (doc_id, content) of (doc_id, segments): each document's paragraphs as arrays of (status, text)."""
    share_package(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            contents = [package([paragraph_xml([(s["status"], s["text"]) for s in p]) for p in doc or []]) for doc in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(contents, pa.binary())], ["doc_id", "content"])

    return texts.select(F.col("doc_id").cast("string").alias("doc_id"), "segments").mapInArrow(run, "doc_id string, content binary")
