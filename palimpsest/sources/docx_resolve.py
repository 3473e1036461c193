"""Resolution inside packages (M4-M7, M16, IO11, IO12): accept or reject everything, on the XML itself.

A search of the bytes decides whether a package can have revisions at all, whatever
its prefixes and encoding; one without is passed on as it is. Paragraphs whose mark goes away merge into the next
one, whose properties win.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.session import share_package
from palimpsest.sources.docx import W, PackageError, _mapped, packed, parts_of, safe_events, tree

#: What marks a revision: elements under any prefix, with wrappers by what accepting does.
MARKS = re.compile(rb"<(?:[^\s<>/:]+:)?(?:ins|del|moveFrom|moveTo|cellIns|cellDel|cellMerge|numberingChange|[A-Za-z]+PrChange|tblGridChange)[\s/>]")
ADDED, REMOVED = (f"{W}ins", f"{W}moveTo"), (f"{W}del", f"{W}moveFrom")
#: Markers without width, which a join of paragraphs steps over (M3).
MARKERS = frozenset(
    f"{W}{name}"
    for name in (
        "bookmarkStart bookmarkEnd commentRangeStart commentRangeEnd proofErr permStart permEnd moveFromRangeStart moveFromRangeEnd moveToRangeStart moveToRangeEnd customXmlInsRangeStart customXmlInsRangeEnd "
        "customXmlDelRangeStart customXmlDelRangeEnd customXmlMoveFromRangeStart customXmlMoveFromRangeEnd customXmlMoveToRangeStart customXmlMoveToRangeEnd"
    ).split()
)
#: Prefixes that written parts keep.
PREFIXES = {
    "w": W[1:-1],
    "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships",
    "wp": "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "a": "http://schemas.openxmlformats.org/drawingml/2006/main",
    "m": "http://schemas.openxmlformats.org/officeDocument/2006/math",
    "mc": "http://schemas.openxmlformats.org/markup-compatibility/2006",
    "w14": "http://schemas.microsoft.com/office/word/2010/wordml",
}
for prefix, uri in PREFIXES.items():
    ElementTree.register_namespace(prefix, uri)
COUNTS = "doc_id string, part string, insertions long, deletions long, moves long, property_changes long, cells long, comment_anchors long, error string"


def has_revisions(data: bytes) -> bool:
    """Whether a part may hold revisions; one in another encoding than UTF-8 may."""
    head = data[:200]
    plain = not head.startswith((b"\xff\xfe", b"\xfe\xff")) and (b"encoding" not in head or re.search(rb"encoding\s*=\s*[\"'](?:utf-8|us-ascii)", head, re.I) is not None)
    return not plain or MARKS.search(data) is not None


def counted_part(data: bytes) -> list[int]:
    """Insertions, deletions, moves, property changes, cells and comment anchors of a part, by name and namespace."""
    counts = [0] * 6
    for _, element, _ in safe_events(data, ("start",)):
        name = element.tag.removeprefix(W)
        if name == element.tag:
            continue
        for k, some in enumerate((("ins",), ("del",), ("moveFrom", "moveTo"), (), ("cellIns", "cellDel"), ("commentRangeStart",))):
            counts[k] += name in some
        counts[3] += name.endswith("PrChange")
    return counts


def preflight(packages: DataFrame) -> DataFrame:
    """IO12, A1: counters of each part. A part or package that cannot be read has a row with an error."""

    def rows(doc: str, content: bytes):
        out = []
        try:
            for n, d in parts_of(content):
                if n.startswith("word/") and n.endswith(".xml"):
                    try:
                        out.append((doc, n, *(counted_part(d) if has_revisions(d) or b"commentRangeStart" in d else [0] * 6), None))
                    except PackageError as e:
                        out.append((doc, n, *[None] * 6, str(e)))
        except PackageError as e:
            return [(doc, None, *[None] * 6, str(e))]
        return out

    return _mapped(packages, COUNTS, rows)


def _resolve(node: ElementTree.Element, accept: bool) -> None:
    """Children of ``node`` in place: kept wrappers are unwrapped, others dropped, property changes settled."""
    keep, drop = (ADDED, REMOVED) if accept else (REMOVED, ADDED)
    children: list[ElementTree.Element] = []
    for child in list(node):
        if child.tag in drop or (child.tag in keep and not len(child)):  # an empty one is a mark of its parent, which is settled
            continue
        if child.tag in keep:
            _resolve(child, accept)
            children += list(child)
            continue
        if child.tag.endswith("PrChange"):
            if not accept:
                previous = next(iter(child), None)
                children = list(previous) if previous is not None else []
            continue
        if child.tag == f"{W}tr" and _row_goes(child, accept):
            continue
        if child.tag == f"{W}delText":
            child.tag = f"{W}t"
        _resolve(child, accept)
        if child.tag == f"{W}tbl" and not child.findall(f"{W}tr"):
            continue
        children.append(child)
    for child in list(node):
        node.remove(child)
    node.extend(children)


def _row_goes(row: ElementTree.Element, accept: bool) -> bool:
    props = row.find(f"{W}trPr")
    ins, gone = (props is not None and props.find(f"{W}{k}") is not None for k in ("ins", "del"))
    return bool(gone if accept else ins)


def _mark(paragraph: ElementTree.Element, accept: bool) -> bool:
    """Whether the paragraph's mark goes away; its own mark revisions are taken off."""
    marks = paragraph.find(f"{W}pPr/{W}rPr")
    if marks is None:
        return False
    ins, gone = marks.find(f"{W}ins"), marks.find(f"{W}del")
    for m in (ins, gone):
        if m is not None:
            marks.remove(m)
    return (gone if accept else ins) is not None


def resolved_xml(data: bytes, accept: bool) -> bytes:
    """M5-M7 on one part."""
    if not has_revisions(data):
        return data
    root = tree(data)
    merges = {id(p) for p in root.iter(f"{W}p") if _mark(p, accept)}
    _resolve(root, accept)
    for parent in root.iter():
        waiting: list[ElementTree.Element] = []
        for child in list(parent):
            if child.tag != f"{W}p":
                if child.tag not in MARKERS:  # any other content parts the paragraphs; emptied tables are gone already
                    waiting = []
                continue
            if waiting:
                first = 1 if child.find(f"{W}pPr") is not None else 0
                moved = [x for w in waiting for x in w if x.tag != f"{W}pPr"]
                for n, x in enumerate(moved):
                    child.insert(first + n, x)
                for w in waiting:
                    parent.remove(w)
                waiting = []
            if id(child) in merges:
                waiting = [child]
    return ElementTree.tostring(root, encoding="utf-8", xml_declaration=True)


def resolved_fragment(xml: str, accept: bool) -> str:
    """A piece of a body, such as an opaque block kept as it was, with its revisions settled."""
    spaces = "".join(f' xmlns:{p}="{u}"' for p, u in PREFIXES.items())
    whole = resolved_xml(f"<w:body{spaces}>{xml}</w:body>".encode(), accept)
    return "".join(ElementTree.tostring(x, encoding="unicode") for x in tree(whole))


def resolved(packages: DataFrame, accept: bool) -> DataFrame:
    """M5: (doc_id, content, outcome): packages with all revisions accepted, or all rejected."""
    share_package(packages.sparkSession)

    def one(content: bytes) -> tuple[bytes | None, str]:
        try:
            parts = dict(parts_of(content))
            if not any(has_revisions(d) for n, d in parts.items() if n.endswith(".xml")):
                return content, "unchanged"
            return packed({n: resolved_xml(d, accept) if n.startswith("word/") and n.endswith(".xml") else d for n, d in parts.items()}), "resolved"
        except PackageError as e:
            return None, str(e)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [one(c.as_py() or b"") for c in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], ["doc_id", "content", "outcome"])

    return packages.select("doc_id", "content").mapInArrow(run, "doc_id string, content binary, outcome string")


def commit_new(packages: DataFrame, target: str) -> DataFrame:
    """IO11: writes to a folder that must not exist, and returns (doc_id, sha256, bytes, verified).

    Rows are written once, with their digests, to a folder beside the target, read
    back and checked; only if all hold is the folder renamed. Else it is removed,
    and the rows that failed are in the error.
    """
    spark = packages.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path(target)):
        raise FileExistsError(f"{target} exists")
    staged = f"{target.rstrip('/')}.staged-{uuid.uuid4().hex}"
    schema = "doc_id string, content binary, sha256 string, bytes long"
    try:
        packages.select("doc_id", "content", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("bytes")).write.parquet(staged)
        back = spark.read.schema(schema).parquet(staged)
        bad = back.where((F.sha2("content", 256) != F.col("sha256")) | (F.octet_length("content") != F.col("bytes"))).select("doc_id").limit(5).collect()
        if bad:
            raise OSError(f"written rows differ: {[r['doc_id'] for r in bad]}")
        if fs.exists(path(target)) or not fs.rename(path(staged), path(target)):
            raise FileExistsError(f"{target} exists")
    finally:
        fs.delete(path(staged), True)
    return spark.read.schema(schema).parquet(target).select("doc_id", "sha256", "bytes", F.lit(True).alias("verified"))


def digest(content: bytes) -> str:
    return hashlib.sha256(content).hexdigest()
