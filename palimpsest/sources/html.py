"""Blocks of HTML pages, by a tolerant parser: headings, paragraphs, list items and cells, in order."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.session import share_package

#: Elements that begin a block, and elements whose content is no text.
BLOCK_TAGS = {"p": "p", "li": "li", "td": "td", "th": "td", "title": "title", **{f"h{k}": f"h{k}" for k in range(1, 7)}}
HIDDEN = ("script", "style")
PARTING = ("div", "article", "nav", "footer", "ul", "ol", "table", "tr", "br", "body", "html", "head")


class _Blocks(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.rows: list[tuple[str, str]] = []
        self.kind, self.text, self.hidden = "text", "", 0

    def close_block(self) -> None:
        text = " ".join(self.text.split())
        if text:
            self.rows.append((self.kind, text))
        self.kind, self.text = "text", ""

    def handle_starttag(self, tag, attrs):
        if tag in HIDDEN:
            self.hidden += 1
        elif tag in BLOCK_TAGS:
            self.close_block()
            self.kind = BLOCK_TAGS[tag]
        elif tag in PARTING:
            self.close_block()

    def handle_endtag(self, tag):
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCK_TAGS or tag in PARTING:
            self.close_block()

    def handle_data(self, data):
        if not self.hidden:
            self.text += data


def block_rows(html: str | None) -> list[tuple[str, str]]:
    parser = _Blocks()
    parser.feed(html or "")
    parser.close()
    parser.close_block()
    return parser.rows


def blocks(pages: DataFrame) -> DataFrame:
    """(page_id, pos, kind, text) of pages (page_id, html)."""
    share_package(pages.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(page, n, *b) for page, html in zip(batch.column(0).to_pylist(), batch.column(1)) for n, b in enumerate(block_rows(html.as_py()))]
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.string(), pa.string()))], ["page_id", "pos", "kind", "text"])

    return pages.select("page_id", "html").mapInArrow(run, "page_id long, pos int, kind string, text string")
