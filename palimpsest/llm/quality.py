"""Quality rules by compression bands.

Repetitive text compresses far better than prose, random or encoded text far
worse. Each document is compressed with zstandard once as a whole and once in
fixed chunks; a ratio (compressed over raw bytes) outside the band of its length
class rejects it. Counts of words, symbols, repeated lines and repeated word
windows come from the same pass.

Defined results: a null text counts as empty and fails the base rule (no words);
texts under the shortest band's length are not judged by compression; repeated
rows give repeated results; an empty table gives an empty table. Documents of any
length are read whole, one at a time; memory beside the Arrow batch is some fifteen
times the longest text, most of it for its list of words. Windows of words are
compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from palimpsest.llm.words import Spans, WordHashes
from palimpsest.session import share_package

#: The bytes that part words, and the symbols that are counted.
SEPARATORS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Band:
    """Limits of the compression ratio for texts of at least ``least`` bytes."""

    least: int
    low: float
    high: float


#: By ascending length. Short texts compress worse, so their bands lie higher.
WHOLE = (Band(256, 0.40, 0.85), Band(1024, 0.43, 0.75), Band(4096, 0.39, 0.70), Band(16384, 0.36, 0.70))
#: Chunks have one length, and the last one at least half of it.
CHUNK_BYTES = 4096
CHUNK = Band(CHUNK_BYTES // 2, 0.38, 0.78)
#: The share of chunks outside their band that rejects a document.
CHUNK_SHARE = 0.5
LEVEL = 3

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, "
    "kept boolean, ratio double, worst_chunk double, chunks_out long, chunks long"
)


def repeated_words(hashes: np.ndarray, spans: Spans, width: int = 5) -> int:
    """Words in windows of ``width`` that are found twice or more, of a text's word hashes."""
    windows = spans.windows(hashes, width)
    ordered = np.sort(windows)
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return 0
    some = ordered[1:][same]
    twice = some[np.minimum(np.searchsorted(some, windows), len(some) - 1)] == windows
    edges = np.zeros(len(hashes) + 1, dtype=np.int64)  # windows that begin, less those that ended
    starts = np.flatnonzero(twice)
    edges[starts] += 1
    edges[starts + width] -= 1
    return int((np.cumsum(edges)[:-1] > 0).sum())


def repeated_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in data.split(b"\n") if x.strip(SEPARATORS)]
    return len(lines) - len(set(lines))


def band_of(size: int, bands: tuple[Band, ...]) -> Band | None:
    return next((b for b in reversed(bands) if size >= b.least), None)


class Judge:
    """The rules for one text after another; compressors are kept between texts."""

    def __init__(self, whole: tuple[Band, ...] = WHOLE, chunk: Band = CHUNK, share: float = CHUNK_SHARE):
        self.whole, self.chunk, self.share = whole, chunk, share
        self.hashes, self.spans = WordHashes(), Spans()
        self.press = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)

    def ratio(self, data: bytes) -> float:
        return len(self.press.compress(data)) / len(data)

    def compression(self, data: bytes) -> tuple[bool, float | None, float | None, int, int]:
        """Whether it stays, the whole's ratio, the chunk ratio furthest from the band's middle, chunks outside, chunks."""
        band = band_of(len(data), self.whole)
        if band is None:
            return True, None, None, 0, 0
        ratio = self.ratio(data)
        middle, worst, out, n = (self.chunk.low + self.chunk.high) / 2, None, 0, 0
        for at in range(0, len(data), CHUNK_BYTES):
            piece = data[at : at + CHUNK_BYTES]
            if len(piece) < self.chunk.least:
                break
            r, n = self.ratio(piece), n + 1
            out += not self.chunk.low <= r <= self.chunk.high
            if worst is None or abs(r - middle) > abs(worst - middle):
                worst = r
        return band.low <= ratio <= band.high and (n == 0 or out < self.share * n), ratio, worst, out, n

    def row(self, text: str | None) -> tuple:
        data = (text or "").encode()
        words = data.split()
        n = len(words)
        spaces = len(data) - len(data.translate(None, SEPARATORS))
        symbols = len(data) - len(data.translate(None, SYMBOLS))
        repeats = repeated_words(self.hashes.of(words), self.spans)
        failed = n < 10 or 100 * repeats > 20 * n
        stays, ratio, worst, out, chunks = self.compression(data)
        return n, len(text or "") - spaces, symbols, repeated_lines(data), repeats, failed, stays and not failed, ratio, worst, out, chunks


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row of counts, ratios and the verdict per row of ``docs``; columns as in :data:`SCHEMA`."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}[x.split()[1]] for x in SCHEMA.split(", ")]

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge()
        for batch in batches:
            rows = [judge.row(x.as_py()) for x in batch.column(1)]
            columns = list(zip(*rows)) if rows else [()] * (len(names) - 1)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds[1:]))], names)

    share_package(docs.sparkSession)
    return docs.select(docs[id_column].cast("long").alias("doc_id"), docs[text_column].alias("text")).mapInArrow(judged, SCHEMA)
