"""N-gram Jaccard self-join with Bayesian candidate pruning.

Documents are sets of shingles (``SHINGLE`` consecutive words; a shorter document
is one shingle). Texts of equal word sequences are one text, kept once.

1. MinHash signatures (``HASHES`` values) and band keys come from one pass. Two
   texts at the threshold share a band but for a chance of 5e-8.
2. In each bucket of a band, pairs are compared value by value, ``STEP`` MinHash
   values at a time; a pair is dropped when the posterior probability that its
   similarity reaches the threshold (uniform prior) falls below ``TOLERANCE``. A
   bucket hands on a forest that spans its surviving pairs, never the pairs.
3. Forests join to groups; the texts of a group meet in cells of bounded size,
   where surviving pairs are verified exactly on their shingle sets. A cell hands
   on each text's number of links and a forest of the verified links.
4. Forests of verified links join to classes.

A bucket or a group of any size is split into cells of two parts of about
``BUCKET_CELL`` or ``GROUP_CELL`` texts, and of ``CELL_BYTES`` of shingles, so no
task holds it whole, however long its texts are; no cap is set.

Defined results: a null text has no words; texts without words are equal texts; a
null doc_id gets the class of its equal texts, or null; rows with one doc_id are
one document; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import components, dropped, stored
from palimpsest.llm.words import Spans, WordHashes, mixed
from palimpsest.session import share_package

SHINGLE, THRESHOLD = 5, 0.8
HASHES, ROWS = 128, 4
STEP, TOLERANCE = 16, 1e-6
BUCKET_CELL, GROUP_CELL, CELL_BYTES = 1024, 256, 8 << 20

_SEEDS = (mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def shingles(of: np.ndarray, spans: Spans, width: int = SHINGLE) -> np.ndarray:
    """The sorted set of shingle hashes of a document's word hashes."""
    if not len(of):
        return of
    return np.unique(spans.windows(of, min(width, len(of))))


def signature(found: np.ndarray) -> np.ndarray:
    """MinHash values: for each seed the least of shingle times seed, in 32 bits."""
    least, short = np.full(HASHES, 0xFFFFFFFF, dtype=np.uint32), (found >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(found), 1024):
        np.minimum(least, (short[at : at + 1024, None] * _SEEDS).min(axis=0), out=least)
    return least.astype(np.uint64)


def band_keys(least: np.ndarray) -> np.ndarray:
    """A key per band of ``ROWS`` values; the band's number is part of it."""
    key = np.arange(HASHES // ROWS, dtype=np.uint64)
    for k in range(ROWS):
        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + least[k::ROWS])
    return key


def compared_bytes(least: np.ndarray) -> bytes:
    """A byte of each MinHash value, mixed: the top byte of a minimum itself is nearly always 0 in a long text."""
    return (mixed(least) >> np.uint64(56)).astype(np.uint8).tobytes()


def least_matches(threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> list[tuple[int, int]]:
    """(values compared, least matches to go on). With a uniform prior and m of n matches, the similarity
    s has a Beta(m + 1, n - m + 1) posterior, and P(s >= t) = P(Binomial(n + 1, t) <= m)."""
    t = threshold + (1 - threshold) / 256  # values are compared by one byte
    out = []
    for n in range(STEP, HASHES + 1, STEP):
        below, m = 0.0, 0
        while (below := below + comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)) < tolerance:
            m += 1
        out.append((n, m))
    return out


def survivors(one: np.ndarray, others: np.ndarray, limits: list[tuple[int, int]]) -> np.ndarray:
    """Places in ``others`` (texts x HASHES bytes) of those not dropped against ``one``."""
    at, matches, before = np.arange(len(others)), np.zeros(len(others), dtype=np.int64), 0
    for n, least in limits:
        if not len(at):
            break
        matches = matches + (others[at, before:n] == one[before:n]).sum(axis=1)
        stay = matches >= least
        at, matches, before = at[stay], matches[stay], n
    return at


class Forest:
    """Disjoint sets of the rows of a cell."""

    def __init__(self, n: int):
        self.parent = list(range(n))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = x = self.parent[self.parent[x]]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)


def parts_of(size: Column, most: int) -> Column:
    return F.greatest(F.ceil(size / F.lit(float(most))), F.lit(1)).cast("long")


def in_cells(rows: DataFrame, group: str, parts: Column) -> DataFrame:
    """``rows`` with ``cell`` and ``side``: one copy for each cell of a pair of parts.

    A group is dealt into ``parts`` by hash; row r of part i goes to the cells
    (min(i, j), max(i, j)) of all parts j. Side 0 is the cell's first part.
    """
    split = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("key", F.lit(11)), F.col("parts")))
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("other")
    spread = split.select("*", other)
    low, high = F.least("part", "other"), F.greatest("part", "other")
    return spread.withColumn("cell", F.xxhash64(group, low, high)).withColumn("side", F.when(F.col("part") == F.col("other"), 2).when(F.col("part") < F.col("other"), 0).otherwise(1)).drop("parts", "part", "other")


def cell_pairs(sides: list[int]) -> Iterator[tuple[int, np.ndarray]]:
    """For each row of a cell, the rows that it is compared with: each pair once."""
    side = np.array(sides)
    if (side == 2).all():
        for i in range(len(side) - 1):
            yield i, np.arange(i + 1, len(side))
    else:
        right = np.flatnonzero(side == 1)
        for i in np.flatnonzero(side == 0):
            yield int(i), right


def streamed(columns: list[str], of_cell: Callable, schema: pa.Schema):
    """A mapInArrow function for partitions sorted by their first column: calls ``of_cell`` once a cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list] = [[] for _ in columns]
        out: list[list] = [[] for _ in schema]

        def flush() -> None:
            if len(held[0]) > 1:
                for c, more in zip(out, of_cell(*held[1:])):
                    c += more
            for c in held:
                c.clear()

        for batch in batches:
            rows = [batch.column(k).to_pylist() for k in range(len(columns))]
            for row in zip(*rows):
                if held[0] and held[0][0] != row[0]:
                    flush()
                for c, v in zip(held, row):
                    c.append(v)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)
                for c in out:
                    c.clear()
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema)], schema=schema)

    return run


def by_cell(rows: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select(*columns).repartition("cell").sortWithinPartitions("cell", "key")


def signed_texts(docs: DataFrame) -> DataFrame:
    """doc_id, seq (hash of the word sequence), bands, sig (a byte of each MinHash value)."""
    share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, spans = WordHashes(), Spans()
        for batch in batches:
            rows = []
            for text in batch.column(1):
                words = (text.as_py() or "").encode().split()
                least = signature(shingles(hashes.of(words), spans))
                bands = band_keys(least).view(np.int64) if words else None
                rows.append((xxhash.xxh3_128_hexdigest(b" ".join(words)), bands, compared_bytes(least)))
            seq, bands, sig = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(seq, pa.string()), pa.array(bands, pa.list_(pa.int64())), pa.array(sig, pa.binary())], ["doc_id", "seq", "bands", "sig"]
            )

    return docs.mapInArrow(run, "doc_id long, seq string, bands array<long>, sig binary")


def candidate_groups(texts: DataFrame) -> DataFrame:
    """(id, class_id): groups of ``texts`` (key, bands, sig) that hold every pair which pruning keeps."""
    limits = least_matches()
    rows = texts.select("key", F.explode("bands").alias("bucket"))
    counts = rows.groupBy("bucket").agg(F.count("*").alias("members")).where("members > 1")
    members = stored(rows.join(counts, "bucket"), "bucket-members")
    cells = in_cells(members.join(texts.select("key", "sig"), "key"), "bucket", parts_of(F.col("members"), BUCKET_CELL))

    def forest(keys: list[int], sides: list[int], sigs: list[bytes]) -> tuple[list, list]:
        values = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(sigs), HASHES)
        sets = Forest(len(keys))
        for i, others in cell_pairs(sides):
            for j in others[survivors(values[i], values[others], limits)].tolist():
                sets.join(i, j)
        pairs = [(k, r) for k in range(len(keys)) if (r := sets.root(k)) != k]
        return [keys[k] for k, _ in pairs], [keys[r] for _, r in pairs]

    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
    columns = ["cell", "key", "side", "sig"]
    links = by_cell(cells, columns).mapInArrow(streamed(columns, forest, schema), "a long, b long")
    groups = components(links, "candidates")
    dropped(members)
    return groups


def verified(texts: DataFrame, groups: DataFrame, threshold: float) -> DataFrame:
    """(key, links, root): in each cell a text's number of verified links, and the least row that it is linked with."""
    limits = least_matches(threshold)
    owned = groups.join(texts.select(F.col("key").alias("id"), F.octet_length("shingles").cast("long").alias("bytes")), "id")
    sized = owned.groupBy("class_id").agg(F.count("*").alias("members"), F.sum("bytes").alias("bytes"))
    rows = texts.join(groups.join(sized, "class_id").select(F.col("id").alias("key"), "class_id", "members", "bytes"), "key")
    cells = in_cells(rows, "class_id", F.greatest(parts_of(F.col("members"), GROUP_CELL), parts_of(F.col("bytes"), CELL_BYTES)))

    def exact(keys: list[int], sides: list[int], sigs: list[bytes], sets: list[bytes]) -> tuple[list, list, list]:
        values = np.frombuffer(b"".join(sigs), dtype=np.uint8).reshape(len(sigs), HASHES)
        found = [np.frombuffer(s, dtype=np.uint64) for s in sets]
        sizes = np.array([len(f) for f in found])
        vocabulary, ids = np.unique(np.concatenate(found), return_inverse=True)
        ids = np.split(ids, np.cumsum(sizes)[:-1])
        links, forest, here = np.zeros(len(keys), dtype=np.int64), Forest(len(keys)), np.zeros(len(vocabulary), dtype=np.int64)
        for i, others in cell_pairs(sides):
            near = others[survivors(values[i], values[others], limits)]
            near = near[sizes[near] > 0]
            if not len(near) or not sizes[i]:
                continue
            here[ids[i]] = 1
            starts = np.concatenate([[0], np.cumsum(sizes[near])[:-1]])
            both = np.add.reduceat(here[np.concatenate([ids[j] for j in near])], starts)
            here[ids[i]] = 0
            linked = near[both >= threshold * (sizes[i] + sizes[near] - both) - 1e-9]
            links[i] += len(linked)
            links[linked] += 1
            for j in linked.tolist():
                forest.join(i, j)
        some = np.flatnonzero(links).tolist()
        return [keys[k] for k in some], links[some].tolist(), [keys[forest.root(k)] for k in some]

    schema = pa.schema([("key", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])
    columns = ["cell", "key", "side", "sig", "shingles"]
    return by_cell(cells, columns).mapInArrow(streamed(columns, exact, schema), "key long, links long, root long")


def with_shingles(texts: DataFrame) -> DataFrame:
    """(key, sig, shingles) of (key, sig, text): the sorted shingle set as 64-bit values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, spans = WordHashes(), Spans()
        for batch in batches:
            sets = [shingles(hashes.of((t.as_py() or "").encode().split()), spans).tobytes() for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sets, pa.binary())], ["key", "sig", "shingles"])

    return texts.mapInArrow(run, "key long, sig binary, shingles binary")


def jaccard_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, text_id, links; a row per row of ``docs``.

    ``text_id``: the least doc_id of an equal word sequence. ``links``: different
    texts of at least the threshold's similarity. ``class_id``: the least doc_id
    that equal texts and links lead to.
    """
    plain = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    signed = stored(signed_texts(plain), "signatures")
    firsts = stored(signed.groupBy("seq").agg(F.min("doc_id").alias("text_id")), "equal-texts")
    members = signed.select("doc_id", "seq").join(firsts, "seq")
    owners = signed.where("doc_id is not null and bands is not null").join(firsts, "seq").where("doc_id = text_id")
    texts = stored(owners.select(F.col("text_id").alias("key"), "bands", "sig").dropDuplicates(["key"]), "texts")
    groups = candidate_groups(texts)
    chosen = texts.select("key", "sig").join(groups.select(F.col("id").alias("key")), "key")
    sets = plain.join(chosen, plain["doc_id"] == chosen["key"]).select("key", "sig", "text")
    sets = stored(with_shingles(sets).dropDuplicates(["key"]), "shingle-sets")
    links = stored(verified(sets, groups, threshold), "links")
    classes = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")), "classes").withColumnRenamed("id", "text_id")
    counts = links.groupBy(F.col("key").alias("text_id")).agg(F.sum("links").alias("links"))
    dropped(texts, sets)
    found = stored(counts.join(classes, "text_id", "left"), "linked-texts")
    return members.join(found, "text_id", "left").select("doc_id", F.coalesce("class_id", "text_id").alias("class_id"), "text_id", F.coalesce("links", F.lit(0).cast("long")).alias("links"))
