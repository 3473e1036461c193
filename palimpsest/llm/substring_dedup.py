"""Removal of passages that an earlier document has: repeated-phrase automata.

A window is ``WINDOW`` consecutive words; each word covered by a window that also
starts in a document with a smaller doc_id goes.

1. One pass over the texts winnows phrases of ``PHRASE`` words: the least phrase
   hash of every window is kept, so two documents that share a window share a
   phrase. Copies of an earlier document's word sequence are settled by their
   hashes, and only the first of them goes on.
2. An aggregation confirms the phrases that recur: those of two documents at least.
3. Documents are dealt into blocks of bounded size. A block gets the recurring
   phrases that its own documents chose (never the whole dictionary), compiles them
   to an Aho-Corasick automaton over word codes, and streams its documents through
   it, which locates every occurrence; a match counts if the phrase's own hash is one
   of the block's, so words of one code do no harm. So each document is streamed
   once, and no shard is set against all documents.
4. A window belongs to the least phrase located in it. For a window that recurs
   this is its winnowed phrase in every document, so equal windows meet under
   equal phrases. Runs of windows of one phrase are compared by the hash of their
   whole span first; only where a phrase has runs of several kinds are the first
   documents' windows compared one by one.
5. Removed spans of a document are gathered, and the kept words hashed.

Hashes of phrase and window together have 128 bits. Defined results: a null text
has no words; documents under ``WINDOW`` words keep all; rows without a doc_id
keep all and do not count as earlier ones; repeated rows (one doc_id) do not
remove each other; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.common import dropped, stored
from palimpsest.llm.words import Spans, WordHashes, sliding_min
from palimpsest.session import share_package

WINDOW, PHRASE = 50, 8
#: Words of a block, about: few, so that the blocks of a task come to about as much as those of any other; and words
#: of a document that are handled at once.
BLOCK_WORDS, SLAB = 250_000, 1 << 20
_INDEX_BITS = 21
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def slabs(n: int, window: int = WINDOW, slab: int = SLAB) -> Iterator[tuple[int, int]]:
    """Parts (start, end) of a document of ``n`` words such that each window is in exactly one."""
    starts = n - window + 1
    for a in range(0, max(starts, 0), slab):
        yield a, min(a + slab, starts) + window - 1


def ordered(phrases: np.ndarray) -> np.ndarray:
    """Keys that order phrases by hash and, for equal ones, by place; the place is in the low bits."""
    low = np.uint64((1 << _INDEX_BITS) - 1)
    return (phrases & ~low) | np.arange(len(phrases), dtype=np.uint64)


def owners(keys: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """For each window the place of its least phrase; -1 where none is marked."""
    least = sliding_min(keys, window - PHRASE + 1)
    return np.where(least == _NONE, -1, (least & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64))


def winnowed(hashes: np.ndarray, spans: Spans) -> set[int]:
    """Hashes of the phrases that some window of the document has as its least."""
    found: set[int] = set()
    for a, b in slabs(len(hashes)):
        phrases = spans.windows(hashes[a:b], PHRASE)
        found.update(phrases[np.unique(owners(ordered(phrases)))].tolist())
    return found


def signed(values: np.ndarray) -> np.ndarray:
    return values.astype(np.uint64).view(np.int64)


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, tag, n_words, seq (hash of the words), all_sha256, phrases; a row per row of ``docs``."""
    share_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, spans = WordHashes(), Spans()
        for batch in batches:
            rows = []
            for text in batch.column(2):
                words = (text.as_py() or "").encode().split()
                joined = b" ".join(words)
                phrases = winnowed(hashes.of(words), spans) if len(words) >= WINDOW else ()
                values = signed(np.fromiter(phrases, dtype=np.uint64, count=len(phrases)))
                rows.append((len(words), xxhash.xxh3_128_hexdigest(joined), hashlib.sha256(joined).hexdigest(), values))
            n, seq, sha, phrases = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(seq, pa.string()), pa.array(sha, pa.string()), pa.array(phrases, pa.list_(pa.int64()))],
                ["doc_id", "tag", "n_words", "seq", "all_sha256", "phrases"],
            )

    return docs.mapInArrow(run, "doc_id long, tag long, n_words long, seq string, all_sha256 string, phrases array<long>")


def automaton_of(phrases: set[str]) -> ahocorasick.Automaton | None:
    """An automaton over the word codes of phrases. Unequal phrases may have equal codes, so it holds no hashes."""
    if not phrases:
        return None
    machine = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for codes in phrases:
        machine.add_word(codes)
    machine.make_automaton()
    return machine


def word_codes(hashes: np.ndarray) -> str:
    """A character per word; equal words have equal characters, and unequal ones seldom."""
    return (np.uint32(0xE000) + (hashes % np.uint64(0x10FFFF - 0xE000 + 1)).astype(np.uint32)).astype("<u4").tobytes().decode("utf-32-le")


_LOCATED = pa.schema([("phrase", pa.int64()), ("sig", pa.int64()), ("doc_id", pa.int64()), ("tag", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("windows", pa.list_(pa.int64()))])


def located(texts: pa.Table, recurring: pa.Table) -> pa.Table:
    """Runs of windows of a block's documents by the recurring phrase that they belong to; copies are settled and skipped."""
    known = set(recurring.column("phrase").drop_null().to_pylist())
    copies = {key for key in zip(recurring.column("copy").to_pylist(), recurring.column("tag").to_pylist()) if key[0] is not None}
    out: list[list] = [[] for _ in _LOCATED]
    if known:
        hashes, spans, phrases, docs = WordHashes(), Spans(), set(), []
        hashes_of_known = np.sort(np.fromiter(known, dtype=np.int64, count=len(known)).view(np.uint64))
        for doc, tag, text in zip(texts.column("doc_id").to_pylist(), texts.column("tag").to_pylist(), texts.column("text")):
            if (doc, tag) in copies:
                continue
            of = hashes.of((text.as_py() or "").encode().split())
            if len(of) < WINDOW:
                continue
            codes = word_codes(of)
            chosen = False
            for a, b in slabs(len(of)):
                all_phrases = spans.windows(of[a:b], PHRASE)
                places = np.unique(owners(ordered(all_phrases)))
                for at in places[among(all_phrases[places], hashes_of_known)].tolist():
                    phrases.add(codes[a + at : a + at + PHRASE])
                    chosen = True
            if chosen:
                docs.append((doc, tag, of, codes))
        machine = automaton_of(phrases)
        for doc, tag, of, codes in docs:
            for a, b in slabs(len(of)):
                _runs_of(out, machine, hashes_of_known, spans, doc, tag, a, of[a:b], codes[a:b])
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(out, _LOCATED)], schema=_LOCATED)


def among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of ``values`` are in ``some``, a sorted array that is not empty."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _runs_of(out: list[list], machine, known: np.ndarray, spans: Spans, doc: int, tag: int, base: int, of: np.ndarray, codes: str) -> None:
    phrases = spans.windows(of, PHRASE)
    places = np.fromiter((end - PHRASE + 1 for end, _ in machine.iter(codes)), dtype=np.int64)
    places = places[among(phrases[places], known)]
    values = np.full(len(phrases), _NONE, dtype=np.uint64)
    values[places] = ordered(phrases)[places]
    owner = owners(values)
    edges = np.flatnonzero(np.diff(owner)) + 1
    starts = np.concatenate([[0], edges])
    ends = np.concatenate([edges, [len(owner)]])
    held = owner[starts] >= 0
    starts, ends = starts[held], ends[held]
    if not len(starts):
        return
    prefix, windows = spans.prefix(of), signed(spans.windows(of, WINDOW))
    own = owner[starts]
    sig = spans.of(prefix, starts, ends + WINDOW - 1) ^ (np.uint64(0x9E3779B97F4A7C15) * (own - starts + 1).astype(np.uint64))
    sig ^= np.uint64(0xD6E8FEB86659FD93) * (ends - starts).astype(np.uint64)
    out[0] += signed(phrases[own]).tolist()
    out[1] += signed(sig).tolist()
    out[2] += [doc] * len(starts)
    out[3] += [tag] * len(starts)
    out[4] += (starts + base).tolist()
    out[5] += (ends - starts).tolist()
    out[6] += [windows[s:e] for s, e in zip(starts.tolist(), ends.tolist())]


def removed_spans(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(doc_id, tag, spans): word spans [start, end) that an earlier document has."""
    total = facts.agg(F.sum("n_words")).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_WORDS))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    chosen = facts.where("not copy and doc_id is not null").select(F.explode("phrases").alias("phrase"), block, "doc_id")
    pairs = stored(chosen.groupBy("phrase", "block").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")), "phrase-blocks")
    recurring = pairs.groupBy("phrase").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("phrase")
    none = F.lit(None).cast("long")
    copies = facts.where("copy").select(block, none.alias("phrase"), F.col("doc_id").alias("copy"), "tag")
    wanted = pairs.join(recurring, "phrase").select("block", "phrase", none.alias("copy"), none.alias("tag")).unionByName(copies)
    runs = stored(
        docs.where("doc_id is not null").select(block, "doc_id", "tag", "text").groupBy("block").cogroup(wanted.groupBy("block")).applyInArrow(
            located, "phrase long, sig long, doc_id long, tag long, start long, length long, windows array<long>"
        ),
        "phrase-runs",
    )
    dropped(pairs)
    kinds = stored(runs.groupBy("phrase", "sig").agg(F.min("doc_id").alias("first")), "run-kinds")
    # Kept as tables, so that the join may deal out a phrase of very many kinds to several tasks.
    several = stored(kinds.groupBy("phrase").agg(F.count("*").alias("n")).where("n > 1").select("phrase"), "phrases-of-several-kinds")
    several = stored(kinds.join(several, "phrase"), "several-kinds")
    # Runs that an earlier document has as a whole.
    span = F.struct(F.col("start"), (F.col("start") + F.col("length") + WINDOW - 1).alias("end"))
    whole = runs.select("phrase", "sig", "doc_id", "tag", span.alias("span")).join(kinds, ["phrase", "sig"]).where("first < doc_id").select("doc_id", "tag", "span")
    # The first document of each kind: its windows against those of the phrase's other kinds.
    firsts = (
        runs.join(several, ["phrase", "sig"])
        .where("first = doc_id")
        .select("phrase", "doc_id", "tag", "start", F.posexplode("windows").alias("at", "window"))
        .select("phrase", "window", "doc_id", "tag", (F.col("start") + F.col("at")).alias("start"))
    )
    firsts = stored(firsts, "first-windows")
    earliest = stored(firsts.groupBy("phrase", "window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last"), "earliest-windows")
    single = (
        firsts.join(earliest, ["phrase", "window"])
        .where("first < doc_id")
        .select("doc_id", "tag", F.struct(F.col("start"), (F.col("start") + WINDOW).alias("end")).alias("span"))
    )
    return whole.unionByName(single).groupBy("doc_id", "tag").agg(F.sort_array(F.collect_set("span")).alias("spans"))


def kept_words(texts_and_spans: DataFrame) -> DataFrame:
    """(doc_id, tag, n_removed, kept_sha256) of (doc_id, tag, spans, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for spans, text in zip(batch.column(2).to_pylist(), batch.column(3)):
                words = (text.as_py() or "").encode().split()
                kept, at = [], 0
                for s in spans:
                    if s["start"] > at:
                        kept += words[at : s["start"]]
                    at = max(at, s["end"])
                kept += words[at:]
                rows.append((len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            removed, sha = zip(*rows) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "tag", "n_removed", "kept_sha256"])

    return texts_and_spans.mapInArrow(run, "doc_id long, tag long, n_removed long, kept_sha256 string")


def deduplicated(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256; a row per row of ``docs``."""
    text = F.coalesce(docs["text"], F.lit(""))
    tagged = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64(text).alias("tag"), text.alias("text"))
    facts = stored(measured(tagged), "phrases")
    classes = stored(facts.where("n_words >= 50 and doc_id is not null").groupBy("seq").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "word-sequences")
    settled = stored(facts.join(classes, "seq", "left").withColumn("copy", F.coalesce(F.col("first") < F.col("doc_id"), F.lit(False))).drop("first", "seq"), "settled")
    dropped(facts, classes)
    copies = settled.where("copy").select("doc_id", "tag").distinct()
    spans = removed_spans(tagged, settled)
    partly = spans.join(copies, ["doc_id", "tag"], "left_anti")
    rest = kept_words(tagged.join(partly, ["doc_id", "tag"]).select("doc_id", "tag", "spans", "text")).dropDuplicates(["doc_id", "tag"])
    nothing = hashlib.sha256(b"").hexdigest()
    return settled.join(rest, ["doc_id", "tag"], "left").select(
        "doc_id",
        "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copy"), F.lit(nothing)).otherwise(F.coalesce("kept_sha256", "all_sha256")).alias("kept_sha256"),
    )
