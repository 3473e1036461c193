"""Best-fit packing by minimum bin slack.

Packing depends on how many pieces there are of each length, and there are at most
``size`` lengths. So one histogram goes to the driver, which packs it: for each bin
the longest length left is taken and a bitset subset-sum over the available
lengths finds the fullest combination with it; the combination is removed as often
as the counts allow, which is what repeating the search would do. The plan, ranges
of ranks of each length, goes back as a table of a few thousand rows whatever the
number of documents, and each piece finds its place by its rank among the pieces
of its length. Pieces of full size fill a sequence each and need no rank.

Defined results: a null text is an empty text and still holds its end mark; a
document of over ``size`` ids is cut into pieces of ``size``, the first of which
may be shorter; repeated rows are packed once each; an empty table gives an empty
table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import dropped, stored
from palimpsest.llm.tokens import ChunkEncoder
from palimpsest.session import share_package

SIZE = 1024
END = 2
#: Ranks are counted in parts, so that a common length is no single task's: of so many pieces at least, and about so many in all.
PART_PIECES, MOST_PARTS = 256, 20_000


def fullest(counts: dict[int, int], size: int) -> dict[int, int]:
    """The combination of the longest length and others that fills a bin of ``size`` furthest.

    Bit s of ``reach[k]`` says that the first k lengths, the longest first, can
    fill s; ties prefer long pieces.
    """
    lengths = sorted(counts, reverse=True)
    top = lengths[0]
    room = size - top
    uses, reach, mask = [], [1], (1 << (room + 1)) - 1
    for n in lengths:
        if n > room:
            continue
        most = min(counts[n] - (n == top), room // n)
        bits, done, part = reach[-1], 0, 1
        while done < most:
            step = min(part, most - done)
            bits |= (bits << (step * n)) & mask
            done, part = done + step, part * 2
        if most:
            uses.append(n)
            reach.append(bits)
            if bits >> room & 1:
                break
    best = reach[-1].bit_length() - 1
    combination = {top: 1}
    for k in range(len(uses), 0, -1):
        n = uses[k - 1]
        while best and not reach[k - 1] >> best & 1:
            combination[n] = combination.get(n, 0) + 1
            best -= n
    return combination


def minimum_bin_slack(counts: dict[int, int], size: int = SIZE) -> list[tuple[dict[int, int], int]]:
    """(combination, how many bins hold it), for all of ``counts``."""
    left = {n: c for n, c in counts.items() if c}
    plan = []
    while left:
        combination = fullest(left, size)
        times = min(left[n] // k for n, k in combination.items())
        for n, k in combination.items():
            left[n] -= k * times
            if not left[n]:
                del left[n]
        plan.append((combination, times))
    return plan


def pieces(docs: DataFrame, size: int = SIZE, tokenizer_path: str | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, the end mark included."""
    share_package(docs.sparkSession)
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = ChunkEncoder(tokenizer_path), END.to_bytes(4, "little")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.ids(text.as_py() or "") + end
                n = len(ids) // 4
                first = n % size or size
                cuts = [0, *range(first, n + 1, size)]
                rows += [(doc, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
            columns = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int32() if k == 1 else pa.int64()) for k, c in enumerate(columns)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(cut, schema)


def placed(cut: DataFrame, size: int = SIZE) -> DataFrame:
    """``cut`` (a stored table of pieces) with sequence_id and offset.

    Sequences of one full piece have negative numbers.
    """
    spark = cut.sparkSession
    alone = cut.where(F.col("length") == size).withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    rest = cut.where(F.col("length") < size)
    # At most a row a length.
    counts = {r["length"]: r["n"] for r in rest.groupBy("length").agg(F.count("*").alias("n")).collect()}
    used, sequence, plan = dict.fromkeys(counts, 0), 0, []
    for combination, times in minimum_bin_slack(counts, size):
        offset = 0
        for length, k in combination.items():
            for _ in range(k):
                plan.append((length, used[length], used[length] + times, sequence, offset))
                used[length] += times
                offset += length
        sequence += times
    a_part = max(PART_PIECES, sum(counts.values()) // MOST_PARTS)
    shares = F.broadcast(spark.createDataFrame([(n, -(-c // a_part)) for n, c in counts.items()], "length long, parts long"))
    ranges = F.broadcast(spark.createDataFrame(plan, "length long, low long, high long, first long, offset long").groupBy("length").agg(F.array_sort(F.collect_list(F.struct("low", "high", "first", "offset"))).alias("ranges")))
    parted = rest.join(shares, "length").withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("parts"))).drop("parts")
    # At most ``MOST_PARTS`` rows and one for each length.
    sums = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = parted.groupBy("length", "part").agg(F.count("*").alias("n"))
    base = F.broadcast(sizes.select("length", "part", F.coalesce(F.sum("n").over(sums), F.lit(0)).alias("before")))
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "ids_crc32")
    ranked = parted.withColumn("row", F.row_number().over(order)).join(base, ["length", "part"]).withColumn("rank", F.col("before") + F.col("row") - 1).join(ranges, "length")
    at = F.filter("ranges", lambda x: (x["low"] <= F.col("rank")) & (F.col("rank") < x["high"]))[0]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    shared = ranked.withColumn("at", at).select(*columns, (F.col("at.first") + F.col("rank") - F.col("at.low")).alias("sequence_id"), F.col("at.offset").alias("offset"))
    return alone.select(*columns, "sequence_id", "offset").unionByName(shared)


def packed(docs: DataFrame, size: int = SIZE, tokenizer_path: str | None = None) -> DataFrame:
    """All documents packed into sequences of at most ``size`` ids."""
    return placed(stored(pieces(docs, size, tokenizer_path), "pieces"), size)
