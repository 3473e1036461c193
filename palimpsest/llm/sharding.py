"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked through a hub (the text's hashes), never by
pairs. Every document starts in a shard of its own hash. In each round a join with
the histogram of its hub's shards tells each linked document where most of its
neighbours are among the open shards, and as many settle there as the quotas admit,
the largest hubs first. Documents without links are ballast: they fill each shard up
to its size, which cuts no edge. The law is ``rows``: counts differ by one at
most, exactly, because final places come from ranks.

Every table of a round has a row per (hub, shard) or a few rows in all; a hub with
a third of all documents is a few rows there. Ranks are counted in buckets of about
``BUCKET_ROWS`` rows by a number that each row got when it was first written, so no
shard, no hub and no repeated doc_id is one task's.

What is cut: hubs of under ``SMALL`` documents go whole or not at all; of a larger
one, what its shard has no room for goes on together in the next round. Linked
documents left after ``ROUNDS`` rounds keep their first shard as far as it has room.

Defined results: a null text is the empty text (size 1); a null doc_id is ranked
as any other; repeated rows are documents of their own; an empty table gives an
empty table; with fewer documents than shards the first shards get one each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import bytes_plus_one, dropped, stored

SHARDS = 8
ROUNDS = 8
#: Hubs of fewer documents are taken or left as a whole.
SMALL = 64
#: Ranks are counted in buckets of about so many rows.
BUCKET_ROWS = 100_000


def quotas(total: int, shards: int) -> list[int]:
    return [total // shards + (s < total % shards) for s in range(shards)]


def admitted(asked: dict[tuple[int, int], int], room: list[float]) -> dict[tuple[int, int], float]:
    """The share of the documents asked for by (shard, level) that fits, the highest levels first; ``room`` shrinks.

    What a level could not place keeps whole shards free of lower levels, the
    emptiest ones, so that a hub larger than a shard goes on in few shards.
    """
    shares = {}
    kept: set[int] = set()
    for level in sorted({k[1] for k in asked}, reverse=True):
        left = 0.0
        for shard in sorted(k[0] for k in asked if k[1] == level):
            n = asked[shard, level]
            taken = 0.0 if shard in kept else min(n, max(0.0, room[shard]))
            room[shard] -= taken
            left += n - taken
            shares[shard, level] = taken / n
        for shard in sorted((s for s in range(len(room)) if s not in kept and room[s] >= 1), key=lambda s: (-room[s], s)):
            if left < 1:
                break
            kept.add(shard)
            left -= room[shard]
    return shares


def propagate(linked: DataFrame, rooms: list[int], shards: int, rounds: int) -> DataFrame:
    """Settles the documents of ``linked`` (doc_id, hub, shard, ...) next to their neighbours.

    ``rooms``: how many linked documents each shard may hold. In each round the
    unsettled documents of a hub ask for the open shard where most of them are; a
    shard takes the largest hubs first, and hubs that it has no room for ask again
    in the next round, as does the rest of a hub that is larger than a shard. What
    a quota cuts is decided by hash: of the hub where it is small, so that it stays
    together, else of the document.
    """
    room = [float(r) for r in rooms]
    linked = linked.withColumn("settled", F.lit(False))
    for turn in range(rounds):
        open_shards = [s for s in range(shards) if room[s] >= 1]
        if not open_shards:
            break
        shares = linked.where(~F.col("settled")).groupBy("hub", "shard").agg(F.count("*").alias("n"))
        # How many of the hub the shard could hold, then how many are there; ties go by a hash, so that hubs spread.
        rooms_now = F.element_at(F.array(*(F.lit(int(r)) for r in room)), F.col("shard") + 1)
        shares = shares.withColumn("total", F.sum("n").over(Window.partitionBy("hub")))
        order = F.struct(F.least("total", rooms_now), "n", F.xxhash64("hub", "shard"))
        best = F.max_by("shard", F.when(F.col("shard").isin(open_shards), order))
        any_open = F.element_at(F.array(*map(F.lit, open_shards)), F.pmod(F.xxhash64("hub"), F.lit(len(open_shards))).cast("int") + 1)
        wish = shares.groupBy("hub").agg(F.first("total").alias("total"), best.alias("best")).withColumn("target", F.coalesce("best", any_open)).withColumn("level", F.floor(F.log2("total")).cast("int"))
        wish = stored(wish.drop("best"), "hub-wishes")
        # A row per shard and power of two.
        asked = {(r["target"], r["level"]): r["n"] for r in wish.groupBy("target", "level").agg(F.sum("total").alias("n")).collect()}
        if not asked:
            dropped(wish)
            break
        taken = [(*k, share) for k, share in sorted(admitted(asked, room).items())]
        allowed = F.broadcast(linked.sparkSession.createDataFrame(taken, "target int, level int, share double"))
        moves = stored(wish.join(allowed, ["target", "level"]).select("hub", "target", "share", "total"), "hub-moves")
        drawn = F.when(F.col("total") < SMALL, F.xxhash64("hub", F.lit(turn))).otherwise(F.xxhash64("row", "hub", F.lit(turn)))
        luck = F.pmod(drawn, F.lit(1 << 30)) / F.lit(float(1 << 30))
        goes = ~F.col("settled") & F.coalesce(luck < F.col("share"), F.lit(False))
        moved = linked.join(moves, "hub", "left").withColumn("shard", F.when(goes, F.col("target")).otherwise(F.col("shard"))).withColumn("settled", F.col("settled") | goes)
        after = stored(moved.select(linked.columns), "linked")
        dropped(wish, moves)
        if hasattr(linked, "stored_path"):
            dropped(linked)
        linked = after
    return linked


def ranked(df: DataFrame, group: str, buckets: list[Column], order: list[str], name: str) -> DataFrame:
    """``df`` with ``name``: its rank in ``group`` by buckets, then by order, gapless from 0.

    One window over (group, buckets) and a table of offsets with a row per group
    and bucket.
    """
    keys = [f"__bucket{n}" for n in range(len(buckets))]
    keyed = df.withColumns(dict(zip(keys, buckets)))
    counts = keyed.groupBy(group, *keys).agg(F.count("*").alias("__n"))
    before = Window.partitionBy(group).orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = F.broadcast(counts.select(group, *keys, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before")))
    row = F.row_number().over(Window.partitionBy(group, *keys).orderBy(*order))
    return keyed.withColumn("__row", row).join(offsets, [group, *keys]).withColumn(name, F.col("__before") + F.col("__row") - 1).drop(*keys, "__row", "__before")


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null under this law), hub, linked."""
    spark = docs.sparkSession
    text = F.coalesce(docs["text"], F.lit(""))
    base = docs.select(
        docs["doc_id"].cast("long").alias("doc_id"),
        bytes_plus_one("text").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("hub"),
    )
    # Equal hash, checksum and size stand for equal texts.
    base = base.withColumn("hub", F.xxhash64("hub", "text_crc32", "size"))
    base = base.withColumn("row", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("row", F.lit(5)), F.lit(shards)).cast("int"))
    base = stored(base, "documents-of-shards")
    total = base.count()
    places = quotas(total, shards)
    hubs = stored(base.groupBy("hub").agg(F.count("*").alias("copies")).where("copies > 1"), "hubs")
    linked = stored(base.join(hubs, "hub"), "linked")
    linked = propagate(linked, places, shards, rounds)
    single = base.join(hubs, "hub", "left_anti")
    # Settled documents come first in their shard, then linked ones that found no room, then ballast: what a shard
    # has too many of is taken from its end.
    columns = ["doc_id", "size", "text_crc32", "hub", "shard", "row"]
    alone = single.select(*columns, F.lit(False).alias("settled"), F.lit(False).alias("linked"), F.lit(1).cast("long").alias("copies"))
    everything = linked.select(*columns, "settled", F.lit(True).alias("linked"), "copies").unionByName(alone)
    kind = F.when(F.col("settled"), 0).when(F.col("linked"), 1).otherwise(2)
    # Hubs without a place stay together in their order, and a large one is dealt to several buckets.
    buckets = F.lit(max(16, total // (shards * BUCKET_ROWS)))
    by_hub = F.pmod(F.xxhash64("hub"), buckets)
    by_row = F.pmod(F.xxhash64("row", F.lit(2)), buckets)
    parts = F.when(kind == 1, F.pmod(F.xxhash64("row", F.lit(1)), F.ceil(F.col("copies") / BUCKET_ROWS))).otherwise(0)
    first = stored(ranked(everything, "shard", [kind, F.when(kind == 1, by_hub).otherwise(by_row), parts], ["hub", "row"], "place"), "first-places")
    dropped(hubs)
    held = {r["shard"]: r["n"] for r in first.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    over = {s: max(0, held.get(s, 0) - places[s]) for s in range(shards)}
    # The rows past a shard's size take the free places of the others, in order of shards.
    free, at = [], 0
    for s in range(shards):
        short = max(0, places[s] - held.get(s, 0))
        if short:
            free.append((at, at + short, s, held.get(s, 0)))
            at += short
    starts, at = [], 0
    for s in range(shards):
        starts.append((s, places[s], at))
        at += over[s]
    # Two tables of a row a shard.
    limits = F.broadcast(spark.createDataFrame(starts, "shard int, quota long, before long"))
    spare = F.array(*(F.struct(F.lit(a).cast("long").alias("low"), F.lit(b).cast("long").alias("high"), F.lit(s).alias("shard"), F.lit(h).cast("long").alias("held")) for a, b, s, h in free or [(0, 0, 0, 0)]))
    turn = F.col("before") + F.col("place") - F.col("quota")
    target = F.filter(spare, lambda x: (x["low"] <= F.col("turn")) & (F.col("turn") < x["high"]))[0]
    out = (
        first.join(limits, "shard")
        .withColumn("turn", F.when(F.col("place") >= F.col("quota"), turn))
        .withColumn("to", F.when(F.col("turn").isNotNull(), target))
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("rows").alias("law"),
            F.coalesce(F.col("to.shard"), F.col("shard")).alias("shard"),
            F.coalesce(F.col("to.held") + F.col("turn") - F.col("to.low"), F.col("place")).alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
            "hub",
            "linked",
        )
    )
    return out


def cut_links(placed: DataFrame) -> DataFrame:
    """(hub, shards, copies) of linked texts: a hub in one shard cuts nothing."""
    return placed.where("linked").groupBy("hub", "shard").agg(F.count("*").alias("n")).groupBy("hub").agg(F.count("*").alias("shards"), F.sum("n").alias("copies"))
