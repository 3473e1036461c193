"""Benchmark decontamination by SimHash windows, in DataFrame operations only.

Items and windows of documents are weighted sets of shingles (``SHINGLE``
consecutive words; the weight is the number of times a shingle stands there).

1. Windows are laid wherever one can reach the threshold. Such a window shares most
   of an item's weight, so it holds one of the item's rarest shingles (those that
   weigh more than may be missing): one pass over the texts finds these, and hands
   on the words around each, as far as an item-sized window with it may reach.
   There, a window of enough shared shingles counts if it begins with one of them
   (or ends with the text), and reaches one that the window before does not: any
   other shares no more than one of these.
2. Items and the distinct windows get a 64-bit SimHash.
3. Multi-index Hamming search: fingerprints are cut into ``BLOCKS`` blocks, and
   two within ``RADIUS`` bits agree in some block up to RADIUS // BLOCKS bits. The
   items' blocks are indexed with all values so near, the windows look up their
   own, and the full distance decides.
4. Candidates are verified by their exact weighted Jaccard similarity.

Items under ``SHINGLE`` words have one shingle, all their words, and windows of
that size are compared with them by that shingle.

The items' rarest shingles are broadcast ``BROADCAST_SHINGLES`` at a time; a larger
benchmark takes as many passes over the texts. Only the rarest are looked up, so
a phrase that many items have costs nothing. No text is shuffled: what moves are
the words around hits. Windows are reduced to distinct contents before they are
fingerprinted, so a passage in a third of all documents is one window.

A document shorter than an item has no window of its size, and the query's SQL
finds nothing there; with ``shorter`` the whole document is its window.

Defined results: null or wordless texts and items match nothing; rows with one
doc_id are one document, rows with one item_id one item each by its text; an empty
table on either side gives an empty table.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import SEPARATORS, stored

SHINGLE, THRESHOLD = 5, 0.8
BITS, BLOCKS, RADIUS = 64, 6, 17
BROADCAST_SHINGLES = 300_000


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), SEPARATORS), lambda w: w != "")


def shingle_hashes(hashes: str, width: str) -> Column:
    """Hashes of the ``width``-word shingles of a column of word hashes, in order."""
    each = F.expr(f"transform(sequence(0, size({hashes}) - {width}), i -> xxhash64(slice({hashes}, i + 1, {width})))")
    return F.when(F.expr(f"{width} > 0 and size({hashes}) >= {width}"), each).otherwise(F.array().cast("array<long>"))


def five_shingles(hashes: str) -> Column:
    """As :func:`shingle_hashes` for the usual width, without a slice per place."""
    at = ", ".join(f"{hashes}[i + {k}]" if k else f"{hashes}[i]" for k in range(SHINGLE))
    each = F.expr(f"transform(sequence(0, size({hashes}) - {SHINGLE}), i -> xxhash64({at}))")
    return F.when(F.expr(f"size({hashes}) >= {SHINGLE}"), each).otherwise(F.array().cast("array<long>"))


def simhash(weights: DataFrame, key: list[str]) -> DataFrame:
    """(key, fingerprint) of rows (key, shingle, weight): bit b is set if shingles with bit b weigh more."""
    sums = [F.sum(F.when(F.expr(f"(shiftright(shingle, {b}) & 1) = 1"), F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(BITS)]
    wide = weights.groupBy(*key).agg(*sums)
    bits = [F.when(F.col(f"b{b}") > 0, F.shiftleft(F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long")) for b in range(BITS)]
    return wide.select(*key, reduce(lambda x, y: x.bitwiseOR(y), bits).alias("fingerprint"))


def block_edges() -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    small, more = divmod(BITS, BLOCKS)
    widths = [small + (k < more) for k in range(BLOCKS)]
    return [(sum(widths[:k]), w) for k, w in enumerate(widths)]


def block(fingerprint: Column, k: int) -> Column:
    first, width = block_edges()[k]
    return F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << width) - 1).cast("long"))


def item_index(items: DataFrame) -> DataFrame:
    """(block, value, item, item_print): every block value within RADIUS // BLOCKS bits of an item's."""
    near = RADIUS // BLOCKS

    def entries(k: int) -> Column:
        width = block_edges()[k][1]
        flips = [sum(1 << b for b in some) for n in range(near + 1) for some in combinations(range(width), n)]
        own = block(F.col("fingerprint"), k)
        return F.transform(F.array(*(F.lit(f).cast("long") for f in flips)), lambda f: F.struct(F.lit(k).alias("block"), own.bitwiseXOR(f).alias("value")))

    return items.select("item", F.col("fingerprint").alias("item_print"), F.explode(F.concat(*(entries(k) for k in range(BLOCKS)))).alias("e")).select("e.block", "e.value", "item", "item_print")


def rarest_shingles(weights: DataFrame, mass: DataFrame, threshold: float) -> DataFrame:
    """(shingle, item): of each item the rarest shingles that weigh more than a window at the threshold may lack.

    A window at similarity t shares t of the item's weight at least, whatever its own.
    """
    spread = weights.groupBy("shingle").agg(F.count("*").alias("items"))
    order = Window.partitionBy("item").orderBy("items", "shingle").rowsBetween(Window.unboundedPreceding, -1)
    before = weights.join(spread, "shingle").withColumn("before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    may_lack = F.col("mass") - F.ceil(F.lit(threshold) * F.col("mass") - 1e-9)
    return before.join(mass, "item").where(F.col("before") <= may_lack).select("shingle", "item")


def surroundings(hashed: DataFrame, lookup: DataFrame, shorter: bool) -> DataFrame:
    """(doc_id, item, n, low, size, pos, words): the hashes of the words around each hit, from word ``low`` of the text on.

    ``lookup``: (shingle, items) of structs (item, n). A window of n words with the
    shingle at ``pos`` lies inside. With ``shorter``, a text of fewer words than the
    item is given whole.
    """
    found = hashed.select("doc_id", "hashes", F.posexplode(five_shingles("hashes")).alias("pos", "shingle")).join(F.broadcast(lookup), "shingle")
    hits = found.select("doc_id", "hashes", F.size("hashes").alias("size"), "pos", F.explode("items").alias("i"))
    if not shorter:
        hits = hits.where("i.n <= size")
    low = F.when(F.col("i.n") > F.col("size"), 0).otherwise(F.greatest(F.col("pos") - F.col("i.n") + SHINGLE, F.lit(0))).cast("int")
    high = F.least(F.col("pos") + F.col("i.n"), F.col("size"))
    around = F.when(F.col("i.n") > F.col("size"), F.col("hashes")).otherwise(F.slice("hashes", low + 1, high - low))
    return hits.select("doc_id", "i.item", "i.n", low.alias("low"), "size", "pos", around.alias("words"))


def window_starts(threshold: float) -> Column:
    """Places in ``words`` where a window is laid, of columns n, low, size, pos, words and of (shingles, mass) of the item."""
    places = "filter(sequence(0, size(found) - 1), i -> array_contains(shingles, found[i]))"
    #: For each hit the number of hits up to the end of the window that begins with it.
    reach = f"transform(hits, (p, i) -> i + size(filter(slice(hits, i + 1, n - {SHINGLE - 1}), q -> q < p + n - {SHINGLE - 1})))"
    enough = f"ceil({2 * threshold / (1 + threshold)} * mass - 1e-9)"
    last = "least(pos, size - n) - low"
    begins = f"filter(hits, (p, i) -> p <= {last} and reach[i] - i >= {enough} and (i = 0 or reach[i] > reach[i - 1]))"
    at_end = f"if(size - n <= pos and size(filter(hits, p -> p >= size - n - low)) >= {enough}, array(size - n - low), cast(array() as array<int>))"
    whole = f"if(size(hits) >= ceil({threshold / (1 + threshold)} * (mass + size - {SHINGLE - 1}) - 1e-9), array(0), cast(array() as array<int>))"
    laid = f"if(n > size, {whole}, array_union({begins}, {at_end}))"
    # Each step names its value once: an array of one is transformed by the next.
    return F.expr(f"flatten(transform(array({places}), hits -> flatten(transform(array({reach}), reach -> {laid}))))")


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, shorter: bool = False) -> DataFrame:
    """doc_id, item_id, shared, united, start: a row per document and item that it holds, at its best window.

    ``shared`` and ``united`` are the sums of the lesser and the greater weights;
    their quotient is the similarity. ``start`` counts words from 0.
    """
    items = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), words_of(benchmark["text"]).alias("words")).where(F.size("words") > 0)
    items = items.select("item_id", F.size("words").alias("item_words"), F.transform("words", lambda w: F.xxhash64(w)).alias("hashes"))
    items = items.withColumn("width", F.least(F.lit(SHINGLE), F.col("item_words"))).withColumn("shingles", shingle_hashes("hashes", "width"))
    # Items of one content are one item until the end; an item is named by its content.
    items = items.withColumn("item", F.xxhash64("shingles", "item_words"))
    items = stored(items.select("item_id", "item", "item_words", "width", "shingles").distinct(), "items")
    contents = stored(items.select("item", F.col("item_words").alias("n"), "width", "shingles", F.size("shingles").cast("long").alias("mass")).dropDuplicates(["item"]), "item-contents")
    item_weights = stored(contents.select("item", F.explode("shingles").alias("shingle")).groupBy("item", "shingle").agg(F.count("*").alias("weight")), "item-weights")

    hashed = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.transform(words_of(docs["text"]), lambda w: F.xxhash64(w)).alias("hashes")).where("doc_id is not null")
    usual = contents.where(F.col("width") == SHINGLE)
    rare = rarest_shingles(item_weights, usual.select("item", "mass"), threshold).join(usual.select("item", "n"), "item")
    lookup = stored(rare.groupBy("shingle").agg(F.collect_list(F.struct("item", "n")).alias("items")), "item-lookup")
    passes = max(1, -(-lookup.count() // BROADCAST_SHINGLES))
    part = F.pmod(F.xxhash64("shingle", F.lit(3)), F.lit(passes))
    around = reduce(DataFrame.unionByName, [surroundings(hashed, lookup.where(part == k) if passes > 1 else lookup, shorter) for k in range(passes)])
    around = stored(around.distinct(), "surroundings")
    near_items = usual.select("item", "mass", F.array_distinct("shingles").alias("shingles"))
    laid = around.withColumn("found", five_shingles("words")).join(near_items, "item").withColumn("at", F.explode(window_starts(threshold)))
    hashes = F.when(F.col("n") > F.col("size"), F.col("words")).otherwise(F.slice("words", F.col("at") + 1, F.col("n")))
    laid = laid.select("doc_id", (F.col("low") + F.col("at")).alias("start"), F.lit(SHINGLE).alias("width"), hashes.alias("hashes"))
    # Items under five words: their one shingle is the window.
    short = contents.where(F.col("width") < SHINGLE).select(F.col("shingles")[0].alias("shingle"), "width").distinct()
    for width in sorted(r["width"] for r in short.select("width").distinct().collect()):
        few = hashed.select("doc_id", "hashes", F.posexplode(shingle_hashes("hashes", str(width))).alias("pos", "shingle")).join(short.where(F.col("width") == width).select("shingle"), "shingle", "left_semi")
        laid = laid.unionByName(few.select("doc_id", F.col("pos").alias("start"), F.lit(width).alias("width"), F.slice("hashes", F.col("pos") + 1, width).alias("hashes")))
    windows = laid.distinct().withColumn("shingles", F.when(F.col("width") == SHINGLE, five_shingles("hashes")).otherwise(shingle_hashes("hashes", "width")))
    windows = windows.withColumn("content", F.xxhash64("shingles", F.size("hashes"))).select("doc_id", "start", "content", "shingles")
    windows = stored(windows, "windows")
    distinct = windows.groupBy("content").agg(F.first("shingles").alias("shingles"))
    weights = stored(distinct.select("content", F.explode("shingles").alias("shingle")).groupBy("content", "shingle").agg(F.count("*").alias("weight")), "window-weights")

    prints = simhash(weights, ["content"])
    blocks = F.array(*(F.struct(F.lit(k).alias("block"), block(F.col("fingerprint"), k).alias("value")) for k in range(BLOCKS)))
    asked = prints.select("content", "fingerprint", F.explode(blocks).alias("e")).select("content", "fingerprint", "e.block", "e.value")
    index = item_index(simhash(item_weights, ["item"]))
    near = asked.join(index, ["block", "value"]).where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("content", "item").distinct()

    shared = (
        near.join(weights, "content")
        .join(item_weights.withColumnRenamed("weight", "item_weight"), ["item", "shingle"])
        .groupBy("content", "item")
        .agg(F.sum(F.least("weight", "item_weight")).alias("shared"))
    )
    mass = weights.groupBy("content").agg(F.sum("weight").alias("mass"))
    item_mass = contents.select("item", F.col("mass").alias("item_mass"))
    alike = (
        shared.join(mass, "content")
        .join(item_mass, "item")
        .withColumn("united", F.col("mass") + F.col("item_mass") - F.col("shared"))
        .where(F.col("shared") >= threshold * F.col("united"))
        .select("content", "item", "shared", "united")
    )
    alike = stored(alike, "alike")
    held = windows.select("doc_id", "start", "content").join(alike, "content").join(items.select("item", "item_id"), "item")
    best = F.max_by(F.struct("shared", "united", "start"), F.struct(F.col("shared") / F.col("united"), -F.col("start"))).alias("best")
    return held.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", "best.shared", "best.united", F.col("best.start").cast("long").alias("start"))
