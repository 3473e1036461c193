"""Audit of two versions (V1-V11, A11): what changed without attribution, and proof that the rest did not."""

from __future__ import annotations

from math import ceil, log2

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.operators import matching, revisions
from palimpsest.session import share_package
from palimpsest.tables import stored


def direct_delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """V3: blocks that differ between the rejected views: changes that no revision accounts for.

    A multiset difference by occurrence on each side; equal blocks meet in one join.
    """
    keys = ["doc_id", "text"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("pos"))
    a = before.withColumn("nth", nth).select(*keys, "nth", F.col("pos").alias("base_pos"))
    b = after.withColumn("nth", nth).select(*keys, "nth", F.col("pos").alias("target_pos"))
    both = a.join(b, [*keys, "nth"], "full").where("base_pos is null or target_pos is null")
    return both.select("doc_id", "base_pos", "target_pos", F.when(F.col("base_pos").isNull(), "inserted").otherwise("deleted").alias("change_type"))


def annotated(rows: DataFrame, revisions: DataFrame) -> DataFrame:
    """V4: direct rows with the prior revisions at their block."""
    ids = revisions.groupBy("doc_id", F.col("pos").alias("base_pos")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("revision_id")), lambda x: x.cast("string")), ",").alias("prior"))
    return rows.join(ids, ["doc_id", "base_pos"], "left")


def untouched_proof(before: DataFrame, after: DataFrame, mentioned_before: DataFrame, mentioned_after: DataFrame, implicated_before: DataFrame | None = None, implicated_after: DataFrame | None = None) -> DataFrame:
    """V5: blocks that no change mentions, paired by order. A document has one row: how many were proved, and its first violation.

    Blocks that a direct change mentions are left out of the order; a pair of which
    a revision implicates either block is passed over.
    """

    def rest(blk: DataFrame, mentioned: DataFrame, implicated: DataFrame | None, name: str) -> DataFrame:
        left = blk.join(mentioned, ["doc_id", "pos"], "left_anti")
        if implicated is None:
            left = left.withColumn("passed", F.lit(False))
        else:
            left = left.join(implicated.select("doc_id", "pos").distinct().withColumn("passed", F.lit(True)), ["doc_id", "pos"], "left")
        nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))
        return left.select("doc_id", nth.alias("nth"), F.col("text").alias(name), F.lit(1).alias(f"has_{name}"), F.coalesce("passed", F.lit(False)).alias(f"passed_{name}"))

    both = rest(before, mentioned_before, implicated_before, "l").join(rest(after, mentioned_after, implicated_after, "r"), ["doc_id", "nth"], "full")
    both = both.withColumn("passed", F.coalesce("passed_l", F.lit(False)) | F.coalesce("passed_r", F.lit(False)))
    lengths = both.groupBy("doc_id").agg(
        F.count("has_l").alias("n_before"), F.count("has_r").alias("n_after"), F.count_if((F.col("l") == F.col("r")) & ~F.col("passed")).alias("equal"), F.count_if(~F.col("l").eqNullSafe(F.col("r")) & ~F.col("passed")).alias("differ")
    )
    verdict = F.when(F.col("n_before") != F.col("n_after"), "length_mismatch").when(F.col("differ") > 0, "content_differs").otherwise("proved")
    return lengths.select("doc_id", "n_before", "n_after", F.when(verdict == "length_mismatch", F.lit(0).cast("long")).otherwise(F.col("equal")).alias("proved"), verdict.alias("verdict"))


def counts(direct: DataFrame, proof: DataFrame, census: DataFrame) -> DataFrame:
    """The counts of an audit by document, and whether the tracked-delivery policy holds."""
    zero = F.lit(0).cast("long")
    d = direct.groupBy("doc_id").agg(F.count("*").alias("direct"))
    c = census.groupBy("doc_id").agg(*(F.count_if(F.col("disposition") == k).alias(k) for k in ("untouched", "modified", "resolved", "new")))
    p = proof.select("doc_id", F.when(F.col("verdict") == "proved", 0).otherwise(1).cast("long").alias("violations"))
    out = p.join(d, "doc_id", "full").join(c, "doc_id", "full")  # a document all of whose blocks changed has nothing to prove
    names = ["violations", "direct", "untouched", "modified", "resolved", "new"]
    out = out.select("doc_id", *(F.coalesce(n, zero).alias(n) for n in names))
    return out.withColumn("delivers", (F.col("violations") == 0) & (F.col("direct") == 0) & (F.col("modified") == 0))


def mentioned(direct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V5: the blocks (doc_id, pos) of either side that a direct change names."""
    one, two = (direct.where(F.col(c).isNotNull()).select("doc_id", F.col(c).alias("pos")).distinct() for c in ("base_pos", "target_pos"))
    return one, two


def implicated(census: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V5: the blocks of either side with a revision that did not stay as it was. ``census``: (doc_id, before, after, disposition)."""
    rows = census.where("disposition <> 'untouched'")
    one, two = (rows.where(F.col(c).isNotNull()).select("doc_id", F.col(c).alias("pos")).distinct() for c in ("before", "after"))
    return one, two


def block_texts(segments: DataFrame, accept: bool) -> DataFrame:
    """The blocks (doc_id, pos, text) of one view of tracked segments (doc_id, pos, seq, text, has_ins, has_del); a block of which no segment stays is gone."""
    held = revisions.projected(segments, accept).groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("parts"))
    return held.select("doc_id", "pos", F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def revision_rows(segments: DataFrame) -> DataFrame:
    """A row per revision of tracked segments: (doc_id, pos, kind, author, text, place)."""
    place = F.col("pos").cast("long") * (1 << 20) + F.col("seq")
    sides = [segments.where(flag).select("doc_id", "pos", F.lit(kind).alias("kind"), F.coalesce("author", F.lit("")).alias("author"), "text", place.alias("place")) for flag, kind in (("has_ins", "insert"), ("has_del", "delete"))]
    return sides[0].unionByName(sides[1])


def audited(before: DataFrame, after: DataFrame) -> dict[str, DataFrame]:
    """V1: the sections of an audit of two tracked versions, segments (doc_id, pos, seq, text, has_ins, has_del, author) each.

    ``direct``: what changed without attribution, with the prior revisions at its
    place; ``census``: revisions and what became of them; ``proof``: that all other
    blocks stayed; ``counts``: a row per document and whether it may be delivered.
    """
    rejected = block_texts(before, False), block_texts(after, False)
    direct = direct_delta(*rejected)
    one, two = revision_rows(before), revision_rows(after)
    paired = matching.census_match(one, two, ["doc_id", "kind", "author"], "text", "place")
    census = paired.select("doc_id", "kind", "author", F.shiftright("before", 20).cast("int").alias("before"), F.shiftright("after", 20).cast("int").alias("after"), "disposition")
    proof = untouched_proof(*rejected, *mentioned(direct), *implicated(census))
    prior = census.where("before is not null and disposition <> 'untouched'").select("doc_id", F.col("before").alias("pos"), F.concat_ws(":", "kind", "author", "before").alias("revision_id"))
    return {"direct": annotated(direct, prior), "census": census, "proof": proof, "counts": counts(direct, proof, census)}


def verified_task(declared: DataFrame, minted: DataFrame, audit_counts: DataFrame) -> DataFrame:
    """Each artifact of a task: the effects that it declares and does not show, whether its audit allows delivery, and whether it is verified.

    ``declared``, ``minted``: (artifact, revision_id); ``audit_counts``: (artifact, delivers).
    """
    missing = missing_effects(declared, minted).groupBy("artifact").agg(F.count("*").alias("missing"))
    undeclared = minted.join(declared, ["artifact", "revision_id"], "left_anti").groupBy("artifact").agg(F.count("*").alias("undeclared"))
    rows = declared.select("artifact").unionByName(audit_counts.select("artifact")).distinct().join(missing, "artifact", "left").join(undeclared, "artifact", "left").join(audit_counts.select("artifact", "delivers"), "artifact", "left")
    zero = F.lit(0).cast("long")
    out = rows.select("artifact", F.coalesce("missing", zero).alias("missing"), F.coalesce("undeclared", zero).alias("undeclared"), F.coalesce("delivers", F.lit(False)).alias("delivers"))
    return out.withColumn("verified", (F.col("missing") == 0) & (F.col("undeclared") == 0) & F.col("delivers"))


def thread_roots(edges: DataFrame) -> DataFrame:
    """(doc_id, para_id, root_id, depth, root_done): the root of each comment, however long the thread. Dangling parents are roots; in a cycle
    the last comment before one that was passed already counts as root.

    Every comment points at its parent; in each round it points at where its target
    points, so a thread of n comments takes log2(n) joins. Only documents with a
    cycle are walked step by step.
    """
    share_package(edges.sparkSession)
    ids = edges.select("doc_id", F.col("para_id").alias("parent_id"), F.lit(1).alias("known"))
    linked = edges.select("doc_id", "para_id", "parent_id").join(ids, ["doc_id", "parent_id"], "left")
    has = F.col("known").isNotNull()
    at = stored(linked.select("doc_id", "para_id", F.when(has, F.col("parent_id")).otherwise(F.col("para_id")).alias("root_id"), has.cast("int").alias("depth"), (~has).alias("ended")), "threads")
    most = at.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    for _ in range(ceil(log2(most)) + 1 if most > 1 else 0):
        target = at.select("doc_id", F.col("para_id").alias("root_id"), F.col("root_id").alias("beyond"), F.col("depth").alias("more"), F.col("ended").alias("then"))
        at = stored(at.join(target, ["doc_id", "root_id"]).select("doc_id", "para_id", F.col("beyond").alias("root_id"), (F.col("depth") + F.when(F.col("ended"), 0).otherwise(F.col("more"))).alias("depth"), (F.col("ended") | F.col("then")).alias("ended")), "threads")
        if not at.where("not ended").limit(1).count():
            break
    in_cycles = stored(at.where("not ended").select("doc_id").distinct(), "threads-with-cycles")

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        parents = {c: p for c, p in zip(pdf["para_id"], pdf["parent_id"]) if pd.notna(p)}
        known, rows = set(pdf["para_id"]), []
        for start in pdf["para_id"]:
            here, passed = start, {start}
            while (up := parents.get(here)) is not None and up in known and up not in passed:
                here = up
                passed.add(up)
            rows.append((pdf["doc_id"].iloc[0], start, here, len(passed) - 1))
        return pd.DataFrame(rows, columns=["doc_id", "para_id", "root_id", "depth"])

    kinds = dict(edges.dtypes)
    schema = f"doc_id {kinds['doc_id']}, para_id {kinds['para_id']}, root_id {kinds['para_id']}, depth int"
    cyclic = edges.join(in_cycles, "doc_id", "left_semi").select("doc_id", "para_id", "parent_id").groupBy("doc_id").applyInPandas(walked, schema)
    roots = at.join(in_cycles, "doc_id", "left_anti").select("doc_id", "para_id", "root_id", "depth").unionByName(cyclic)
    done = edges.select("doc_id", F.col("para_id").alias("root_id"), F.col("done").alias("root_done"))
    return roots.join(done, ["doc_id", "root_id"]).select("doc_id", "para_id", "root_id", "depth", "root_done")


def missing_effects(declared: DataFrame, minted: DataFrame) -> DataFrame:
    """Declared effects that no revision of the output shows."""
    return declared.join(minted, ["artifact", "revision_id"], "left_anti")


def manifest_faults(artifacts: DataFrame, effects: DataFrame, targets: DataFrame) -> DataFrame:
    """V9: artifact paths and effect ids that repeat, effects without a target, targets without an effect."""
    one = artifacts.groupBy("path").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_path").alias("fault"), F.col("path").alias("subject"))
    two = effects.groupBy("effect_id").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("duplicate_effect"), F.col("effect_id").cast("string"))
    three = effects.select("effect_id").distinct().join(targets, "effect_id", "left_anti").select(F.lit("effect_without_target"), F.col("effect_id").cast("string"))
    four = targets.select("effect_id").distinct().join(effects, "effect_id", "left_anti").select(F.lit("unknown_effect"), F.col("effect_id").cast("string"))
    return one.union(two).union(three).union(four)
