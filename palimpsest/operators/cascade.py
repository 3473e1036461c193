"""Cascades (C1-C9): style chains by doubling, effective properties by coalesced joins.

A three-state property is a nullable boolean: null inherits. It is never coalesced
to false on the way.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.tables import stored


def style_chains(styles: DataFrame) -> DataFrame:
    """(style_id, ancestor, depth) over based_on, of any length. A cycle ends where it would repeat; a base that is not there ends a chain.

    Steps double: what 2^k steps reach joins with what 2^k more reach, so a chain of
    n styles takes log2(n) joins.
    """
    own = styles.select("style_id", F.col("style_id").alias("ancestor"), F.lit(0).alias("depth"))
    known = styles.select(F.col("style_id").alias("at"))
    step = stored(styles.select("style_id", F.col("based_on").alias("at")).where("at is not null").join(known, "at", "left_semi").select("style_id", "at"), "style-steps")
    reached, length, total = stored(own, "style-chains"), 1, styles.count()
    while length < 2 * total and step.limit(1).count():
        further = step.join(reached.select(F.col("style_id").alias("at"), "ancestor", "depth"), "at").select("style_id", "ancestor", (F.col("depth") + length).alias("depth"))
        reached = stored(reached.unionByName(further).groupBy("style_id", "ancestor").agg(F.min("depth").alias("depth")), "style-chains")
        step = stored(step.join(step.select(F.col("style_id").alias("at"), F.col("at").alias("beyond")), "at").select("style_id", F.col("beyond").alias("at")), "style-steps")
        length *= 2
    return reached


def flattened(styles: DataFrame, props: list[str]) -> DataFrame:
    """For each style and property the first value that is not null along its chain."""
    values = style_chains(styles).join(styles.select(F.col("style_id").alias("ancestor"), *props), "ancestor")
    firsts = [F.min_by(p, F.when(F.col(p).isNotNull(), F.col("depth"))).alias(p) for p in props]
    return values.groupBy("style_id").agg(*firsts, F.max("depth").alias("depth"))


#: References to theme fonts, and the slots of the theme that they mean.
THEME_FONTS = {
    "majorHAnsi": "major_latin", "majorAscii": "major_latin", "minorHAnsi": "minor_latin", "minorAscii": "minor_latin", "majorEastAsia": "major_ea", "minorEastAsia": "minor_ea", "majorBidi": "major_cs",
    "minorBidi": "minor_cs",
}


def resolved_fonts(runs: DataFrame, fonts: DataFrame) -> DataFrame:
    """``runs`` (doc_id, theme_ref, font) with ``effective_font``: the theme's font if the reference names one that it has, else the font itself.

    ``fonts``: (doc_id, slot, font), as :func:`palimpsest.sources.docx_parts.theme_fonts` reads them.
    """
    slot = F.coalesce(*(F.when(F.col("theme_ref") == ref, F.lit(name)) for ref, name in THEME_FONTS.items()))
    theme = fonts.select("doc_id", "slot", F.col("font").alias("theme_font"))
    return runs.withColumn("slot", slot).join(theme, ["doc_id", "slot"], "left").withColumn("effective_font", F.coalesce("theme_font", "font")).drop("slot", "theme_font")


#: Properties of paragraphs that cascade from direct formatting over the style's chain to the defaults (C4).
PARAGRAPH_PROPERTIES = "tabs indent spacing borders shading alignment num_id contextual_spacing widow_control keep_next keep_lines page_break_before outline_level".split()


def paragraph_cascade(paragraphs: DataFrame, styles: DataFrame, defaults: DataFrame, props: list[str] | None = None) -> DataFrame:
    """C4: ``paragraphs`` (doc_id, style_id, direct properties) with each property of ``props`` as it takes effect.

    ``styles``: (style_id, based_on, properties); ``defaults``: one row of properties.
    A paragraph without a style, or with one that is not there, has its own
    properties and the defaults.
    """
    props = props or [p for p in PARAGRAPH_PROPERTIES if p in paragraphs.columns]
    flat = flattened(styles, props).select("style_id", *(F.col(p).alias(f"__style_{p}") for p in props))
    base = {p: v for p, v in (defaults.select(*props).first() or {}).asDict().items()} if defaults.limit(1).count() else {}
    out = paragraphs.join(flat, "style_id", "left")
    rows = {p: effective(F.col(p), F.lit(None), F.col(f"__style_{p}"), F.lit(base.get(p))) for p in props}
    return out.withColumns(rows).drop(*(f"__style_{p}" for p in props))


def effective(direct: Column, char_style: Column, para_style: Column, default: Column) -> Column:
    """The first layer that says anything; toggles too, without exclusive-or."""
    return F.coalesce(direct, char_style, para_style, default)


def collisions(one: DataFrame, two: DataFrame, key: str, definition: str) -> DataFrame:
    """Styles of two documents: only here, only there, same, or differing under one id."""
    a, b = one.select(key, F.col(definition).alias("l"), F.lit(1).alias("in_l")), two.select(key, F.col(definition).alias("r"), F.lit(1).alias("in_r"))
    kind = F.when(F.col("in_r").isNull(), "only_left").when(F.col("in_l").isNull(), "only_right").when(F.col("l").eqNullSafe(F.col("r")), "same").otherwise("collision")
    return a.join(b, key, "full").select(key, kind.alias("kind"), F.coalesce("r", "l").alias("merged"))


def level_of(paragraphs: DataFrame, nums: DataFrame, levels: DataFrame) -> DataFrame:
    """num_id to abstract list to level, with the override of the instance before the level's own start."""
    return (
        paragraphs.join(nums, "num_id", "left")
        .join(levels, ["abstract_id", "ilvl"], "left")
        .withColumn("start", F.coalesce("start_override", "level_start", F.lit(0)))
        .drop("start_override", "level_start")
    )


def same_numbering(one: DataFrame, two: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Lists of two documents and whether they are the same in structure: every column but the rendered text, null-safe; (keys, same)."""
    a = one.select(*keys, *(F.col(c).alias(f"l_{c}") for c in columns), F.lit(True).alias("in_l"))
    b = two.select(*keys, *(F.col(c).alias(f"r_{c}") for c in columns), F.lit(True).alias("in_r"))
    same = reduce(lambda x, y: x & y, (F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")) for c in columns), F.col("in_l").isNotNull() & F.col("in_r").isNotNull())
    return a.join(b, keys, "full").select(*keys, same.alias("same"))


def section_references(sections: DataFrame) -> DataFrame:
    """Header and footer references inherited from section to section, kind by kind."""
    w = Window.partitionBy("doc_id", "kind").orderBy("section").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sections.withColumn("effective_ref", F.last("ref", ignorenulls=True).over(w))
