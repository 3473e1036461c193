"""The validation rules over packages (2.14): 44 rules as filters, anti-joins, duplicate, pairing and order checks.

``findings_of`` takes the facts of :func:`palimpsest.sources.docx_elements.package_facts`
and yields (doc_id, rule_id, severity, part, subject). What one element breaks by
itself is found in one scan without a shuffle; what crosses elements or parts is a
join or an aggregation by document.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Elements whose w:id is an annotation's, and those that share one by design.
ANNOTATIONS = "del ins moveFrom moveTo bookmarkStart bookmarkEnd commentRangeStart commentRangeEnd pPrChange rPrChange tblPrChange trPrChange tcPrChange sectPrChange cellIns cellDel".split()
#: What may stand directly in a tracked change of runs.
IN_TRACKED_RUNS = (
    "customXml smartTag sdt dir bdo r proofErr permStart permEnd ins del moveFrom moveTo bookmarkStart bookmarkEnd commentRangeStart commentRangeEnd moveFromRangeStart moveFromRangeEnd "
    "moveToRangeStart moveToRangeEnd customXmlInsRangeStart customXmlInsRangeEnd customXmlDelRangeStart customXmlDelRangeEnd customXmlMoveFromRangeStart customXmlMoveFromRangeEnd "
    "customXmlMoveToRangeStart customXmlMoveToRangeEnd"
).split()
#: The order of children that the schema demands, by container.
ORDERS = {
    "w:pPr": (
        "I-ORD-001",
        "pStyle keepNext keepLines pageBreakBefore framePr widowControl numPr suppressLineNumbers pBdr shd tabs suppressAutoHyphens kinsoku wordWrap overflowPunct topLinePunct autoSpaceDE autoSpaceDN bidi "
        "adjustRightInd snapToGrid spacing ind contextualSpacing mirrorIndents suppressOverlap jc textDirection textAlignment textboxTightWrap outlineLvl divId cnfStyle rPr sectPr pPrChange",
    ),
    "w:rPr": (
        "I-ORD-002",
        "rStyle rFonts b bCs i iCs caps smallCaps strike dstrike outline shadow emboss imprint noProof snapToGrid vanish webHidden color spacing w kern position sz szCs highlight u effect bdr shd fitText "
        "vertAlign rtl cs em lang eastAsianLayout specVanish oMath rPrChange",
    ),
    "w:tblPr": (
        "I-ORD-003",
        "tblStyle tblpPr tblOverlap bidiVisual tblStyleRowBandSize tblStyleColBandSize tblW jc tblCellSpacing tblInd tblBorders shd tblLayout tblCellMar tblLook tblCaption tblDescription tblPrChange",
    ),
    "w:trPr": ("I-ORD-004", "cnfStyle divId gridBefore gridAfter wBefore wAfter cantSplit trHeight tblHeader tblCellSpacing jc hidden ins del trPrChange"),
    "w:tcPr": ("I-ORD-005", "cnfStyle tcW gridSpan hMerge vMerge tcBorders shd noWrap tcMar textDirection tcFitText vAlign hideMark headers cellIns cellDel cellMerge tcPrChange"),
}
#: The content types of parts of the word folder, by file name, and those of a main part.
_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml."
CONTENT_TYPES = {
    "document": "document.main", "styles": "styles", "numbering": "numbering", "settings": "settings", "webSettings": "webSettings", "fontTable": "fontTable", "footnotes": "footnotes", "endnotes": "endnotes",
    "comments": "comments",
}
MAIN_TYPES = [_TYPE + "document.main+xml", _TYPE + "template.main+xml", "application/vnd.ms-word.document.macroEnabled.main+xml", "application/vnd.ms-word.template.macroEnabledTemplate.main+xml"]
#: Namespaces that every consumer knows.
CORE = [
    "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships", "http://schemas.openxmlformats.org/officeDocument/2006/math",
    "http://schemas.openxmlformats.org/markup-compatibility/2006", "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing",
    "http://schemas.openxmlformats.org/drawingml/2006/picture", "urn:schemas-microsoft-com:vml", "urn:schemas-microsoft-com:office:office", "urn:schemas-microsoft-com:office:word", "http://www.w3.org/XML/1998/namespace",
]
#: Numbers beyond which consumers refuse a package.
MOST_COMMENT_RANGES, MOST_STYLES, STYLE_ID_CHARS, BOOKMARK_BYTES, MOST_NOTE_ID, LEAST_NOTE_ID = 32767, 4079, 253, 40, 32767, -2147483648
#: Rules whose findings warn; all others are errors.
WARNINGS = ["I-STORY-001", "I-PEOPLE-001", "I-ANN-008", "I-NS-001", *(rule for rule, _ in ORDERS.values())]
RULES = (
    "I-PKG-000 I-PKG-001 I-PKG-002 I-PKG-003 I-CT-001 I-CT-002 I-REL-001 I-REL-002 I-REL-003 I-REL-004 I-XML-001 I-STORY-001 I-PEOPLE-001 I-TC-001 I-TC-002 I-TC-003 I-ANN-001 I-ANN-002 I-ANN-003 I-ANN-004 "
    "I-ANN-005 I-ANN-006 I-ANN-007 I-ANN-008 I-ANN-009 I-DOC-001 I-DOC-002 I-DOC-003 I-MATH-001 I-MATH-002 I-PERM-001 I-RANGE-001 I-ORD-001 I-ORD-002 I-ORD-003 I-ORD-004 I-ORD-005 I-NS-001 I-NS-002 "
    "I-XREF-001 I-XREF-002 I-XREF-003 I-XREF-004 I-XREF-005"
).split()

MAIN = "word/document.xml"
_BLOCK = "(?!(?:w:body|w:tc|w:txbxContent|w:sdtContent|w:customXml|w:ins|w:del|w:moveFrom|w:moveTo)/)"
_OWN_TEXT = "(?:(?!(?:w:txbxContent|w:ins|w:moveFrom|w:moveTo|w:fldSimple|w:hyperlink|w:subDoc)/)[^/]+/)*"
#: Paths of what may not stand in tracked changes: undeleted text of controls, paragraph-level elements, the same change once more.
DELETED_TEXT = f"/w:del/{_OWN_TEXT}(?:w:sdt|w:customXml|w:smartTag)/{_OWN_TEXT}w:(?:t|instrText)$"
PARAGRAPH_LEVEL = f"/{_BLOCK}[^/]+/w:(?:ins|del)/(?:(?!w:txbxContent/)[^/]+/)+w:(?:fldSimple|hyperlink|subDoc)$"
TRACKED_CHILD = f"/{_BLOCK}[^/]+/w:(?:ins|del)/w:[^/]+$"
NESTED_CHANGE = "/(w:(?:ins|del|moveFrom|moveTo))/(?:(?!(?:w:ins|w:del|w:moveFrom|w:moveTo|w:txbxContent)/)[^/]+/)*\\1$"


def attribute(name: str) -> Column:
    return F.try_element_at(F.col("a"), F.lit(name))


def elements_of(facts: DataFrame) -> DataFrame:
    """(doc_id, part, seq, parent, name, path, a): elements with their attributes as a map."""
    return facts.where("fact = 'element'").select("doc_id", "part", "seq", "parent", "name", "path", F.when(F.col("attributes") != "", F.str_to_map("attributes", F.lit("\x1e"), F.lit("\x1f"))).alias("a"))


def finding(df: DataFrame, rule: str, part: Column, subject: Column) -> DataFrame:
    return df.select("doc_id", F.lit(rule).alias("rule_id"), part.alias("part"), subject.cast("string").alias("subject"))


def _named(*names: str) -> Column:
    return F.col("name").isin(*(f"w:{n}" for n in names))


def element_rules(elements: DataFrame) -> DataFrame:
    """Rules that one element breaks by itself, in one scan."""
    local, path, own = F.substring_index("name", ":", -1), F.col("path"), attribute("w:id")
    plain = own.rlike("^[+-]?[0-9]{1,18}$")
    number = F.when(plain, own.cast("long"))
    in_math = path.rlike("/m:oMath(Para)?/")
    para, hexa = attribute("w14:paraId"), attribute("w14:paraId").rlike("^[0-9A-Fa-f]{1,8}$")

    def rule(name: str, condition: Column, subject: Column) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), F.struct(F.lit(name).alias("rule_id"), subject.cast("string").alias("subject")))

    tests = [
        rule("I-TC-001", path.rlike(DELETED_TEXT) & ~in_math, local),
        rule("I-TC-001", path.rlike(PARAGRAPH_LEVEL) & ~in_math, local),
        rule("I-TC-001", path.rlike(TRACKED_CHILD) & ~local.isin(*IN_TRACKED_RUNS) & ~in_math, local),
        rule("I-TC-002", _named("ins", "del") & (F.coalesce(own, F.lit("")) == ""), local),
        rule("I-TC-003", path.rlike(NESTED_CHANGE), local),
        rule("I-ANN-002", _named(*ANNOTATIONS) & own.isNotNull() & ~(F.coalesce(own.rlike("^\\+?[0-9]{1,18}$") & (number <= 4294967295), F.lit(False))), own),
        rule("I-ANN-004", para.isNotNull() & ~F.coalesce(hexa & (F.conv(para, 16, 10).cast("long") < 0x80000000), F.lit(False)), para),
        rule("I-ANN-006", _named("footnote", "endnote", "footnoteReference", "endnoteReference") & own.isNotNull() & ~F.coalesce(number.between(LEAST_NOTE_ID, MOST_NOTE_ID), F.lit(False)), own),
        rule("I-ANN-008", _named("bookmarkStart") & (F.octet_length(attribute("w:name")) > BOOKMARK_BYTES), attribute("w:name")),
        rule("I-MATH-001", path.rlike("/m:oMath/(?:.*/)?m:oMath$"), local),
        rule("I-MATH-002", path.rlike("/w:body/m:oMath$"), local),
        rule("I-PERM-001", _named("permStart", "permEnd") & own.isNotNull() & ~F.coalesce(number.between(-(1 << 31), (1 << 31) - 1), F.lit(False)), own),
        rule("I-RANGE-001", _named("bookmarkStart", "permStart") & (attribute("w:colFirst").isNull() != attribute("w:colLast").isNull()), local),
        rule("I-REL-004", _named("headerReference", "footerReference") & (F.coalesce(attribute("r:id"), F.lit("")) == ""), local),
        rule("I-XREF-005", (F.col("part") == "word/styles.xml") & _named("style") & (F.char_length(attribute("w:styleId")) > STYLE_ID_CHARS), attribute("w:styleId")),
        rule("I-DOC-001", (F.col("part") == MAIN) & F.col("parent").isNull() & (F.col("name") != "w:document"), F.col("name")),
    ]
    stories = elements.where(F.col("part").startswith("word/") & ~F.col("part").contains("_rels/"))
    return stories.select("doc_id", "part", F.explode(F.array_compact(F.array(*tests))).alias("f")).select("doc_id", "f.rule_id", "part", "f.subject")


def pairing(elements: DataFrame, rule: str, start: str, end: str) -> DataFrame:
    """Starts and ends of a range by id and part that do not come in equal numbers."""
    marks = elements.where(_named(start, end)).groupBy("doc_id", "part", attribute("w:id").alias("id"))
    counts = marks.agg(F.count_if(F.col("name") == f"w:{start}").alias("starts"), F.count_if(F.col("name") == f"w:{end}").alias("ends"))
    return finding(counts.where("id is not null and starts <> ends"), rule, F.col("part"), F.col("id"))


def annotation_rules(elements: DataFrame) -> DataFrame:
    """I-ANN-001, 003, 005, 007 and 009."""
    ids = elements.where(_named(*ANNOTATIONS)).groupBy("doc_id", attribute("w:id").alias("id")).agg(
        F.count("*").alias("n"), F.count_distinct("part").alias("parts"), F.collect_set("name").alias("names"), F.min("part").alias("part")
    )
    paired = reduce(lambda a, b: a | b, (F.size(F.array_intersect("names", F.array(F.lit(f"w:{k}Start"), F.lit(f"w:{k}End")))) == 2 for k in ("bookmark", "commentRange")))
    twice = ids.where(F.col("id").isNotNull() & (F.col("n") > 1) & ~((F.col("n") == 2) & (F.col("parts") == 1) & paired))
    out = [finding(twice, "I-ANN-001", F.col("part"), F.col("id")), pairing(elements, "I-ANN-003", "bookmarkStart", "bookmarkEnd"), pairing(elements, "I-ANN-005", "commentRangeStart", "commentRangeEnd")]
    out += [pairing(elements, "I-ANN-009", f"customXml{k}RangeStart", f"customXml{k}RangeEnd") for k in ("Ins", "Del", "MoveFrom", "MoveTo")]
    many = elements.where(_named("commentRangeStart")).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_COMMENT_RANGES)
    return reduce(DataFrame.unionByName, [*out, finding(many, "I-ANN-007", F.lit(MAIN), F.col("n"))])


def structure_rules(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """I-DOC-002, I-DOC-003, I-ORD-001..005 and I-NS-001."""
    main = elements.where(F.col("part") == MAIN)
    bodies = main.groupBy("doc_id").agg(F.count_if(F.col("path") == "/w:document/w:body").alias("n"), F.count_if(F.col("path") == "/w:document").alias("roots"))
    last = main.where(F.col("path").rlike("^/w:document/w:body/[^/]+$")).groupBy("doc_id").agg(F.max_by("name", "seq").alias("last"))
    no_end = bodies.where("n > 0").join(last, "doc_id", "left").where("coalesce(last, '') <> 'w:sectPr'")
    out = [finding(bodies.where("roots > 0 and n <> 1"), "I-DOC-002", F.lit(MAIN), F.col("n")), finding(no_end, "I-DOC-003", F.lit(MAIN), F.coalesce("last", F.lit("")))]
    order = Window.partitionBy("doc_id", "part", "parent").orderBy("seq")
    inside = F.regexp_extract("path", "/([^/]+)/[^/]+$", 1)
    place = F.coalesce(*(F.when(inside == c, F.array_position(F.array(*(F.lit(f"w:{n}") for n in names.split())), F.col("name"))) for c, (_, names) in ORDERS.items()))
    children = elements.where(F.col("path").rlike("/w:(?:pPr|rPr|tblPr|trPr|tcPr)/[^/]+$")).withColumn("inside", inside).withColumn("place", place).where("place > 0")
    wrong = children.withColumn("before", F.lag("place").over(order)).where("before > place").groupBy("doc_id", "part", "parent", "inside").agg(F.count("*").alias("n"))
    rule = F.coalesce(*(F.when(F.col("inside") == c, F.lit(r)) for c, (r, _) in ORDERS.items()))
    out.append(wrong.select("doc_id", rule.alias("rule_id"), "part", F.concat(F.col("inside"), F.lit("@"), F.col("parent")).alias("subject")))
    ignorable = elements.where("parent is null").select("doc_id", "part", F.split(F.coalesce(attribute("mc:Ignorable"), F.lit("")), "\\s+").alias("ignorable"))
    extra = facts.where("fact = 'namespace'").where(~F.col("value").isin(*CORE) & F.col("part").startswith("word/") & ~F.col("part").contains("_rels/")).select("doc_id", "part", F.col("name").alias("prefix"))
    uncovered = extra.join(ignorable, ["doc_id", "part"]).where(~F.array_contains("ignorable", F.col("prefix")))
    return reduce(DataFrame.unionByName, [*out, finding(uncovered, "I-NS-001", F.col("part"), F.col("prefix"))])


def reference_rules(elements: DataFrame) -> DataFrame:
    """I-XREF-001..004: what styles, lists and comments are referred to and are not there. Without the part itself nothing is said."""

    def dangling(rule: str, uses: DataFrame, part: str, element: str, key: str) -> DataFrame:
        known = elements.where((F.col("part") == part) & _named(element)).select("doc_id", attribute(key).alias("id")).distinct()
        has_part = elements.where((F.col("part") == part) & F.col("parent").isNull()).select("doc_id").distinct()
        return finding(uses.where("id is not null").join(has_part, "doc_id", "left_semi").join(known, ["doc_id", "id"], "left_anti").distinct(), rule, F.col("part"), F.col("id"))

    stories = elements.where(F.col("part").startswith("word/") & ~F.col("part").isin("word/styles.xml", "word/numbering.xml"))
    styles = stories.where(_named("pStyle", "rStyle", "tblStyle")).select("doc_id", "part", attribute("w:val").alias("id"))
    lists = stories.where(F.col("path").endswith("/w:numPr/w:numId")).select("doc_id", "part", attribute("w:val").alias("id")).where("id <> '0'")
    comments = stories.where(_named("commentReference")).select("doc_id", "part", attribute("w:id").alias("id"))
    many = elements.where((F.col("part") == "word/styles.xml") & _named("style")).groupBy("doc_id").agg(F.count("*").alias("n")).where(F.col("n") > MOST_STYLES)
    out = [
        dangling("I-XREF-001", styles, "word/styles.xml", "style", "w:styleId"),
        dangling("I-XREF-002", lists, "word/numbering.xml", "num", "w:numId"),
        dangling("I-XREF-003", comments, "word/comments.xml", "comment", "w:id"),
        finding(many, "I-XREF-004", F.lit("word/styles.xml"), F.col("n")),
    ]
    return reduce(DataFrame.unionByName, out)


def resolved_target(base: Column, target: Column) -> Column:
    """A relationship's target as a part name: absolute ones lose their slash, steps up are taken."""
    joined = F.when(target.startswith("/"), F.substring(target, F.lit(2), F.length(target))).otherwise(F.concat(base, target))
    out = F.regexp_replace(joined, "(^|/)\\./", "$1")
    for _ in range(4):
        out = F.regexp_replace(out, "(^|/)(?!\\.\\./)[^/]+/\\.\\./", "$1")
    return out


def relationship_rows(elements: DataFrame) -> DataFrame:
    """(doc_id, part, source, id, kind, resolved, external) of all relationships; ``part`` is the .rels, ``source`` whose they are."""
    rels = elements.where((F.col("name") == "Relationship") & F.col("part").endswith(".rels"))
    base = F.regexp_extract("part", "^(.*?)_rels/[^/]*$", 1)
    source = F.concat(base, F.regexp_extract("part", "_rels/([^/]*)\\.rels$", 1))
    target = F.coalesce(attribute("Target"), F.lit(""))
    external = F.lower(F.coalesce(attribute("TargetMode"), F.lit(""))) == "external"
    return rels.select("doc_id", "part", source.alias("source"), attribute("Id").alias("id"), F.substring_index(attribute("Type"), "/", -1).alias("kind"), target.alias("target"), resolved_target(base, target).alias("resolved"), external.alias("external"))


def package_part_rules(facts: DataFrame, elements: DataFrame) -> DataFrame:
    """I-PKG-000..003, I-XML-001, I-NS-002, I-CT-001, I-CT-002, I-REL-001..003, I-STORY-001 and I-PEOPLE-001."""
    parts = facts.where("fact = 'part'").select("doc_id", "part")
    errors = facts.where("fact = 'error'").select("doc_id", F.col("name").alias("rule_id"), "part", F.col("value").alias("subject"))
    unread = facts.where("fact = 'error' and part is null").select("doc_id").distinct()
    readable = facts.select("doc_id").distinct().join(unread, "doc_id", "left_anti")
    needed = readable.select("doc_id", F.explode(F.array(F.struct(F.lit("I-PKG-001").alias("rule_id"), F.lit("_rels/.rels").alias("part")), F.struct(F.lit("I-PKG-002").alias("rule_id"), F.lit(MAIN).alias("part")))).alias("n"))
    needed = needed.select("doc_id", "n.rule_id", "n.part", F.lower("n.part").alias("low"))
    low = parts.select("doc_id", F.lower("part").alias("low"))
    missing = needed.join(low, ["doc_id", "low"], "left_anti").select("doc_id", "rule_id", "part", F.col("part").alias("subject"))

    types = elements.where((F.col("part") == "[Content_Types].xml") & F.col("name").isin("Default", "Override"))
    defaults = types.where("name = 'Default'").select("doc_id", F.lower(attribute("Extension")).alias("extension"), F.lit(True).alias("by_default")).distinct()
    overrides = types.where("name = 'Override'").groupBy("doc_id", F.lower(F.ltrim(attribute("PartName"), F.lit("/"))).alias("low")).agg(F.max(attribute("ContentType")).alias("content_type"))
    owned = parts.where((F.col("part") != "[Content_Types].xml") & ~F.col("part").contains("_rels/")).withColumn("low", F.lower("part")).withColumn("extension", F.lower(F.regexp_extract("part", "\\.([^./]+)$", 1)))
    typed = owned.join(overrides, ["doc_id", "low"], "left").join(defaults, ["doc_id", "extension"], "left")
    untyped = finding(typed.where("content_type is null and by_default is null"), "I-CT-001", F.lit("[Content_Types].xml"), F.col("part"))
    file = F.regexp_extract("part", "^word/([^/]+)\\.xml$", 1)
    story = F.regexp_extract(file, "^(header|footer)[0-9]+$", 1)
    want = F.coalesce(*(F.when(file == name, F.lit(f"{_TYPE}{kind}+xml")) for name, kind in CONTENT_TYPES.items()), F.when(story != "", F.concat(F.lit(_TYPE), story, F.lit("+xml"))))
    has_types = types.select("doc_id").distinct()
    fits = F.when(F.col("part") == MAIN, F.col("content_type").isin(*MAIN_TYPES)).otherwise(F.col("content_type") == F.col("want"))
    odd = typed.withColumn("want", want).where(F.col("want").isNotNull() & ~F.coalesce(fits, F.lit(False))).join(has_types, "doc_id", "left_semi")
    canonical = finding(odd, "I-CT-002", F.lit("[Content_Types].xml"), F.col("part"))

    rels = relationship_rows(elements)
    inside = elements.where(F.col("part").startswith("word/") & ~F.col("part").contains("_rels/"))
    used = inside.select("doc_id", "part", F.explode(F.array_compact(F.array(attribute("r:id"), attribute("r:embed"), attribute("r:link")))).alias("id")).where("id <> ''").distinct()
    lost = used.join(rels.select("doc_id", F.col("source").alias("part"), "id"), ["doc_id", "part", "id"], "left_anti")
    repeated = rels.groupBy("doc_id", "part", "id").agg(F.count("*").alias("n")).where("n > 1")
    internal = rels.where(~F.col("external") & ~F.col("target").startswith("#")).withColumn("low", F.lower("resolved"))
    nowhere = internal.join(low, ["doc_id", "low"], "left_anti")
    of_main = rels.where(F.col("part") == "word/_rels/document.xml.rels").select("doc_id", F.col("resolved").alias("part"), "kind")
    stories = parts.where(F.col("part").rlike("^word/(?:(?:header|footer)[^/]*|footnotes|endnotes|comments)\\.xml$")).join(of_main, ["doc_id", "part"], "left_anti")
    people = parts.where(F.col("part") == "word/people.xml").join(of_main.where("kind = 'people'").select("doc_id"), "doc_id", "left_anti")
    out = [
        errors, missing, untyped, canonical, finding(lost, "I-REL-001", F.col("part"), F.col("id")), finding(repeated, "I-REL-002", F.col("part"), F.col("id")), finding(nowhere, "I-REL-003", F.col("part"), F.col("resolved")),
        finding(stories, "I-STORY-001", F.lit("word/_rels/document.xml.rels"), F.col("part")), finding(people, "I-PEOPLE-001", F.lit("word/_rels/document.xml.rels"), F.col("part")),
    ]
    return reduce(DataFrame.unionByName, out)


def findings_of(facts: DataFrame) -> DataFrame:
    """(doc_id, rule_id, severity, part, subject) by all rules. ``facts`` is read several times; store it first where it is large."""
    elements = elements_of(facts)
    found = [package_part_rules(facts, elements), element_rules(elements), annotation_rules(elements), structure_rules(facts, elements), reference_rules(elements)]
    severity = F.when(F.col("rule_id").isin(*WARNINGS), "warning").otherwise("error")
    return reduce(DataFrame.unionByName, found).select("doc_id", "rule_id", severity.alias("severity"), "part", "subject")


def verdicts(facts: DataFrame, findings: DataFrame) -> DataFrame:
    """A row per package: its errors and warnings, and whether it may be exported."""
    counts = findings.groupBy("doc_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    zero = F.lit(0).cast("long")
    out = facts.select("doc_id").distinct().join(counts, "doc_id", "left")
    return out.select("doc_id", F.coalesce("errors", zero).alias("errors"), F.coalesce("warnings", zero).alias("warnings"), (F.coalesce("errors", zero) == 0).alias("ok"))
