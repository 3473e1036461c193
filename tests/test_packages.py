import pytest
from test_operators import packages, values

from palimpsest.sources import docx, docx_parts, docx_resolve

NS = f'xmlns:w="{docx.W[1:-1]}"'


def with_parts(body: str, **parts: str) -> bytes:
    out = {docx.MAIN_PART: f'<w:document {NS}><w:body>{body}</w:body></w:document>'.encode()}
    return docx.packed(out | {f"word/{k}.xml": v.encode() for k, v in parts.items()})


TRACKED = (
    '<w:p><w:pPr><w:jc w:val="center"/><w:rPr><w:del w:id="1" w:author="a"/></w:rPr></w:pPr><w:r><w:t>one </w:t></w:r></w:p>'
    '<w:p><w:pPr><w:jc w:val="left"/></w:pPr><w:r><w:t>two</w:t></w:r><w:ins w:id="2"><w:r><w:t> in</w:t></w:r></w:ins><w:del w:id="3"><w:r><w:delText> out</w:delText></w:r></w:del>'
    '<w:ins w:id="4"><w:del w:id="5"><w:r><w:delText> both</w:delText></w:r></w:del></w:ins></w:p>'
    '<w:tbl><w:tr><w:trPr><w:del w:id="6"/></w:trPr><w:tc><w:p><w:r><w:t>cell</w:t></w:r></w:p></w:tc></w:tr></w:tbl>'
)


def test_accept_and_reject(spark):
    df = packages(spark, with_parts(TRACKED), with_parts("<w:p><w:r><w:t>plain</w:t></w:r></w:p>"))
    accepted = docx_resolve.resolved(df, accept=True)
    assert sorted(values(accepted, "doc_id", "outcome")) == [("0", "resolved"), ("1", "unchanged")]
    assert sorted(values(docx.blocks(accepted), "doc_id", "pos", "block_type", "text")) == [("0", 0, "paragraph", "one two in"), ("1", 0, "paragraph", "plain")]
    rejected = docx_resolve.resolved(df, accept=False)
    assert sorted(values(docx.blocks(rejected).where("doc_id = '0'"), "pos", "block_type", "text")) == [(0, "paragraph", "one "), (1, "paragraph", "two out"), (2, "table", "cell\t")]
    for done in (accepted, rejected):  # no revision is left, and a second pass changes nothing
        assert docx.spans(done).where("status <> 'normal'").count() == 0
        assert values(docx_resolve.resolved(done, True), "outcome") == ["unchanged"] * 2
    assert b'w:val="left"' in next(d for n, d in docx.parts_of(accepted.where("doc_id = '0'").first()["content"]) if n == docx.MAIN_PART)


def test_property_changes_are_settled(spark):
    body = '<w:p><w:pPr><w:jc w:val="center"/><w:pPrChange w:id="1"><w:pPr><w:jc w:val="left"/></w:pPr></w:pPrChange></w:pPr><w:r><w:t>x</w:t></w:r></w:p>'
    df = packages(spark, with_parts(body))
    for accept, want in ((True, b"center"), (False, b"left")):
        content = docx_resolve.resolved(df, accept).first()["content"]
        main = next(d for n, d in docx.parts_of(content) if n == docx.MAIN_PART)
        assert want in main and b"PrChange" not in main


def test_preflight_counts(spark):
    got = docx_resolve.preflight(packages(spark, with_parts(TRACKED), b"bad", docx.packed({docx.MAIN_PART: b"<a><w:ins></a>"}))).collect()
    assert [(r["insertions"], r["deletions"], r["error"] is None) for r in got] == [(2, 4, True), (None, None, False), (None, None, False)]


def test_revisions_are_found_under_any_prefix(spark):
    other = f'<x:document xmlns:x="{docx.W[1:-1]}"><x:body><x:p><x:ins\nx:id="1"><x:r><x:t>new</x:t></x:r></x:ins></x:p></x:body></x:document>'
    default = other.replace("xmlns:x=", "xmlns=").replace("<x:", "<").replace("</x:", "</").replace("x:id", "id")
    wide = "<?xml version='1.0' encoding='utf-16'?>" + other
    contents = [docx.packed({docx.MAIN_PART: c}) for c in (other.encode(), default.encode(), wide.encode("utf-16"))]
    assert values(docx_resolve.preflight(packages(spark, *contents)), "insertions") == [1, 1, 1]
    done = docx_resolve.resolved(packages(spark, *contents), accept=False)
    assert values(done, "outcome") == ["resolved"] * 3
    assert all(b"new" not in d for r in done.collect() for _, d in docx.parts_of(r["content"]))


def test_hostile_packages_do_not_fail_resolution(spark):
    deep = docx.packed({docx.MAIN_PART: (f'<w:p {NS}>' + "<w:ins>" * 3000 + "</w:ins>" * 3000 + "</w:p>").encode()})
    typed = docx.packed({docx.MAIN_PART: b"<!DOCTYPE x [<!ENTITY e 'y'>]><x><ins /></x>"})
    nested = docx.packed({docx.MAIN_PART: (f'<w:p {NS}>' + "<w:ins>" * 500 + "<w:r/>" + "</w:ins>" * 500 + "</w:p>").encode()})
    assert values(docx_resolve.resolved(packages(spark, deep, typed, b"", nested), True), "outcome") == ["too deep", "document type", "not a package", "resolved"]
    assert docx.relationships(packages(spark, deep, typed, b"")).count() == 0 and docx.properties(packages(spark, b"x", deep)).count() == 0


def test_parts_are_replaced_and_added(spark):
    df = packages(spark, docx.package([docx.paragraph_xml([("normal", "old")])]), b"bad")
    changes = spark.createDataFrame([("0", "WORD/document.xml", bytearray(docx.document_xml([docx.paragraph_xml([("normal", "new")])]))), ("0", "word/extra.xml", bytearray(b"<x/>"))], "doc_id string, part_name string, data binary")
    done = docx.with_parts(df, changes)
    assert sorted(values(done, "doc_id", "outcome")) == [("0", "written"), ("1", "not a package")]
    good = done.where("content is not null")
    assert values(docx.blocks(good), "text") == ["new"] and values(docx.parts(good).orderBy("part_name"), "part_name") == ["[Content_Types].xml", "_rels/.rels", "word/document.xml", "word/extra.xml"]


def test_commit_refuses_what_exists(spark, tmp_path):
    df = packages(spark, with_parts(TRACKED))
    assert values(docx_resolve.commit_new(df, str(tmp_path / "new")), "verified") == [True]
    with pytest.raises(Exception, match="(?i)exist"):
        docx_resolve.commit_new(df, str(tmp_path / "new"))


def test_styles_numbering_comments_and_opaque(spark):
    styles = f'<w:styles {NS}><w:style w:styleId="A" w:type="paragraph" w:default="1"><w:rPr><w:b/><w:sz w:val="24"/></w:rPr></w:style><w:style w:styleId="B"><w:basedOn w:val="A"/><w:rPr><w:b w:val="0"/></w:rPr></w:style></w:styles>'
    numbering = (
        f'<w:numbering {NS}><w:abstractNum w:abstractNumId="7"><w:lvl w:ilvl="0"><w:start w:val="1"/><w:numFmt w:val="decimal"/><w:lvlText w:val="%1."/></w:lvl></w:abstractNum>'
        '<w:num w:numId="3"><w:abstractNumId w:val="7"/><w:lvlOverride w:ilvl="0"><w:startOverride w:val="5"/></w:lvlOverride></w:num></w:numbering>'
    )
    comments = f'<w:comments {NS} xmlns:w14="{docx_parts.W14[1:-1]}"><w:comment w:id="1" w:author="me"><w:p w14:paraId="AA"><w:r><w:t>why</w:t></w:r></w:p></w:comment></w:comments>'
    extended = f'<x:commentsEx xmlns:x="{docx_parts.W15[1:-1]}"><x:commentEx x:paraId="AA" x:paraIdParent="BB" x:done="1"/></x:commentsEx>'
    body = (
        '<w:p><w:fldSimple w:instr=" PAGE "><w:r><w:t>4</w:t></w:r></w:fldSimple></w:p><w:sdt><w:sdtPr><w:tag w:val="name"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>Ann</w:t></w:r></w:p></w:sdtContent></w:sdt>'
        f'<w:p><w:r><w:drawing xmlns:wp="{docx_parts.WP[1:-1]}"><wp:inline><wp:extent cx="10" cy="20"/><wp:docPr name="Pic" descr="alt"/></wp:inline></w:drawing></w:r></w:p>'
    )
    df = packages(spark, with_parts(body, styles=styles, numbering=numbering, comments=comments, commentsExtended=extended))
    assert values(docx_parts.styles(df), "style_id", "based_on", "bold", "size") == [("A", None, "on", 24), ("B", "A", "off", None)]
    assert values(docx_parts.numbering(df), "num_id", "abstract_id", "start", "start_override", "lvl_text") == [(3, 7, 1, 5, "%1.")]
    assert values(docx_parts.comments(df), "comment_id", "para_id", "parent_para_id", "done", "text") == [(1, "AA", "BB", "1", "why")]
    assert values(docx_parts.opaque(df), "kind", "name", "value", "width") == [("field", "PAGE", "4", None), ("control", "name", "Ann", None), ("drawing", "Pic", "alt", 10)]


def test_markup_runs():
    assert docx_parts.markup_runs('a <b>bold <i>both</i></b> <a href="x">link</a> 1 < 2') == [("a ", (), None), ("bold ", ("b",), None), ("both", ("b", "i"), None), (" ", (), None), ("link", (), "x"), (" 1 < 2", (), None)]
    for bad in ("<b>x", "</b>", "<b><i>x</b></i>"):
        with pytest.raises(ValueError):
            docx_parts.markup_runs(bad)


def test_settings_themes_equations_and_interiors(spark):
    settings = f'<w:settings {NS}><w:evenAndOddHeaders w:val="0"/><w:updateFields/><w:defaultTabStop w:val="720"/><w:documentProtection w:edit="readOnly" w:enforcement="1"/><w:compat><w:compatSetting w:name="compatibilityMode" w:val="15"/></w:compat></w:settings>'
    bad = f'<w:settings {NS}><w:updateFields w:val="maybe"/></w:settings>'
    got = values(docx_parts.settings(packages(spark, with_parts("", settings=settings), with_parts(""), with_parts("", settings=bad), b"x")), "even_and_odd", "update_fields", "tab_stop", "protection", "protection_enforced", "compat", "error")
    assert got == [(False, True, 720, "readOnly", True, "compatibilityMode=15", None), (None,) * 7, (None,) * 6 + ("updateFields: neither on nor off",), (None,) * 6 + ("not a package",)]
    theme = f'<a:theme xmlns:a="{docx_parts.A[1:-1]}"><a:themeElements><a:fontScheme><a:majorFont><a:latin typeface="Cambria"/><a:ea typeface=""/></a:majorFont><a:minorFont><a:latin typeface="Calibri"/></a:minorFont></a:fontScheme></a:themeElements></a:theme>'
    content = docx.packed({docx.MAIN_PART: b"<x/>", "word/theme/theme1.xml": theme.encode()})
    assert values(docx_parts.theme_fonts(packages(spark, content, b"x")), "slot", "font") == [("major_latin", "Cambria"), ("minor_latin", "Calibri")]
    body = (
        f'<w:p><m:oMath xmlns:m="{docx_parts.M[1:-1]}"><m:r/></m:oMath></w:p><w:p><w:r><w:txbxContent><w:p><w:r><w:t>in</w:t></w:r></w:p><w:p><w:r><w:t>side</w:t></w:r></w:p></w:txbxContent></w:r></w:p>'
        '<w:sdt><w:sdtPr><w:tag w:val="a"/></w:sdtPr><w:sdtContent><w:p><w:r><w:t>free</w:t></w:r></w:p></w:sdtContent></w:sdt><w:sdt><w:sdtPr><w:lock w:val="contentLocked"/></w:sdtPr><w:sdtContent><w:p/></w:sdtContent></w:sdt>'
    )
    df = packages(spark, with_parts(body), b"x")
    assert values(docx_parts.editable_interiors(df), "pos", "kind", "nth", "tag", "text") == [(1, "textbox", 0, None, "in\nside"), (2, "control", 0, "a", "free")]
    assert [(p, "oMath" in x) for p, x in values(docx_parts.equations(df), "pos", "xml")] == [(0, True)]


def test_choices_of_markup():
    head = f'xmlns:mc="{docx_parts.MC[1:-1]}" {NS} xmlns:w14="{docx_parts.W14[1:-1]}" xmlns:q="urn:q"'

    def chosen(inner):
        return docx_parts.with_chosen_branches(f"<w:p {head}>{inner}</w:p>".encode()).decode()

    both = '<mc:AlternateContent><mc:Choice Requires="q"><w:a/></mc:Choice><mc:Choice Requires="w14 w"><w:b/></mc:Choice><mc:Fallback><w:c/></mc:Fallback></mc:AlternateContent>'
    assert "<w:b" in chosen(both) and "<w:a" not in chosen(both) and "<w:c" not in chosen(both) and "AlternateContent" not in chosen(both)
    only = '<mc:AlternateContent><mc:Choice Requires="q"><w:a/></mc:Choice><mc:Fallback><w:c/></mc:Fallback></mc:AlternateContent>'
    assert "<w:c" in chosen(only) and "<w:c" not in chosen(only.replace("<mc:Fallback><w:c/></mc:Fallback>", ""))
    with pytest.raises(docx.PackageError):
        chosen('<mc:AlternateContent><mc:Choice Requires="nowhere"><w:a/></mc:Choice></mc:AlternateContent>')


def test_tolerated_shapes_become_regular():
    root = docx.tree(f'<w:body {NS}><w:p><w:pPr><w:shd w:val="none"/></w:pPr><w:r><w:rPr><w:b/></w:rPr><w:t>a</w:t><w:r><w:t>b</w:t></w:r><w:t>c</w:t></w:r><w:tbl/></w:p><w:p><w:pPr><w:shd w:val="none" w:fill="FF0000"/></w:pPr></w:p></w:body>'.encode())
    assert sorted(docx_parts.normalized_shapes(root)) == ["nested_run", "shading_none", "shading_none", "table_in_paragraph"]
    assert [c.tag.removeprefix(docx.W) for c in root] == ["p", "tbl", "p"]
    runs = root[0].findall(f"{docx.W}r")
    assert [r.find(f"{docx.W}t").text for r in runs] == ["a", "b", "c"] and [r.find(f"{docx.W}rPr") is not None for r in runs] == [True, False, True]
    assert root[0].find(f".//{docx.W}shd") is None and root[2].find(f".//{docx.W}shd").attrib == {f"{docx.W}fill": "FF0000"}
    assert docx_parts.normalized_shapes(root) == []


def test_volatile_fields_are_place_holders(spark):
    field = '<w:r><w:fldChar w:fldCharType="begin"/></w:r><w:r><w:instrText> {} </w:instrText></w:r><w:r><w:fldChar w:fldCharType="separate"/></w:r><w:r><w:t>1 May</w:t></w:r><w:r><w:t> 2024</w:t></w:r><w:r><w:fldChar w:fldCharType="end"/></w:r>'
    body = f'<w:p><w:r><w:t>On </w:t></w:r>{field.format("DATE \\@ d")}</w:p><w:p>{field.format("REF x")}</w:p><w:p><w:fldSimple w:instr="time"><w:r><w:t>12:00</w:t></w:r></w:fldSimple></w:p>'
    assert values(docx.spans(packages(spark, with_parts(body))), "text") == ["On \ufffc", "1 May 2024", "\ufffc"]


def test_fragments_and_markers_are_resolved(spark):
    fragment = '<w:p><w:ins w:id="1"><w:r><w:t>in</w:t></w:r></w:ins><w:del w:id="2"><w:r><w:delText>out</w:delText></w:r></w:del></w:p>'
    assert "in" in docx_resolve.resolved_fragment(fragment, True) and "out" not in docx_resolve.resolved_fragment(fragment, True)
    assert "out" in docx_resolve.resolved_fragment(fragment, False) and "delText" not in docx_resolve.resolved_fragment(fragment, False)
    joined = '<w:p><w:pPr><w:rPr><w:del w:id="1"/></w:rPr></w:pPr><w:r><w:t>a</w:t></w:r></w:p>{}<w:p><w:r><w:t>b</w:t></w:r></w:p>'
    contents = [with_parts(joined.format(x)) for x in ('<w:bookmarkStart w:id="5"/><w:proofErr/>', "<w:sdt/>", '<w:tbl><w:tr><w:trPr><w:del w:id="9"/></w:trPr></w:tr></w:tbl>')]
    done = docx_resolve.resolved(packages(spark, *contents), True)
    texts = {}
    for doc, kind, text in values(docx.blocks(done), "doc_id", "block_type", "text"):
        if kind == "paragraph":
            texts.setdefault(doc, []).append(text)
    assert texts == {"0": ["ab"], "1": ["a", "b"], "2": ["ab"]}
    glossary = docx.packed({docx.MAIN_PART: b"<x/>", "word/glossary/document.xml": f"<w:p {NS}>{fragment[5:]}".encode()})
    assert b"out" not in dict(docx.parts_of(docx_resolve.resolved(packages(spark, glossary), True).first()["content"]))["word/glossary/document.xml"]
