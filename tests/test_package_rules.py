"""Each validation rule on a package that breaks it, and none on one that breaks nothing."""

import pytest
from test_operators import packages, values

from palimpsest.operators import package_rules
from palimpsest.sources import docx, docx_elements

W = docx.W[1:-1]
R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
HEAD = f'xmlns:w="{W}" xmlns:r="{R}" xmlns:m="http://schemas.openxmlformats.org/officeDocument/2006/math" xmlns:w14="http://schemas.microsoft.com/office/word/2010/wordml" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006" mc:Ignorable="w14"'
TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml."
RUN = "<w:r><w:t>x</w:t></w:r>"


def types(*more):
    rows = [("word/document.xml", "document.main"), *more]
    return f'<Types xmlns="{docx.TYPES[1:-1]}"><Default Extension="rels" ContentType="a/rels"/><Default Extension="xml" ContentType="application/xml"/>' + "".join(f'<Override PartName="/{n}" ContentType="{TYPE}{t}+xml"/>' for n, t in rows) + "</Types>"


def rels(*rows):
    return f'<Relationships xmlns="{docx.RELS[1:-1]}">' + "".join(f'<Relationship Id="{i}" Type="{R}/{t}" Target="{target}"{mode}/>' for i, t, target, mode in ((*r, "")[:4] for r in rows)) + "</Relationships>"


def made(body="<w:p/>", end="<w:sectPr/>", main=None, without=(), **parts):
    out = {
        "[Content_Types].xml": types(),
        "_rels/.rels": rels(("rId1", "officeDocument", "word/document.xml")),
        "word/document.xml": main or f"<w:document {HEAD}><w:body>{body}{end}</w:body></w:document>",
        "word/_rels/document.xml.rels": rels(),
    }
    names = {"types": "[Content_Types].xml", "main_rels": "word/_rels/document.xml.rels"}
    out |= {names.get(k, f"word/{k}.xml"): v for k, v in parts.items()}
    return docx.packed({k: v.encode() if isinstance(v, str) else v for k, v in out.items() if k not in without})


def story(name, kind, content, relation=True, typed=True):
    """A part beside the main one, with its relationship and content type."""
    found = {name: content}
    if relation:
        found["main_rels"] = rels(("rId9", kind, f"{name}.xml"))
    if typed:
        found["types"] = types((f"word/{name}.xml", kind))
    return found


def styles(*ids):
    return story("styles", "styles", f"<w:styles {HEAD}>" + "".join(f'<w:style w:styleId="{i}"/>' for i in ids) + "</w:styles>")


CASES = {
    "I-PKG-000": b"no zip", "I-PKG-001": made(without=["_rels/.rels"]), "I-PKG-002": made(without=["word/document.xml", "_rels/.rels"]), "I-PKG-003": docx.packed({"A.xml": b"<x/>", "a.xml": b"<x/>"}),
    "I-CT-001": docx.packed({**dict(docx.parts_of(made())), "word/media/i.png": b"x"}), "I-CT-002": made(**story("comments", "comments", f"<w:comments {HEAD}/>", typed=False)),
    "I-REL-001": made('<w:p><w:hyperlink r:id="rId7"/></w:p>'), "I-REL-002": made(main_rels=rels(("a", "x", "document.xml"), ("a", "x", "../word/document.xml"))), "I-REL-003": made(main_rels=rels(("a", "image", "media/no.png"))),
    "I-REL-004": made(end='<w:sectPr><w:headerReference w:type="default"/></w:sectPr>'), "I-XML-001": made(main="<w:document><w:body>"), "I-STORY-001": made(**story("footnotes", "footnotes", f"<w:footnotes {HEAD}/>", relation=False)),
    "I-PEOPLE-001": made(people="<x/>"), "I-TC-001": made('<w:p><w:ins w:id="1"><w:t>x</w:t></w:ins></w:p>'), "I-TC-002": made(f"<w:p><w:ins>{RUN}</w:ins></w:p>"),
    "I-TC-003": made(f'<w:p><w:ins w:id="1"><w:ins w:id="2">{RUN}</w:ins></w:ins></w:p>'), "I-ANN-001": made(f'<w:p><w:ins w:id="1">{RUN}</w:ins><w:ins w:id="1">{RUN}</w:ins></w:p>'),
    "I-ANN-002": made(f'<w:p><w:ins w:id="-1">{RUN}</w:ins></w:p>'), "I-ANN-003": made('<w:p><w:bookmarkStart w:id="1" w:name="a"/></w:p>'), "I-ANN-004": made('<w:p w14:paraId="80000000"/>'),
    "I-ANN-005": made('<w:p><w:commentRangeEnd w:id="1"/></w:p>'), "I-ANN-006": made('<w:p><w:r><w:footnoteReference w:id="40000"/></w:r></w:p>'), "I-ANN-008": made(f'<w:p><w:bookmarkStart w:id="1" w:name="{"n" * 41}"/><w:bookmarkEnd w:id="1"/></w:p>'),
    "I-ANN-009": made('<w:p><w:customXmlInsRangeStart w:id="1"/></w:p>'), "I-DOC-001": made(main=f"<w:glossaryDocument {HEAD}/>"), "I-DOC-002": made(main=f"<w:document {HEAD}/>"), "I-DOC-003": made(end=""),
    "I-MATH-001": made("<w:p><m:oMath><m:oMath/></m:oMath></w:p>"), "I-MATH-002": made("<m:oMath/>"), "I-PERM-001": made('<w:p><w:permStart w:id="x"/></w:p>'),
    "I-RANGE-001": made('<w:p><w:bookmarkStart w:id="1" w:name="a" w:colFirst="0"/><w:bookmarkEnd w:id="1"/></w:p>'), "I-ORD-001": made("<w:p><w:pPr><w:jc/><w:keepNext/></w:pPr></w:p>"), "I-ORD-002": made("<w:p><w:r><w:rPr><w:sz/><w:b/></w:rPr></w:r></w:p>"),
    "I-ORD-003": made("<w:tbl><w:tblPr><w:tblLook/><w:tblW/></w:tblPr></w:tbl>"), "I-ORD-004": made("<w:tbl><w:tr><w:trPr><w:jc/><w:cantSplit/></w:trPr></w:tr></w:tbl>"), "I-ORD-005": made("<w:tbl><w:tr><w:tc><w:tcPr><w:shd/><w:tcW/></w:tcPr></w:tc></w:tr></w:tbl>"),
    "I-NS-001": made('<w:p xmlns:q="urn:q" q:a="1"/>'), "I-NS-002": made("<w:p><q:x/></w:p>"), "I-XREF-001": made('<w:p><w:pPr><w:pStyle w:val="No"/></w:pPr></w:p>', **styles("Yes")),
    "I-XREF-002": made('<w:p><w:pPr><w:numPr><w:numId w:val="5"/></w:numPr></w:pPr></w:p>', **story("numbering", "numbering", f'<w:numbering {HEAD}><w:num w:numId="1"/></w:numbering>')),
    "I-XREF-003": made('<w:p><w:r><w:commentReference w:id="4"/></w:r></w:p>', **story("comments", "comments", f'<w:comments {HEAD}><w:comment w:id="1"/></w:comments>')),
    "I-XREF-004": made(**styles(*(f"s{n}" for n in range(4080)))), "I-XREF-005": made(**styles("s" * 254)), "I-ANN-007": None,
}
CLEAN = made(
    f'<w:p w14:paraId="7FFFFFFF"><w:pPr><w:pStyle w:val="Yes"/><w:keepNext/><w:numPr><w:numId w:val="0"/></w:numPr><w:jc/></w:pPr><w:bookmarkStart w:id="1" w:name="a"/><w:ins w:id="2"><w:del w:id="3"><w:r><w:delText>x</w:delText></w:r></w:del></w:ins>'
    f'<w:bookmarkEnd w:id="1"/><m:oMath><m:r/></m:oMath></w:p><w:ins w:id="9"><w:p>{RUN}</w:p></w:ins>',
    **styles("Yes"),
)


@pytest.fixture(scope="module")
def found(spark):
    contents = [c for c in CASES.values() if c] + [CLEAN, docx.package([docx.paragraph_xml([("normal", "x")])])]
    names = [k for k, c in CASES.items() if c] + ["clean", "written here"]
    facts = docx_elements.package_facts(packages(spark, *contents)).cache()
    findings = package_rules.findings_of(facts)
    rows = {n: [] for n in names}
    for doc, rule, severity, part, subject in values(findings, "doc_id", "rule_id", "severity", "part", "subject"):
        rows[names[int(doc)]].append((rule, severity, part, subject))
    verdicts = {names[int(d)]: ok for d, ok in values(package_rules.verdicts(facts, findings), "doc_id", "ok")}
    return rows, verdicts


def test_all_rules_have_a_case():
    assert set(CASES) == set(package_rules.RULES) and len(package_rules.RULES) == 44


@pytest.mark.parametrize("rule", [k for k, c in CASES.items() if c])
def test_rule_is_found(rule, found):
    rows, verdicts = found
    rules = {r[0] for r in rows[rule]}
    # What cannot but come along: a part that does not parse, or an id that two elements hold, breaks others too.
    along = {"I-PKG-002": {"I-PKG-001", "I-REL-003"}, "I-DOC-001": set(), "I-TC-003": set(), "I-PKG-001": set(), "I-XML-001": set()}
    assert rule in rules and rules <= {rule} | along.get(rule, set())
    assert verdicts[rule] == (rule in package_rules.WARNINGS)


def test_nothing_is_found_where_nothing_is_wrong(found):
    rows, verdicts = found
    assert rows["clean"] == [] and rows["written here"] == [] and verdicts["clean"]


def test_too_many_comment_ranges(spark, monkeypatch):
    monkeypatch.setattr(package_rules, "MOST_COMMENT_RANGES", 2)
    marks = "".join(f'<w:commentRangeStart w:id="{n}"/><w:commentRangeEnd w:id="{n}"/>' for n in range(3))
    facts = docx_elements.package_facts(packages(spark, made(f"<w:p>{marks}</w:p>")))
    assert values(package_rules.findings_of(facts), "rule_id", "subject") == [("I-ANN-007", "3")]


def test_paths_of_tracked_changes(spark):
    """The content model of tracked changes: what a path allows and what not."""
    good = ("<w:p><w:del w:id='1'><w:r><w:t>x</w:t></w:r></w:del></w:p>", "<w:p><w:ins w:id='1'><w:r><w:drawing><w:txbxContent><w:p><w:hyperlink/><w:ins w:id='2'><w:r/></w:ins></w:p></w:txbxContent></w:drawing></w:r></w:ins></w:p>")
    bad = ("<w:p><w:del w:id='1'><w:sdt><w:sdtContent><w:r><w:t>x</w:t></w:r></w:sdtContent></w:sdt></w:del></w:p>", "<w:p><w:ins w:id='1'><w:smartTag><w:hyperlink/></w:smartTag></w:ins></w:p>", "<w:p><w:del w:id='1'><w:ins w:id='2'><w:r/></w:ins><w:r><w:p><w:del w:id='3'><w:r/></w:del></w:p></w:r></w:del></w:p>")
    facts = docx_elements.package_facts(packages(spark, *map(made, good + bad)))
    got = {}
    for doc, rule in values(package_rules.findings_of(facts), "doc_id", "rule_id"):
        got.setdefault(int(doc), set()).add(rule)
    assert got == {2: {"I-TC-001"}, 3: {"I-TC-001"}, 4: {"I-TC-003"}}
