import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.functions import inline
from palimpsest.functions import kernels as k

WORDS = st.lists(st.sampled_from("abcd"), max_size=12)


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = 0
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], before + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


@pytest.mark.parametrize(
    "text, want",
    [
        ("Section 3.1(a)", ["Section", " ", "3", ".", "1", "(", "a", ")"]),
        ("Stock);", ["Stock", ")", ";"]),
        ("(ii) and (aa)", ["(ii)", " ", "and", " ", "(aa)"]),
        ("13(d)", ["13", "(", "d", ")"]),
        ("don't a'b'c", ["don't", " ", "a'b", "'", "c"]),
        ("￼0123456789ab x", ["￼0123456789ab", " ", "x"]),
        ("", []),
    ],
)
def test_tokens(text, want):
    assert k.tokens(text) == want


@given(st.text(max_size=60))
def test_tokens_rebuild_the_text(text):
    assert "".join(k.tokens(text)) == text


@given(WORDS, WORDS)
def test_myers_is_a_longest_common_subsequence(a, b):
    pairs = k.myers(a, b)
    assert pairs == sorted(pairs) and all(a[i] == b[j] for i, j in pairs)
    assert len(pairs) == lcs(a, b) == k.common_length(a, b)
    other = k.common_pairs(a, b)
    assert other == sorted(other) and len(other) == len(pairs) and all(a[i] == b[j] for i, j in other)


@given(WORDS, WORDS)
def test_patience_rebuilds_both_sides(a, b):
    ops = k.patience(a, b)
    assert [x for op, i, j, _, _ in ops if op != "insert" for x in a[i:j]] == a
    assert [x for op, _, _, i, j in ops if op != "delete" for x in b[i:j]] == b


@settings(max_examples=200)
@given(st.text("ab .", max_size=90), st.text("ab .", max_size=90))
def test_word_changes_rebuild_both_sides(a, b):
    runs = inline.word_changes(a, b)
    assert "".join(t for op, t in runs if op != "insert") == a
    assert "".join(t for op, t in runs if op != "delete") == b


def test_word_changes_of_known_pairs():
    assert inline.word_changes("The quick brown fox jumps over the lazy dog.", "The quick red fox leaps over the lazy dog.") == [
        ("equal", "The quick "),
        ("delete", "brown fox jumps"),
        ("insert", "red fox leaps"),
        ("equal", " over the lazy dog."),
    ]
    assert inline.word_changes("same", "same") == [("equal", "same")] and inline.word_changes("", "") == []


@given(st.lists(st.integers(0, 20), max_size=15))
def test_increasing_is_longest(values):
    places = k.increasing(values)
    kept = [values[p] for p in places]
    assert places == sorted(places) and all(x < y for x, y in zip(kept, kept[1:]))
    best = [0] * len(values)
    for i, v in enumerate(values):
        best[i] = 1 + max((best[j] for j in range(i) if values[j] < v), default=0)
    assert len(places) == max(best, default=0)


BLOCKS = st.lists(st.sampled_from(["", "first paragraph here", "second paragraph there", "a third one", "and the fourth of them"]), max_size=7)


@settings(max_examples=200)
@given(BLOCKS, BLOCKS)
def test_alignment_uses_each_block_once_in_order(a, b):
    rows = k.align(a, b)
    assert [i for _, i, _ in rows if i is not None] == list(range(len(a)))
    assert [j for *_, j in rows if j is not None] == list(range(len(b)))
    assert all(a[i] == b[j] for kind, i, j in rows if kind == "matched")


def slow_affine(a, b, similar):
    """The three states cell by cell, over plain lists."""
    n, m, far = len(a), len(b), float("inf")
    cost = [[[far] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    come = [[[0] * 3 for _ in range(m + 1)] for _ in range(n + 1)]
    cost[0][0][0] = 0.0
    for i in range(n + 1):
        for j in range(m + 1):
            if i and j:
                s = min((0, 1, 2), key=cost[i - 1][j - 1].__getitem__)
                cost[i][j][0], come[i][j][0] = cost[i - 1][j - 1][s] + k.match_cost(a[i - 1], b[j - 1], abs(i - j), similar), s
            for state, x, y in ((1, i - 1, j), (2, i, j - 1)):
                if x >= 0 and y >= 0:
                    options = [(cost[x][y][s] + (k.GAP_EXTEND if s == state else k.GAP_OPEN), n, s) for n, s in enumerate((state, 0, 3 - state))]
                    cost[i][j][state], _, come[i][j][state] = min(options)
    out, i, j, state = [], n, m, min((0, 1, 2), key=cost[n][m].__getitem__)
    while i or j:
        was = come[i][j][state]
        i, j = i - (state != 2), j - (state != 1)
        out.append(("matched" if a[i] == b[j] else "modified", i, j) if state == 0 else ("deleted", i, None) if state == 1 else ("inserted", None, j))
        state = was
    return out[::-1]


def test_alignment_is_that_of_the_plain_recurrence():
    rng = random.Random(8)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    for _ in range(150):
        a, b = ([" ".join(rng.choice(words) for _ in range(rng.randint(0, 5))) for _ in range(rng.randint(1, 9))] for _ in range(2))
        assert k.affine(a, b, k.block_similarity) == slow_affine(a, b, k.block_similarity)


def test_distant_pairs_are_not_compared():
    """Beyond the reach the likeness is never asked for, and the result is that of asking for all."""
    asked = []

    def similar(x, y):
        asked.append(1)
        return k.block_similarity(x, y)

    a = [f"line {n}" for n in range(60)]
    b = ["new text here"] * 400 + [f"line {n} x" for n in range(60)]
    assert k.affine(a, b, similar) == slow_affine(a, b, k.block_similarity)
    assert len(asked) < 0.9 * len(a) * len(b)


FORMATTED = st.lists(st.builds(inline.Piece, st.sampled_from(["The Term ", "means", " a fee", " of (i) ", "5 USD", ".", " and so on and so forth"]), st.sampled_from([None, "b", "i"])), max_size=6)


@given(FORMATTED, FORMATTED, st.booleans())
def test_formatted_changes_rebuild_both_sides_with_formats(a, b, whole):
    def letters(pieces):
        return [(c, p.format) for p in pieces for c in p.text]

    runs = inline.changes(a, b, whole)
    assert [c for c, _ in letters(a)] == [c for r in runs if r.op != "insert" for c in r.text]
    new = [(c, r.format) for r in runs if r.op != "delete" for c in r.text]
    assert [c for c, _ in new] == [c for c, _ in letters(b)]
    assert all(x.look != y.look for x, y in zip(runs, runs[1:]))


def test_formats_and_objects_of_changes():
    P, obj = inline.Piece, "0123456789ab"
    runs = inline.changes([P("The "), P("Term", "b"), P(" means this"), P("￼", None, obj)], [P("The "), P("Term"), P(" means that"), P("￼", None, obj)])
    assert [(r.op, r.text, r.format, r.before, r.opaque) for r in runs] == [
        ("equal", "The ", None, None, None), ("equal", "Term", None, "b", None), ("equal", " means ", None, None, None), ("delete", "this", None, None, None), ("insert", "that", None, None, None), ("equal", "￼", None, None, obj)
    ]
    gone = inline.changes([P("see "), P("￼", None, obj)], [P("see ")])
    assert [(r.op, r.opaque) for r in gone] == [("equal", None), ("delete", obj)]
    swapped = [(2, inline.Run("delete", "￼", opaque="a")), (3, inline.Run("delete", "￼", opaque="b")), (2, inline.Run("insert", "￼", opaque="c")), (9, inline.Run("equal", "x"))]
    assert [(n, r.op) for n, r in inline.in_reading_order(swapped)] == [(2, "delete"), (2, "insert"), (3, "delete"), (9, "equal")]


def test_fragments_become_replacements_between_anchors():
    got = inline.word_changes("pay the sum of ten at noon to me", "ask a fee for two by dusk of us", whole=False)
    assert [op for op, _ in got] == ["delete", "insert"]
    anchored = inline.word_changes("Under this Agreement we pay five (5) years. Signed and sealed by them.", "Under this Agreement we pay two (2) years. Signed and sealed by them.")
    assert anchored[0] == ("equal", "Under this Agreement we pay ") and anchored[-1] == ("equal", ") years. Signed and sealed by them.") and {op for op, _ in anchored} == {"equal", "delete", "insert"}
    assert [t for op, t in anchored if op == "delete"] == ["five (5"] or [t for op, t in anchored if op == "delete"] == ["five", "5"]
    # An enumerator, short as it is, is never swallowed.
    kept = inline.word_changes("aa bb (ii) cc dd", "xx yy (ii) zz ww", whole=False)
    assert ("equal", "(ii)") in [(op, t.strip()) for op, t in kept]
    runs = [inline.Run("delete", "first of all"), inline.Run("insert", "first of some")]
    assert [(r.op, r.text) for r in inline.with_shared_affixes(runs)] == [("equal", "first of "), ("delete", "all"), ("insert", "some")]
    assert inline.with_shared_affixes([inline.Run("delete", "cat"), inline.Run("insert", "car")]) == [inline.Run("delete", "cat"), inline.Run("insert", "car")]


def test_row_quality():
    assert k.row_quality(["a", None], ["a", None]) == 1.0 and k.row_quality([], []) == 1.0
    assert k.row_quality(["abcd", "x"], ["abcd"]) == 0.5 and k.row_quality(["ab"], ["xy"]) == 0.0


def test_alignment_of_a_known_pair():
    base = ["Alpha paragraph one", "Beta paragraph two", "Gamma paragraph three", "Delta paragraph four"]
    target = ["Alpha paragraph uno", "Gamma paragraph three", "Delta paragraph vier", "Epsilon is all new text"]
    assert [r[0] for r in k.align(base, target)] == ["modified", "deleted", "matched", "modified", "inserted"]


def test_similarities():
    assert k.content_similarity("", " ") == 1.0 and k.content_similarity("a", "") == 0.0
    assert k.block_similarity("A  b", "a b") == 1.0
    assert k.row_similarity("", "") == 1.0 and k.row_similarity("abc", "abd") == pytest.approx(2 / 3)
    assert [k.significance(t) for t in ("", " abc ")] == [0.0, 0.1]


def test_rows_match_by_similarity_without_crossings():
    assert k.match_rows(["a b c d", "e f g h"], ["e f g x", "a b c y"]) in ([(0, 1)], [(1, 0)])
    assert k.match_rows(["one row", "two row"], ["one row", "two row!"]) == [(0, 0), (1, 1)]


def test_numbering():
    levels = {(1, 0): {"text": "%1."}, (2, 0): {"text": "(%1)", "kind": "letter"}}
    assert k.labels([(1, 0), (1, 0), (2, 0), (2, 0), (1, 0)], levels) == ["1.", "2.", "(a)", "(b)", "3."]
    nested = {(1, 0): {"text": "%1."}, (1, 1): {"text": "%1.%2"}, (1, 2): {"text": "%4"}}
    assert k.labels([(1, 0), (1, 1), (1, 1), (1, 0), (1, 1), (1, 2)], nested) == ["1.", "1.1", "1.2", "2.", "2.1", ""]
    kept = {(1, 0): {"text": "%1."}, (1, 1): {"text": "%2", "restart": 0}}
    assert k.labels([(1, 0), (1, 1), (1, 0), (1, 1)], kept) == ["1.", "1", "2.", "2"]
    assert k.labels([(1, 0), (1, 0)], {(1, 0): {"start": 0}}) == ["0.", "1."]
    assert [k.roman(n) for n in (0, 4, 9, 14, 40)] == ["", "iv", "ix", "xiv", "xl"]
    assert [k.letters(n) for n in (0, 1, 26, 27, 703)] == ["", "a", "z", "aa", "aaa"]


def test_fields():
    assert k.field_words('REF "a \\"b" c') == ["REF", 'a "b', "c"]
    found = k.parse_field('HYPERLINK "http://x y" \\l "b" \\h')
    assert found == {"name": "HYPERLINK", "arguments": ["http://x y"], "switches": {"\\l": "b", "\\h": ""}}
    assert k.parse_field("")["name"] == ""
