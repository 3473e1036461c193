"""Scalar text functions as Column expressions.

All stay in the JVM. Offsets count code points from 0 unless a name says bytes.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What matching folds one to one (spaces, apostrophes, quotation marks).
FOLDED_SPACES = "\u00a0\u202f\t" + "".join(map(chr, range(0x2002, 0x200B)))
FOLDED_FROM = FOLDED_SPACES + "\u2019\u02bc\u2018\u201c\u201d"
FOLDED_TO = " " * len(FOLDED_SPACES) + "'''" + '""'

#: Lengths of previews, excerpts' radius, and least bytes of moves and splits.
PREVIEW_CHARS, EXCERPT_RADIUS, MOVE_BYTES, SPLIT_BYTES = 120, 32, 20, 10

#: A word as tokens know it: letters, digits and underscores.
WORD = "[\\p{L}\\p{N}_]+"


def n_words(text: Column) -> Column:
    """Words parted by single spaces; an empty text has one empty word."""
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit(""))) + 1


def fold(text: Column) -> Column:
    """spaces, apostrophes and quotation marks folded one to one, so offsets stay."""
    return F.translate(text, FOLDED_FROM, FOLDED_TO)


def normalized(text: Column) -> Column:
    """runs of white space become one space, ends are trimmed, letters lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, "\\s+", " ")))


def visible_chars(text: Column) -> Column:
    return F.char_length(F.regexp_replace(text, "\\s", ""))


def significance(text: Column) -> Column:
    """F8: 0 for blank text, 0.1 up to five visible characters, then 1 + ln(n) / 5."""
    n = visible_chars(text)
    return F.when(n == 0, 0.0).when(n <= 5, 0.1).otherwise(1.0 + F.log(n.cast("double")) / 5.0)


def high_value(token: Column) -> Column:
    """a digit, a percent or dollar sign, or a currency code."""
    return token.rlike("[0-9%$]|^(USD|EUR|GBP)$")


def simple_tokens(text: Column) -> Column:
    """F1 without fusing: words, runs of white space, and single other characters."""
    return F.regexp_extract_all(text, F.lit("[\\p{L}\\p{N}_]+|\\s+|."), F.lit(0))


def occurrences(text: Column, needle: str) -> Column:
    """non-overlapping matches from the left."""
    if not needle:
        raise ValueError("an empty pattern matches nothing")
    return ((F.char_length(text) - F.char_length(F.replace(text, F.lit(needle), F.lit("")))) / len(needle)).cast("long")


def match_positions(text: Column, needle: str) -> Column:
    """where each of the non-overlapping matches from the left begins, from 0."""
    pieces = F.split(text, quoted(needle), -1)
    starts = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda k: F.aggregate(F.slice(pieces, 1, k), F.lit(0), lambda a, x: a + F.char_length(x)) + (k - 1) * len(needle))
    return F.when(F.size(pieces) > 1, starts).otherwise(F.array().cast("array<int>"))


def folded_pattern(needle: str) -> str:
    """``needle`` as a regular expression whose spaces, apostrophes and quotation marks match all that fold to them."""
    out = ""
    for c in needle.translate(str.maketrans(FOLDED_FROM, FOLDED_TO)):
        alike = "".join(a for a, b in zip(FOLDED_FROM, FOLDED_TO) if b == c)
        out += f"[{c}{alike}]" if alike else quoted(c)
    return out


def quoted(needle: str) -> str:
    """``needle`` as a literal regular expression, without engine-specific quoting."""
    return "".join("\\" + c if c in "\\.^$|?*+()[]{}-" else c for c in needle)


def whole_word(needle: str) -> str:
    """``needle`` as a whole word, any case; word characters are letters and numbers."""
    return f"(?i)(^|[^\\p{{L}}\\p{{N}}])({quoted(needle)})($|[^\\p{{L}}\\p{{N}}])"


def excerpt(text: Column, needle: str, radius: int = EXCERPT_RADIUS) -> Column:
    """the first match in marks with ``radius`` characters around it; dots where the text was cut."""
    at = F.instr(text, needle)
    size = len(needle)
    start = F.greatest(at - radius, F.lit(1))
    end = F.least(at + size - 1 + radius, F.char_length(text))
    return F.when(
        at > 0,
        F.concat(
            F.when(start > 1, "...").otherwise(""),
            F.substring(text, start, at - start),
            F.lit("«"),
            F.substring(text, at, F.lit(size)),
            F.lit("»"),
            F.substring(text, at + size, end - at - size + 1),
            F.when(end < F.char_length(text), "...").otherwise(""),
        ),
    )


def letters(n: Column) -> Column:
    """F16: bijective base 26 (a..z, aa..), '' for 0 and below; any 64-bit number."""
    n = n.cast("long")
    # Numbers of k letters begin at (26^k - 1) / 25.
    first = [(26**k - 1) // 25 for k in range(1, 14)]

    def of(k: int) -> Column:
        rest = n - F.lit(first[k - 1])
        digits = (F.pmod(F.call_function("div", rest, F.lit(26**p)), F.lit(26)).cast("int") for p in range(k - 1, -1, -1))
        return F.concat(*(F.substring(F.lit("abcdefghijklmnopqrstuvwxyz"), d + 1, F.lit(1)) for d in digits))

    out = F.when(n < 1, "")
    for k in range(1, 13):
        out = out.when(n < first[k], of(k))
    return out.otherwise(of(13))


#: Signs of roman numerals by decimal place.
ROMAN = (("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "m", "mm", "mmm"))


def roman(n: Column) -> Column:
    """F16: roman numerals of 1 to 3999, '' otherwise."""
    def place(k: int) -> Column:
        return F.element_at(F.array(*map(F.lit, ROMAN[k])), (F.floor(n / 10**k) % 10).cast("int") + 1)

    return F.when((n > 0) & (n < 4000), F.concat(F.element_at(F.array(*map(F.lit, ROMAN[3])), F.floor(n / 1000).cast("int") + 1), place(2), place(1), place(0))).otherwise("")


def numeral(n: Column, kind: Column) -> Column:
    return F.when(kind == "letter", letters(n)).when(kind == "roman", roman(n)).when(kind == "none", "").otherwise(n.cast("string"))


def level_text(pattern: Column, counters: list[Column]) -> Column:
    """%1..%N of ``pattern`` replaced by the counters; '' if it names a deeper level."""
    out = pattern
    for k, counter in enumerate(counters, 1):
        out = F.replace(out, F.lit(f"%{k}"), counter)
    return F.when(out.rlike("%[0-9]"), "").otherwise(out)


def prefix_separated(text: Column) -> Column:
    """one space after a leading "(x)" or "x)" of up to four ASCII letters or digits, if none is there."""
    return F.regexp_replace(text, "^(\\s*\\(?[0-9A-Za-z]{1,4}\\))(?=\\S)", "$1 ")


def color_hex(value: Column) -> Column:
    """six upper-case hex digits, null for anything else."""
    bare = F.upper(F.ltrim(value, F.lit("#")))
    return F.when(bare.rlike("^[0-9A-F]{6}$"), bare)


def snake(style_id: Column) -> Column:
    """camel case and separators to snake case."""
    parted = F.regexp_replace(style_id, "([a-z0-9])([A-Z])", "$1_$2")
    return F.lower(F.trim(F.regexp_replace(parted, "[^A-Za-z0-9]+", "_"), F.lit("_")))


def quantized(value: Column, bucket: int) -> Column:
    """the nearest multiple of ``bucket``, ties away from zero."""
    return (F.signum(value) * F.floor((F.abs(value) + bucket / 2) / bucket) * bucket).cast("long")


def numbering_sort(text: Column) -> Column:
    """bullet, numbered or none, by the label's first sign."""
    return F.when(F.trim(text) == "", "none").when(text.rlike("^\\s*[•●▪*-]"), "bullet").when(text.rlike("[0-9A-Za-z]"), "numbered").otherwise("bullet")


def identity_tag(kind: Column, content: Column) -> Column:
    """kind and twelve hex digits of the content's hash."""
    return F.concat(kind, F.lit(":"), F.left(F.sha2(content.cast("binary"), 256), F.lit(12)))


def part_directory(path: Column) -> Column:
    """the folder of a package part."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def rels_path(path: Column) -> Column:
    """where a part's relationships are kept."""
    name = F.regexp_extract(path, "([^/]*)$", 1)
    folder = part_directory(path)
    return F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.lit("_rels/"), name, F.lit(".rels"))


def escaped_html(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for sign, name in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out
