"""Brute-force versions of the operators, on plain Python values."""

import re
import zlib
from collections import Counter, defaultdict


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingles(found, width=5):
    k = min(width, len(found))
    return [tuple(found[a : a + k]) for a in range(len(found) - k + 1)] if k else []


def kept_words(docs, window=50):
    """op2: the words of each (doc_id, text) that no earlier document has in a window."""
    first = {}
    for doc, text in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        w = words(text)
        for k in range(len(w) - window + 1):
            first.setdefault(tuple(w[k : k + window]), doc)
    out = []
    for doc, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[k : k + window])] < doc:
                gone[k : k + window] = [True] * window
        out.append((doc, w, [x for x, g in zip(w, gone) if not g]))
    return out


def jaccard_classes(docs, threshold=0.8):
    """op7: {doc_id: (class_id, text_id, links)}."""
    first, sets = {}, {}
    for doc, text in sorted(docs):
        w = tuple(words(text))
        if first.setdefault(w, doc) == doc:
            sets[doc] = set(shingles(w))
    parent, links = {d: d for d in sets}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    where = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            where[x].append(d)
    for d, s in sets.items():
        for e, n in Counter(e for x in s for e in where[x] if e > d).items():
            if n >= threshold * (len(s) + len(sets[e]) - n):
                links[d] += 1
                links[e] += 1
                a, b = sorted((root(d), root(e)))
                parent[b] = a
    return {doc: (root(first[tuple(words(text))]), first[tuple(words(text))], links[first[tuple(words(text))]]) for doc, text in docs}


def leaks(docs, items, threshold=0.8):
    """op3: {(doc_id, item_id): (shared, united)} over all windows of an item's size, at the best one."""
    found = {}
    for item, text in items:
        w = words(text)
        if not w:
            continue
        want = Counter(shingles(w))
        for doc, t in docs:
            have = words(t)
            k = min(5, len(w))
            every = [tuple(have[a : a + k]) for a in range(len(have) - k + 1)]
            if not any(s in want for s in every):
                continue
            best = None
            for a in range(len(have) - len(w) + 1):
                c = Counter(every[a : a + len(w) - k + 1])
                shared, united = sum((c & want).values()), sum((c | want).values())
                if best is None or shared / united > best[0] / best[1]:
                    best = (shared, united)
            if best and best[0] >= threshold * best[1]:
                found[doc, item] = best
    return found


def quality(text):
    """op8's base counts: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    w = words(text)
    lines, dups = set(), 0
    for line in text.split("\n"):
        if words(line):
            dups += line in lines
            lines.add(line)
    windows = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    covered = set()
    for k in range(len(w) - 4):
        if windows[tuple(w[k : k + 5])] > 1:
            covered.update(range(k, k + 5))
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dups, len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)


KINDS = ("email", "ip", "card", "phone")
PATTERNS = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def luhn(digits):
    doubled = [int(c) * (2 if n % 2 else 1) for n, c in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def personal(text):
    """op1's base spans as (start, kind's number, end)."""
    out = []
    for n, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if n == 1 and any(int(p) > 255 for p in m[0].split(".")) or n == 2 and not (12 <= len(digits) <= 19 and luhn(digits)) or n == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), n, m.end()))
    return sorted(out)


def held_out(doc):
    return doc is not None and zlib.crc32(str(doc).encode()) % 4 == 2


RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))


def url_parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), slash + path


def url_rule(url):
    host, path = url_parts(url)
    fitting = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
    return max(fitting, key=lambda r: len(r[1] + r[2]), default=(None, None, None))
