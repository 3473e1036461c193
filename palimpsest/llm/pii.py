"""Personal data by patterns and a conditional random field.

Patterns give the base spans (email, ip, card, phone). A linear-chain conditional
random field over word shapes adds spans that no pattern covers, such as secrets
after a cue, or numbers written another way. It is trained here on a small labelled
table of sentences and decoded by Viterbi in numpy, many chains at once.

Only words with a digit, "@", a quotation mark or a capital after a small letter can
be part of an entity; all others are outside by constraint, in training too. A fixed
state parts a first-order chain exactly, so only the runs of such words are decoded,
each with the shapes of its neighbours, and the result is that of decoding the whole
text. (A secret of small letters alone, without quotes, is a word like others.)

Defined results: a null text is empty and has no span; added spans never overlap a
base span; repeated rows give repeated results; an empty table gives an empty
table. Texts of any length are read whole, in linear time; chains are decoded
``CHAIN_WORDS`` at a time, and a longer chain by itself.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from palimpsest.session import share_package

#: The kinds in the order of ties, and the patterns of the base spans.
KINDS = ("email", "ip", "card", "phone", "secret")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: No match can begin inside a run of digits: it would begin with the run's first one.
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MARKED = re.compile(r"[0-9@\"]+|[a-z][A-Z]")
SEPARATOR = re.compile(r"[\x20\x09-\x0D]")
EDGES = "\"'()[]{}<>,;:!?.*#$%&|=`"
SPACES = " \t\n\x0b\x0c\r"
#: Words whose features are held at once, and features that are summed at once.
CHAIN_WORDS, SLAB = 100_000, 20_000


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        n = int(c) * (1 + at % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def small_parts(address: str) -> bool:
    """Whether all parts are at most 255, however many zeros lead them."""
    return all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in address.split(".")))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The leftmost matches: before each "@" as many local characters as there are since the last match."""
    at, end = text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, (end := m.end())
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), ordered."""
    found = [(a, 0, b) for a, b in emails(text)]
    for m in CARD.finditer(text):
        digits = digits_of(m[0])
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    if "." in text:
        found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if small_parts(m[0])]
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(digits_of(m[0])) <= 15]
    return sorted(found)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


# --- features ----------------------------------------------------------------------


def may_be_entity(word: str) -> bool:
    """Words outside this class are outside of every entity."""
    return MARKED.search(word) is not None


def shape(word: str) -> str:
    """Runs of letters, capitals and digits as one sign each, other characters as they are; at most 12 signs."""
    out = ""
    for c in word:
        s = "d" if c.isdigit() else "X" if c.isupper() else "x" if c.isalpha() else c
        if out[-1:] != s:
            out += s
    return out[:12]


def size_class(n: int) -> str:
    return str(n) if n < 5 else "5-8" if n < 9 else "9-12" if n < 13 else "13-19" if n < 20 else "20+"


HEX = re.compile(r"[0-9a-fA-F]{16,}")


def features(words: list[str], at: int) -> list[str]:
    word = words[at]
    core = word.strip(EDGES)
    digits = digits_of(core)
    before, after = (words[at - 1] if at else "<s>"), (words[at + 1] if at + 1 < len(words) else "</s>")
    out = [
        "1",
        "shape=" + shape(word),
        "core=" + shape(core),
        "digits=" + size_class(len(digits)),
        "share=" + str(4 * len(digits) // max(1, len(core))),
        "size=" + size_class(len(core)),
        "before=" + before.lower().strip(EDGES)[:12] if not any(c.isdigit() for c in before) else "before#" + shape(before),
        "after#" + shape(after)[:4],
        "cue=" + (words[at - 2].lower().strip(EDGES)[:12] if at > 1 else "") + ("=" if before == "=" or before.endswith(("=", ":")) else ""),
    ]
    if "@" in core:
        out.append("at")
    if HEX.fullmatch(core):
        out.append("hex")
    if 12 <= len(digits) <= 19 and len(digits) == len(core):
        out.append("luhn" if luhn(digits) else "noluhn")
    return out


# --- the field -----------------------------------------------------------------------

TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
K = len(TAGS)


def allowed_moves() -> np.ndarray:
    """Log weights of 0 for moves that keep entities whole, else -inf: I-x follows B-x or I-x."""
    out = np.zeros((K, K))
    for a, x in enumerate(TAGS):
        for b, y in enumerate(TAGS):
            if y[0] == "I" and x[2:] != y[2:]:
                out[a, b] = -1e9
    return out


@dataclass
class Field:
    """Weights of features by tag, and of moves between tags. Index 0 stands for unknown features, weight 0."""

    index: dict[str, int]
    weights: np.ndarray
    moves: np.ndarray

    def emissions(self, rows: list[list[list[str]]]) -> tuple[np.ndarray, np.ndarray]:
        """(chains x places x tags, lengths), padded."""
        lengths = np.array([len(r) for r in rows])
        words = [names for row in rows for names in row]
        width, known = max(map(len, words)), self.index
        flat = np.empty((len(words), K))
        for at in range(0, len(words), SLAB):
            part = words[at : at + SLAB]
            ids = np.array([[known.get(n, 0) for n in names] + [0] * (width - len(names)) for names in part])
            flat[at : at + SLAB] = self.weights[ids].sum(axis=1)
        out = np.zeros((len(rows), lengths.max(), K))
        out[np.arange(lengths.max())[None] < lengths[:, None]] = flat
        return out, lengths

    def viterbi(self, scores: np.ndarray, lengths: np.ndarray) -> list[list[int]]:
        """The best tags of every chain. The words around a chain are outside, so it begins and ends next to O."""
        n, most, _ = scores.shape
        best = scores[:, 0] + self.moves[0]
        back = np.zeros((n, most, K), dtype=np.int8)
        final = best.copy()
        for t in range(1, most):
            options = best[:, :, None] + self.moves[None]
            back[:, t] = options.argmax(axis=1)
            best = options.max(axis=1) + scores[:, t]
            final[lengths > t] = best[lengths > t]
        tags = np.zeros((n, most), dtype=np.int64)
        last = (final + self.moves[:, 0]).argmax(axis=1)
        for i in range(n):
            at = last[i]
            for t in range(lengths[i] - 1, -1, -1):
                tags[i, t] = at
                at = back[i, t, at]
        return [tags[i, : lengths[i]].tolist() for i in range(n)]


def chains_of(words: list[str]) -> list[tuple[int, int]]:
    """Runs of words that may be part of an entity."""
    out, start = [], None
    for at in range(len(words) + 1):
        inside = at < len(words) and may_be_entity(words[at])
        if inside and start is None:
            start = at
        elif not inside and start is not None:
            out.append((start, at))
            start = None
    return out


def train(table: list[tuple[str, list[tuple[int, int, str]]]], rounds: int = 160, rate: float = 0.2, penalty: float = 2e-3) -> Field:
    """Maximum likelihood with a ridge penalty, by forward-backward over all chains at once and Adagrad steps."""
    chains, gold = [], []
    for sentence, spans in table:
        places = [(m.start(), m.end()) for m in WORD.finditer(sentence)]
        words = [sentence[a:b] for a, b in places]
        tags = [0] * len(words)
        for a, b, kind in spans:
            inside = [i for i, (s, e) in enumerate(places) if s < b and e > a]
            for n, i in enumerate(inside):
                tags[i] = 1 + 2 * KINDS.index(kind) + (n > 0)
        for a, b in chains_of(words):
            chains.append([features(words, t) for t in range(a, b)])
            gold.append(tags[a:b])
    index = {name: i + 1 for i, name in enumerate(sorted({f for c in chains for w in c for f in w}))}
    field = Field(index, np.zeros((len(index) + 1, K)), allowed_moves())
    fixed = field.moves < -1e8
    n, most = len(chains), max(map(len, chains))
    width = max(len(f) for c in chains for f in c)
    ids, y = np.zeros((n, most, width), dtype=np.int64), np.zeros((n, most), dtype=np.int64)
    real = np.zeros((n, most), dtype=bool)
    for i, (c, g) in enumerate(zip(chains, gold)):
        real[i, : len(c)], y[i, : len(c)] = True, g
        for t, names in enumerate(c):
            ids[i, t, : len(names)] = [index[x] for x in names]
    lengths = real.sum(axis=1)
    seen = np.zeros_like(field.weights), np.zeros_like(field.moves)
    observed_moves = np.zeros((K, K))
    for i in range(n):
        path = [0, *y[i, : lengths[i]], 0]
        for a, b in zip(path, path[1:]):
            observed_moves[a, b] += 1

    def logsum(x: np.ndarray, axis: int) -> np.ndarray:
        top = x.max(axis=axis, keepdims=True)
        return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)

    for _ in range(rounds):
        scores, m = field.weights[ids].sum(axis=2), field.moves
        forward = np.zeros((n, most, K))
        forward[:, 0] = scores[:, 0] + m[0]
        for t in range(1, most):
            forward[:, t] = logsum(forward[:, t - 1, :, None] + m[None], 1) + scores[:, t]
        backward = np.zeros((n, most, K))
        total = logsum(forward[np.arange(n), lengths - 1] + m[:, 0], 1)
        backward[np.arange(n), lengths - 1] = m[:, 0]
        for t in range(most - 2, -1, -1):
            inner = logsum(m[None] + (scores[:, t + 1] + backward[:, t + 1])[:, None, :], 2)
            backward[:, t] = np.where((t < lengths - 1)[:, None], inner, backward[:, t])
        marginal = np.exp(forward + backward - total[:, None, None]) * real[:, :, None]
        expected = np.zeros((K, K))
        expected[0] += marginal[:, 0].sum(axis=0)
        expected[:, 0] += marginal[np.arange(n), lengths - 1].sum(axis=0)
        for t in range(most - 1):
            on = real[:, t + 1]
            pair = forward[on, t, :, None] + m[None] + (scores[on, t + 1] + backward[on, t + 1])[:, None, :] - total[on, None, None]
            expected += np.exp(pair).sum(axis=0)
        error = -marginal
        error[np.arange(n)[:, None], np.arange(most)[None], y] += real
        step = np.zeros_like(field.weights)
        np.add.at(step, ids, error[:, :, None, :])
        step = step / n - penalty * field.weights
        step[0] = 0
        move = (observed_moves - expected) / n - penalty * np.where(fixed, 0, field.moves)
        move[fixed] = 0
        for s, g, target in ((seen[0], step, field.weights), (seen[1], move, field.moves)):
            s += g * g
            target += rate * g / (np.sqrt(s) + 1e-8)
    return field


# --- the labelled table -----------------------------------------------------------------

#: Sentences of the labelled table; {kind} stands for an entity, {other} for a number or word that is none.
SENTENCES = (
    "Write to {email} or call {phone} before noon.",
    "mail: {email}",
    "Her address is {email}, his is {email}.",
    "Reach us at {phone}.",
    "Tel. {phone} or fax {phone}",
    "phone {phone}, ask for room {other}",
    "The host {ip} answered after {other} tries.",
    "ping {ip} and {ip} from {other}",
    "server {ip} port {other} refused",
    "Pay with card {card} until {other}.",
    "card {card} was charged {other} times",
    "the {card} in the {other} that",
    'token = "{secret}"',
    'the token = "{secret}" and so on',
    'api_key = "{secret}", region = "{other}"',
    "the password is {secret} for now",
    "{camel} and {camel} were written by {camel} in {year}",
    "a {camel} of the {camel} kind",
    "password: {secret}",
    "secret = {secret} was left in the log",
    'he set key = "{secret}" for the {other} hosts',
    'she said "{plain}" and left',
    'a "{plain}" of "{plain}" kinds',
    "order {other} has {other} parts",
    "in the year {year} and {year}",
    "version {version} of {year}",
    "Licensed under the {version} text, version {version}.",
    "number {long} is no card",
    "the {long} of {long} and the {other}",
    "chapter {other}, verse {other}",
    "it was {other}% of {other}",
    "on {date} at {time}",
    "code {hexword} is a colour",
    "see page {other} - {other}",
    "{long} {other} {year}",
    "write @{plain} or ask {plain}",
    "{code} {code} {code} {code} {code} {code}",
    "part {code} fits {code} and {code}",
    "{other} {other} {other} {other} {other} {other} {other}",
    "{other} | {other} | {other}, {year}",
    "{code}, {other} {code} {other}",
)


@lru_cache(maxsize=1)
def labelled_table(copies: int = 8, seed: int = 7) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """The small labelled table: (sentence, [(start, end, kind)]), drawn from the sentences above."""
    rng = random.Random(seed)

    def number(n: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(n))

    def word(n: int = 0) -> str:
        return "".join(rng.choice("abcdefghiklmnoprstu") for _ in range(n or rng.randint(2, 9)))

    def card() -> str:
        head = number(rng.choice((11, 12, 14, 15, 15, 15, 18)))
        return next(head + c for c in "0123456789" if luhn(head + c))

    def no_card() -> str:
        text = number(rng.choice((12, 13, 16, 16, 16, 19)))
        return text if not luhn(text) else text[:-1] + str((int(text[-1]) + 1) % 10)

    def secret() -> str:
        signs, sizes = rng.choice((("0123456789abcdef", (32, 40, 40, 64)), ("ABCDEFabcdefXYZxyz0123456789_-", range(20, 45)), ("ABCDEFGHKLMNPQRSTabcdefghkmnopqrstuvwxyz", range(20, 45))))
        return "".join(rng.choice(signs) for _ in range(rng.choice(sizes)))

    def phone() -> str:
        return rng.choice((f"+{number(1)} ({number(3)}) {number(3)}-{number(4)}", f"({number(3)}) {number(3)}-{number(4)}", f"+{number(2)} {number(3)} {number(7)}", f"{number(3)}-{number(3)}-{number(4)}"))

    make = {
        "email": lambda: f"{word()}.{number(2)}@{word()}{number(1)}.{word()}.{rng.choice(('com', 'org', 'net', 'de'))}",
        "phone": phone,
        "ip": lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)),
        "card": card,
        "secret": secret,
        "long": no_card,
        "year": lambda: str(rng.randint(1500, 2100)),
        "other": lambda: number(rng.randint(1, 5)),
        "version": lambda: f"{number(1)}.{number(1)}",
        "date": lambda: f"{rng.randint(1, 28)}.{rng.randint(1, 12)}.{rng.randint(1990, 2030)}",
        "time": lambda: f"{rng.randint(0, 23)}:{rng.randint(10, 59)}",
        "hexword": lambda: "#" + "".join(rng.choice("0123456789abcdef") for _ in range(6)),
        "plain": word,
        "camel": lambda: rng.choice(("", "Mc", "i")) + word().capitalize() + rng.choice(("", word().capitalize())) + word(2) + "X" * rng.randint(0, 1),
        "code": lambda: rng.choice((lambda: word(rng.randint(1, 3)) + number(rng.randint(1, 3)), lambda: word(1) + number(2) + word(1) + number(2), lambda: number(2) + word(2)))(),
    }
    table = []
    for _ in range(copies):
        for sentence in SENTENCES:
            text, spans = "", []
            for n, part in enumerate(re.split(r"\{(\w+)\}", sentence)):
                value = make[part]() if n % 2 else part
                if n % 2 and part in KINDS:
                    spans.append((len(text), len(text) + len(value), part))
                text += value
            table.append((text, spans))
    return table


@lru_cache(maxsize=1)
def default_field() -> Field:
    return train(labelled_table())


# --- whole texts ---------------------------------------------------------------------------


def marked_runs(text: str) -> list[list[tuple[int, int]]]:
    """The runs of words that may be part of an entity, as places of their words."""
    runs: list[list[tuple[int, int]]] = []
    at = 0
    while m := MARKED.search(text, at):
        start = _word_start(text, m.start(), at)
        end = (e := SEPARATOR.search(text, m.end())) and e.start() or len(text)
        if runs and not text[runs[-1][-1][1] : start].strip(SPACES):
            runs[-1].append((start, end))
        else:
            runs.append([(start, end)])
        at = end
    return runs


def _word_start(text: str, at: int, least: int) -> int:
    while at > least and text[at - 1] not in SPACES:
        at -= 1
    return at


def neighbours(text: str, start: int, end: int, n: int = 2) -> tuple[list[str], list[str]]:
    """Up to ``n`` words before and one after, as splitting the whole text would give them."""
    size = 48
    while True:
        low = max(0, start - size)
        before = WORD.findall(text, low, start)
        if low == 0 or len(before) > n or (len(before) == n and text[low] in SPACES):
            break
        size *= 4
    size = 48
    while True:
        m = WORD.search(text, end, end + size)
        if end + size >= len(text) or (m and m.end() < end + size):
            break
        size *= 4
    return before[-n:], [m[0]] if m else []


def added_spans(texts: list[str], bases: list[list[tuple[int, int, int]]], field: Field) -> list[list[tuple[int, int, int]]]:
    """Spans of the field that touch no base span, for many texts at once."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    owners, places, rows, held = [], [], [], 0

    def decode() -> None:
        order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
        at = 0
        while at < len(order):  # chains of about one length together, so that padding stays small
            size = max(1, min(4096, CHAIN_WORDS // max(1, len(rows[order[min(at + 4095, len(order) - 1)]]))))
            part = order[at : at + size]
            at += size
            scores, lengths = field.emissions([rows[i] for i in part])
            for i, tags in zip(part, field.viterbi(scores, lengths)):
                out[owners[i]] += entities(texts[owners[i]], places[i], tags)
        for c in (owners, places, rows):
            c.clear()

    for n, text in enumerate(texts):
        for run in marked_runs(text):
            before, after = neighbours(text, run[0][0], run[-1][1])
            words = [*before, *(text[a:b] for a, b in run), *after]
            owners.append(n)
            places.append(run)
            rows.append([features(words, len(before) + t) for t in range(len(run))])
            held += len(run)
            if held >= CHAIN_WORDS:
                decode()
                held = 0
    decode()
    return [apart(sorted(spans), base) for spans, base in zip(out, bases)]


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``spans`` that no base span overlaps; both are ordered by start."""
    out, at, reach = [], 0, 0
    for s in spans:
        while at < len(base) and base[at][0] < s[2]:
            reach = max(reach, base[at][2])
            at += 1
        if reach <= s[0]:
            out.append(s)
    return out


def plausible(kind: int, span: str) -> bool:
    """What must hold of a span whatever the field says: a kind's digits, parts or length."""
    digits = digits_of(span)
    if kind == 0:
        return "@" in span
    if kind == 1:
        return IP.fullmatch(span) is not None and small_parts(span)
    if kind == 2:
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == 3:
        return 9 <= len(digits) <= 15 and not any(c.isalpha() for c in span)
    return len(span) >= 16 and not any(c in SPACES for c in span)


def entities(text: str, places: list[tuple[int, int]], tags: list[int]) -> list[tuple[int, int, int]]:
    found, t = [], 0
    while t < len(tags):
        if TAGS[tags[t]][0] == "B":
            last = t
            while last + 1 < len(tags) and TAGS[tags[last + 1]] == "I" + TAGS[tags[t]][1:]:
                last += 1
            start, end = places[t][0], places[last][1]
            while start < end and text[start] in EDGES and text[start] != "(":
                start += 1
            while end > start and text[end - 1] in EDGES:
                end -= 1
            kind = KINDS.index(TAGS[tags[t]][2:])
            if start < end and plausible(kind, text[start:end]):
                found.append((start, kind, end))
            t = last
        t += 1
    return found


def spans_of(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of each text."""
    bases = [base_spans(t) for t in texts]
    return [(b, sorted([*b, *more])) for b, more in zip(bases, added_spans(texts, bases, field))]


def personal_data(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans; a row per row of ``docs``."""
    share_package(docs.sparkSession)
    field = field or default_field()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for base, every in spans_of([t or "" for t in batch.column(1).to_pylist()], field):
                counts = [sum(k == n for _, k, _ in base) for n in range(4)]
                rows.append((*counts, hashlib.sha256(listed(base).encode()).hexdigest(), listed(every)))
            columns = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64() if n < 4 else pa.string()) for n, c in enumerate(columns))],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, schema)


def masked_text(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, at = [], 0
    for a, k, b in spans:
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def masked(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """``docs`` with personal data masked in the column text; all other columns as they are."""
    share_package(docs.sparkSession)
    field = field or default_field()
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            spans = spans_of([t or "" for t in texts], field)
            new = [t if t is None else masked_text(t, every) for t, (_, every) in zip(texts, spans)]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)
