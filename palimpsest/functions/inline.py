"""Word changes of a text with formats and opaque objects, and their clean-up.

Texts are runs: pieces of one format, or an opaque object by its identity. Changes are
runs too. Raw token changes are fragments where a text was rewritten; the clean-up
joins fragments between strong anchors to whole replacements, and gives back the
affixes that both sides share.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator, Sequence
from dataclasses import dataclass, replace
from itertools import groupby

from palimpsest.functions import kernels

#: Visible characters that make a kept run an anchor; change runs, and their share of all runs, from which
#: a stretch is a zipper; similarity under which it is replaced whole; least bytes that two sides must share for a split.
ANCHOR_CHARS, ZIPPER_RUNS, ZIPPER_SHARE, LOW_SIMILARITY, SHARED_BYTES, SOLID_CHARS = 8, 4, 0.20, 0.15, 4, 3

EQUAL, DELETE, INSERT = "equal", "delete", "insert"
OBJECT = "￼"


@dataclass(frozen=True)
class Piece:
    """A piece of a text: characters of one format, or an opaque object (``text`` is then its place holder)."""

    text: str
    format: Hashable = None
    opaque: str | None = None


@dataclass(frozen=True)
class Run:
    """A run of changes: what is kept, gone or new. ``before`` is the old format of kept text that was formatted anew."""

    op: str
    text: str
    format: Hashable = None
    before: Hashable = None
    opaque: str | None = None

    @property
    def look(self) -> tuple:
        return self.op, self.format, self.before


def pieces_of(text: str) -> list[Piece]:
    return [Piece(text)] if text else []


def _tokens(pieces: Sequence[Piece]) -> list[tuple[str, Hashable, str | None]]:
    """(token, format of its first character, identity of an object) over all pieces."""
    formats = [p.format for p in pieces if p.opaque is None for _ in p.text]
    out, at = [], 0
    for opaque, group in groupby(pieces, key=lambda p: p.opaque is not None):
        if opaque:
            out += [(OBJECT + p.opaque, p.format, p.opaque) for p in group]
            continue
        for token in kernels.tokens("".join(p.text for p in group)):
            out.append((token, formats[at], None))
            at += len(token)
    return out


def raw_changes(old: Sequence[Piece], new: Sequence[Piece]) -> list[Run]:
    """Token by token, before any clean-up."""
    a, b = _tokens(old), _tokens(new)
    out: list[Run] = []
    for op, i0, i1, j0, j1 in kernels.patience([t for t, _, _ in a], [t for t, _, _ in b]):
        for k in range(max(i1 - i0, j1 - j0)):
            token, fmt, opaque = b[j0 + k] if op != DELETE else a[i0 + k]
            was = a[i0 + k][1] if op == EQUAL else None
            out.append(Run(op, OBJECT if opaque else token, fmt, was if op == EQUAL and was != fmt else None, opaque))
    return out


def merged(runs: Sequence[Run]) -> list[Run]:
    """Neighbours of one look as one run; objects stay apart."""
    out: list[Run] = []
    for (look, opaque), group in groupby(runs, key=lambda r: (r.look, r.opaque is not None)):
        some = list(group)
        out += some if opaque or len(some) == 1 else [Run(look[0], "".join(r.text for r in some), *look[1:])]
    return out


def visible(text: str) -> int:
    return len("".join(text.split()))


def is_anchor(run: Run) -> bool:
    """Kept text that no replacement may swallow: enough of it, an enumerator, or an object."""
    if run.op != EQUAL:
        return False
    return run.opaque is not None or OBJECT in run.text or visible(run.text) >= ANCHOR_CHARS or kernels.is_enumerator(run.text.strip())


def change_runs(region: Sequence[Run]) -> int:
    """How often a stretch turns from one sort of change to another; slight kept text between does not count."""
    solid = [r.op for r in region if r.op != EQUAL or visible(r.text) >= SOLID_CHARS]
    return sum(op != EQUAL for op, _ in groupby(solid))


def is_zipper(region: Sequence[Run]) -> bool:
    """Whether a stretch between anchors reads better as one replacement."""
    if all(r.op == EQUAL for r in region):
        return False
    turns = change_runs(region)
    if turns >= ZIPPER_RUNS and turns / len(region) >= ZIPPER_SHARE:
        return True
    return kernels.block_similarity(side(region, INSERT), side(region, DELETE)) < LOW_SIMILARITY


def side(runs: Sequence[Run], without: str) -> str:
    return "".join(r.text for r in runs if r.op != without)


def collapsed(region: Sequence[Run]) -> list[Run]:
    """A stretch as what is gone, then what is new; runs that both begin or end with stay kept."""

    def of(op: str, skip: str) -> list[Run]:
        return merged([Run(op, r.text, r.format if op == INSERT or r.before is None else r.before, None, r.opaque) for r in region if r.op != skip and r.text])

    gone, come = of(DELETE, INSERT), of(INSERT, DELETE)
    if not gone or not come:
        return gone + come

    def same(x: Run, y: Run) -> bool:
        return (x.text, x.format, x.opaque) == (y.text, y.format, y.opaque)

    head = next((k for k, (x, y) in enumerate(zip(gone, come)) if not same(x, y)), min(len(gone), len(come)))
    rest = list(zip(reversed(gone[head:]), reversed(come[head:])))
    tail = next((k for k, (x, y) in enumerate(rest) if not same(x, y)), len(rest))
    kept = [replace(r, op=EQUAL) for r in come]
    return kept[:head] + gone[head : len(gone) - tail] + come[head : len(come) - tail] + (kept[len(come) - tail :] if tail else [])


def without_zippers(runs: Sequence[Run]) -> Iterator[Run]:
    for anchored, group in groupby(runs, key=is_anchor):
        region = list(group)
        yield from region if anchored or not is_zipper(region) else collapsed(region)


def parted(text: str, at: int) -> bool:
    """Whether a token may begin at a place of the text."""
    if at <= 0 or at >= len(text):
        return True
    a, b = kernels.char_class(text[at - 1]), kernels.char_class(text[at])
    return a != b or a == "other"


def with_shared_affixes(runs: Sequence[Run]) -> list[Run]:
    """Of a replacement within one format, the beginning and end that both sides share stay kept, at token borders,
    if they are more than what differs."""
    out: list[Run] = []
    waiting = list(runs)
    while waiting:
        gone = waiting.pop(0)
        if not (waiting and gone.op == DELETE and waiting[0].op == INSERT and gone.opaque is None and waiting[0].opaque is None and gone.format == waiting[0].format):
            out.append(gone)
            continue
        come = waiting.pop(0)
        old, new = gone.text, come.text
        least = min(len(old), len(new))
        head = next((k for k in range(least) if old[k] != new[k]), least)
        tail = next((k for k in range(least - head) if old[-1 - k] != new[-1 - k]), least - head)
        if head < least:
            while head and not (parted(old, head) and parted(new, head)):
                head -= 1
        if tail < least:
            while tail and not (parted(old, len(old) - tail) and parted(new, len(new) - tail)):
                tail -= 1
        shared, sizes = len((old[:head] + old[len(old) - tail :]).encode()), (len(old.encode()), len(new.encode()))
        own = min(sizes) - shared
        if own > 0 and shared > own and shared >= SHARED_BYTES:
            out += [Run(EQUAL, old[:head], come.format)] if head else []
            out += [replace(gone, text=old[head : len(old) - tail]), replace(come, text=new[head : len(new) - tail])]
            out += [Run(EQUAL, old[len(old) - tail :], come.format)] if tail else []
        else:
            out += [gone, come]
    return out


def cleaned(runs: Sequence[Run]) -> list[Run]:
    """Merge, collapse zippers, merge again, and share affixes."""
    return merged(with_shared_affixes(merged(list(without_zippers(merged(runs))))))


def in_reading_order(runs: Sequence[tuple[int, Run]]) -> list[tuple[int, Run]]:
    """Neighbouring objects by their place in the text, kept before gone before new."""
    out: list[tuple[int, Run]] = []
    for opaque, group in groupby(runs, key=lambda x: x[1].opaque is not None):
        rows = list(group)
        out += sorted(rows, key=lambda x: (x[0], (EQUAL, DELETE, INSERT).index(x[1].op))) if opaque else rows
    return out


def replaced(old: Sequence[Piece], new: Sequence[Piece]) -> list[Run]:
    """All gone, all new."""
    return merged([Run(op, p.text, p.format, None, p.opaque) for op, some in ((DELETE, old), (INSERT, new)) for p in some if p.text])


def changes(old: Sequence[Piece], new: Sequence[Piece], whole: bool = True) -> list[Run]:
    """D13, D15, D16 of two texts with formats. ``whole=False`` never gives way to a whole replacement."""
    a, b = "".join(p.text for p in old), "".join(p.text for p in new)
    if whole and kernels.unlike(a, b):
        return replaced(old, new)
    return cleaned(raw_changes(old, new))


def word_changes(old: str, new: str, whole: bool = True) -> list[tuple[str, str]]:
    """D12 of plain texts: (op, text) runs that rebuild either side."""
    if old == new:
        return [(EQUAL, old)] if old else []
    return [(r.op, r.text) for r in changes(pieces_of(old), pieces_of(new), whole)]
