"""Token ids of whole texts through a cache of chunks.

A byte-level BPE splits a text into pre-tokens before it merges bytes, and a new
pre-token always begins at a space whose neighbours are not both white space. So a
text may be cut before such spaces and the chunks encoded one by one; words recur,
and a chunk's ids are looked up far more often than they are computed.

Added tokens of the vocabulary (its end mark) stand for themselves in a text, as the
tokenizers library has it: a text is parted at them first, and its parts are encoded
each for itself. ``added=False`` takes them as plain text instead.
"""

from __future__ import annotations

import base64
import json
import re
from array import array
from pathlib import Path

import public_tokenizers
import tiktoken

#: The vocabulary as ranks; its ids are those of byte_bpe_50k.json (tests compare them).
VOCABULARY = "byte_bpe_50k.tiktoken"
DESCRIPTION = "byte_bpe_50k.json"

#: A space between white space (or at the end): the one place where a cut could split a pre-token.
_UNSAFE = re.compile(r"\s (?:\s|\Z)")


def merge_core(path: str | None = None):
    lines = Path(path or public_tokenizers.path(VOCABULARY)).read_bytes().splitlines()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def added_tokens(path: str | None = None) -> dict[str, int]:
    """The vocabulary's added tokens and their ids."""
    described = json.loads(Path(path or public_tokenizers.path(DESCRIPTION)).read_bytes())
    return {t["content"]: t["id"] for t in described["added_tokens"]}


class _Known(dict):
    """Ids of chunks that begin with a space, by what follows it; emptied at ``most`` entries."""

    def __init__(self, encode, single, most: int):
        self.encode, self.single, self.most = encode, single, most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        chunk = " " + word
        ids = self.single(chunk.encode()) if word.isalpha() else self.encode(chunk)
        self[word] = out = array("I", ids).tobytes()
        return out


class ChunkEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str | None = None, most: int = 800_000, added: bool = True):
        core = merge_core(path)
        self.added = added_tokens() if added else {}
        self.parted = re.compile("(" + "|".join(map(re.escape, self.added)) + ")")
        self.encode = core.encode_ordinary
        self.known = _Known(core.encode_ordinary, core._core_bpe.encode_single_piece, most)

    def ids(self, text: str) -> bytes:
        """The ids of the whole text."""
        if any(t in text for t in self.added):
            parts = self.parted.split(text)
            return b"".join(array("I", [self.added[x]]).tobytes() if n % 2 else self._plain(x) for n, x in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _UNSAFE.search(text):
            return b"".join(array("I", self.encode(x)).tobytes() for x in safe_pieces(text))
        first, *rest = text.split(" ")
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.known.__getitem__, rest))

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


def safe_pieces(text: str) -> list[str]:
    """Pieces of any text whose ids, one after the other, are the text's: cuts at safe spaces alone."""
    cuts = [0]
    for m in re.finditer(" ", text):
        at = m.start()
        if at and at + 1 < len(text) and not text[at + 1].isspace():
            cuts.append(at)
    return [text[a:b] for a, b in zip(cuts, [*cuts[1:], len(text)])] if text else []
