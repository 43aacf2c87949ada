"""Byte-pair merging with a heap over a linked list, and the splitting of text into pieces.

A piece is a stretch of text whose ends are pre-token boundaries wherever it stands, so its
tokens do not depend on its neighbours and can be remembered.
"""

from __future__ import annotations

import heapq
import json
import re
import sys

from pyspark import cloudpickle

from .common import per_process

cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Pre-token pattern of the byte-level vocabulary (fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_ODD = re.compile("[\x00\x1c-\x1f]")
_RUN = re.compile(r"\s\s")
_SPACES = re.compile(r"\s+")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def read_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in kept else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Merge ranks by pair of ids, bytes by id, and the special strings of a byte-level BPE file."""

    def __init__(self, text: str):
        data = json.loads(text)
        symbols = byte_symbols()
        byte_of = {s: b for b, s in enumerate(symbols)}
        ids = data["model"]["vocab"]
        self.first = [ids[s] for s in symbols]
        self.ranks = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[ids[a], ids[b]] = (rank, ids[a + b])
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes = [b""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, i in ids.items():
            if token not in self.special:
                self.bytes[i] = bytes(byte_of[c] for c in token)
        for token, i in self.special.items():
            self.bytes[i] = token.encode()

    @classmethod
    def shared(cls, text: str) -> Vocabulary:
        return per_process(("vocabulary", hash(text)), lambda: cls(text))


def merge(raw: bytes, vocab: Vocabulary) -> tuple[int, list[int], list[int]]:
    """Merge one pre-token: number of merges, symbols, and the links of the surviving ones.

    The heap holds adjacent pairs by rank, leftmost first; a stale entry is known by its symbols.
    """
    symbols = [vocab.first[b] for b in raw]
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    ranks = vocab.ranks
    heap = []
    for i in range(n - 1):
        pair = ranks.get((symbols[i], symbols[i + 1]))
        if pair:
            heap.append((pair[0], i, pair[1], symbols[i], symbols[i + 1]))
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        merges += 1
        symbols[i], symbols[j] = new, -1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            pair = ranks.get((new, symbols[k]))
            if pair:
                heapq.heappush(heap, (pair[0], i, pair[1], new, symbols[k]))
        h = before[i]
        if h >= 0:
            pair = ranks.get((symbols[h], new))
            if pair:
                heapq.heappush(heap, (pair[0], h, pair[1], symbols[h], new))
    return merges, symbols, after


def merged_ids(raw: bytes, vocab: Vocabulary) -> list[int]:
    return [s for s in merge(raw, vocab)[1] if s >= 0] if raw else []


def pretokens(text: str) -> list[str]:
    import regex

    return per_process("pretoken_pattern", lambda: regex.compile(PATTERN)).findall(text)


def _split_run(m) -> str:
    run = m[0]
    if m.end() == len(m.string):
        return "\x00" + run
    last = run[-1]
    return ("\x00" + run[:-1] if len(run) > 1 else "") + "\x00" + last + ("" if last == " " else "\x00")


def pieces(text: str) -> list[str]:
    """Cut before every space that opens a word and around every other white space.

    A run of white space before a word gives its last character to the word if that is a space
    and otherwise lets it stand alone, as the pattern does.
    """
    if _ODD.search(text):
        return pretokens(text)
    if _RUN.search(text):
        marked = _SPACES.sub(_split_run, text)
    else:
        marked = text.replace(" ", "\x00 ").replace("\n", "\x00\n\x00")
    return [p for p in marked.split("\x00") if p]


class Memory(dict):
    """Values by piece in two generations of bounded size; the older one goes when the newer is full."""

    def __init__(self, make, size: int = 600_000, longest: int = 48):
        super().__init__()
        self.make, self.size, self.longest, self.old = make, size, longest, {}

    def __missing__(self, piece):
        value = self.old.get(piece)
        if value is None:
            value = self.make(piece)
        if len(piece) <= self.longest:
            if len(self) >= self.size:
                self.old = dict(self)
                self.clear()
            self[piece] = value
        return value
