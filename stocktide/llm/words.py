"""Words of many texts at once as 64-bit hashes, on numpy arrays."""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

from .common import per_process

cloudpickle.register_pickle_by_value(sys.modules[__name__])

_LONG = 64  # bytes; longer words are hashed one by one
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _word_bytes() -> np.ndarray:
    """Letters, digits and every byte of a character beyond ASCII."""
    kept = np.zeros(256, dtype=bool)
    kept[128:] = True
    for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
        kept[c] = True
    return kept


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-case words of all texts in a row, and where each text begins among them (one more at the end)."""
    import xxhash

    raws = [t.lower().encode() for t in texts]
    raw = b"\n".join(raws) + b"\n"
    data = np.frombuffer(raw, dtype=np.uint8)
    inside = per_process("word_bytes", _word_bytes)[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    starts, ends = np.nonzero(edge == 1)[0], np.nonzero(edge == -1)[0]
    lengths = ends - starts
    hashes = np.full(len(starts), 7, dtype=np.uint64)
    active = np.arange(len(starts))
    for k in range(_LONG):
        active = active[lengths[active] > k]
        if not len(active):
            break
        hashes[active] = hashes[active] * _ODD + data[starts[active] + k] + np.uint64(1)
    for i in np.nonzero(lengths > _LONG)[0]:
        hashes[i] = xxhash.xxh64_intdigest(raw[starts[i]:ends[i]])
    borders = np.cumsum([0, *(len(r) + 1 for r in raws)])
    return mixed(hashes), np.searchsorted(starts, borders)
