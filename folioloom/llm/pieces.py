"""Texts as pieces that tokenize independently of each other, each distinct piece encoded once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

from folioloom.llm import utf8

#: Bytes before and after which a cut is safe: printable ASCII, and letters of two bytes led by 0xC3 to 0xDF, none of
#: which is white space.
_PRINTABLE = np.zeros(256, bool)
_PRINTABLE[0x21:0x7F] = True
_LEAD = np.zeros(256, bool)
_LEAD[0xC3:0xE0] = True


def cut_words(buf: np.ndarray, offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where pieces start: at each text, and at a space or newline byte (mask at) between two characters that are
    surely not white space. A text without such places is one piece."""
    start = np.zeros(len(buf) + 1, bool)
    if len(buf) > 2:
        solid = _PRINTABLE[buf]
        solid[1:] |= _LEAD[buf[:-1]] & (buf[1:] >= 0x80)  # the end of a two-byte letter
        opens = _PRINTABLE[buf] | _LEAD[buf]
        start[1:-2] = at[1:-1] & solid[:-2] & opens[2:]
    start[offsets] = True
    start[len(buf)] = False
    return np.flatnonzero(start[:-1]) if len(buf) else np.zeros(0, np.int64)


class Memo:
    """Encodes each distinct piece once per worker: hash -> ids, held in flat arrays, dropped when over most ids."""

    def __init__(self, encode: Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]], most: int = 2_000_000):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.at = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def __call__(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces one after another, how many each piece has)."""
        keys, first, which = np.unique(utf8.hashes(buf, starts, ends), return_index=True, return_inverse=True)
        if len(self.ids) > self.most:
            self.clear()
        spot = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        new = np.flatnonzero(self.keys[spot] != keys) if len(self.keys) else np.arange(len(keys))
        if len(new):
            raw = buf.tobytes()
            ids, sizes = self.encode([raw[s:e] for s, e in zip(starts[first[new]].tolist(), ends[first[new]].tolist(), strict=True)])
            all_keys = np.concatenate([self.keys, keys[new]])
            order = np.argsort(all_keys)
            at = np.concatenate([self.at, len(self.ids) + np.cumsum(sizes) - sizes])
            self.keys, self.at, self.size = all_keys[order], at[order], np.concatenate([self.size, sizes])[order]
            self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
            spot = np.searchsorted(self.keys, keys)
        size = self.size[spot][which]
        return self.ids[utf8.flat(self.at[spot][which], size)], size


def per_text(piece_starts: np.ndarray, offsets: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Ids in each text, from the ids of its pieces."""
    total = np.r_[0, np.cumsum(sizes)]
    return np.diff(total[np.searchsorted(piece_starts, offsets)])
