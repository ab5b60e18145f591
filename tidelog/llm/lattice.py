"""The lattice of a word: every way to segment it into pieces of a vocabulary, weighted by the pieces' scores.

Words of one length are taken together as numpy vectors.  A word is spelt with a mark before it; pieces that begin
with the mark begin words, the others go on.  Any character may also come from the piece ``other``, evenly.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np

MARK = "▁"
CHARACTERS = 0x110000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
SLOT_BITS = 18
NONE = -1e30
#: Words of one length taken at once.
TOGETHER = 8192


def _hash(codes: np.ndarray) -> np.ndarray:
    """Hashes of all prefixes of each row: (rows, length + 1)."""
    out = np.zeros((codes.shape[0], codes.shape[1] + 1), np.uint64)
    for k in range(codes.shape[1]):
        out[:, k + 1] = out[:, k] * _BASE + codes[:, k].astype(np.uint64) + np.uint64(1)
    return out


def _codes(words: list[str]) -> np.ndarray:
    """Code points of words of one length with the mark before each; a mark inside a word is no piece's character."""
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), -1)
    out = np.empty((len(words), flat.shape[1] + 1), np.uint32)
    out[:, 0] = ord(MARK)
    out[:, 1:] = np.where(flat == ord(MARK), CHARACTERS, flat)
    return out


class Lattice:
    """``pieces``: distinct nonempty strings with the mark at most at their start.  ``scores``: natural log probabilities
    of the pieces, then of ``other`` (any character, evenly) and of the end of a text; they sum to one."""

    def __init__(self, pieces: list[str]):
        self.pieces = pieces
        self.other, self.end = len(pieces), len(pieces) + 1
        self.longest = max((len(p) for p in pieces), default=1)
        by_length = defaultdict(list)
        for k, p in enumerate(pieces):
            by_length[len(p)].append(k)
        self.keys = np.zeros(len(pieces) + 1, np.uint64)
        for n, own in by_length.items():
            codes = np.frombuffer("".join(pieces[k] for k in own).encode("utf-32-le"), np.uint32).reshape(len(own), n)
            self.keys[own] = _hash(codes)[:, n]
        self.power = np.array([pow(int(_BASE), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        # A piece lies in the slot of its hash, or where that is taken in the second table, or else in a sorted list.
        none = len(pieces)
        self.first, self.second = (np.full(1 << SLOT_BITS, none, np.int32) for _ in range(2))
        slots = self._slot(self.keys[:none], 0)
        _, kept = np.unique(slots, return_index=True)
        self.first[slots[kept]] = kept
        rest = np.setdiff1d(np.arange(none), kept)
        slots = self._slot(self.keys[rest], 1)
        _, kept = np.unique(slots, return_index=True)
        self.second[slots[kept]] = rest[kept]
        # The few that neither table holds, in the order of their keys.
        last = np.setdiff1d(rest, rest[kept])
        self.last = last[np.argsort(self.keys[last])]

    @staticmethod
    def _slot(h: np.ndarray, table: int) -> np.ndarray:
        return ((h * _ODD) >> np.uint64(64 - SLOT_BITS) if table == 0 else (h ^ (h >> np.uint64(31))) & np.uint64((1 << SLOT_BITS) - 1)).astype(np.int64)

    def _find(self, h: np.ndarray) -> np.ndarray:
        """Piece of each hash, or the number of pieces where there is none."""
        k = self.first[self._slot(h, 0)]
        missed = np.nonzero(self.keys[k] != h)[0]
        if len(missed):
            again = self.second[self._slot(h[missed], 1)]
            k[missed] = np.where(self.keys[again] == h[missed], again, len(self.pieces))
            if len(self.last):
                missed = missed[k[missed] == len(self.pieces)]
                at = np.searchsorted(self.keys[self.last], h[missed]) % len(self.last)
                k[missed] = np.where(self.keys[self.last[at]] == h[missed], self.last[at], k[missed])
        return k

    def _arcs(self, codes: np.ndarray, scores: np.ndarray):
        """For each end position: start positions, the pieces found and the arcs' log weights (starts, rows)."""
        table = np.append(scores[:len(self.pieces)], NONE)
        other = scores[self.other] - np.log(CHARACTERS)
        h = _hash(codes)
        for end in range(1, codes.shape[1] + 1):
            starts = np.arange(max(0, end - self.longest), end)
            found = np.stack([self._find(h[:, end] - h[:, s] * self.power[end - s]) for s in starts])
            weight = table[found]
            if starts[-1] > 0:  # the mark before a word comes from a piece
                weight[-1] = np.logaddexp(weight[-1], other)
            yield end, starts, found, weight

    def _forward(self, codes, scores, arcs=None):
        f = np.full((codes.shape[1] + 1, len(codes)), NONE)
        f[0] = 0.0
        for end, starts, found, weight in self._arcs(codes, scores):
            x = f[starts] + weight
            top = x.max(axis=0)
            f[end] = top + np.log(np.exp(x - top).sum(axis=0))
            if arcs is not None:
                arcs.append((end, starts, found, weight))
        return f

    def log_marginals(self, words: list[str], scores: np.ndarray) -> np.ndarray:
        """Natural log of the total weight of all segmentations of each nonempty word: forward recursion in log space."""
        out = np.zeros(len(words))
        for own in _by_length(words):
            out[own] = self._forward(_codes([words[k] for k in own]), scores)[-1]
        return out

    def expected(self, words: list[str], weights: np.ndarray, scores: np.ndarray) -> np.ndarray:
        """Expected uses of each piece, ``other`` and the end (none) in the words, by forward and backward recursions."""
        total = np.zeros(len(self.pieces) + 2)
        other = scores[self.other] - np.log(CHARACTERS)
        for own in _by_length(words):
            codes, arcs = _codes([words[k] for k in own]), []
            f = self._forward(codes, scores, arcs)
            b = np.full(f.shape, NONE)
            b[-1] = 0.0
            for end, starts, found, weight in reversed(arcs):
                through = weight + b[end]
                b[starts] = np.logaddexp(b[starts], through)
                use = np.exp(f[starts] + through - f[-1]) * weights[own]
                if starts[-1] > 0:
                    share = np.exp(other - weight[-1]) * use[-1]
                    total[self.other] += share.sum()
                    use[-1] -= share
                total[:len(self.pieces)] += np.bincount(found.ravel(), use.ravel(), len(self.pieces) + 1)[:-1]
        return total


def _by_length(words: list[str]):
    length = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(length, kind="stable")
    cuts = np.nonzero(np.diff(length[order]))[0] + 1
    for own in np.split(order, cuts):
        step = max(1, TOGETHER * 16 // max(16, int(length[own[0]]))) if len(own) else 1
        for k in range(0, len(own), step):
            yield own[k:k + step]
