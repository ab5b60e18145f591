"""Adaptive context-mixing range coder for token ids (operator 6): the coder itself.

Ids are cut into blocks.  Every block is coded by a model of its own that starts anew, so blocks decode
independently, and carries the crc32 of its ids.  The blocks of a segment are coded in lockstep, one id of
each block at a time, as numpy vectors: the work for an id is the same as one block alone would do.

For each id, the order-2 and order-1 tables name the id that last followed the same two ids or the same id,
with a confidence.  Hit rates by confidence (order 2, order 1) and overall (order 0) are mixed by
weights that follow each one's recent error; the mix gives the probability that the named id is right.
Otherwise the order-0 model of the block gives the id's bit length.  The bits below it are as likely as not: they go as they
are into a stream of bits beside the code words.  All arithmetic is on integers or exact, so a decoder on any machine takes the same steps.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids in a block, and blocks coded together in a segment.
BLOCK = 2048
LANES = 2048
#: Ids are below 2 to this power.
ID_BITS = 18
MAGIC = b"TLRC2\0"

TABLE_BITS = 10
TABLE = (1 << TABLE_BITS) - 1
ONE = 4096  # probability 1 of the flag and of a class
CODE_BITS = 24  # flag and class together
CLASSES = ID_BITS + 1
MIX_EVERY, COUNT_EVERY = 8, 32
SURE, UNSURE = 4048, 48  # a flag's probability stays between
# An interval is kept over 2**40; 16 bits leave it at a time.
TOP, SHORT = 56, 1 << 40
LOW = (1 << TOP) - 1
MULTIPLY_1, MULTIPLY_2 = 0x9E3779B1 & 0x7FFFFF, 0x85EBCA77 & 0x7FFFFF


class _Model:
    """State of all blocks of a segment; the first ``n`` are still active in a step.  Of pairs the first is order 1, the second order 2."""

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        pair = np.stack([self.lane, self.lane + lanes])
        self.at, self.row = pair << TABLE_BITS, pair << 4
        self.table = np.empty(2 * lanes << TABLE_BITS, np.int32)
        self.table.fill(0)
        self.place = self.at
        self.rate = np.tile(np.arange(16, dtype=np.int32) // 2 * 500 + 60, 2 * lanes)
        self.rate0 = np.full(lanes, 500, np.int32)
        self.weight = np.full((2, lanes), 85, np.int32)
        self.error = np.full((3, lanes), 1000, np.int32)
        # Order 0 starts as for a vocabulary in falling order of frequency: longer ids are more, but each is rarer.
        self.count = np.repeat(np.arange(1, CLASSES + 1, dtype=np.int64)[:, None], lanes, 1)
        self.frequencies()

    def frequencies(self):
        """Class frequencies from the counts so far, by (class, block); each is 8 at least."""
        self.freq = self.count * (ONE - 9 * CLASSES) // self.count.sum(0) + 8
        self.freq[-1] += ONE - self.freq.sum(0)
        self.cum = np.zeros((CLASSES + 1, len(self.lane)), np.int64)
        np.cumsum(self.freq, axis=0, out=self.cum[1:])
        self.above = self.cum[1:-1].astype(np.int16)
        self.span = (self.cum[:-1] << 16) + self.freq

    def counted(self, cells: list[np.ndarray]):
        """``cells`` (class * blocks + block): those of the ids not named since the frequencies were last made."""
        self.count += 2 * np.bincount(np.concatenate(cells), minlength=self.count.size).reshape(self.count.shape)
        self.frequencies()

    def places(self, ids: np.ndarray, before: np.ndarray) -> np.ndarray:
        """Where the tables keep what followed ``ids`` (rows of one id of each block), and ``ids`` behind ``before``."""
        h = np.empty((2, *ids.shape), np.int64)
        np.multiply(ids, MULTIPLY_1, out=h[0], dtype=np.int64)
        np.multiply(before, MULTIPLY_2, out=h[1], dtype=np.int64)
        h[1] += h[0]
        h[0] >>= 9
        h[1] >>= 11
        h &= TABLE
        h += self.at[:, None, :ids.shape[1]]
        return h

    def predict(self, n: int):
        """The named id, and the probability (of ONE) that it is right."""
        x = self.table.take(self.place)
        c, by = x & 7, x >> 3
        named = np.where(c[1] > 0, by[1], by[0])
        k = self.row[:, :n] + ((c << 1) + (by[0] == by[1]))
        q, q0 = self.rate.take(k), self.rate0[:n]
        self.seen = x, c, by, k, q
        m = (q - q0) * self.weight[:, :n]
        return named, ((q0 << 8) + m[0] + m[1]) >> 8

    def interval(self, p: np.ndarray, hit: np.ndarray, cell: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and length of what was coded: the named id is right, or else the class of ``cell``."""
        named_part, rest, span = p << 12, ONE - p, self.span.take(cell)
        start = rest * (span >> 16)
        start += named_part
        start *= ~hit
        span &= 0xFFFF
        span *= rest
        np.copyto(span, named_part, where=hit)
        return start, span

    def update(self, t: int, n: int, ids: np.ndarray, hit: np.ndarray, following: np.ndarray):
        """Learns ``ids``; ``following`` are the places of the next step."""
        x, c, by, k, q = self.seen
        q0 = self.rate0[:n]
        target = np.where(hit, np.int32(SURE), np.int32(UNSURE))
        if t % MIX_EVERY == MIX_EVERY - 1:
            e = self.error[:, :n]
            e += (np.abs(target - np.stack([q0, *q])) - e) >> 3
            g = (1 << 24) // (e.astype(np.int64) + 32)
            self.weight[:, :n] = (g[1:] << 8) // g.sum(0)
        q0 += (target - q0) >> 5
        self.rate[k] = q + ((target - q) >> 4)
        right = by == ids
        x += _STEP.take(c + (right << np.int32(3)))
        np.copyto(x, (ids << 3) + 1, where=(c <= 1) & ~right)
        self.table[self.place] = x
        self.place = following


#: What a confidence changes by, first where the named id was wrong.
_STEP = np.array([-1] * 8 + [1] * 7 + [0], np.int32)
#: Bit length of each id.
_LENGTH = np.zeros(1 << ID_BITS, np.int64)
for _k in range(1, CLASSES):
    _LENGTH[1 << (_k - 1):1 << _k] = _k
_BASE = np.array([0, *(1 << k for k in range(ID_BITS))])
_RAW = np.array([0, *range(ID_BITS)])
_MASK = (1 << _RAW) - 1


class _Encoder:
    def __init__(self, lanes: int, block: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, LOW, np.int64)
        # An id takes less than 16 bits here.  A word that overflows keeps its carry until the end.
        self.wide = block + 8
        self.out, self.pos = np.zeros(lanes * self.wide, np.uint32), np.arange(lanes) * self.wide

    def put(self, n: int, start, freq):
        """Narrow each interval to [start, start + freq) of ``1 << CODE_BITS``; 16 bits leave those that got short."""
        low, r = self.low[:n], self.range[:n]
        r >>= CODE_BITS
        low += r * start
        r *= freq
        carry = np.nonzero(low > LOW)[0]
        self.out[self.pos[carry] - 1] += 1
        low &= LOW
        short = np.nonzero(r < SHORT)[0]
        x = low[short]
        pos = self.pos[short]
        self.out[pos] = x >> (TOP - 16)
        self.pos[short] = pos + 1
        low[short] = (x << 16) & LOW
        r[short] <<= 16

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """Words of every block, one block after another, and their numbers."""
        for word in (self.low >> 40, self.low >> 24, self.low >> 8, self.low << 8):
            self.out[self.pos] = word & 0xFFFF
            self.pos += 1
        sizes = self.pos - np.arange(len(self.pos)) * self.wide
        words = self.out.reshape(-1, self.wide)
        for k in range(int(sizes.max()) - 1, 0, -1):
            words[:, k - 1] += words[:, k] >> 16
        return words[np.arange(self.wide) < sizes[:, None]].astype("<u2"), sizes


class _Decoder:
    def __init__(self, words: np.ndarray, starts: np.ndarray):
        self.words, self.pos = np.concatenate([words, np.zeros(4, np.uint16)]).astype(np.int64), starts + 4
        self.range = np.full(len(starts), LOW, np.int64)
        self.code = np.zeros(len(starts), np.int64)
        for k in range(3):
            self.code = (self.code << 16) + self.words[starts + k]
        self.code = (self.code << 8) + (self.words[starts + 3] >> 8)
        # Three words and half of the next are in: the halves are read one word later than they lie.
        self.half = self.words[starts + 3] & 0xFF

    def peek(self, n: int):
        self.r = self.range[:n] >> CODE_BITS
        return np.minimum(self.code[:n].view(np.uint64) // self.r.view(np.uint64), np.uint64((1 << CODE_BITS) - 1)).view(np.int64)

    def take(self, n: int, start, freq):
        code, r = self.code[:n], self.range[:n]
        code -= self.r * start
        np.multiply(self.r, freq, out=r)
        short = np.nonzero(r < SHORT)[0]
        word = self.words.take(self.pos[short], mode="clip")
        code[short] = (code[short] << 16) + (self.half[short] << 8) + (word >> 8)
        self.half[short] = word & 0xFF
        self.pos[short] += 1
        r[short] <<= 16


def _packed(values: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Each value's ``bits`` bits, one value after another, as 16-bit words."""
    ends = np.cumsum(bits)
    at = ends - bits
    # A value of at most 17 bits lies in three words at most; no two values share a bit, so that sums are exact.
    window = values << (48 - bits - (at & 15))
    at >>= 4
    out = np.zeros((int(bits.sum()) >> 4) + 3)
    for k in range(3):
        out[k:] += np.bincount(at, ((window >> (32 - 16 * k)) & 0xFFFF).astype(float), len(out))[:len(out) - k]
    return out.astype("<u2")


def encode_segment(ids: np.ndarray, block: int = BLOCK) -> bytes:
    """Bytes of a segment: header, for each block its number of words and of plain bits and the crc32 of its ids, the code words, the plain bits."""
    ids = np.ascontiguousarray(ids, "<u4")
    total = len(ids)
    if total and int(ids.max()) >> ID_BITS:
        raise ValueError(f"ids must be below 2**{ID_BITS}")
    lanes = -(-total // block)
    head = np.array([block, total, lanes], "<u8").tobytes()
    if not lanes:
        return MAGIC + head
    grid = np.zeros((lanes, block), np.int32)
    grid.ravel()[:total] = ids
    tail, steps = total - (lanes - 1) * block, min(block, total)
    grid = np.ascontiguousarray(grid.T)
    model, coder = _Model(lanes), _Encoder(lanes, block)
    hits = np.ones(grid.shape, bool)
    before = np.zeros((1, lanes), np.int32)
    for first in range(0, steps, COUNT_EVERY):
        rows = grid[first:first + COUNT_EVERY]
        cells = _LENGTH.take(rows) * lanes + model.lane
        places = model.places(rows, np.concatenate([before, rows[:-1]]))
        before, missed = rows[-1:], []
        for t in range(first, min(first + COUNT_EVERY, steps)):
            n = lanes if t < tail else lanes - 1
            now, cell = rows[t - first, :n], cells[t - first, :n]
            named, p = model.predict(n)
            p = p.astype(np.int64)
            hit = np.equal(named, now, out=hits[t, :n])
            coder.put(n, *model.interval(p, hit, cell))
            missed.append(cell[~hit])
            model.update(t, n, now, hit, places[:, t - first, :lanes if t + 1 < tail else lanes - 1])
        model.counted(missed)
    words, sizes = coder.finish()
    plain = ids[~np.ascontiguousarray(hits.T).ravel()[:total]].astype(np.int64)
    of = _LENGTH.take(plain)
    bits = _RAW.take(of)
    ends = np.append(0, np.cumsum(bits))
    missed = np.append(0, np.cumsum((~hits).sum(0)))
    lengths = np.diff(ends.take(missed))
    sums = [zlib.crc32(ids[k * block:(k + 1) * block].tobytes()) for k in range(lanes)]
    return b"".join([MAGIC, head, sizes.astype("<u4").tobytes(), lengths.astype("<u4").tobytes(), np.array(sums, "<u4").tobytes(), words.tobytes(),
                     _packed(plain - _BASE.take(of), bits).tobytes()])


def decode_segment(data: bytes) -> np.ndarray:
    """Ids of a segment (uint32); raises ValueError where the header or the checksum of a block doesn't hold."""
    if data[:len(MAGIC)] != MAGIC or len(data) < len(MAGIC) + 24:
        raise ValueError("not a segment of token ids")
    at = len(MAGIC)
    block, total, lanes = (int(x) for x in np.frombuffer(data, "<u8", 3, at))
    if not lanes:
        return np.zeros(0, np.uint32)
    at += 24
    sizes, lengths, sums = (np.frombuffer(data, "<u4", lanes, at + 4 * lanes * k).astype(np.int64) for k in range(3))
    words = np.frombuffer(data, "<u2", -1, at + 12 * lanes)
    n_words = int(sizes.sum())
    if len(words) != n_words + (int(lengths.sum()) >> 4) + 3:
        raise ValueError("a segment of token ids is cut short")
    # Plain bits from any place on: three words from the one that it lies in.
    plain = words[n_words:].astype(np.int64)
    plain = (plain[:-2] << 32) + (plain[1:-1] << 16) + plain[2:]
    bit = np.cumsum(lengths) - lengths
    tail, steps = total - (lanes - 1) * block, min(block, total)
    grid = np.zeros((steps, lanes), np.int32)
    model, coder = _Model(lanes), _Decoder(words[:n_words], np.cumsum(sizes) - sizes)
    before, missed = np.zeros(lanes, np.int32), []
    for t in range(steps):
        n = lanes if t < tail else lanes - 1
        named, p = model.predict(n)
        p = p.astype(np.int64)
        s = coder.peek(n)
        named_part, rest = p << 12, ONE - p
        hit = s < named_part
        # A quotient of integers this small is exact in its whole part.
        s = ((s - named_part) / rest).astype(np.int16)
        k = np.where(hit, 0, np.add.reduce((model.above[:, :n] <= s).view(np.int8), 0, np.int8)).astype(np.int64)
        cell = k * len(model.lane) + model.lane[:n]
        coder.take(n, *model.interval(p, hit, cell))
        raw, own = _RAW.take(k), bit[:n]
        value = (plain.take(own >> 4, mode="clip") >> (48 - raw - (own & 15))) & _MASK.take(k)
        own += raw
        now = np.where(hit, named, _BASE.take(k) + value).astype(np.int32)
        missed.append(cell[~hit])
        grid[t, :n] = now
        following = lanes if t + 1 < tail else lanes - 1
        model.update(t, n, now, hit, model.places(now[None, :following], before[None, :following])[:, 0])
        before = now
        if t % COUNT_EVERY == COUNT_EVERY - 1:
            model.counted(missed)
            missed = []
    out = np.ascontiguousarray(grid.T).ravel().astype("<u4")[:total]
    for k in range(lanes):
        if zlib.crc32(out[k * block:(k + 1) * block].tobytes()) != sums[k]:
            raise ValueError(f"checksum of block {k} doesn't hold")
    return out
