"""Blocks of token ids, coded by an adaptive context-mixing range coder (all arithmetic on integers).

Each block starts from an empty model. Its ids are cut into lanes of neighbouring ids; the lanes are
coded in step, so one array operation serves all of them, and they share one model of three distributions:

  order 2  counts of the ids seen after the two ids before (hashed contexts, `WAYS[1]` ids of each),
  order 1  counts of the ids seen after the id before (`WAYS[0]` ids of each),
  order 0  counts of all ids.

The three are mixed by weights that depend on how much the contexts of order 1 and 2 have seen: the code
space is cut into the three weights, each part into its distribution, and an id is coded in the part that
gives it the widest interval. The weights follow how often each part was the one. Counts and weights adapt
with every id; sums of order 0 and the weights are renewed every `RARE` steps. A carry-less range coder with
64-bit state and 16-bit output takes the intervals.

A block: header (magic, ids, lanes, vocabulary, CRC-32 of the ids, CRC-32 of the body), then the body:
16-bit words of each lane (as 16-bit counts) and the lanes' words. An empty block is valid.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC, HEADER = b"TID2", struct.Struct("<4sIIIII")
STEPS = 512  # ids of a lane
SLOTS = 1 << 17  # hashed order-2 contexts
WAYS = (8, 4)
GAIN, MOST = 2, 2047  # of a count
NAME_BITS = 20  # of an id; the other bits are its count
NAMES = (1 << NAME_BITS) - 1
RARE = 16
U = np.uint64
TOP, BOTTOM, W16, W32, W48 = U(1 << 48), U((1 << 32) - 1), U(16), U(32), U(48)
SAFE = U(1 << 38)
SHARES = 22  # bits of the order-0 intervals
WHOLE, LEAST = 1 << 32, 1 << 22  # of the mixture's weights
SEEN = np.minimum(7, np.frexp(np.arange(WAYS[0] * (MOST + GAIN) + 1))[1] * 3 // 4 + (np.arange(WAYS[0] * (MOST + GAIN) + 1) > 0)).astype(np.uint8)  # classes of what a context has seen; 0: nothing

BITS = 1 << np.arange(8, dtype=np.uint8)[:, None]
FIRST = np.array([(x & -x).bit_length() - 1 if x else 8 for x in range(256)], dtype=np.int64)  # the first set bit of a byte, 8 if there is none


class CorruptBlock(ValueError):
    pass


class Order:
    """Ids seen in each context and their counts, in one number; the ways of a context lie side by side."""

    def __init__(self, contexts: int, ways: int) -> None:
        self.ways = ways
        self.table = np.full((contexts, ways), NAMES, dtype=np.int32)
        self.flat = self.table.reshape(-1)

    def look(self, at) -> None:
        self.at = at.astype(np.int64)
        found = np.ascontiguousarray(self.table.take(self.at, axis=0).T)
        self.own, self.upto = found & NAMES, found >> NAME_BITS
        # Counts as sums from the first way on; row by row, which is several times as fast as cumsum().
        for way in range(1, self.ways):
            self.upto[way] += self.upto[way - 1]
        self.total = self.upto[-1]
        self.seen = SEEN.take(self.total)

    def match(self, x, step: int) -> None:
        """Which ids are known, and in which way; what lies there, or else in the way whose turn it is."""
        same = (self.own == x).view(np.uint8) * BITS[: self.ways]
        self.way = FIRST.take(np.bitwise_or.reduce(same, axis=0))
        self.hit = self.way < 8
        self.way = np.where(self.hit, self.way, step % self.ways)
        self.place = self.at * self.ways + self.way
        self.was = self.flat.take(self.place)
        self.count = self.was >> NAME_BITS

    def part(self, start, width):
        """Begin and end of each lane's id in the part of this order; nothing where it is not known.

        Numbers are below 2^47, and quotients below 2^33 of divisors below 2^15: as doubles they are cut to the same whole numbers."""
        m = len(self.way)
        upto = self.upto.reshape(-1).take(self.way * m + np.arange(m))
        width, total = width.astype(np.float64), np.maximum(self.total, 1)
        return start + (width * (upto - self.count * self.hit) / total).astype(np.int64), start + (width * upto / total).astype(np.int64)

    def learn(self, x) -> None:
        """A known id gains; else the way whose turn it is loses, or goes to the new id when it is at its end."""
        was, n = self.was, self.count
        self.flat[self.place] = np.where(self.hit, was + (np.minimum(GAIN, MOST - n) << NAME_BITS), np.where(n <= 1, x + (GAIN << NAME_BITS), was - (1 << NAME_BITS)))


class Model:
    def __init__(self, lanes: int, vocabulary: int) -> None:
        self.vocabulary = vocabulary
        self.one, self.two = Order(vocabulary, WAYS[0]), Order(SLOTS, WAYS[1])
        self.counts = np.ones(vocabulary, dtype=np.int64)
        self.before, self.before2 = np.zeros(lanes, dtype=np.int32), np.zeros(lanes, dtype=np.int32)
        self.every = np.arange(vocabulary + 1)
        # By what the orders have seen (order 2, order 1): how often each order's part was the one.
        self.used = np.full((64, 3), 64, dtype=np.int64)
        self.used[:8, 2] = 0
        self.used[::8, 1] = 0
        self.ids, self.parts, self.states, self.step = [], [], [], 0
        self.sum_up()

    def sum_up(self) -> None:
        total = int(self.counts.sum())
        # Each id gets one place and its part of the rest.
        upto = np.zeros(self.vocabulary + 1, dtype=np.int64)
        np.cumsum(self.counts, out=upto[1:])
        upto = (upto * (((1 << SHARES) - self.vocabulary) / total)).astype(np.int64)
        upto[-1] = (1 << SHARES) - self.vocabulary
        upto += self.every
        self.places, self.narrow = upto, upto.astype(np.int32)
        w = self.used[:, 1:] * (WHOLE - 3 * LEAST) // np.maximum(1, self.used.sum(axis=1))[:, None] + LEAST
        w = np.where(self.used[:, 1:] > 0, w, 0)
        self.end2, self.end1 = w[:, 1], w.sum(axis=1)

    def predict(self, n: int) -> None:
        """For the first n lanes: where the parts of order 2 and 1 end, of WHOLE places; the rest is order 0's."""
        last, before = self.before[:n], self.before2[:n]
        self.one.look(last)
        self.two.look(((before * np.int32(0x2C9277B5) ^ last * np.int32(0x5F356495)) >> 11) & np.int32(SLOTS - 1))
        self.state = self.two.seen * 8 + self.one.seen
        self.e2, self.e1 = self.end2[self.state], self.end1[self.state]

    def intervals(self, x):
        """Begin and end of each lane's id, and whose part it is in."""
        room = WHOLE - self.e1
        a, b = self.e1 + (room * self.places[x] >> SHARES), self.e1 + (room * self.places[x + 1] >> SHARES)
        part = np.zeros(len(x), dtype=np.int64)
        for k, order, start, width in ((1, self.one, self.e2, self.e1 - self.e2), (2, self.two, 0, self.e2)):
            order.match(x, self.step)
            c, d = order.part(start, width)
            better = d - c > b - a
            a, b = np.where(better, c, a), np.where(better, d, b)
            np.copyto(part, k, where=better)
        return a, b, part

    def find(self, v):
        """The ids whose intervals hold the places v, with those intervals and whose part they are in."""
        n = len(v)
        x, a, b = np.zeros(n, dtype=np.int32), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        part = np.where(v < self.e2, 2, np.where(v < self.e1, 1, 0))
        k = np.flatnonzero(part == 0)
        room = WHOLE - self.e1[k]
        # The last id whose begin is not behind: begins are rounded down.
        place = ((((v[k] - self.e1[k] + 1) << SHARES) - 1) // room).astype(np.int32)
        order = np.argsort(place)  # near places one after the other find each other's way still warm
        k, room = k[order], room[order]
        s = np.searchsorted(self.narrow, place[order], side="right") - 1
        x[k], a[k], b[k] = s, self.e1[k] + (room * self.places[s] >> SHARES), self.e1[k] + (room * self.places[s + 1] >> SHARES)
        for which, order in ((1, self.one), (2, self.two)):
            k = np.flatnonzero(part == which)
            begin = self.e2[k] if which == 1 else 0
            width, total = ((self.e1 if which == 1 else self.e2)[k] - begin).astype(np.float64), order.total[k]
            # As doubles: see Order.part().
            place = (((v[k] - begin + 1) * total - 1) / width).astype(np.int32)
            way = (order.upto.take(k, axis=1) <= place).sum(axis=0, dtype=np.int8).astype(np.int64) * n + k
            x[k] = order.own.reshape(-1).take(way)
            high = order.upto.reshape(-1).take(way)
            low = np.where(way < n, 0, order.upto.reshape(-1).take(np.maximum(way - n, 0)))
            a[k], b[k] = begin + (width * low / total).astype(np.int64), begin + (width * high / total).astype(np.int64)
        self.one.match(x, self.step)
        self.two.match(x, self.step)
        return x, a, b, part

    def learn(self, x, part) -> None:
        """x: ids of the lanes (int32); whose part coded them."""
        self.ids.append(x)
        self.parts.append(part)
        self.states.append(self.state)
        self.one.learn(x)
        self.two.learn(x)
        self.step += 1
        if self.step % RARE == 0:
            self.counts += 32 * np.bincount(np.concatenate(self.ids), minlength=self.vocabulary)
            if self.step % 128 == 0:
                self.counts = (self.counts + 1) >> 1 if self.counts.sum() > 1 << 26 else self.counts
            seen = np.bincount(np.concatenate(self.states).astype(np.int64) * 3 + np.concatenate(self.parts), minlength=192).reshape(64, 3)
            self.used += 16 * seen - (self.used >> 4)
            self.ids, self.parts, self.states = [], [], []
            self.sum_up()
        n = len(x)
        self.before2[:n] = self.before[:n]
        self.before[:n] = x


def _shape(n: int) -> tuple[int, int, int, int]:
    """Lanes, steps, lanes that hold ids, ids of the last of those."""
    lanes = max(1, -(-n // STEPS))
    steps = -(-n // lanes)
    full = -(-n // steps) if n else 0
    return lanes, steps, full, n - (full - 1) * steps if n else 0


def _settle(low, rng, n: int, move) -> None:
    """Of the first n lanes: moves out 16 bits while the top bits are fixed or the range is short."""
    lo, r = low[:n], rng[:n]
    at = np.flatnonzero(((lo ^ (lo + r)) < TOP) | (r < SAFE))
    while len(at):
        lo, r = low[at], rng[at]
        fixed = (lo ^ (lo + r)) < TOP
        # A short range over an edge is cut at the next multiple of 2^32, which lies within it.
        r = np.where(fixed, r, (~lo & BOTTOM) + U(1)) << W16
        move(at, lo)
        lo = lo << W16
        low[at], rng[at] = lo, r
        at = at[((lo ^ (lo + r)) < TOP) | (r < SAFE)]


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """One block of ids below `vocabulary`."""
    ids = np.asarray(ids)
    n = len(ids)
    if n and int(ids.max()) >= vocabulary or vocabulary > NAMES:
        raise ValueError("an id is not in the vocabulary, or that is too large")
    crc = zlib.crc32(ids.astype("<u4").tobytes())
    lanes, steps, full, short = _shape(n)
    grid = np.zeros(lanes * steps, dtype=np.int32)
    grid[:n] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    low, rng = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    out_lane, out_word = [], []

    def move(at, lo) -> None:
        out_lane.append(at.astype(np.uint32))
        out_word.append((lo >> W48).astype(np.uint16))

    model = Model(lanes, vocabulary)
    for t in range(steps):
        m = full if t < short else full - 1
        x = grid[t, :m]
        model.predict(m)
        a, b, part = model.intervals(x)
        unit = rng[:m] >> W32
        low[:m] += unit * a.view(np.uint64)
        rng[:m] = unit * (b - a).view(np.uint64)
        _settle(low, rng, m, move)
        model.learn(x, part)
    # Two words name a place within the range, whatever follows them: no range is shorter than SAFE.
    low += BOTTOM
    for _ in range(2):
        move(np.arange(lanes), low)
        low <<= W16
    lane, word = np.concatenate(out_lane), np.concatenate(out_word)
    order = np.argsort(lane.astype(np.uint16) if lanes < 1 << 16 else lane, kind="stable")
    body = np.bincount(lane, minlength=lanes).astype("<u2").tobytes() + word[order].astype("<u2").tobytes()
    return HEADER.pack(MAGIC, n, lanes, vocabulary, crc, zlib.crc32(body)) + body


def decode(block: bytes) -> np.ndarray:
    """The ids of a block; CorruptBlock if a checksum doesn't fit."""
    magic, n, lanes, vocabulary, crc, body_crc = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise CorruptBlock("body")
    lanes, steps, full, short = _shape(n)
    counts = np.frombuffer(body, "<u2", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u2", offset=2 * lanes), np.zeros(4, "<u2")]).astype(np.uint64)
    ptr, last = np.cumsum(counts) - counts, len(words) - 1
    low, rng = np.zeros(lanes, dtype=np.uint64), np.full(lanes, (1 << 64) - 1, dtype=np.uint64)
    code = np.zeros(lanes, dtype=np.uint64)
    for _ in range(4):
        code = (code << W16) | words[np.minimum(ptr, last)]
        ptr += 1
    grid = np.zeros((steps, lanes), dtype=np.int32)

    def move(at, lo) -> None:
        code[at] = (code[at] << W16) | words[np.minimum(ptr[at], last)]
        ptr[at] += 1

    model = Model(lanes, vocabulary)
    for t in range(steps):
        m = full if t < short else full - 1
        model.predict(m)
        unit = rng[:m] >> W32
        v = np.minimum((code[:m] - low[:m]) // unit, BOTTOM).view(np.int64)
        x, a, b, part = model.find(v)
        low[:m] += unit * a.view(np.uint64)
        rng[:m] = unit * (b - a).view(np.uint64)
        _settle(low, rng, m, move)
        grid[t, :m] = x
        model.learn(x, part)
    ids = np.ascontiguousarray(grid.T).reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != crc:
        raise CorruptBlock("ids")
    return ids
