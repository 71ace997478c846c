"""Adaptive context-mixing range coder for token ids below 65536.

An id is predicted from the two ids before it (order 2) and from the one before it (order 1), each context holding one
id and how sure it is of it; two adaptive models, of the contexts' sureness and of the last outcomes, are mixed to say
how likely either prediction is to hold.  An id that neither predicts is coded by order-0 frequencies of its high and
low byte.  One range coding step does all of it.

Blocks of BLOCK ids are coded on their own, from fresh models, and carry a checksum.  Many blocks are coded at the
same time, as lanes of numpy arrays, so that the work per id is a few nanoseconds of each array operation.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
#: Blocks coded at the same time.
LANES = 6144
#: Slots of a lane's order-1 and order-2 contexts.
SLOT_BITS = 10
#: Ids after which the order-0 frequencies are drawn up anew.
REBUILDS = frozenset((32, 96, 256, 640, 1280))

_TOP, _BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
_WORD, _TOTAL, _REST = np.uint64(16), np.uint64(28), np.uint64(48)
_HEAD = struct.Struct("<III")
_MASK = (1 << SLOT_BITS) - 1
#: Three counts of 20 bits in one number: literals, order 2, order 1.
_COUNT, _OLD = (1 << 20) - 1, 0x7FFF | 0x7FFF << 20 | 0x7FFF << 40
_START = 16 | 16 << 20 | 16 << 40
_MORE = np.array([24, 24 << 20, 24 << 40], np.int64)


class _Model:
    """What encoder and decoder both know of each lane after the same ids."""

    def __init__(self, lanes: int):
        n = self.n = lanes
        lane = np.arange(n, dtype=np.int64)
        self.lane, self.slots, self.of_sure, self.of_past = lane, lane << SLOT_BITS, lane << 5, lane << 6
        self.bytes, self.places = lane * 768, lane * 3072
        # Contexts hold an id, times 4, and how sure it is, 0 for none.
        self.t1, self.t2 = (np.zeros(n << SLOT_BITS, np.int32) for _ in range(2))
        self.p1, self.p2 = (np.zeros(n, np.int64) for _ in range(2))
        # Counts of the outcomes by the contexts' sureness and by the last three outcomes.
        self.sure, self.past = np.full(n << 5, _START, np.int64), np.full(n << 6, _START, np.int64)
        self.history = np.zeros(n, np.int64)
        # Order 0: high bytes, and low bytes for the high byte 0 and for others.
        self.seen = np.zeros((n, 3, 256), np.int32)
        self.rebuild(None)

    def rebuild(self, ids: np.ndarray | None) -> None:
        """Frequencies of 10 bits, one at least for each byte, with the ids (steps x lanes) since the last time."""
        if ids is not None:
            high, low = ids >> 8, ids & 255
            keys = np.concatenate([self.bytes + high, self.bytes + 256 + 256 * (high > 0) + low]).ravel()
            self.seen += np.bincount(keys, minlength=self.seen.size).astype(np.int32).reshape(self.seen.shape)
        f = 1 + self.seen * np.int32(767) // (self.seen.sum(2, keepdims=True, dtype=np.int32) + np.int32(1))
        f[:, :, 0] += 1024 - f.sum(2, dtype=np.int32)
        self.share = f.ravel()
        # Where a byte begins, times 2048, and its frequency.
        self.range = ((np.cumsum(f, axis=2, dtype=np.int32) - f << 11) + f).ravel()

    def byte_at(self) -> np.ndarray:
        """The byte of each of 1024 places, for decoding."""
        return np.repeat(np.tile(np.arange(256, dtype=np.uint8), 3 * self.n), self.share)

    def predict(self) -> None:
        h = self.p1 * 40503
        self.i1 = self.slots + (h >> 5 & _MASK)
        self.i2 = self.slots + (h + self.p2 * 210077 >> 5 & _MASK)
        self.e1, self.e2 = self.t1.take(self.i1), self.t2.take(self.i2)
        self.s1, self.s2 = self.e1 & 3, self.e2 & 3
        self.d1, self.d2 = self.e1 >> 2, self.e2 >> 2
        same = self.d1 == self.d2
        self.use2 = self.s2 > 0
        self.use1 = (self.s1 > 0) & ~(same & self.use2)
        self.ka = self.of_sure + ((self.s2 << 3) + (self.s1 << 1) + same)
        self.kb = self.of_past + self.history
        self.va, self.vb = self.sure.take(self.ka), self.past.take(self.kb)
        v = self.va + self.vb
        n1, n2 = v >> 20 & _COUNT, v >> 40
        scale = 252.0 / ((v & _COUNT) + n1 + n2)
        self.w2 = ((n1 * scale).astype(np.int64) + 1) * self.use2
        self.w1 = ((n2 * scale).astype(np.int64) + 1) * self.use1
        self.w0 = 256 - self.w1 - self.w2

    def learn(self, ids: np.ndarray, kind: np.ndarray) -> None:
        """kind: 0 literal, 1 order 2, 2 order 1."""
        more = _MORE.take(kind)
        self.sure[self.ka] = self.va + more - (self.va >> 5 & _OLD)
        self.past[self.kb] = self.vb + more - (self.vb >> 5 & _OLD)
        self.history = (self.history << 2 | kind) & 63
        fresh = (ids << 2) + 1
        for table, at, e, held, sure in ((self.t1, self.i1, self.e1, self.d1, self.s1), (self.t2, self.i2, self.e2, self.d2, self.s2)):
            hit = (held == ids) & (sure > 0)
            table[at] = np.where(hit, e + (sure < 3), np.where(sure > 1, e - 1, fresh))
        self.p2, self.p1 = self.p1, ids

    def interval(self, literal, kind, high_range, low_range) -> tuple[np.ndarray, np.ndarray]:
        """Begin and width of an outcome among 2 ** 28."""
        fh, fl = high_range & 2047, low_range & 2047
        ch, cl = (high_range >> 11).astype(np.int64), low_range >> 11
        order1 = kind == 2
        begin = np.where(literal, self.w0 * ((ch << 10) + fh * cl), self.w0 + self.w2 * order1 << 20)
        width = np.where(literal, self.w0 * fh * fl, np.where(order1, self.w1, self.w2) << 20)
        return begin.view(np.uint64), width.view(np.uint64)


def _narrowed(at, low, span):
    """Lanes that have a word settled (or too little room left), with low and span before the word goes."""
    small = span < _BOTTOM
    settled = (low ^ (low + span)) < _TOP
    go = np.flatnonzero(settled | small)
    if len(go) == 0:
        return at[:0], low, span
    at, low, span = at.take(go), low.take(go), span.take(go)
    tight = small.take(go) & ~settled.take(go)
    return at, low, np.where(tight, (~low + np.uint64(1)) & (_BOTTOM - np.uint64(1)), span)


def encode_lanes(blocks: np.ndarray) -> list[bytes]:
    """Code rows of equally many ids."""
    n, size = blocks.shape
    m = _Model(n)
    low, span = np.zeros(n, np.uint64), np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    out, end = np.empty((n, 2 * size + 8), np.uint16), np.zeros(n, np.int64)
    steps = np.ascontiguousarray(blocks.T.astype(np.int64))
    high, lo = steps >> 8, steps & 255
    lo += 256 + 256 * (high > 0)
    built = 0
    for t in range(size):
        if t in REBUILDS:
            m.rebuild(steps[built:t])
            built = t
        ids = steps[t]
        m.predict()
        by2, by1 = (m.d2 == ids) & m.use2, (m.d1 == ids) & m.use1
        kind = by2 + (by1.view(np.int8) << 1).astype(np.int64)
        begin, width = m.interval(kind == 0, kind, m.range.take(m.bytes + high[t]), m.range.take(m.bytes + lo[t]))
        r = span >> _TOTAL
        low += r * begin
        span = r * width
        at, l, s = _narrowed(m.lane, low, span)
        while len(at):
            to = end.take(at)
            out[at, to] = l >> _REST
            end[at] = to + 1
            l, s = l << _WORD, s << _WORD
            low[at], span[at] = l, s
            at, l, s = _narrowed(at, l, s)
        m.learn(ids, kind)
    for _ in range(4):
        out[m.lane, end] = low >> _REST
        end += 1
        low <<= _WORD
    return [out[i, : end[i]].astype("<u2").tobytes() for i in range(n)]


def decode_lanes(payloads: list[bytes], size: int) -> np.ndarray:
    """The ids of blocks that have `size` ids each."""
    n = len(payloads)
    m = _Model(n)
    words = np.zeros((n, max(map(len, payloads), default=0) // 2 + 8), np.uint64)
    for i, p in enumerate(payloads):
        words[i, : len(p) // 2] = np.frombuffer(p, "<u2")
    last = words.shape[1] - 1
    low, code, end = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, np.int64)
    span = np.full(n, 0xFFFFFFFFFFFFFFFF, np.uint64)
    for _ in range(4):
        code = (code << _WORD) | words[m.lane, end]
        end += 1
    out, built, find = np.empty((size, n), np.int64), 0, m.byte_at()
    most = np.uint64((1 << 28) - 1)
    for t in range(size):
        if t in REBUILDS:
            m.rebuild(out[built:t])
            built, find = t, m.byte_at()
        m.predict()
        r = span >> _TOTAL
        v = np.minimum((code - low) // r, most).view(np.int64)
        top = v >> 20
        not0 = top >= m.w0
        kind = not0.astype(np.int64) + (top >= m.w0 + m.w2)
        kind *= not0
        literal = ~not0
        # A literal's place among 2 ** 20; anything for the others.
        q = np.minimum((v / m.w0).astype(np.int64), (1 << 20) - 1)
        high = find.take(m.places + (q >> 10)).astype(np.int64)
        high_range = m.range.take(m.bytes + high)
        rest = np.minimum((q - ((high_range >> 11).astype(np.int64) << 10)) // (high_range & 2047), 1023)
        other = high > 0
        lo = find.take(m.places + 1024 + (other.astype(np.int64) << 10) + rest).astype(np.int64)
        low_range = m.range.take(m.bytes + 256 + (other.astype(np.int64) << 8) + lo)
        ids = np.where(literal, high << 8 | lo, np.where(kind == 2, m.d1, m.d2))
        begin, width = m.interval(literal, kind, high_range, low_range)
        low += r * begin
        span = r * width
        at, l, s = _narrowed(m.lane, low, span)
        while len(at):
            to = end.take(at)
            code[at] = (code.take(at) << _WORD) | words[at, np.minimum(to, last)]
            end[at] = to + 1
            l, s = l << _WORD, s << _WORD
            low[at], span[at] = l, s
            at, l, s = _narrowed(at, l, s)
        m.learn(ids, kind)
        out[t] = ids
    return out.T


def _groups(n: int) -> list[tuple[int, int]]:
    """n blocks in groups of about the same size, of LANES at most."""
    k = -(-n // LANES)
    return [(n * i // k, n * (i + 1) // k) for i in range(k)]


def encode(ids: np.ndarray) -> list[bytes]:
    """Blocks of a run of ids: number of ids, payload bytes, crc32 of the ids, payload."""
    if len(ids) and int(ids.max()) > 0xFFFF:
        raise ValueError("ids must be below 65536")
    full = len(ids) // BLOCK
    coded: list[bytes] = []
    for a, b in _groups(full):
        coded += encode_lanes(ids[a * BLOCK : b * BLOCK].reshape(-1, BLOCK))
    if len(ids) % BLOCK:
        coded += encode_lanes(ids[full * BLOCK :].reshape(1, -1))
    out = []
    for i, payload in enumerate(coded):
        own = ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4").tobytes()
        out.append(_HEAD.pack(len(own) // 4, len(payload), zlib.crc32(own)) + payload)
    return out


def decode(blocks: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The ids of (number, crc32, payload) blocks; a block that doesn't fit its checksum raises ValueError."""
    out: list[np.ndarray | None] = [None] * len(blocks)
    by_size: dict[int, list[int]] = {}
    for i, (n, _, _) in enumerate(blocks):
        by_size.setdefault(n, []).append(i)
    for n, own in by_size.items():
        for a, b in _groups(len(own)):
            part = own[a:b]
            for i, ids in zip(part, decode_lanes([blocks[i][2] for i in part], n), strict=True):
                out[i] = ids.astype("<u4")
    for i, (_, crc, _) in enumerate(blocks):
        if zlib.crc32(out[i].tobytes()) != crc:
            raise ValueError(f"checksum of block {i}")
    return out
