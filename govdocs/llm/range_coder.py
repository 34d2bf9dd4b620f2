"""An adaptive context-mixing range coder for token ids, in blocks that need nothing from each other.

A block's ids are dealt to lanes of equal length that are coded in step, so that each step is a few
array operations. Three predictors share a model that both directions update after every step: the id
that followed the two ids before (order 2), the id that followed the one before (order 1), and the
frequencies of ids so far (order 0). An id's probability is their mixture, with weights learned for each
pair of confidences of the first two; its interval drives a carry-less range coder of 64 bits that
writes units of 16. A block begins with its directory and ends with the CRC-32 of all before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"TIDS"
HEAD = struct.Struct("<4sIIIHI")  # magic, documents, ids, vocabulary, lanes, units
MIX_BITS, FREQ_BITS = 11, 18
TOP, BOTTOM = np.uint64(1 << 48), np.uint64(1 << 32)
UNIT, TOP_SHIFT = np.uint64(16), np.uint64(48)
SLOTS = 1 << 18
U64 = np.uint64


class MixedModel:
    """The shared predictions of a block."""

    def __init__(self, vocabulary: int):
        self.size = vocabulary
        # the id that is expected and, in the last two bits, how often it was right of late
        self.table2, self.table1 = np.zeros(SLOTS, dtype=np.int64), np.zeros(vocabulary, dtype=np.int64)
        self.seen, self.step = np.zeros(vocabulary, dtype=np.int64), 0
        self.outcomes = np.ones((32, 3), dtype=np.int64)
        self.frequencies()
        self.weights()

    def frequencies(self) -> None:
        total, spare = int(self.seen.sum()), (1 << FREQ_BITS) - self.size
        self.freq = np.ones(self.size, dtype=np.int64) + (self.seen * spare // total if total else spare // self.size)
        self.freq[int(self.seen.argmax())] += (1 << FREQ_BITS) - int(self.freq.sum())
        self.first = np.concatenate([[0], np.cumsum(self.freq)[:-1]])
        self.slot = None

    def weights(self) -> None:
        share = self.outcomes * ((1 << MIX_BITS) - 3) // self.outcomes.sum(axis=1, keepdims=True) + 1
        share[:, 2] += (1 << MIX_BITS) - share.sum(axis=1)
        self.w2, self.w1, self.w0 = (np.ascontiguousarray(share[:, i]) for i in range(3))

    def predict(self, one: np.ndarray, two: np.ndarray) -> None:
        """Looks at the last id (one) and the one before it (two) of each lane."""
        self.h2, self.h1 = (one * 0x9E3779B1 + two * 0x85EBCA6B) >> 7 & (SLOTS - 1), one
        self.t2, self.t1 = self.table2[self.h2], self.table1[one]
        self.p2, self.p1 = self.t2 >> 2, self.t1 >> 2
        self.mix = ((self.t2 & 3) << 3) + ((self.t1 & 3) << 1) + (self.p1 == self.p2)
        self.m2, self.m1, self.m0 = self.w2[self.mix], self.w1[self.mix], self.w0[self.mix]

    def intervals(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each id's interval, in a total of 2 ** (MIX_BITS + FREQ_BITS)."""
        hit2, hit1 = self.hit2, self.hit1 = ids == self.p2, ids == self.p1
        start = np.where(hit2, 0, np.where(hit1, self.m2 << FREQ_BITS, (self.m2 + self.m1 << FREQ_BITS) + self.m0 * self.first[ids]))
        size = np.where(hit2, self.m2 << FREQ_BITS, np.where(hit1, self.m1 << FREQ_BITS, self.m0 * self.freq[ids]))
        return start, size

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose intervals hold the values."""
        if self.slot is None:
            self.slot = np.repeat(np.arange(self.size, dtype=np.int32), self.freq)
        one, both = self.m2 << FREQ_BITS, self.m2 + self.m1 << FREQ_BITS
        # numbers of 30 bits, whose quotients floats hold exactly enough
        rest = np.clip(((at - both) / self.m0).astype(np.int64), 0, (1 << FREQ_BITS) - 1)
        return np.where(at < one, self.p2, np.where(at < both, self.p1, self.slot[rest]))

    def update(self, ids: np.ndarray) -> None:
        """Learns the ids whose intervals were taken last."""
        hit2, hit1 = self.hit2, self.hit1
        self.outcomes += np.bincount(self.mix * 3 + np.where(hit2, 0, 2 - hit1), minlength=96).reshape(32, 3)
        self.table2[self.h2] = self.learned(self.t2, hit2, ids)
        self.table1[self.h1] = self.learned(self.t1, hit1, ids)
        np.add.at(self.seen, ids, 1)
        self.step += 1
        if self.step & (self.step - 1) == 0 or self.step % 64 == 0:
            self.frequencies()
        if self.step < 16 or self.step % 8 == 0:
            self.weights()

    @staticmethod
    def learned(held: np.ndarray, hit: np.ndarray, ids: np.ndarray) -> np.ndarray:
        sure = held & 3
        return np.where(hit, held + (sure < 3), np.where(sure > 0, held - 1, ids << 2))


def lanes_for(n: int) -> int:
    """Lanes that leave each about 256 steps, 4096 at most."""
    return max(1, min(4096, n // 256))


def renormalised(low: np.ndarray, wide: np.ndarray):
    """Which lanes must move a unit, and their ranges."""
    same = (low ^ (low + wide)) < TOP
    tight = ~same & (wide < BOTTOM)
    if tight.any():
        wide = np.where(tight, (~low + U64(1)) & (BOTTOM - U64(1)), wide)
    return same | tight, wide


def encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[int, np.ndarray, np.ndarray]:
    """(lanes, units of each lane, all units lane by lane)."""
    lanes = lanes_for(len(ids))
    steps = -(-len(ids) // lanes)
    grid = np.zeros(lanes * steps, dtype=np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = MixedModel(vocabulary)
    low, wide = np.zeros(lanes, dtype=U64), np.full(lanes, (1 << 64) - 1, dtype=U64)
    one = two = np.zeros(lanes, dtype=np.int64)
    who, what = [], []
    for t in range(steps):
        now = grid[t]
        model.predict(one, two)
        start, size = model.intervals(now)
        unit = wide >> U64(MIX_BITS + FREQ_BITS)
        low = low + unit * start.astype(U64)
        wide = unit * size.astype(U64)
        while True:
            move, wide = renormalised(low, wide)
            k = np.nonzero(move)[0]
            if not len(k):
                break
            who.append(k)
            what.append((low[k] >> TOP_SHIFT).astype(np.uint16))
            low[k] <<= UNIT
            wide[k] <<= UNIT
        model.update(now)
        two, one = one, now
    end = (low + BOTTOM - U64(1)) & ~(BOTTOM - U64(1))
    for shift in (48, 32):
        who.append(np.arange(lanes))
        what.append((end >> U64(shift)).astype(np.uint16))
    lane = np.concatenate(who)
    order = np.argsort(lane, kind="stable")
    return lanes, np.bincount(lane, minlength=lanes), np.concatenate(what)[order]


def decode_ids(n: int, vocabulary: int, lanes: int, counts: np.ndarray, units: np.ndarray) -> np.ndarray:
    steps = -(-n // lanes)
    ends = np.cumsum(counts)
    at = (ends - counts).astype(np.int64)
    flat = np.concatenate([units.astype(U64), np.zeros(1, dtype=U64)])

    def take(k: np.ndarray) -> np.ndarray:
        out = np.where(at[k] < ends[k], flat[np.minimum(at[k], len(flat) - 1)], U64(0))
        at[k] += 1
        return out

    model, every = MixedModel(vocabulary), np.arange(lanes)
    low, wide, code = np.zeros(lanes, dtype=U64), np.full(lanes, (1 << 64) - 1, dtype=U64), np.zeros(lanes, dtype=U64)
    for _ in range(4):
        code = code << UNIT | take(every)
    grid = np.zeros((steps, lanes), dtype=np.int64)
    one = two = np.zeros(lanes, dtype=np.int64)
    for t in range(steps):
        model.predict(one, two)
        unit = wide >> U64(MIX_BITS + FREQ_BITS)
        value = np.minimum((code - low) // unit, U64((1 << MIX_BITS + FREQ_BITS) - 1)).astype(np.int64)
        now = model.find(value)
        start, size = model.intervals(now)
        low = low + unit * start.astype(U64)
        wide = unit * size.astype(U64)
        while True:
            move, wide = renormalised(low, wide)
            k = np.nonzero(move)[0]
            if not len(k):
                break
            low[k] <<= UNIT
            wide[k] <<= UNIT
            code[k] = code[k] << UNIT | take(k)
        model.update(now)
        grid[t] = now
        two, one = one, now
    return np.ascontiguousarray(grid.T).ravel()[:n]


def pack_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """One block of whole documents."""
    lanes, counts, units = encode_ids(ids, vocabulary) if len(ids) else (1, np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint16))
    null = np.array([d is None for d in doc_ids], dtype=np.uint8)
    names = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    body = HEAD.pack(MAGIC, len(doc_ids), len(ids), vocabulary, lanes, len(units))
    body += null.tobytes() + names.tobytes() + np.array(lengths, dtype="<u4").tobytes() + counts.astype("<u4").tobytes() + units.astype("<u2").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_block(block: bytes) -> tuple[list[int | None], list[int], np.ndarray]:
    """(doc_ids, lengths, ids) of a block; an error if it isn't whole."""
    body, (crc,) = block[:-4], struct.unpack("<I", block[-4:])
    if zlib.crc32(body) != crc or body[:4] != MAGIC:
        raise ValueError("the block's checksum or magic is wrong")
    _, docs, n, vocabulary, lanes, n_units = HEAD.unpack_from(body)
    at = HEAD.size
    parts = []
    for kind, count in (("u1", docs), ("<i8", docs), ("<u4", docs), ("<u4", lanes), ("<u2", n_units)):
        parts.append(np.frombuffer(body, dtype=kind, count=count, offset=at))
        at += parts[-1].nbytes
    null, names, lengths, counts, units = parts
    ids = decode_ids(n, vocabulary, lanes, counts.astype(np.int64), units) if n else np.zeros(0, dtype=np.int64)
    return [None if z else int(d) for z, d in zip(null, names)], lengths.tolist(), ids
