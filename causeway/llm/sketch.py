"""Count-min sketches of 64-bit keys, built per partition, merged by blocks of cells, broadcast with a bounded size.

A sketch has `depth` rows of 2**bits cells; cell counts saturate at `cap`. Partitions send only their own non-zero cells,
as gaps between sorted cell numbers, so what is shuffled follows the keys rather than the width. An estimate is never
below the true count (up to the cap), whatever the width: a sketch that is too narrow costs time, never rows.

A width has a bound, as sketches are broadcast; `lone` counts the keys that nothing else has without one: keys go by blocks
to tasks that count them, and each sends back, to the chunk of items that a key came from, that it is alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .frames import lean

U = np.uint64
#: Odd multipliers of the rows.
ROWS = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0x27D4EB2F165667C5))
BLOCK_BITS = 22
#: Keys of a partition that are held at once.
FLUSH = 1 << 22
#: Sketches of this many partitions meet in one merge; beyond it they are merged in two levels.
FAN = 256


def bits_for(keys: int, most: int = 28) -> int:
    """Width for about half a key per cell, at most 2**most cells a row."""
    return min(most, max(16, int(2 * max(1, keys) - 1).bit_length()))


def cells(keys: np.ndarray, row: int, bits: int) -> np.ndarray:
    return ((keys * ROWS[row]) >> U(64 - bits)).astype(np.uint32)


def members(keys: Iterator[np.ndarray], most: int, depth: int = 4, widest: int = 26) -> Sketch:
    """A sketch that counts the given keys, about `most`, as 2 and, but for collisions, others as 1; no given one is missed."""
    bits = bits_for(2 * most, most=widest)
    data = np.zeros((depth << bits) // 8, np.uint8)
    for k in keys:
        for row in range(depth):
            c = cells(k, row, bits).astype(np.int64) + (row << bits)
            np.bitwise_or.at(data, c >> 3, np.uint8(1) << (c & 7).astype(np.uint8))
    return Sketch(bits, depth, 2, data)


def pack_varints(v: np.ndarray) -> np.ndarray:
    """Unsigned values under 2**28 as bytes of 7 bits each, low first."""
    size = np.ones(len(v), np.int64)
    for k in (7, 14, 21):
        size += v >= (1 << k)
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(4):
        own = size > k
        out[at[own] + k] = ((v[own] >> (7 * k)) & 127) | np.where(size[own] > k + 1, 128, 0)
    return out


def unpack_varints(b: np.ndarray) -> np.ndarray:
    end = np.flatnonzero(b < 128)
    start = np.concatenate([[0], end[:-1] + 1]) if len(end) else end
    v = (b[start] & 127).astype(np.uint32)
    for k in (1, 2, 3):
        own = np.flatnonzero(start + k <= end)
        v[own] |= (b[start[own] + k] & 127).astype(np.uint32) << np.uint32(7 * k)
    return v


def _encode(cell: np.ndarray, count: np.ndarray) -> bytes:
    gap = np.diff(cell, prepend=0).astype(np.uint32)
    many = count > 1
    body = pack_varints((gap << np.uint32(1)) | many.astype(np.uint32))
    return np.uint32(len(body)).tobytes() + body.tobytes() + count[many].astype(np.uint8).tobytes()


def _add(total: np.ndarray, blob: bytes, cap: int) -> None:
    n = int(np.frombuffer(blob, np.uint32, 1)[0])
    v = unpack_varints(np.frombuffer(blob, np.uint8, n, 4))
    count = np.ones(len(v), np.uint16)
    many = (v & 1) == 1
    count[many] = np.frombuffer(blob, np.uint8, offset=4 + n)
    cell = np.cumsum(v >> 1)
    total[cell] = np.minimum(total[cell] + count, cap)


def _partial(keys: np.ndarray, bits: int, depth: int, cap: int):
    width = min(bits, BLOCK_BITS)
    for row in range(depth):
        c = np.sort(cells(keys, row, bits))
        first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
        count = np.minimum(np.diff(np.append(first, len(c))), cap)
        c = c[first]
        edge = np.searchsorted(c, np.arange((1 << (bits - width)) + 1, dtype=np.int64) << width)
        for b in np.flatnonzero(np.diff(edge)):
            own = slice(edge[b], edge[b + 1])
            yield row * (1 << (bits - width)) + int(b), _encode(c[own] & np.uint32((1 << width) - 1), count[own])


class Sketch:
    """A merged sketch: for cap 2 one bit a cell (estimate of at least 2), else one byte a cell."""

    def __init__(self, bits: int, depth: int, cap: int, data: np.ndarray):
        self.bits, self.depth, self.cap, self.data = bits, depth, cap, data

    def counts(self, keys: np.ndarray) -> np.ndarray:
        """Estimates from 0 to the cap; for cap 2, 1 stands for 0 and 1."""
        out = None
        for row in range(self.depth):
            c = cells(keys, row, self.bits)
            if self.cap == 2:
                c = c.astype(np.int64) + (row << self.bits)
                got = ((self.data[c >> 3] >> (c & 7).astype(np.uint8)) & 1) + 1
            else:
                got = self.data[c.astype(np.int64) + (row << self.bits)]
            out = got if out is None else np.minimum(out, got)
        return out


def build(
    source: DataFrame,
    keys_of: Callable[[pa.RecordBatch], Iterator[np.ndarray]],
    bits: int,
    depth: int = 2,
    cap: int = 2,
    partitions: int = 0,
    hold: int = FLUSH,
) -> Sketch:
    """Sketch of all keys that keys_of gives for the batches of `source`.

    partitions: about how many the source has; over FAN, partial sketches merge in two levels. hold: keys of a partition
    that are held at once, about 40 bytes each while they are sorted; fewer make more and wider gaps.
    """

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, salt = [], 0, None

        def flush() -> pa.RecordBatch:
            nonlocal held, n
            rows = list(_partial(np.concatenate(held), bits, depth, cap))
            held, n = [], 0
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([b for b, _ in rows], pa.int32()), "salt": pa.array([salt] * len(rows), pa.int32()), "blob": pa.array([x for _, x in rows], pa.binary())}
            )

        for batch in batches:
            for keys in keys_of(batch):
                if len(keys):
                    salt = int(keys[0] % U(FAN)) if salt is None else salt
                    held.append(keys)
                    n += len(keys)
                if n >= hold:
                    yield flush()
        if n:
            yield flush()

    width = min(bits, BLOCK_BITS)

    def summed(t: pa.Table) -> np.ndarray:
        total = np.zeros(1 << width, np.uint16)
        for blob in t["blob"]:
            _add(total, blob.as_buffer(), cap)
        return total

    def level(t: pa.Table) -> pa.Table:
        total = summed(t)
        cell = np.flatnonzero(total)
        return pa.table({"block": t["block"][:1], "salt": pa.array([0], pa.int32()), "blob": pa.array([_encode(cell, total[cell])], pa.binary())})

    def merged(t: pa.Table) -> pa.Table:
        total = summed(t)
        out = np.packbits(total >= 2, bitorder="little") if cap == 2 else total.astype(np.uint8)
        return pa.table({"block": t["block"][:1], "blob": pa.array([out.tobytes()], pa.binary())})

    frame = source.mapInArrow(lean(parts), "block int, salt int, blob binary")
    if partitions > FAN:
        frame = frame.groupBy("block", "salt").applyInArrow(level, "block int, salt int, blob binary")
    per = (1 << width) // 8 if cap == 2 else 1 << width
    data = np.zeros(depth * (1 << bits) // 8 if cap == 2 else depth * (1 << bits), np.uint8)
    for r in frame.groupBy("block").applyInArrow(merged, "block int, blob binary").toLocalIterator():
        data[r["block"] * per : (r["block"] + 1) * per] = np.frombuffer(r["blob"], np.uint8)
    return Sketch(bits, depth, cap, data)


# -- keys that stand alone

#: Items of a chunk, which 16 bits tell apart.
ITEMS = 1 << 16
#: Blocks are up to 2**12 of 2**18 keys or so, then larger up to 2**21 keys, then more; 2**26 cells each, so few keys meet by
#: chance.
BLOCKS, SMALL, LARGE, CELL_BITS = 12, 18, 21, 26


def _chunk(keys: np.ndarray, item: np.ndarray, blocks: int) -> Iterator[tuple[int, bytes]]:
    """(block, blob) of a chunk's keys: gaps between its cells, then the items of those that the chunk has once."""
    keys = keys >> U(64 - blocks - CELL_BITS)
    order = np.argsort(keys)
    keys, item = keys[order], item[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    once = np.diff(np.append(first, len(keys))) == 1
    keys, item = keys[first], item[first].astype(np.uint16)
    block = (keys >> U(CELL_BITS)).astype(np.int64)
    edge = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1], [True]]))
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist()):
        cell = (keys[lo:hi] & U((1 << CELL_BITS) - 1)).astype(np.uint32)
        body = pack_varints((np.diff(cell, prepend=np.uint32(0)) << np.uint32(1)) | once[lo:hi].astype(np.uint32))
        yield int(block[lo]), np.uint32(len(body)).tobytes() + body.tobytes() + item[lo:hi][once[lo:hi]].tobytes()


def _alone(blobs: list) -> list[np.ndarray]:
    """For each blob of a block, the items of its keys that no other blob has."""
    cell, once, items = [], [], []
    for blob in blobs:
        n = int(np.frombuffer(blob, np.uint32, 1)[0])
        v = unpack_varints(np.frombuffer(blob, np.uint8, n, 4))
        cell.append(np.cumsum(v >> 1, dtype=np.uint32))
        once.append((v & 1) == 1)
        items.append(np.frombuffer(blob, np.uint16, offset=4 + n))
    size = np.cumsum([len(x) for x in cell])[:-1]
    _, at, count = np.unique(np.concatenate(cell), return_inverse=True, return_counts=True)
    return [x[alone[o]] for x, o, alone in zip(items, once, np.split(count[at] == 1, size))]


def lone(source: DataFrame, items_of: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]], keys: int, hold: int = FLUSH) -> DataFrame:
    """(ids, sizes, lone): for each chunk of items the binary arrays of their ids, sizes (int64) and numbers of lone keys.

    items_of gives, for the batches of `source`, arrays: ids and sizes of items, offsets of their keys, and the keys, hashes
    that differ within an item. A key is lone if nothing else has it; keys whose leading bits agree count as one, so a number
    may be too small, never too large. keys: about how many there are, which sets the number of blocks. A chunk is named by
    what it holds; what a task that ran again numbers otherwise isn't counted as lone.
    """
    blocks = int(keys).bit_length()
    blocks = min(64 - CELL_BITS, max(1, min(BLOCKS, blocks - SMALL), blocks - LARGE))

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, items, n = [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal held, items, n
            ids, sizes, counts, key = (np.concatenate(x) for x in zip(*held))
            place = np.repeat(np.arange(len(ids)), counts)
            name = int(((ids.astype(U) * ROWS[0]) ^ (np.arange(len(ids), dtype=U) * ROWS[1])).sum(dtype=U))
            name = (name * int(ROWS[2]) + part) % (1 << 64) - (1 << 63)
            rows = list(_chunk(key, place, blocks)) if len(key) else []
            held, items, n = [], 0, 0
            # what tells the items goes along, past the blocks
            rows.append((-1 - name % 4096, ids.astype(np.int64).tobytes() + sizes.astype(np.int64).tobytes()))
            return pa.RecordBatch.from_pydict({"block": pa.array([b for b, _ in rows], pa.int64()), "chunk": pa.array([name] * len(rows), pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

        for batch in batches:
            for ids, sizes, offs, key in items_of(batch):
                for lo in range(0, len(ids), ITEMS):
                    hi = min(len(ids), lo + ITEMS)
                    if items + hi - lo > ITEMS:
                        yield flush()
                    held.append((ids[lo:hi], sizes[lo:hi], np.diff(offs[lo : hi + 1]), key[offs[lo] : offs[hi]]))
                    items += hi - lo
                    n += offs[hi] - offs[lo]
                    if n >= hold:
                        yield flush()
        if items:
            yield flush()

    def count(t: pa.Table) -> pa.Table:
        if t["block"][0].as_py() < 0:
            return t.select(["chunk", "block", "blob"])
        found = _alone([x.as_buffer() for x in t["blob"]])
        return pa.table({"chunk": t["chunk"], "block": t["block"], "blob": pa.array([x.tobytes() for x in found], pa.binary())})

    def gather(t: pa.Table) -> pa.Table:
        told, alone = [], []
        for block, blob in zip(t["block"].to_pylist(), t["blob"]):
            (told if block < 0 else alone).append(blob.as_buffer())
        if not told:  # blocks of a task that ran again
            return pa.table({c: pa.array([], pa.binary()) for c in ("ids", "sizes", "lone")})
        n = len(told[0]) // 16
        total = np.zeros(n, np.int64)
        for x in alone:
            total += np.bincount(np.frombuffer(x, np.uint16), minlength=n)
        # equal chunks have no lone keys, so their items are told once
        return pa.table({"ids": pa.array([told[0].slice(0, 8 * n).to_pybytes()], pa.binary()), "sizes": pa.array([told[0].slice(8 * n).to_pybytes()], pa.binary()), "lone": pa.array([total.tobytes()], pa.binary())})

    sent = source.mapInArrow(lean(parts), "block long, chunk long, blob binary")
    counted = sent.groupBy("block").applyInArrow(count, "chunk long, block long, blob binary")
    return counted.where("octet_length(blob) > 0").groupBy("chunk").applyInArrow(gather, "ids binary, sizes binary, lone binary")
