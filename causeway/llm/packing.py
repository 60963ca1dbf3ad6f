"""Packing of token ids into windows of at most `window` ids by Karmarkar-Karp multiway differencing.

Each task encodes its documents as they come. Full windows are cut from long documents; what is left is cut into pieces
of at most `piece` ids, and a group of pieces of about GROUP windows is partitioned into k windows. Neighbouring short
pieces that fit into `piece` ids together are one item. Every item begins as a partial partition of its own, and the two
partial partitions of largest imbalance are merged, largest sum onto smallest, until one is left. k starts at the fewest
windows that could hold the ids and rises by one whenever a window exceeds the capacity.

Any two neighbouring items hold more than `piece` ids, so a group has at most 2 * GROUP * window / piece + 1 of them, each
with two arrays of k numbers: 17 MB at 256 windows and pieces of 256 ids, however short the texts. A group also ends at
PIECES pieces. So a task's memory doesn't grow with its input, and nothing is shuffled.

Defined results: null text is the empty text (its end id alone); every row is packed, repeated rows too; sequence ids
are unique but not consecutive; a text of any length is encoded whole, in bounded batches, and its ids are held until
they are cut; a table without rows gives no pieces; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .frames import lean
from .tokens import crc, encoder, with_end

#: Windows partitioned at once.
GROUP = 256
#: Pieces of a group, at most: about 200 bytes each while they wait.
PIECES = 1 << 16


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Partition items into k sets of near-equal sums: the sets, as item numbers."""
    left, right, heap = [], [], []  # nodes from len(sizes) on join two sets
    n = len(sizes)
    for i, size in enumerate(sizes):
        sums, node = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], node[0] = size, i
        heap.append((-size, i, sums, node))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, tie, a, x = heapq.heappop(heap)
        _, _, b, y = heapq.heappop(heap)
        sums, y = a + b[::-1], y[::-1]
        node = np.maximum(x, y)  # -1 is an empty set
        both = (np.minimum(x, y) >= 0).nonzero()[0]
        if len(both):
            node[both] = n + len(left) + np.arange(len(both))
            left.extend(x[both].tolist())
            right.extend(y[both].tolist())
        order = (-sums).argsort(kind="stable")
        sums, node = sums[order], node[order]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), tie, sums, node))
    out = []
    for top in heap[0][3].tolist() if heap else []:
        items, stack = [], [top] if top >= 0 else []
        while stack:
            at = stack.pop()
            if at < n:
                items.append(at)
            else:
                stack += [right[at - n], left[at - n]]
        out.append(items)
    return out


def fit(sizes: list[int], window: int) -> list[list[int]]:
    """Sets of items, none over the window: as few as differencing reaches, counting up from the fewest possible."""
    k = max(1, -(-sum(sizes) // window))
    while True:
        sets = differencing(sizes, k)
        if all(sum(sizes[i] for i in s) <= window for s in sets):
            return [s for s in sets if s]
        k += 1


def bundles(sizes: list[int], most: int) -> list[list[int]]:
    """Runs of neighbouring items that hold at most `most` ids together; a larger item stands alone."""
    out, room = [], most + 1
    for i, size in enumerate(sizes):
        if room + size > most:
            out.append([])
            room = 0
        out[-1].append(i)
        room += size
    return out


def pack(
    docs: DataFrame, path: str, end_id: int, window: int = 2048, piece: int = 256, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True
) -> DataFrame:
    """One row per piece: id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids."""
    kind = docs.schema[id_col].dataType.simpleString()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, sequence = encoder(path), TaskContext.get().partitionId() << 32
        out: list[tuple] = []
        rest: list[tuple] = []  # (id, start, ids, ids of the document)
        room = 0

        def close() -> None:
            nonlocal sequence, rest, room
            sizes = [len(r[2]) for r in rest]
            items = bundles(sizes, piece)
            for s in fit([sum(sizes[i] for i in item) for item in items], window):
                offset = 0
                for i in (i for item in s for i in items[item]):
                    out.append((*rest[i], sequence, offset))
                    offset += sizes[i]
                sequence += 1
            rest, room = [], 0

        def rows(id_type: pa.DataType) -> pa.RecordBatch:
            cols = [
                pa.array([r[0] for r in out], id_type),
                pa.array([r[1] for r in out], pa.int64()),
                pa.array([len(r[2]) for r in out], pa.int64()),
                pa.array([crc(r[2]) for r in out], pa.int64()),
                pa.array([r[3] for r in out], pa.int64()),
                pa.array([r[4] for r in out], pa.int64()),
                pa.array([r[5] for r in out], pa.int64()),
            ]
            names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                cols.append(pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(r[2]) for r in out])]).astype(np.int32), np.concatenate([r[2] for r in out]).astype(np.int32)) if out else pa.array([], pa.list_(pa.int32())))
                names.append("ids")
            out.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for batch in batches:
            ids_in, id_type = batch["id"].to_pylist(), batch["id"].type
            for lo, n, ids in enc.encode(X.texts_of(batch["text"])):
                offs, all_ids = with_end(n, ids, end_id)
                for j in range(len(n)):
                    doc = all_ids[offs[j] : offs[j + 1]]
                    full = len(doc) // window * window
                    for at in range(0, full, window):
                        out.append((ids_in[lo + j], at, doc[at : at + window], len(doc), sequence, 0))
                        sequence += 1
                    for at in range(full, len(doc), piece):
                        rest.append((ids_in[lo + j], at, doc[at : at + piece], len(doc)))
                    room += len(doc) - full
                    if room >= GROUP * window or len(rest) >= PIECES:
                        close()
                    if len(out) >= 512:
                        yield rows(id_type)
        if rest:
            close()
        if out:
            yield rows(id_type)

    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, `offset` long" + ", ids array<int>" * with_ids
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lean(packed), schema)
