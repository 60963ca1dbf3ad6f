"""Continuous merging: a causal queue as streaming state.

Changes arrive in any order and possibly twice. Per document the state holds the hashes that are applied and the changes
that wait; a micro-batch releases every change whose dependencies are all applied, again and again until none is ready.
Nothing is dropped for its age; an operator may set a timeout as a safety valve, off by default.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Changes in, as a stream carries them: hash and dependencies, and the encoded rest.
IN = "doc string, hash binary, deps array<binary>, body string"
OUT = "doc string, hash binary, body string, place long, waiting long"


def released(stream: DataFrame) -> DataFrame:
    """(doc, hash, body, place, waiting): changes in an order in which they can be applied, as they become ready."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        applied, order, hashes, deps, bodies = state.get if state.exists else ([], 0, [], [], [])
        done = {bytes(h) for h in applied}
        wait = {bytes(h): ([bytes(d) for d in ds], b) for h, ds, b in zip(hashes, deps, bodies)}
        for pdf in batches:
            for h, ds, b in zip(pdf["hash"], pdf["deps"], pdf["body"]):
                h = bytes(h)
                if h not in done:
                    wait.setdefault(h, ([bytes(d) for d in (ds if ds is not None else [])], b))
        needed: dict[bytes, list[bytes]] = {}
        left = {}
        for h, (ds, _) in wait.items():
            left[h] = sum(d not in done for d in set(ds))
            for d in set(ds):
                needed.setdefault(d, []).append(h)
        ready, out = deque(sorted(h for h, n in left.items() if n == 0)), []
        while ready:
            h = ready.popleft()
            _, body = wait.pop(h)
            done.add(h)
            out.append((key[0], h, body, order))
            order += 1
            for x in sorted(needed.get(h, ())):
                if x in wait:
                    left[x] -= 1
                    if left[x] == 0:
                        ready.append(x)
        state.update((sorted(done), order, list(wait), [d for d, _ in wait.values()], [b for _, b in wait.values()]))
        yield pd.DataFrame([(*r, len(wait)) for r in out], columns=["doc", "hash", "body", "place", "waiting"])

    return stream.groupBy("doc").applyInPandasWithState(step, OUT, "applied array<binary>, at long, hashes array<binary>, deps array<array<binary>>, bodies array<string>", "append", GroupStateTimeout.NoTimeout)


def as_stream_rows(changes: DataFrame) -> DataFrame:
    """Changes in the form that a stream carries."""
    return changes.select("doc", "hash", "deps", F.to_json(F.struct(F.hex("actor").alias("actor"), "seq", "start_op", "max_op", "time", "message")).alias("body"))


def patches(view_stream: DataFrame, watermark: str | None = None) -> DataFrame:
    """Latest winner of each key in update mode: an incremental register view of streamed operations without deletes.

    (doc, key_str, ctr, actor, value): the operation with the largest id so far.
    """
    rows = view_stream if watermark is None else view_stream.withWatermark("at", watermark)
    return rows.groupBy("doc", "key_str").agg(F.max(F.struct("ctr", "actor", "value")).alias("w")).select("doc", "key_str", "w.*")
