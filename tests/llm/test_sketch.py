"""Sketches never underestimate, whatever their width, and merge the same in one level or two."""

import numpy as np
import pyarrow as pa
import pytest

from causeway.llm import sketch
from causeway.llm import text as X

U = np.uint64


def test_varints():
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.integers(0, 1 << k, 200) for k in (1, 7, 8, 14, 15, 21, 28)]).astype(np.uint32)
    assert (sketch.unpack_varints(sketch.pack_varints(v)) == v).all()
    assert len(sketch.unpack_varints(sketch.pack_varints(v[:0]))) == 0


@pytest.mark.parametrize("bits,cap,partitions", [(10, 2, 0), (18, 2, 10_000), (18, 255, 0), (23, 255, 10_000)])
def test_estimates(spark, bits, cap, partitions):
    df = spark.range(0, 6000, 1, 5).selectExpr("id % 2500 as k")

    def keys(batch: pa.RecordBatch):
        yield X.mix(batch["k"].to_numpy().astype(U))

    s = sketch.build(df, keys, bits, cap=cap, partitions=partitions)
    k = np.arange(3000)
    true = np.array([3 if x < 1000 else 2 if x < 2500 else 0 for x in k])
    got = s.counts(X.mix(k.astype(U)))
    assert (got >= np.minimum(true, cap)).all()
    if bits >= 18:
        assert (got[true == 0] > 1).mean() < 0.01
        assert cap == 2 or (got == true).mean() > 0.98


@pytest.mark.parametrize("hold", [40, 100_000])
def test_lone_keys(spark, hold):
    """Every key that one item alone has is counted, and no other, whatever the chunks; no name of a filter is missed."""
    rng = np.random.default_rng(5)
    sets = {i: sorted({int(x) for x in rng.integers(0, 3000, i % 13)}) for i in range(500)}
    sets |= {500: [], 501: list(range(5000, 5090)), 502: list(range(5000, 5080))}
    times = np.bincount([k for s in sets.values() for k in s])
    df = spark.createDataFrame(list(sets.items()), "id long, keys array<long>").repartition(4)

    def items(batch: pa.RecordBatch):
        keys = [X.mix(np.array(k, U)) for k in batch["keys"].to_pylist()]
        size = np.array([len(k) for k in keys])
        yield batch["id"].to_numpy().astype(U), size, np.concatenate([[0], np.cumsum(size)]), np.concatenate([np.zeros(0, U), *keys])

    got = {}
    for r in sketch.lone(df, items, 1 << 22, hold).collect():
        ids, sizes, lone = (np.frombuffer(r[c], np.int64).tolist() for c in ("ids", "sizes", "lone"))
        assert sizes == [len(sets[i]) for i in ids] and not set(ids) & set(got)
        got |= dict(zip(ids, lone))
    assert got == {i: sum(times[k] == 1 for k in s) for i, s in sets.items()}
    names = X.mix(np.arange(4000).astype(U))
    m = sketch.members(iter([names[:1000], names[1000:2000]]), 2000)
    assert (m.counts(names[:2000]) == 2).all() and (m.counts(names[2000:]) == 2).mean() < 0.05


def test_words_and_hashes():
    texts = pa.array(["a bb  c\n", "", " ", "bb a", "é x" * 3, "y" * 100 + " a"], pa.large_string())
    data, offs = X.raw(texts)
    starts, ends, before = X.words(data, offs)
    words = [data[s:e].tobytes().decode() for s, e in zip(starts, ends)]
    assert words == [w for t in texts.to_pylist() for w in t.split()]
    assert np.diff(before).tolist() == [len(t.split()) for t in texts.to_pylist()]
    h = X.word_hashes(data, starts, ends)
    assert len(set(h.tolist())) == len(set(words)) and h[words.index("a")] == h[-1]
    assert [r for r in X.slices(texts, 4)][0] == (0, 1) and [b for _, b in X.slices(texts, 10**6)] == [6]
