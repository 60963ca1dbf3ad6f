"""Sync messages and states as bytes; peers that read only, start anew or lost what was common."""

import random

import pytest
from pyspark.sql import functions as F

from causeway.operators import hydrate, merge, sync
from causeway.operators.transaction import frames
from causeway.sources import chunks, messages
from causeway.sources.chunks import BadChunk

from .test_engine import replicas


def test_messages_are_read_as_they_were_written():
    rng = random.Random(4)
    for n in (0, 1, 2, 130):
        h = [sorted(rng.randbytes(32) for _ in range(k)) for k in (n, n // 2, n // 3)]
        size = -(-n * 10 // 8) * 8
        bits = sorted(rng.sample(range(size), size // 3))
        parts = [rng.randbytes(k) for k in range(n % 4)]
        for flags, whole in ((None, False), (0, False), (5, True)):
            data = messages.encode(*h, n, bits, parts, flags, whole)
            got = messages.decode(data)
            assert [got[k] for k in ("heads", "need", "last_sync", "entries", "size", "bits", "parts", "flags", "whole")] == [*h, n, size, bits, parts, flags, whole]
            with pytest.raises(BadChunk):
                messages.decode(data[: len(data) - 2 if flags is None and parts else 1 + n])
        assert messages.decode_state(messages.encode_state(h[0])) == h[0]
    with pytest.raises(BadChunk):
        messages.decode(b"\x00")
    with pytest.raises(BadChunk):
        messages.decode_state(messages.encode([], [], [], 0, [], []))


@pytest.fixture(scope="module")
def log(spark):
    changes, ops, _, _ = replicas(21, rounds=2, steps=4)
    c, o = frames(spark, changes, ops)
    new = chunks.rehashed(c, o).drop("bytes")
    return new.cache(), o.cache()


def part(c, o, keep):
    from causeway.functions.frames import cut

    own, queued = merge.apply_changes(c.limit(0), c.where(keep))
    return cut(own), cut(queued), o


@pytest.mark.parametrize("whole", [False, True])
def test_replicas_agree_by_bytes_alone(spark, log, whole):
    from causeway.functions.frames import cut

    c, o = log
    low = c.agg(F.percentile_approx("max_op", 0.5)).first()[0]
    (a, qa, _), (b, qb, _) = part(c, o, "true" if whole else f"max_op <= {low}"), part(c, o, "actor = X'00'" if whole else "seq = 1")
    oa, ob = (o.join(x.select("doc", "actor", "start_op", "max_op"), ["doc", "actor"]).where("ctr between start_op and max_op").select(*o.columns) for x in (a, b))
    pa, pb, kinds = sync.Peer(), sync.Peer(), set()
    for _ in range(5):
        for way in (0, 1):
            (s, qs, os_, ps), (r, qr, or_, pr) = ((a, qa, oa, pa), (b, qb, ob, pb))[:: -1 if way else 1]
            data = cut(messages.to_bytes(sync.generate(s, qs, ps), s.unionByName(qs), os_, whole))
            kinds |= {bytes(r["bytes"])[0] for r in data.collect()}
            m, ops = messages.from_bytes(data)
            r, qr = (cut(x) for x in sync.receive(r, qr, pr, m))
            or_ = cut(or_.unionByName(ops.select(*or_.columns)).dropDuplicates(["doc", "actor", "ctr"]))
            a, qa, oa, b, qb, ob = (r, qr, or_, b, qb, ob) if way else (a, qa, oa, r, qr, or_)
        if sync.agree(a, qa, b, qb):
            break
    assert sync.agree(a, qa, b, qb)
    assert kinds == ({messages.MESSAGE, messages.WHOLE_MESSAGE} if whole else {messages.MESSAGE})
    assert a.select("hash").exceptAll(b.select("hash")).isEmpty() and a.count() > 1
    assert hydrate.to_json(oa).first()["json"] == hydrate.to_json(ob).first()["json"]


def test_a_replica_that_reads_only_takes_nothing_until_it_may(spark, log):
    c, o = log
    (a, qa, _), (b, qb, _) = part(c, o, "true"), part(c, o, "actor = X'00'")
    pa, pb = sync.Peer(), sync.Peer(read_only=True)
    n = b.count()
    # a sends before it knows, b drops it and says so, a then sends nothing
    a, qa = sync.receive(a, qa, pa, sync.generate(b, qb, sync.Peer()))
    first = sync.generate(a, qa, pa)
    assert first.changes.count() > 0
    b, qb = sync.receive(b, qb, pb, first)
    m = sync.generate(b, qb, pb)
    assert b.count() == n and m.flags & sync.READ_ONLY and m.need.isEmpty()
    a, qa = sync.receive(a, qa, pa, m)
    assert sync.generate(a, qa, pa).changes.isEmpty()
    # now it may: a forgets what it sent
    pb.set_read_only(False)
    m = sync.generate(b, qb, pb)
    assert m.flags & sync.RESET and not m.flags & sync.READ_ONLY
    a, qa = sync.receive(a, qa, pa, m)
    b, qb = sync.receive(b, qb, pb, sync.generate(a, qa, pa))
    assert b.count() == a.count()
    # a peer that knows no flags is told of an empty replica
    old = sync.Peer(read_only=True)
    old.set_read_only(False)
    assert sync.generate(b, qb, old).heads.isEmpty() and not old.needs_reset


def test_sync_starts_over_where_the_last_heads_are_unknown(spark, log):
    c, o = log
    a, qa, _ = part(c, o, "actor = X'00'")
    peer = sync.Peer()
    theirs = sync.generate(c, c.limit(0), sync.Peer())
    unknown = c.select("doc", F.expr("unhex(repeat('ab', 32))").alias("hash")).distinct()
    a, qa = sync.receive(a, qa, peer, sync.Message(theirs.heads, theirs.need, (unknown, *theirs.have[1:]), c.limit(0), theirs.flags))
    m = sync.generate(a, qa, peer)
    assert m.changes.isEmpty() and m.need.isEmpty() and m.have[0].isEmpty() and m.have[2].isEmpty() and not m.heads.isEmpty()


def test_bundles_give_back_their_changes(spark, log):
    c, o = log
    cs, os_ = [[r.asDict(recursive=True) for r in x.collect()] for x in log]
    own = lambda some: [r for r in os_ for x in some if bytes(r["actor"]) == bytes(x["actor"]) and x["start_op"] <= r["ctr"] <= x["max_op"]]
    for some in (cs, cs[1::2], cs[:1], []):
        for deflate in (True, False):
            got, ops = chunks.load(chunks.write_bundle(some, own(some), deflate), "d")
            assert {bytes(x["hash"]) for x in got} == {bytes(x["hash"]) for x in some}
            assert len(ops) == len(own(some))
            first = {k: sorted((r["ctr"], bytes(r["actor"]), r["action"], r["key_str"], r["obj_ctr"], len(r["pred"] or [])) for r in k_rows) for k, k_rows in (("a", ops), ("b", own(some)))}
            assert first["a"] == first["b"]
    sets = c.select("doc", "hash", (F.col("seq") % 2).alias("name"))
    made = chunks.bundles(c, o, sets)
    back, ops = chunks.read(made)
    assert made.count() == 2 and ops.count() == o.count()
    assert back.select("hash").exceptAll(c.select("hash")).isEmpty() and back.count() == c.count()
    broken = bytearray(chunks.write_bundle(cs, os_))
    broken[-1] ^= 1
    with pytest.raises(BadChunk):
        chunks.load(bytes(broken))
