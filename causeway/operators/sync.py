"""Synchronising replicas: Bloom filters of change hashes, what to send, and the messages of a session.

A filter has 10 bits an entry and 7 probes, which come from the first twelve bytes of a hash; membership is a join of
probes with set bits, so neither side collects the other's hashes.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.frames import cut
from .graph import changes_since, clock_at, dependents, edges, heads

#: Fixed values of the protocol: bits an entry, probes.
BITS, PROBES = 10, 7
#: Flags of a message: what was sent before is forgotten, the sender takes no changes, the sender knows the first flag.
RESET, READ_ONLY, KNOWS_RESET = 1, 2, 4
#: Rounds that move nothing after which a session ends: what a message asks for comes a round later.
IDLE = 3


def _word(h: Column, at: int) -> Column:
    """Four little-endian bytes of a hash from byte `at`."""
    x = F.hex(h)
    byte = lambda i: F.conv(F.substring(x, 2 * (at + i) + 1, 2), 16, 10).cast("long")
    return byte(0) + byte(1) * 256 + byte(2) * 65536 + byte(3) * 16777216


def probes(hashes: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc, hash, bit): the seven bits of each hash in a filter of `bits` bits (doc, bits)."""
    x, y, z, m = _word(F.col("hash"), 0), _word(F.col("hash"), 4), _word(F.col("hash"), 8), F.col("bits")
    rows = hashes.select("doc", "hash").join(sizes, "doc").where("bits > 0")
    rows = rows.select("doc", "hash", (x % m).alias("x"), (y % m).alias("y"), (z % m).alias("z"), "bits")
    bit = F.transform(F.sequence(F.lit(0), F.lit(PROBES - 1)), lambda i: (F.col("x") + i * F.col("y") + (i * (i - 1) / 2).cast("long") * F.col("z")) % F.col("bits"))
    return rows.select("doc", "hash", F.explode(bit).alias("bit"))


def filter_sizes(hashes: DataFrame) -> DataFrame:
    """(doc, bits, entries): whole bytes for BITS bits an entry."""
    return hashes.groupBy("doc").agg((F.ceil(F.count("*") * BITS / 8) * 8).cast("long").alias("bits"), F.count("*").alias("entries"))


def bloom(hashes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, bit) and (doc, bits, entries): the filter of a set of hashes (doc, hash)."""
    sizes = filter_sizes(hashes)
    return probes(hashes, sizes).select("doc", "bit").distinct(), sizes


def contains(filter_bits: DataFrame, sizes: DataFrame, hashes: DataFrame) -> DataFrame:
    """(doc, hash, maybe): whether each hash may be in the filter; never false for one that is."""
    p = probes(hashes, sizes).join(filter_bits.withColumn("set", F.lit(1)), ["doc", "bit"], "left")
    hit = p.groupBy("doc", "hash").agg((F.sum(F.coalesce("set", F.lit(0))) == F.count("*")).alias("maybe"))
    return hashes.select("doc", "hash").join(hit, ["doc", "hash"], "left").select("doc", "hash", F.coalesce("maybe", F.lit(False)).alias("maybe"))


def hashes_to_send(changes: DataFrame, last_sync: DataFrame, filter_bits: DataFrame, sizes: DataFrame, need: DataFrame | None = None) -> DataFrame:
    """(doc, hash): changes after the last common heads that the peer's filter lacks, all that depends on them, and what
    the peer asked for."""
    since = changes_since(changes, clock_at(changes, last_sync))
    lacks = contains(filter_bits, sizes, since).where("not maybe").select("doc", "hash")
    out = dependents(since, lacks)
    if need is not None:
        out = out.unionByName(need.join(changes.select("doc", "hash"), ["doc", "hash"], "left_semi").select("doc", "hash")).distinct()
    return out


def whole_document(changes: DataFrame, sending: DataFrame) -> DataFrame:
    """(doc, whole): whether more than a third of a document's changes go, so that all of it is sent at once."""
    a = changes.groupBy("doc").agg(F.count("*").alias("all"))
    b = sending.groupBy("doc").agg(F.count("*").alias("n"))
    return a.join(b, "doc", "left").select("doc", (F.coalesce("n", F.lit(0)) * 3 > F.col("all")).alias("whole"))


@dataclass
class Peer:
    """What a replica remembers of one peer; only shared_heads outlives a session.

    A replica that is `read_only` asks for nothing and takes nothing; its peer then sends no changes. Once it may take
    them again, its next message says that what was sent before is to be sent anew.
    """

    shared_heads: DataFrame | None = None
    their_heads: DataFrame | None = None
    their_need: DataFrame | None = None
    their_have: tuple[DataFrame, DataFrame, DataFrame] | None = None  # last sync, bits, sizes
    read_only: bool = False
    peer_read_only: bool = False
    peer_knows_reset: bool = False
    needs_reset: bool = False
    sent: list = field(default_factory=list)

    def set_read_only(self, to: bool) -> None:
        self.needs_reset |= self.read_only and not to
        self.read_only = to


@dataclass
class Message:
    heads: DataFrame
    need: DataFrame
    have: tuple[DataFrame, DataFrame, DataFrame]
    changes: DataFrame
    flags: int | None = None


def _empty(changes: DataFrame) -> DataFrame:
    return changes.select("doc", "hash").limit(0)


def generate(changes: DataFrame, queued: DataFrame, peer: Peer) -> Message:
    """The next message to a peer: own heads, what is missing, a filter of what was added since the last sync, changes.

    Where the peer's last common heads are unknown here, sync starts over: no changes go and nothing is taken as common.
    """
    shared = peer.shared_heads if peer.shared_heads is not None else _empty(changes)
    own = heads(changes).select("doc", "hash")
    want = edges(queued).select("doc", F.col("dep").alias("hash"))
    if peer.their_heads is not None:
        want = want.unionByName(peer.their_heads)
    known = changes.select("doc", "hash").unionByName(queued.select("doc", "hash"))
    need = want.distinct().join(known, ["doc", "hash"], "left_anti")
    if peer.read_only:
        need = need.limit(0)
    lost = None
    if peer.their_have is not None:
        lost = cut(peer.their_have[0].join(changes.select("doc", "hash"), ["doc", "hash"], "left_anti").select("doc").distinct())
        if lost.isEmpty():
            lost = None
        else:
            shared = shared.join(lost, "doc", "left_anti")
    since = changes_since(changes, clock_at(changes, shared)).select("doc", "hash")
    if lost is not None:
        need, since = need.join(lost, "doc", "left_anti"), since.join(lost, "doc", "left_anti")
    bits, sizes = bloom(since)
    send = changes.limit(0)
    if peer.their_have is not None and not peer.peer_read_only:
        ids = hashes_to_send(changes, *peer.their_have, need=peer.their_need)
        if lost is not None:
            ids = ids.join(lost, "doc", "left_anti")
        for before in peer.sent:
            ids = ids.join(before, ["doc", "hash"], "left_anti")
        peer.sent.append(ids)
        send = changes.join(ids, ["doc", "hash"], "left_semi")
    flags = KNOWS_RESET | (READ_ONLY if peer.read_only else 0)
    if peer.needs_reset:
        peer.needs_reset = False
        if peer.peer_knows_reset:
            flags |= RESET
        else:
            own = own.limit(0)  # a peer that doesn't know the flag takes this for a loss of all data
    return Message(own, need, (shared, bits, sizes), send, flags)


def receive(changes: DataFrame, queued: DataFrame, peer: Peer, message: Message) -> tuple[DataFrame, DataFrame]:
    """(changes, queued) after a message; the peer's state moves on."""
    from .merge import apply_changes

    new = message.changes.limit(0) if peer.read_only else message.changes
    applied, waiting = apply_changes(changes.unionByName(queued), new)
    if message.flags is not None:
        peer.peer_knows_reset = bool(message.flags & KNOWS_RESET)
        peer.peer_read_only = bool(message.flags & READ_ONLY)
    if (message.flags or 0) & RESET or message.heads.isEmpty():
        peer.sent.clear()
    peer.their_heads, peer.their_need, peer.their_have = message.heads, message.need, message.have
    both = message.heads.join(applied.select("doc", "hash"), ["doc", "hash"], "left_semi")
    old = peer.shared_heads if peer.shared_heads is not None else _empty(changes)
    # shared heads move to the peer's heads that are known here; a document whose heads aren't all known keeps its old ones
    full = message.heads.join(both.withColumn("k", F.lit(1)), ["doc", "hash"], "left").groupBy("doc").agg(F.min(F.coalesce("k", F.lit(0))).alias("all"))
    peer.shared_heads = both.join(full.where("all = 1"), "doc", "left_semi").unionByName(old.join(full.where("all = 1"), "doc", "left_anti"))
    return applied, waiting


def agree(a: DataFrame, qa: DataFrame, b: DataFrame, qb: DataFrame) -> bool:
    """Whether two replicas have the same heads and neither has changes that wait."""
    if not (qa.isEmpty() and qb.isEmpty()):
        return False
    x, y = heads(a).select("doc", "hash"), heads(b).select("doc", "hash")
    return x.exceptAll(y).unionByName(y.exceptAll(x)).isEmpty()


def session(a: DataFrame, qa: DataFrame, b: DataFrame, qb: DataFrame, pa: Peer | None = None, pb: Peer | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(a, queue of a, b, queue of b) after messages to and fro until the replicas agree.

    Where both lack a change they can't: it ends when IDLE rounds have moved nothing, and what waits stays in the queues.
    """
    pa, pb = pa or Peer(), pb or Peer()
    sizes, idle = None, 0
    while idle < IDLE and not agree(a, qa, b, qb):
        b, qb = [cut(x) for x in receive(b, qb, pb, _held(generate(a, qa, pa), pa))]
        _hold(pb)
        a, qa = [cut(x) for x in receive(a, qa, pa, _held(generate(b, qb, pb), pb))]
        _hold(pa)
        now = [x.count() for x in (a, qa, b, qb)]
        sizes, idle = now, idle + 1 if now == sizes else 0
    return a, qa, b, qb


def _held(m: Message, sender: Peer) -> Message:
    """The message without lineage, and so what its sender remembers of it."""
    if sender.sent:
        sender.sent[-1] = cut(sender.sent[-1])
    return Message(cut(m.heads), cut(m.need), tuple(cut(x) for x in m.have), cut(m.changes), m.flags)


def _hold(peer: Peer) -> None:
    peer.shared_heads = cut(peer.shared_heads)
