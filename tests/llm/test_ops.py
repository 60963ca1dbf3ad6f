"""The ten operators against brute force on a small table of odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from causeway.llm import containment, iblt, jaccard, language, packing, pii, quality, substring, tokens, urls
from causeway.llm.queries import tokenizer_path

from .conftest import rows, sentence

LAST = (1 << 63) - 1
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def test_substring_dedup(docs, nothing):
    got = Counter((r["doc_id"], r["n_words"], r["n_removed"], r["kept"]) for r in substring.dedup_substrings(docs).collect())
    seen = defaultdict(lambda: LAST)
    table = [(LAST if r[0] is None else r[0], r[0], WORDS.findall(r[1] or "")) for r in rows()]
    for key, _, w in table:
        for i in range(len(w) - 12):
            seen[tuple(w[i : i + 13])] = min(seen[tuple(w[i : i + 13])], key)
    want = Counter()
    for key, given, w in table:
        gone = set()
        for i in range(len(w) - 12):
            if seen[tuple(w[i : i + 13])] < key:
                gone |= set(range(i, i + 13))
        want[(given, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone))] += 1
    assert got == want and any(k[2] for k in want)
    assert substring.dedup_substrings(nothing).count() == 0


def test_substring_dedup_is_whole_with_a_full_sketch(docs, monkeypatch):
    from causeway.llm import sketch

    want = sorted(map(str, substring.dedup_substrings(docs).collect()))
    monkeypatch.setattr(sketch, "bits_for", lambda *a, **b: 3)  # every window is estimated repeated
    assert sorted(map(str, substring.dedup_substrings(docs).collect())) == want


BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base_spans(text):
    out = []
    for kind, pattern in BASE.items():
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def private_texts():
    rng = random.Random(5)
    alpha = "0123456789" * 3 + "  --..++()@@ab%_\x01é😀\n"
    out = ["".join(rng.choice(alpha) for _ in range(rng.randrange(0, 60))) for _ in range(600)]
    out += ["a@b.c@d.e", "x a@b.cd%x@y.z", "a@b..c", "é😀 a@b.co.uk. +1 (555) 555-5010", "4111 1111 1111 1111x 1.2.3.4.5.6.7.8 0001.002.3.4 256.1.1.1"]
    return out + ["1 " * 20000, "a@" + "b." * 20000 + "c", "9" * 30000, None, ""]


def test_pii_base(spark):
    texts = private_texts()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = pii.fit(df)
    for r in pii.find(df, models).collect():
        assert [(x["kind"], x["s"], x["e"]) for x in r["base"]] == base_spans(texts[r["doc_id"]] or "")
        for x in r["added"]:  # added spans are candidates that no base span touches
            assert not any(b["s"] < x["e"] and x["s"] < b["e"] for b in r["base"])


def test_pii_redact_and_models(spark, docs, nothing):
    texts = ["mail a@b.co now +1 (555) 555-5010", None, "none", "5 a@b.co"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, base string")
    got = {r["doc_id"]: (r["text"], r["base"]) for r in pii.redact(df, {}).collect()}
    assert got == {0: ("mail <email> now <phone>", "x"), 1: (None, "x"), 2: ("none", "x"), 3: ("5 <email>", "x")}
    clash = df.select("doc_id", "text", F.lit("kept").alias("cw_mine"), F.lit("kept").alias("cw_text"), F.lit("kept").alias("m"), F.lit("kept").alias("t"))
    assert pii.find(clash, pii.fit(clash)).columns == [*clash.columns, "base", "added"]
    assert {tuple(r)[2:6] for r in pii.find(clash, {}).collect()} == {("kept",) * 4} == {tuple(r)[2:] for r in pii.redact(clash, {}).collect()}
    assert pii.fit(nothing) == {} and pii.redact(nothing, {}).count() == 0
    assert pii.redact(docs, pii.fit(docs)).count() == len(rows())


def test_pii_trees_add_what_looks_alike(spark):
    good = [f"tel: +1 (555) 555-{i:04d} end" for i in range(200)]
    alike = [f"tel: 1 (555) 556-{i:04d} end" for i in range(20)]
    bad = [f"{i:016d}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(good + alike + bad)), "doc_id long, text string")
    models = pii.fit(df)
    # the trees are evaluated by SQL as by Python
    x = pii._exploded(df, "text").where("kind = 'phone'")
    m = models["phone"]
    score = repr(m.bias) + "D + " + " + ".join(t.sql(list(pii.FEATURES)) for t in m.trees)
    for r in x.withColumn("score", F.expr(score)).distinct().collect():
        assert abs(r["score"] - m.of(tuple(r[f] for f in pii.FEATURES))) < 1e-6


def test_pii_adds_disguised_spans_however_many(spark):
    mails = [f"write to user{i} {at} example{i % 7} {dot} org today" for i in range(150) for at, dot in (("[at]", "[dot]"), ("(at)", "(dot)"))]
    phones = [f"reach me: 1 (555) 556-{i:04d} or so" for i in range(300)] + [f"phone: 1555556{i:04d} or so" for i in range(300)]
    base = [f"mail a{i}@b.co or +1 (555) 555-{i:04d} end" for i in range(30)]
    other = [f"serial {i * 7919 % 10**9:09d} made" for i in range(300)] + [f"x (at) {i}.{i + 30} there" for i in range(100)]
    texts = mails + phones + base + other
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    models = pii.fit(df)
    got = {r["doc_id"]: [(x["kind"], texts[r["doc_id"]][x["s"] : x["e"]]) for x in r["added"]] for r in pii.find(df, models).collect()}
    for i, t in enumerate(texts):
        if i < len(mails):
            assert got[i] == [("email", t[9:-6])]
        elif i < len(mails + phones):
            assert got[i] == [("phone", t[t.index(": ") + 2 : -6])]
        else:
            assert got[i] == []
    red = {r["text"] for r in pii.redact(df.where(f"doc_id < {len(mails + phones)}"), models).collect()}
    assert red == {"write to <email> today", "reach me: <phone> or so", "phone: <phone> or so"}
    # no base span and nothing rejected anywhere
    alone = spark.createDataFrame(list(enumerate(mails)), "doc_id long, text string")
    assert {r["text"] for r in pii.redact(alone, pii.fit(alone)).collect()} == {"write to <email> today"}


def test_fingerprints(docs, nothing):
    got = iblt.fingerprint_edits(docs, parts=5).collect()
    table = [(-(1 << 63) if r[0] is None else r[0], r[0], r[1] or "") for r in rows()]
    ids = Counter(k for k, _, _ in table)
    ordered = sorted(table, key=lambda r: r[0])
    by = {(r["doc_id"], r["n_chars"], r["edited_sha256"]): r for r in got}
    assert len(got) == len(table)
    for i, (key, given, text) in enumerate(ordered):
        after = ordered[(i + 1) % len(ordered)]
        if ids[key] > 1 or ids[after[0]] > 1:
            continue
        e = iblt.edited(text, after[2])
        r = by[(given, len(text), hashlib.sha256(e.encode()).hexdigest())]
        assert 0 <= r["near_next"] <= 1 and 0 <= r["near_edited"] <= 1
        assert (r["fingerprint"] == r["edited_fingerprint"]) == (iblt_set(text) == iblt_set(e))
        for name, other in (("near_edited", e), ("near_next", after[2])):
            a, b = iblt_set(text), iblt_set(other)
            assert r[name] == pytest.approx(len(a & b) / len(a | b) if a | b else 1.0)
    assert iblt.fingerprint_edits(nothing).count() == 0
    lone = iblt.fingerprint_edits(docs.where("doc_id = 11").limit(1)).collect()
    assert lone[0]["near_next"] == 1.0


def iblt_set(text):
    import pyarrow as pa

    return set(iblt.digests(pa.array([text], pa.large_string()))[1].tolist())


def test_fingerprints_peel_to_the_difference():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 5, 40, 400):
        a = rng.integers(1, 1 << 62, n).astype(np.uint64)
        b = np.concatenate([a[n // 2 :], rng.integers(1, 1 << 62, n).astype(np.uint64)])
        only_a, only_b, done = iblt.differences((np.array([0, n]), a), (np.array([0, len(b)]), b), np.array([9 * n + 30]))
        assert done.all() and only_a[0] == n // 2 and only_b[0] == n


def test_an_inserted_word_changes_few_paragraphs():
    words = sentence(random.Random(8), 4000).split()
    a, b = iblt_set(" ".join(words)), iblt_set(" ".join([*words[:5], "inserted", *words[5:]]))
    assert len(a) > 100 and len(a & b) >= len(a | b) - 8
    assert len(iblt_set("same " * 100_000)) in (1, 100_000)  # no word cuts, or each does


def labelled(spark, n=400):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(n):
        good = rng.random() < 0.7
        text = sentence(rng, 30) + "." if good else " ".join(w + "!!" for w in sentence(rng, 30).upper().split())
        docs.append((i, text))
        labels.append((i, int(good)))
    docs += [(n, None), (n + 1, ""), (n + 2, "ab")]
    labels += [(None, 1), (3, None), (4, 7), labels[5]]
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_quality(spark, nothing):
    docs, labels = labelled(spark)
    keep = F.pmod("doc_id", F.lit(5)) != 0
    model = quality.fit(quality.training_rows(docs, labels, keep, "doc_id", "text", "quality"))
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality in (0, 1)").collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    held = [i for i in truth if i is not None and i % 5 == 0]
    assert len(got) == 403 and all(0 <= s <= 1 for s in got.values())
    assert sum((got[i] >= 0.3) == truth[i] for i in held) >= 0.97 * len(held)
    assert got[400] == got[401]
    # one class, no labels, no rows
    one = quality.fit(quality.training_rows(docs, labels.where("quality = 1"), None, "doc_id", "text", "quality"))
    assert all(r["score"] > 0.99 for r in quality.score(docs, one).collect())
    none = quality.fit(quality.training_rows(docs, labels.where("quality = 9"), None, "doc_id", "text", "quality"))
    assert all(abs(r["score"] - 0.5) < 1e-9 for r in quality.score(docs, none).collect())
    assert quality.score(nothing, model).count() == 0
    again = docs.where("doc_id < 3").withColumns({"score": F.lit("x"), "cw_h": F.lit("kept"), "y": F.lit("kept")})
    assert [(r["cw_h"], r["y"], r["score"] == got[r["doc_id"]]) for r in quality.score(again, model).collect()] == [("kept", "kept", True)] * 3
    # brute force: features of each text one by one, and the model's sum over them
    texts = [r["text"] or "" for r in docs.collect()] + ["ab 12 ab 12 ab ab c\n" * 400, "x"]
    for text, score in zip(texts, model.scores(*quality.features(pa.array(texts, pa.large_string())))):
        f = sorted(brute_features(text))
        margin = sum(float(model.weights[i]) for i in f) / math.sqrt(max(1, len(f))) + model.bias
        assert abs(score - 1 / (1 + math.exp(-min(30, max(-30, model.a * margin + model.b))))) < 1e-4


def brute_features(text):
    b = bytes(48 if 48 <= c <= 57 else c for c in text.encode())
    out = {((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - quality.BITS) for i in range(len(b) - 2)}
    words = WORDS.findall(text)
    code = [next((k for k in (1, 2, 3) if i >= k and words[i - k] == w), 0) for i, w in enumerate(words)]
    for i in range(len(code) - quality.REPEAT + 1):
        out.add((1 << quality.BITS) + sum(c << 2 * k for k, c in enumerate(code[i : i + quality.REPEAT])))
    return out


def test_dual_descent_closes_the_gap():
    rng = np.random.default_rng(3)
    rows = [np.unique(rng.integers(0, 40, 6)) for _ in range(120)]
    y = np.where([r.sum() + 10 * rng.normal() > 90 for r in rows], 1, -1)
    scale = rng.normal(size=40)
    w, bias = quality.dual_descent(rows, y, scale, epochs=3000)
    x = np.zeros((120, 41))
    for i, r in enumerate(rows):
        x[i, r] = scale[r] / math.sqrt(len(r))
    x[:, 40] = 1
    cost = np.where(y > 0, 0.5 / (y > 0).mean(), 0.5 / (y < 0).mean())
    full = np.append(w, bias)
    primal = lambda v: 0.5 * v @ v + (cost * np.maximum(0, 1 - y * (x @ v))).sum()
    best, step = full.copy(), 0.05
    for t in range(4000):  # no subgradient walk finds a better point
        g = best - x.T @ (cost * y * (y * (x @ best) < 1))
        nxt = best - step / (1 + t) ** 0.7 * g / max(1, np.linalg.norm(g))
        best = nxt if primal(nxt) < primal(best) else best
    assert primal(full) <= primal(best) * 1.005


def test_quality_sample_is_bounded_in_bytes(spark, monkeypatch):
    docs, labels = labelled(spark)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 100_000)
    model = quality.fit(quality.training_rows(docs, labels, None, "doc_id", "text", "quality"))
    truth = {r["doc_id"]: r["quality"] for r in labels.where("quality in (0, 1)").collect()}
    got = {r["doc_id"]: r["score"] for r in quality.score(docs, model).collect()}
    assert sum((got[i] >= 0.3) == truth[i] for i in truth if i is not None and i in got) >= 0.9 * len(truth)


@pytest.mark.parametrize("block", [1 << 20, 60])
def test_contamination(spark, docs, nothing, block, monkeypatch):
    monkeypatch.setattr(containment, "BLOCK_BYTES", block)
    table = rows()
    long = next(r[1] for r in table if r[0] == 31)
    items = [("7", long[5:150]), ("7", long[5:150]), ("12", "One, two!"), ("3", None), (None, long), ("5", " .. "), ("9", table[0][1] or "w1"), ("10", "not there at all")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["items"]), r["contaminated"], r["base"]) for r in containment.contamination(docs, bench).collect())
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = defaultdict(set)
    for item, text in items:
        w = word.findall(lower(text or "")) if item else []
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if n else ():
            windows[tuple(w[i : i + n])].add(item)
    want = Counter()
    for given, text, *rest in table:
        w = word.findall(lower(text or ""))
        hit, found = set(), set()
        for win, names in windows.items():
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= names
        want[(given, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w), rest[3])] += 1
    assert got == want and any(k[4] for k in want)
    clash = docs.withColumns({c: F.lit("x") for c in ("key", "items", "n_words", "cw_items", "lo")})
    assert set(containment.contamination(clash, bench).columns) == {*clash.columns, "n_hit", "contaminated"}
    assert containment.contamination(nothing, bench).count() == 0
    assert not any(r["contaminated"] for r in containment.contamination(docs, bench.limit(0)).collect())


def plain_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def crc(ids):
    import numpy as np

    return zlib.crc32(np.asarray(ids, "<u4").tobytes())


def test_tokens_round_trip(docs, nothing):
    files, dictionary = tokens.write_tokens(docs, tokenizer_path(), 2, parts=3)
    got = tokens.read_tokens(files, dictionary).collect()
    table = rows()
    want = Counter((r[0], tuple([*ids, 2])) for r, ids in zip(table, plain_ids([r[1] for r in table])))
    assert Counter((r["doc_id"], tuple(r["ids"])) for r in got) == want
    assert all(r["ids_crc32"] == crc(r["ids"]) and r["n_tokens"] == len(r["ids"]) for r in got)
    ordered, at = sorted(got, key=lambda r: r["start"]), 0
    keys = [-1 if r["doc_id"] is None else r["doc_id"] for r in ordered]
    assert keys == sorted(keys)
    for r in ordered:
        assert r["start"] == at
        at += r["n_tokens"]
    files, dictionary = tokens.write_tokens(nothing, tokenizer_path(), 2)
    assert tokens.read_tokens(files, dictionary).count() == 0


def test_token_tasks_keep_their_encoder(spark, docs, tmp_path):
    import shutil

    import pyarrow as pa

    own = str(tmp_path / "own.json")
    shutil.copy(tokenizer_path(), own)
    files, dictionary = tokens.write_tokens(docs, own, 2, parts=2)
    assert tokens.read_tokens(files, dictionary).count() == len(rows())

    def held(batches):
        for _ in batches:
            yield pa.RecordBatch.from_pydict({"path": pa.array([k[0] for k in tokens._HELD], pa.string())})

    assert own in {r["path"] for r in spark.range(64).repartition(64).mapInArrow(held, "path string").collect()}


def test_encoder_cuts():
    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    t, enc, rng = Tokenizer.from_file(tokenizer_path()), tokens.Encoder(tokenizer_path()), random.Random(3)
    alpha = [*"abcXYZ  \n\n'.,!*#019\t\r", "\u00a0", "\u2003", "é", "ß", "…", "😀", "'s", "'ll", "<|endoftext|>", " the", "\x85", "\x1c", "\u3000", "€", "½", "_", "-"]
    texts = ["".join(rng.choice(alpha) for _ in range(rng.randrange(80))) for _ in range(1500)] + ["", "x" * 5000, " " * 300]
    got = []
    for _, n, ids in enc.encode(pa.array(texts, pa.large_string())):
        got += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
    assert got == [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]


def test_encoder_learns_many_pieces_at_once(monkeypatch):
    import unicodedata

    import numpy as np
    import pyarrow as pa
    from tokenizers import Tokenizer

    class Counting:
        def __init__(self, t):
            self.t, self.given = t, 0

        def encode_batch_fast(self, texts, **how):
            self.given += len(texts)
            return self.t.encode_batch_fast(texts, **how)

    def ids_of(texts):
        out = []
        for _, n, ids in enc.encode(pa.array(texts, pa.large_string())):
            out += [x.tolist() for x in np.split(ids, np.cumsum(n)[:-1])]
        return out

    t, rng = Tokenizer.from_file(tokenizer_path()), random.Random(11)
    enc = tokens.Encoder(tokenizer_path())
    enc.tokenizer = seen = Counting(enc.tokenizer)
    words = ["".join(rng.choice("abcdeéßж") for _ in range(rng.randrange(4, 12))) + rng.choice(["", ",", ".", "'s", "1.", "«", "\n\n"]) for _ in range(9000)]
    texts = [rng.choice(["", " ", "\n", ". "]) + " ".join(words[i : i + 30]) + rng.choice(["", " ", "\n\n"]) for i in range(0, 9000, 30)]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(texts) == want and seen.given < 50  # it was one for every piece
    seen.given = 0
    assert ids_of(texts) == want and seen.given == 0
    # a full cache keeps what was found again
    known = enc.key[: enc.kept].copy()
    monkeypatch.setattr(tokens, "CACHE", enc.kept + 2000)
    more = [" ".join(f"{w}{w[::-1]}" for w in words[i : i + 30]) for i in range(0, 9000, 30)]
    assert ids_of(more) == [e.ids for e in t.encode_batch(more, add_special_tokens=False)]
    assert (enc._find(known) >= 0).sum() >= tokens.CACHE // 2 and ids_of(texts) == want
    # one text of more pieces than the cache holds
    monkeypatch.setattr(tokens, "CACHE", 500)
    assert ids_of([" ".join(words)] * 2 + texts) == [e.ids for e in t.encode_batch([" ".join(words)] * 2 + texts, add_special_tokens=False)]
    # ids whose bytes don't add up are never cut by them
    enc.widths = enc.widths + 1
    enc._empty()
    assert ids_of(texts[:20]) == want[:20]
    # the first bytes of two that are taken for letters, but for U+D7 and U+F7
    for first in (*range(0xC3, 0xCA), 0xD0, 0xD1):
        for second in range(0x80, 0xC0):
            c = bytes([first, second]).decode()
            assert unicodedata.category(c)[0] == "L" or c in "\u00d7\u00f7"
    assert tokens.encoder(tokenizer_path()) is tokens.encoder(tokenizer_path())


def test_packing(docs, nothing):
    got = packing.pack(docs, tokenizer_path(), 1, window=64, piece=20).collect()
    table = rows()
    want = Counter((r[0], tuple([*ids, 1])) for r, ids in zip(table, plain_ids([r[1] for r in table])))
    by = defaultdict(list)
    for r in got:
        assert r["length"] == len(r["ids"]) > 0 and r["ids_crc32"] == crc(r["ids"])
        by[r["sequence_id"]].append(r)
    for s in by.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 64
    total = sum(len(ids) * n for (_, ids), n in want.items())
    assert sum(r["length"] for r in got) == total and len(by) <= total / 64 * 1.1 + 3
    for key in {k for k, n in Counter(r[0] for r in table).items() if n == 1}:  # ids that aren't shared
        pieces = sorted((r for r in got if r["doc_id"] == key), key=lambda r: r["start"])
        ids = [i for r in pieces for i in r["ids"]]
        assert (key, tuple(ids)) in want and pieces[0]["doc_tokens"] == len(ids)
    assert packing.pack(nothing, tokenizer_path(), 1).count() == 0


def test_packing_of_many_short_texts(spark):
    docs = spark.range(300_000).select(F.col("id").alias("doc_id"), F.lit("").alias("text"), F.lit(0).alias("start"))
    got = packing.pack(docs, tokenizer_path(), 1, with_ids=False)
    whole = got.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max("offset").alias("last")).collect()
    assert sum(r["n"] for r in whole) == 300_000 and all(r["n"] == r["last"] + 1 <= 2048 for r in whole)
    assert len(whole) <= 1.1 * 300_000 / 2048 + 8
    assert packing.bundles([3, 3, 9, 1, 1, 1, 8], 6) == [[0, 1], [2], [3, 4, 5], [6]]


def test_differencing():
    assert sorted(map(sorted, packing.differencing([8, 7, 6, 5, 4], 2))) in ([[0, 1], [2, 3, 4]], [[0, 2], [1, 3, 4]], [[0, 3], [1, 2, 4]], [[0, 1, 4], [2, 3]], [[0, 2, 4], [1, 3]])
    rng = random.Random(1)
    sizes = [rng.randrange(1, 400) for _ in range(300)]
    sets = packing.fit(sizes, 1000)
    assert sorted(i for s in sets for i in s) == list(range(300))
    assert max(sum(sizes[i] for i in s) for s in sets) <= 1000 and len(sets) <= sum(sizes) / 1000 + 3


def brute_components(table, n, num, den):
    sets = []
    for r in table:
        w = WORDS.findall(lower(r[1] or ""))
        sets.append(frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)]))
    root = list(range(len(table)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(table)):
        for j in range(i):
            if sets[i] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = defaultdict(lambda: LAST)
    for i, r in enumerate(table):
        least[find(i)] = min(least[find(i)], LAST if r[0] is None else r[0])
    return Counter((r[0], len(sets[i]), None if r[0] is None and least[find(i)] == LAST else least[find(i)]) for i, r in enumerate(table))


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80), (3, 50)])
def test_jaccard(docs, nothing, n, num, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 200)
    got = jaccard.components(docs, n=n, num=num)
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got.collect()) == brute_components(rows(), n, num, 100)
    assert jaccard.components(nothing).count() == 0


@pytest.mark.parametrize("num", [80, 90])
def test_jaccard_drops_sets_beyond_a_sketch(spark, num, monkeypatch):
    """However narrow a sketch may be for the tokens, sets that link with nothing aren't stored, and those that do are."""
    rng, sets, bits, own = random.Random(3), [], jaccard.sketch.bits_for, jaccard.written
    monkeypatch.setattr(jaccard.sketch, "bits_for", lambda keys, most=28: min(bits(keys, most), 13))
    monkeypatch.setattr(jaccard, "written", lambda df, name: (sets.append(out := own(df, name)), out)[1])
    rows = [(i, " ".join(f"w{rng.randrange(10**6)}" for _ in range(200))) for i in range(400)]
    rows += [(400, rows[7][1] + " end"), (401, rows[9][1])]
    got = jaccard.components(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), num=num).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == {i: i for i in range(400)} | {400: 7, 401: 9}
    assert sets[0].where("blob is not null").select("a", "b").distinct().count() == 3


def test_jaccard_chains_over_groups(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "GROUP_TOKENS", 120)
    rng = random.Random(9)
    table = []
    for _ in range(4):
        own = sentence(rng, 60, 5000).split()
        for _ in range(14):  # each a small step from the one before
            own = list(own)
            own[rng.randrange(len(own))] = f"n{rng.randrange(10**6)}"
            table.append((rng.randrange(10**9), " ".join(own)))
    df = spark.createDataFrame(table, "doc_id long, text string").repartition(5)
    for num in (80, 90):
        got = jaccard.components(df, num=num).collect()
        assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got) == brute_components(table, 3, num, 100)


def test_contamination_counts_blocks_apart(docs, spark, monkeypatch):
    texts = sorted({r[1] for r in rows() if r[1] and len(r[1].split()) > 20})
    bench = spark.createDataFrame([(str(i), " ".join(t.split()[3:40])) for i, t in enumerate(texts)], "item_id string, text string")
    key = lambda: sorted(str(r) for r in containment.contamination(docs, bench).collect())
    want = key()
    monkeypatch.setattr(containment, "BLOCK_BYTES", 900)
    assert key() == want
    monkeypatch.setattr(containment, "VOCABULARY", 5)
    assert key() == want


@pytest.mark.parametrize("forest", [1 << 20, 3])
def test_labels_of_forests(spark, monkeypatch, forest):
    monkeypatch.setattr(jaccard, "FOREST", forest)  # 3: rounds of stars, as a forest of more links than one task takes
    monkeypatch.setattr(jaccard, "LINKS", 8)
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 240)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    root = {x: x for e in links for x in e}
    for _ in root:
        for u, v in links:
            root[u] = root[v] = min(root[u], root[v])
    df = spark.createDataFrame(links, "u long, v long").repartition(4)
    got = {r["node"]: r["label"] for r in jaccard.Join()._labels(df).collect()}
    assert got == {x: m for x, m in root.items() if x != m}


def test_language(spark, nothing):
    rng = random.Random(4)
    sound = {"aa": "bada gaba daga", "bb": "zizu wuzi zuwi", "cc": "ñeño ñoñe éñé"}
    table = []
    for i in range(300):
        lang = rng.choice(list(sound))
        parts = [x[j : j + 2] for x in sound[lang].split() for j in (0, 2)]
        table.append((i, " ".join("".join(rng.choice(parts) for _ in range(4)) for _ in range(20)), lang if i % 9 else None, lang))
    table += [(300, None, "aa", "und"), (301, "12 !?", "bb", "und"), (302, "", None, "und")]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, truth string")
    model = language.fit(df.where("doc_id % 3 != 1").select(F.col("doc_id").alias("id"), "text", "lang"))
    got = language.identify(df, model).collect()
    assert all(r["lang_pred"] == r["truth"] and 0 <= r["score"] <= 1 for r in got) and len(got) == 303
    far = language.identify(spark.createDataFrame([(1, "qqq xxx kkk")], "doc_id long, text string"), model).first()
    assert far["rejected"] and far["lang_pred"] in sound
    # brute force: dictionaries of trigrams, all centroids tried one by one
    def vector(text):
        b = bytes(32 if c < 128 and not chr(c).isalpha() else c + 32 if 65 <= c <= 90 else c for c in text.encode())
        tf = Counter()
        for i in range(len(b) - 2):
            if not (b[i + 1] == 32 and 32 in (b[i], b[i + 2])):
                tf[((b[i] | b[i + 1] << 8 | b[i + 2] << 16) * 0x9E3779B1 & 0xFFFFFFFF) >> 20] += 1
        v = {d: math.log1p(n) * float(model.idf[d]) for d, n in tf.items()}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1.0
        return {d: x / norm for d, x in v.items()}

    seen = Counter()
    learnt = [r for r in table if r[0] % 3 != 1 and r[2] and r[1] is not None]
    for r in learnt:
        seen.update(vector(r[1]).keys())
    assert all(abs(model.idf[d] - math.log((len(learnt) + 1) / (n + 1)) - 0.05) < 1e-5 for d, n in seen.items())
    assert [model.owner.tolist().count(j) for j in range(3)] == [language.CENTROIDS] * 3
    for r in got:
        v = vector(r["text"] or "")
        best = [max(sum(x * float(c[d]) for d, x in v.items()) for c, o in zip(model.centroids, model.owner) if o == j) for j in range(3)]
        if r["lang_pred"] != "und":
            assert model.langs[best.index(max(best))] == r["lang_pred"]
            assert abs(r["score"] * (2 if r["rejected"] else 1) - max(best) / sum(best)) < 1e-3
    again = spark.createDataFrame([table[0], table[0]], df.schema).withColumn("score", F.lit("x")).withColumn("cw_h", F.lit("y"))
    assert len({(r["lang_pred"], r["score"], r["cw_h"]) for r in language.identify(again, model).collect()}) == 1
    empty = language.fit(nothing.select(F.col("doc_id").alias("id"), "text", "lang"))
    assert {r["lang_pred"] for r in language.identify(df, empty).collect()} == {"und"}
    assert language.identify(nothing, model).count() == 0


def test_urls(spark):
    given = [None, "", "nothing", "http://A.Example.ORG/es/x?y#z", "https://example.org/en/12", "https://notexample.org/en/12", "x://com/fr/", "http://a.com/de/1", "http://a.com", "HTTP://a.net/x#/fr/", "http://m.casino-win.a.net/?q", "http://a.net/casino-win", "://org/", "http://org?x=/", "a://b://c/d"]
    df = spark.createDataFrame([(i, u, "kept") for i, u in enumerate(given)], "page_id long, url string, rule string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got[0] == got[1] == got[2] == ("", "", None, "allow")
    assert got[3] == ("a.example.org", "/es/x", "example.org/es/", "block")
    assert got[4] == ("example.org", "/en/12", "example.org/en/1", "block")
    assert got[5] == ("notexample.org", "/en/12", "org/", "allow")
    assert got[6] == ("com", "/fr/", "com/fr/", "allow") and got[7][2:] == ("com/de/", "block")
    assert got[8] == ("a.com", "", None, "allow") and got[9] == ("a.net", "/x", None, "allow")
    assert got[10][2:] == (None, "block") and got[11][2:] == (None, "allow")
    assert got[12] == ("org", "/", "org/", "allow") and got[13] == ("org", "", None, "allow") and got[14] == ("b:", "//c/d", None, "allow")
    # the index never loses a rule that running all of them would find
    rng = random.Random(6)
    parts = ["casino", "win", "free", "bets", "-", ".", "/", "?", "utm_source=feed", "&", "adult", "x", "http://", "ads", "track", "cheap-pills"]
    many = [("http://" if rng.random() < 0.8 else "") + "".join(rng.choice(parts) for _ in range(rng.randrange(1, 8))) for _ in range(2000)]
    rules = urls.Rules((), urls.PATTERNS, {"casino": 5, "win": 2})
    for u in many:
        plain = next((p for p in urls.PATTERNS if re.search(p.regex, u.lower())), None)
        assert rules.pattern(u) == plain
    assert urls.judge(df.limit(0)).count() == 0


def test_url_rules_hold_with_any_rarest_token(spark):
    # every alternative and optional part of every rule, on the host itself and on a subdomain
    forms = {
        "casino": ["casino-win."], "bets": ["free-bet.", "free-bets.", "free-bets-"], "pills": ["cheap-pills."], "spam": ["spam-farm."],
        "adult": ["adult-x.", "adult-9z."], "trackers": ["ads-track."],
    }
    given = [(name, f"http://{sub}{host}example.net/p") for name, hosts in forms.items() for host in hosts for sub in ("", "m.")]
    given += [("feeds", f"http://a.net/p{before}utm_source=feed{after}") for before in ("?", "?x=1&") for after in ("", "&y=2", "#z")]
    assert {name for name, _ in given} == {p.name for p in urls.PATTERNS}
    for rarest in {t for p in urls.PATTERNS for t in p.tokens} | {"bets", "bet"}:
        rules = urls.Rules((), urls.PATTERNS, {t: 0 if t == rarest else 9 for p in urls.PATTERNS for t in p.tokens})
        assert [(rules.pattern(u).name if rules.pattern(u) else None, u) for _, u in given] == given
    # in a table, `bets` is as rare as `free`, and then rarer
    for more in ([], ["http://a.net/free"]):
        df = spark.createDataFrame(list(enumerate(["http://free-bet.example.net/", "http://a.net/bets", *more])), "page_id long, url string")
        got = {r["page_id"]: (r["verdict"], r["pattern"]) for r in urls.judge(df).collect()}
        assert got[0] == ("block", "bets") and got[1] == ("allow", None)


def test_thousands_of_url_rules(spark):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ad", "bet", "win", "shop", "x1") for b in ("", "s", "9", "er")]

    def piece(depth=0):
        w = re.escape(rng.choice(words))
        forms = [w, w, w + "s?", f"({w})?", rf"[{rng.choice(words)}]", rng.choice(["-", r"\.", "/", "_", ".", r"\w*", "$", "^", r"\b", "[^a-z0-9]", "[a-z]+", "(?i:A)"])]
        if depth < 2:
            forms += [f"(?:{pattern(depth + 1)}|{pattern(depth + 1)})", f"({pattern(depth + 1)}){rng.choice(['', '+', '*', '{2}', '?'])}"]
        return rng.choice(forms)

    def pattern(depth=0):
        return "".join(rng.choice(["", "-", "/", r"\.", "[./]"]) + piece(depth) for _ in range(rng.randrange(1, 4))) + rng.choice(["", "/", r"\.", "$"])

    rules = tuple(urls.Pattern("block", f"r{i}", pattern() + rng.choice(["", "|" + pattern()])) for i in range(3000))
    index = urls.Rules((), rules, {w: rng.randrange(5) for w in words})
    assert 100 < len(index.always) < 2900
    for _ in range(150):
        u = "http://" + "".join(rng.choice([*words, "-", ".", "/", "_", "A", "é"]) for _ in range(rng.randrange(1, 9)))
        assert index.pattern(u) == next((p for p in rules if re.search(p.regex, u.lower())), None)
    table = spark.createDataFrame([(p.verdict, p.name, p.regex, 1) for p in rules[:20]], "verdict string, name string, regex string, extra int")
    assert set(urls.patterns_of(table)) == set(rules[:20])
    assert urls.required(r"://([^/?#]*\.)?free-bets?\.") == ("free",) and urls.required("casino") == () and urls.required("(?i)/A-b/") == ()


def test_pii_query_columns(spark, tmp_path):
    from causeway.llm.queries import op2_pii

    texts = private_texts()[:300] + ["a@b.co 4111 1111 1111 1111 +1 (555) 555-5010 1.2.3.4", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    for r in op2_pii(spark, str(tmp_path)).collect():
        want = base_spans(texts[r["doc_id"]] or "")
        assert [r[f"n_{k}"] for k in BASE] == [sum(s[0] == k for s in want) for k in BASE]
        listed = [":".join(map(str, s)) for s in want]
        assert r["base_sha256"] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert set(listed) <= set(filter(None, r["spans"].split(",")))
