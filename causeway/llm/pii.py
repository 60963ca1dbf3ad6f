"""Personal data: overlapping candidate spans, scored by gradient-boosted trees, kept above calibrated thresholds.

Everything runs as Spark SQL expressions. Generators are regular expressions of high recall (GENERATORS), whose matches
get code-point positions from the lengths of the gaps between them. Each candidate has discrete format features (digits,
groups, signs, length) and context features (a cue word before it, what touches it). Shallow trees are boosted on the
counts of distinct feature vectors: the table of all data's candidates grouped by feature vector, whose number of rows is
bounded by the features' values (MOST_CELLS), so training reads every candidate and the driver holds a table of fixed
size. The weak label of a candidate is whether the strict rules (Luhn, octets, digit counts) accept a span inside it, or
all of it once its disguise is undone (see _evidence); features leave out what those rules test. The trees become one CASE
expression each. A kind's threshold is the lowest score at which the candidates above it are at least PRECISION accepted,
measured on candidates that no base span touches, as only those can be added, of a fold that the trees didn't see.

Base spans (strict rules) always stay; the method adds candidates of high score that no base span touches.

Defined results: null text is the empty text without spans; repeated rows get equal rows; without accepted candidates
nothing is trained, and without rejected ones all candidates have the same score; if no candidate can be added base spans
alone are returned; texts of any length are searched whole; a table without rows gives none. `find` replaces columns named
base and added and keeps all others, whatever their names; `redact` keeps all columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
#: Strict patterns, written so that no start is tried twice and nothing recurses on long runs. In `card`, a separator
#: between two digits is marked first (see _marked), so a run is one character class.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?=\.[A-Za-z0-9-])[A-Za-z0-9.-]*?(?![A-Za-z0-9-]|\.[A-Za-z0-9-])",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": "[0-9\x01]{2,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Candidates of high recall; a kind's candidates may overlap its base spans and other kinds'.
GENERATORS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\x20?[\[(]at[\])]\x20?)[A-Za-z0-9-]{1,63}+(?:(?:\.|\x20?[\[(]dot[\])]\x20?)[A-Za-z0-9-]{1,63}+){1,8}",
    "ip": r"(?<![0-9.])[0-9]{1,4}+(?:[.\x20-][0-9]{1,4}+){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9][0-9\x20.-]{11,30}[0-9](?![0-9])",
    "phone": r"(?<![0-9])\+?[(]?[0-9][\x20()./0-9-]{6,22}[0-9](?![0-9])",
}
#: Words before a candidate that speak for a kind.
CUES = r"(?i)(?:mail|contact|phone|tel|call|fax|mobile|ip|host|server|card|visa|account|iban|pay)[a-z]*[\x20:=#.]{0,3}$"
#: What stands for @ and . in a disguised address, and what an address is once that is undone.
AT, DOT = r"\x20?[\[(]at[\])]\x20?", r"\x20?[\[(]dot[\])]\x20?"
ADDRESS = r"^[._%+-]*[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.){1,8}[A-Za-z]{2,}$"
#: Words right before a number that say what it is, by kind; stricter than CUES, as labels rest on them.
NAMED = {
    "phone": r"(?i)(?<![a-z])(?:phone|tele?|call|fax|mobile|contact)[a-z]*[\x20:=#.]{1,3}$",
    "ip": r"(?i)(?<![a-z])(?:ip|host|server)[a-z]*[\x20:=#.]{1,3}$",
}
#: Layouts of phone numbers: an area code and groups that end in four digits, or pairs.
LAID_OUT = r"^(?:[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)[\x20.-]?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20.-][0-9]{4}$|^0[1-9](?:[\x20.-][0-9]{2}){4}$"
FEATURES = ("digits", "groups", "length", "signs", "cue", "left", "right")
#: Distinct feature vectors of a kind: 7 * 6 * 6 * 8 * 2 * 3 * 3 values at most.
MOST_CELLS = 36_288
ROUNDS, DEPTH, RATE, LEAST = 24, 2, 0.3, 8
PRECISION = 0.9
#: Scores this near are one: SQL adds up rounded leaves.
NEAR = 1e-6


def _plus(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _marked(text: Column) -> Column:
    """The text of equal length in which x01 stands for a single blank or hyphen between two digits."""
    return F.regexp_replace(F.translate(text, "\x01", "\x02"), r"(?<=[0-9])[\x20-](?=[0-9])", "\x01")


def spans(text: Column, pattern: str, needed: Column) -> Column:
    """array<struct<s, e, m>>: start, end (code points) and text of all matches, if `needed` holds.

    The gaps between matches are what split() leaves; their lengths and the matches' give the positions.
    """
    none = F.array().cast("array<struct<s:int,e:int,m:string>>")
    found, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), none.alias("out"))
    step = lambda acc, x: F.struct(
        (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("int").alias("at"),
        F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["g"])).cast("int").alias("s"), (acc["at"] + F.length(x["g"]) + F.length(x["m"])).cast("int").alias("e"), x["m"].alias("m")))).alias("out"),
    )
    pairs = F.arrays_zip(F.slice(gaps, 1, F.size(found)).alias("g"), found.alias("m"))
    return F.when(needed, F.aggregate(pairs, state, step, lambda acc: acc["out"])).otherwise(none)


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Luhn's sum of a digit string is a multiple of 10."""
    rev = F.reverse(digits)
    each = F.transform(F.sequence(F.lit(1), F.length(digits)), lambda i: F.substring(rev, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.when(d > 9, d - 9).otherwise(d)) % 10 == 0


def _strict(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # octets of any length: leading zeros go before the comparison
        return F.forall(F.split(m, r"\."), lambda o: F.length(F.ltrim(o, F.lit("0"))).between(0, 3) & (F.substring(F.concat(F.lit("000"), F.ltrim(o, F.lit("0"))), -3, 3).cast("int") <= 255))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(8, 15)


def _has_digit(text: Column) -> Column:
    """Whether any pattern can match: all want a digit or an at sign, or "at" in brackets."""
    return F.when(F.contains(text, F.lit("@")), True).otherwise(text.rlike(r"[0-9]|[aA][tT][)\]]"))


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<s, e, m>> of the strict rules' spans of a kind."""
    if kind == "card":
        return F.filter(spans(_marked(text), BASE[kind], text.rlike(r"[0-9](?:[\x20-]?[0-9]){15}")), lambda x: _strict(kind, x["m"]))
    needed = {"email": F.contains(text, F.lit("@")), "ip": text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), "phone": text.rlike(r"\+[0-9]")}[kind]
    return F.filter(spans(text, BASE[kind], needed), lambda x: _strict(kind, x["m"]))


def candidates(text: Column, kind: str) -> Column:
    """array<struct<s, e, m>> of a kind's candidates."""
    needed = F.contains(text, F.lit("@")) | F.contains(F.lower(text), F.lit("at]")) | F.contains(F.lower(text), F.lit("at)")) if kind == "email" else text.rlike(r"[0-9][\x20()./-]{0,3}[0-9]")
    return spans(text, GENERATORS[kind], needed)


def _bin(x: Column, edges: list[int]) -> Column:
    out = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(x <= edges[i], i).otherwise(out)
    return out


def _around(text: Column, x: Column) -> tuple[Column, Column]:
    """The characters before a candidate, twelve at most, and the one after it."""
    left, right = F.substring(text, x["s"] - 11, F.lit(12)), F.substring(text, x["e"] + 1, F.lit(1))
    return F.when(x["s"] > 11, left).otherwise(F.substring(text, F.lit(1), x["s"])), right


def _evidence(kind: str, text: Column, x: Column) -> Column:
    """Whether the strict rules accept all of a candidate once its disguise is undone.

    That is [at] and [dot] of an address, other separators of a card, those of an octet row that a word names, and the
    missing + of a phone number that a word names or that is laid out as one.
    """
    m = x["m"]
    before, right = _around(text, x)
    if kind == "email":
        return F.regexp_replace(F.regexp_replace(m, AT, "@"), DOT, ".").rlike(ADDRESS)
    alone = ~F.substring(before, -1, 1).rlike(r"[\p{L}0-9_]") & ~right.rlike(r"[\p{L}0-9_]")
    if kind == "card":
        return alone & _strict(kind, m)
    if kind == "ip":
        return alone & before.rlike(NAMED[kind]) & _strict(kind, F.translate(m, " -", ".."))
    return alone & _strict(kind, m) & (before.rlike(NAMED[kind]) | m.rlike(LAID_OUT))


def _features(text: Column, x: Column) -> dict[str, Column]:
    """Discrete features of a candidate; numbers that the strict rules test are binned coarsely."""
    m = x["m"]
    before, right = _around(text, x)
    touch = lambda c: F.when(c == "", 0).when(c.rlike(r"[\p{L}0-9_=/]"), 2).otherwise(1)
    return {
        "digits": _bin(F.length(_digits(m)), [0, 4, 7, 11, 15, 19]),
        "groups": _bin(F.size(F.split(m, r"[^A-Za-z0-9]+")), [1, 2, 3, 4, 6]),
        "length": _bin(F.length(m), [8, 12, 16, 20, 28]),
        "signs": F.contains(m, F.lit(".")).cast("int") + 2 * F.contains(m, F.lit("(")).cast("int") + 4 * F.contains(m, F.lit("-")).cast("int"),
        "cue": before.rlike(CUES).cast("int"),
        "left": touch(F.substring(before, -1, 1)),
        "right": touch(right),
    }


@dataclass
class Tree:
    """A split on feature <= value, or a leaf."""

    feature: int = -1
    value: int = 0
    low: "Tree | None" = None
    high: "Tree | None" = None
    leaf: float = 0.0

    def of(self, row: tuple) -> float:
        t = self
        while t.feature >= 0:
            t = t.low if row[t.feature] <= t.value else t.high
        return t.leaf

    def sql(self, names: list[str]) -> str:
        if self.feature < 0:
            return repr(round(self.leaf, 9)) + "D"
        return f"case when {names[self.feature]} <= {self.value} then {self.low.sql(names)} else {self.high.sql(names)} end"


@dataclass
class Model:
    """Log-odds of a candidate: bias and trees; kept at `least` or more."""

    bias: float
    trees: list[Tree]
    least: float

    def of(self, row: tuple) -> float:
        return self.bias + sum(t.of(row) for t in self.trees)


def grow(rows: list[tuple], g: list[float], h: list[float], depth: int) -> Tree:
    """A tree of largest gain by second-order sums, features being small integers."""
    sg, sh = sum(g), sum(h)
    leaf = Tree(leaf=-RATE * sg / (sh + 1.0))
    if depth == 0 or sh < LEAST:
        return leaf
    best = (1e-6, -1, 0)
    for f in range(len(rows[0])):
        sums: dict[int, list[float]] = {}
        for r, x, y in zip(rows, g, h):
            s = sums.setdefault(r[f], [0.0, 0.0])
            s[0] += x
            s[1] += y
        lg = lh = 0.0
        for value in sorted(sums)[:-1]:
            lg, lh = lg + sums[value][0], lh + sums[value][1]
            if min(lh, sh - lh) >= 1.0:
                gain = lg * lg / (lh + 1) + (sg - lg) ** 2 / (sh - lh + 1) - sg * sg / (sh + 1)
                best = max(best, (gain, f, value))
    if best[1] < 0:
        return leaf
    _, f, value = best
    side = [r[f] <= value for r in rows]
    part = lambda keep: ([r for r, s in zip(rows, side) if s == keep], [x for x, s in zip(g, side) if s == keep], [y for y, s in zip(h, side) if s == keep])
    return Tree(f, value, grow(*part(True), depth - 1), grow(*part(False), depth - 1))


def boost(cells: list[tuple[tuple, int, float, float, float, float]]) -> Model | None:
    """A model from (feature vector, fold, accepted, all, open accepted, open) cells: fold 0 calibrates, the others train.

    Open candidates are those that no base span touches.
    """
    train = [c for c in cells if c[1] != 0] or cells
    up, n = sum(c[2] for c in train), sum(c[3] for c in train)
    if not up:
        return None
    merged: dict[tuple, list[float]] = {}
    for row, _, a, k, *_ in train:
        s = merged.setdefault(row, [0.0, 0.0])
        s[0] += a
        s[1] += k
    rows = sorted(merged)
    model = Model(math.log(up / max(n - up, 0.5)), [], 0.0)
    score = [model.bias] * len(rows)
    for _ in range(ROUNDS):
        p = [1 / (1 + math.exp(-s)) for s in score]
        g = [merged[r][1] * q - merged[r][0] for r, q in zip(rows, p)]
        h = [merged[r][1] * q * (1 - q) + 1e-9 for r, q in zip(rows, p)]
        tree = grow(rows, g, h, DEPTH)
        if tree.feature < 0:
            break
        model.trees.append(tree)
        score = [s + tree.of(r) for s, r in zip(score, rows)]
    # the lowest score above which what could be added of the calibration fold is precise enough; never under even odds
    held = any(fold == 0 and k for _, fold, _, _, _, k in cells)
    check = sorted(((model.of(row), a, k) for row, fold, _, _, a, k in cells if k and (fold == 0 or not held)), reverse=True)
    right = total = 0.0
    least = math.inf
    for i, (s, a, k) in enumerate(check):
        right, total = right + a, total + k
        if right >= PRECISION * total and (i + 1 == len(check) or check[i + 1][0] < s):
            least = s
    model.least = max(least, 0.0)
    return model


def _exploded(docs: DataFrame, text_col: str) -> DataFrame:
    """One row per candidate with its kind, features, fold, weak label and whether no base span touches it."""
    text = F.col("text")
    src = docs.select(_plus(F.col(text_col)).alias("text")).where(_has_digit(text))
    src = src.select(
        "text", F.array(*[F.struct(F.lit(k).alias("kind"), candidates(text, k).alias("c"), base_spans(text, k).alias("b")) for k in KINDS]).alias("kinds")
    )
    rows = src.select("text", F.flatten("kinds.b").alias("every"), F.explode("kinds").alias("k")).where(F.size("k.c") > 0)
    rows = rows.select("text", "every", F.col("k.kind").alias("kind"), F.col("k.b").alias("b"), F.explode("k.c").alias("x"))
    good = F.exists("b", lambda b: (b["s"] >= F.col("x.s")) & (b["e"] <= F.col("x.e")))
    for k in KINDS:
        good = F.when(good, True).when(F.col("kind") == k, _evidence(k, text, F.col("x"))).otherwise(good)
    free = ~F.exists("every", lambda b: (b["s"] < F.col("x.e")) & (F.col("x.s") < b["e"]))
    return rows.select("kind", F.pmod(F.xxhash64("text"), F.lit(4)).alias("fold"), good.cast("int").alias("y"), free.cast("int").alias("open"), *[c.cast("int").alias(n) for n, c in _features(text, F.col("x")).items()])


def fit(docs: DataFrame, text_col: str = "text") -> dict[str, Model]:
    """A model for each kind that has accepted candidates, from all documents."""
    cells = _exploded(docs, text_col).groupBy("kind", "fold", *FEATURES).agg(F.sum("y").alias("y"), F.count("*").alias("n"), F.sum(F.col("y") * F.col("open")).alias("oy"), F.sum("open").alias("o"))
    found: dict[str, list] = {}
    for r in cells.collect():  # at most kinds x 4 folds x MOST_CELLS rows, by the features' values
        found.setdefault(r["kind"], []).append((tuple(r[f] for f in FEATURES), r["fold"], *[float(r[c]) for c in ("y", "n", "oy", "o")]))
    out = {}
    for kind in KINDS:
        model = boost(sorted(found.get(kind, [])))
        if model:
            out[kind] = model
    return out


def find(docs: DataFrame, models: dict[str, Model], text_col: str = "text") -> DataFrame:
    """All columns of docs and `base`, `added`: array<struct<kind, s, e>>, sorted by kind as listed, then start."""
    kept = [c for c in docs.columns if c.lower() not in ("base", "added")]
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("cw_row"), F.when(_has_digit(F.col(f"`{text_col}`")), F.col(f"`{text_col}`")).otherwise("").alias("cw_text"))
    text = F.col("cw_text")
    for i, k in enumerate(KINDS):
        src = src.withColumn(f"cw_b{i}", base_spans(text, k))
    label = lambda name, k: F.transform(F.col(name), lambda x: F.struct(F.lit(k).alias("kind"), x["s"].alias("s"), x["e"].alias("e")))
    src = src.withColumn("base", F.concat(*[label(f"cw_b{i}", k) for i, k in enumerate(KINDS)]))
    for i, k in enumerate(KINDS):
        m = models.get(k)
        if m is None or math.isinf(m.least):
            src = src.withColumn(f"cw_a{i}", F.array().cast("array<struct<s:int,e:int,m:string>>"))
            continue
        features = F.transform(candidates(text, k), lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["m"].alias("m"), *[c.cast("int").alias(n) for n, c in _features(text, x).items()]))
        total = " + ".join([repr(round(m.bias, 9)) + "D", *[f"({t.sql(['x.' + n for n in FEATURES])})" for t in m.trees]])
        src = src.withColumn(f"cw_c{i}", features)
        src = src.withColumn(
            f"cw_a{i}",
            F.expr(f"filter(cw_c{i}, x -> not exists(base, b -> b.s < x.e and x.s < b.e) and ({total}) >= {round(m.least - NEAR, 9)!r}D)"),
        )
    src = src.withColumn("added", F.concat(*[label(f"cw_a{i}", k) for i, k in enumerate(KINDS)]))
    return src.select(*[F.col(f"cw_row.`{c}`").alias(c) for c in kept], "base", "added")


def listed(spans_of: Column) -> Column:
    """kind:start:end, comma-joined, by kind as listed, then start."""
    order = {k: i for i, k in enumerate(KINDS)}
    keyed = F.transform(spans_of, lambda x: F.struct(F.when(x["kind"] == "email", 0).when(x["kind"] == "ip", 1).when(x["kind"] == "card", 2).otherwise(3).alias("k"), x["s"].alias("s"), x["e"].alias("e"), x["kind"].alias("kind")))
    assert len(order) == 4
    return F.array_join(F.transform(F.array_sort(keyed), lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def redact(docs: DataFrame, models: dict[str, Model], text_col: str = "text") -> DataFrame:
    """docs with every span replaced by <kind>; overlapping spans become one, named by the first."""
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text_col).alias("t"))
    found = find(src, models, "t")
    merged = F.expr(
        "aggregate(array_sort(transform(concat(base, added), x -> struct(x.s as s, x.e as e, x.kind as kind))), cast(array() as array<struct<s:int,e:int,kind:string>>), (acc, x) -> "
        "if(size(acc) > 0 and element_at(acc, -1).e > x.s, concat(slice(acc, 1, size(acc) - 1), array(named_struct('s', element_at(acc, -1).s, 'e', greatest(element_at(acc, -1).e, x.e), 'kind', element_at(acc, -1).kind))), "
        "concat(acc, array(x))))"
    )
    out = found.withColumn("m", F.when(F.size("base") + F.size("added") > 0, merged))
    new = F.expr(
        "if(m is null, t, concat(array_join(transform(m, (x, i) -> concat(substring(t, if(i = 0, 0, m[i - 1].e) + 1, x.s - if(i = 0, 0, m[i - 1].e)), '<', x.kind, '>')), ''), "
        "substring(t, element_at(m, -1).e + 1)))"
    )
    return out.select(*[new.alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
