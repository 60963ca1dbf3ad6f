"""URL filters: prefix rules by host and path, then pattern rules indexed by their rarest literal token.

A pattern rule is a regular expression. Parsing it gives the literal tokens that any URL it matches must contain as whole
runs of letters and digits (see required): those of every alternative, never those of an optional part. The index keeps
each rule under the one of its tokens that is rarest over all URLs of the table; a URL's tokens fetch candidate rules, and
only those run their expressions, with the rules that have no sure token. Rules come as tuples or from a table
(patterns_of); they and the index are broadcast. Their number is the rules', not the URLs', and checked: more than
MOST_RULES are an error.

Prefix rules (host, path) fit the host and all its subdomains if the URL's path starts with the rule's path; the longest
rule wins. They come first; a URL that none fits gets the verdict of the first pattern rule (in the given order) that
matches, and is allowed if none does.

Defined results: a null URL, or one without "://", has an empty host and path and is allowed; equal URLs get equal rows;
URLs of any length are judged whole; a table without rows gives none; columns named host, path, rule, verdict and pattern
are replaced, all others kept.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from re import _parser as P

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .frames import lean

MOST_RULES = 200_000
TOKEN = re.compile(r"[a-z0-9]+")


@dataclass(frozen=True)
class Prefix:
    verdict: str
    rule: str  # host and path as one, like "example.org/es/"


def _is_token(c: int) -> bool:
    return 97 <= c <= 122 or 48 <= c <= 57


def _clean(items: list, last: bool) -> bool:
    """Whether whatever a parsed sequence matches surely begins (or ends, if `last`) with a character outside tokens, or at
    the URL's end. A sequence that can be empty is never sure."""
    for op, av in reversed(items) if last else items:
        if op is P.LITERAL:
            return not _is_token(av)
        if op is P.IN:
            if any(o is P.CATEGORY for o, _ in av):
                return False
            own = [o is P.LITERAL and [v] or o is P.RANGE and range(v[0], v[1] + 1) or [] for o, v in av]
            holds = {c for r in own for c in r if _is_token(c)}
            return len(holds) == 36 if any(o is P.NEGATE for o, _ in av) else not holds
        if op is P.SUBPATTERN:
            return _clean(list(av[3]), last)
        if op is P.BRANCH:
            return all(_clean(list(x), last) for x in av[1])
        if op in (P.MAX_REPEAT, P.MIN_REPEAT):
            inner = _clean(list(av[2]), last)
            if av[0] or not inner:
                return inner
            continue  # it may be left out: what comes next must be sure too
        return op is P.AT and av in ((P.AT_BEGINNING, P.AT_BEGINNING_STRING) if last else (P.AT_END, P.AT_END_STRING))
    return False


def _required(items: list, sure: bool) -> set[str]:
    """Tokens that stand whole in whatever a parsed sequence matches; sure: the character before it is outside tokens."""
    out, run = set(), ""
    for i, (op, av) in enumerate(items):
        if op is P.LITERAL and _is_token(av):
            if not run:
                sure = sure if i == 0 else _clean(items[:i], True) or sure and all(o in (P.MAX_REPEAT, P.MIN_REPEAT) and _clean(list(v[2]), True) for o, v in items[:i])
            run += chr(av)
            continue
        if run and sure and _clean(items[i:], False):
            out.add(run)
        run = ""
        before = _clean(items[:i], True)
        if op is P.SUBPATTERN:
            out |= _required(list(av[3]), before)
        elif op is P.BRANCH:
            out |= set.intersection(*[_required(list(x), before) for x in av[1]])
        elif op in (P.MAX_REPEAT, P.MIN_REPEAT) and av[0] == 1:
            out |= _required(list(av[2]), before)
    return out


def required(regex: str) -> tuple[str, ...]:
    """Tokens that every URL which the expression matches holds as whole runs of letters and digits; none if unsure."""
    if re.search(r"\(\?[a-zA-Z]*i", regex):  # a literal may stand for another character
        return ()
    return tuple(sorted(_required(list(P.parse(regex)), False)))


@dataclass(frozen=True)
class Pattern:
    verdict: str
    name: str
    regex: str  # searched in the lower-cased URL

    @cached_property
    def tokens(self) -> tuple[str, ...]:
        return required(self.regex)


#: The contract's prefix rules.
PREFIXES = (Prefix("allow", "org/"), Prefix("block", "example.org/es/"), Prefix("block", "example.org/en/1"), Prefix("allow", "com/fr/"), Prefix("block", "com/de/"))
#: Pattern rules of the query.
PATTERNS = (
    Pattern("block", "casino", r"://([^/?#]*\.)?casino-win\."),
    Pattern("block", "bets", r"://([^/?#]*\.)?free-bets?\.|://([^/?#]*\.)?free-bets-"),
    Pattern("block", "pills", r"://([^/?#]*\.)?cheap-pills\."),
    Pattern("block", "spam", r"://([^/?#]*\.)?spam-farm\."),
    Pattern("block", "adult", r"://([^/?#]*\.)?adult-[a-z0-9]+\."),
    Pattern("block", "trackers", r"://([^/?#]*\.)?ads-track\."),
    Pattern("block", "feeds", r"[?&]utm_source=feed(&|#|$)"),
)


def split_url(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    rest = re.split(r"[?#]", url[at + 3 :], maxsplit=1)[0]
    host, slash, path = rest.partition("/")
    return re.sub("[A-Z]+", lambda m: m[0].lower(), host), slash + path


class Rules:
    def __init__(self, prefixes: tuple[Prefix, ...], patterns: tuple[Pattern, ...], counts: dict[str, int]):
        self.hosts: dict[str, list[tuple[str, Prefix]]] = {}
        for p in prefixes:
            host, slash, path = p.rule.partition("/")
            self.hosts.setdefault(host, []).append((slash + path, p))
        self.patterns = [(p, re.compile(p.regex)) for p in patterns]
        self.always = [i for i, p in enumerate(patterns) if not p.tokens]
        self.index: dict[str, list[int]] = {}
        for i, p in enumerate(patterns):
            if p.tokens:
                self.index.setdefault(min(p.tokens, key=lambda t: (counts.get(t, 0), t)), []).append(i)

    def __getstate__(self):
        return {"hosts": self.hosts, "index": self.index, "always": self.always, "patterns": [p for p, _ in self.patterns]}

    def __setstate__(self, state):
        self.hosts, self.index, self.always = state["hosts"], state["index"], state["always"]
        self.patterns = [(p, re.compile(p.regex)) for p in state["patterns"]]

    def prefix(self, host: str, path: str) -> Prefix | None:
        best = None
        labels = host.split(".")
        for i in range(len(labels)) if host else ():
            for start, p in self.hosts.get(".".join(labels[i:]), ()):
                if path.startswith(start) and (best is None or (len(p.rule), p.rule) > (len(best.rule), best.rule)):
                    best = p
        return best

    def pattern(self, url: str) -> Pattern | None:
        url = url.lower()
        found = sorted({*self.always, *(i for t in set(TOKEN.findall(url)) for i in self.index.get(t, ()))})
        return next((self.patterns[i][0] for i in found if self.patterns[i][1].search(url)), None)

    def judge(self, url: str | None) -> tuple[str, str, str | None, str, str | None]:
        """host, path, prefix rule, verdict, pattern rule."""
        host, path = split_url(url)
        p = self.prefix(host, path)
        if p:
            return host, path, p.rule, p.verdict, None
        q = self.pattern(url) if host or path else None
        return host, path, None, q.verdict if q else "allow", q.name if q else None


def token_counts(pages: DataFrame, url_col: str, tokens: set[str]) -> dict[str, int]:
    """How many URLs of the table have each of the tokens."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(tokens, 0)
        for batch in batches:
            for url in batch[0].to_pylist():
                for t in set(TOKEN.findall((url or "").lower())) & tokens:
                    total[t] += 1
        yield pa.RecordBatch.from_pydict({"t": pa.array(list(total), pa.string()), "n": pa.array(list(total.values()), pa.int64())})

    return {r["t"]: r["n"] for r in pages.select(url_col).mapInArrow(lean(count), "t string, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}


def patterns_of(rules: DataFrame) -> tuple[Pattern, ...]:
    """The pattern rules of a table with columns verdict, name and regex, in the order of their names."""
    found = rules.select("verdict", "name", "regex").orderBy("name", "regex").limit(MOST_RULES + 1).collect()  # checked by judge
    return tuple(Pattern(r["verdict"], r["name"], r["regex"]) for r in found if r["regex"] is not None)


def judge(pages: DataFrame, url_col: str = "url", prefixes: tuple[Prefix, ...] = PREFIXES, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """All columns of pages and host, path, rule, verdict, pattern."""
    if len(prefixes) + len(patterns) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules: they are broadcast")
    counts = token_counts(pages, url_col, {t for p in patterns for t in p.tokens}) if patterns else {}
    held = pages.sparkSession.sparkContext.broadcast(Rules(prefixes, patterns, counts))
    names = ["host", "path", "rule", "verdict", "pattern"]
    src = pages.drop(*names)
    place = src.columns.index(url_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = held.value
        for batch in batches:
            found = list(zip(*[rules.judge(u) for u in batch.column(place).to_pylist()])) or [()] * 5
            yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, pa.string()) for c in found]], names=[*batch.schema.names, *names])

    schema = T.StructType(list(src.schema.fields))
    for n in names:
        schema = schema.add(n, T.StringType())
    return src.mapInArrow(lean(run), schema)
