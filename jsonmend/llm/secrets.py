"""Operator 2, secret scans over a trigram inverted index.

Each rule's regular expression is compiled to a Boolean query over the trigrams
that every match must contain (the analysis of Cox's code search: exact, prefix
and suffix string sets, combined over concatenation, alternation and
repetition).  Documents are read in segments; each segment gets an inverted
index of the trigrams that any rule asks for, with sorted posting lists; a
rule's query intersects and unites postings, and only the surviving documents
are verified with the expression itself.  A rule without mandatory trigrams is
verified on every document.

Segments are Arrow batches, so the index never leaves the task that built it:
no shuffle, bounded memory, and a lost executor costs only its own segments.
Trigrams are taken from UTF-8 bytes with A-Z folded, which can only add
candidates.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as sre_parse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jsonmend.llm.common import read_table, small_batches, text_slices


@dataclass(frozen=True)
class Rule:
    """One kind of secret; ``group`` of a match must have ``least`` characters."""

    kind: str
    pattern: str
    flags: int = 0
    group: int = 0
    least: int = 0


#: The base kinds of the contract, in its order.  ``hex`` states its
#: length inside the pattern: maximal runs are the same, short ones are never built.
BASE_RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I, 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: Further kinds with published, distinctive shapes.
EXTRA_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
RULES = BASE_RULES + EXTRA_RULES

# ---- Boolean trigram queries: True, a trigram, or ("and" | "or", frozenset of queries)

Query = object
_MOST_STRINGS = 64


def _both(*parts: Query) -> Query:
    flat = set()
    for q in parts:
        flat |= q[1] if isinstance(q, tuple) and q[0] == "and" else {q}
    flat.discard(True)
    return True if not flat else next(iter(flat)) if len(flat) == 1 else ("and", frozenset(flat))


def _either(parts) -> Query:
    parts = set(parts)
    if True in parts or not parts:
        return True
    return next(iter(parts)) if len(parts) == 1 else ("or", frozenset(parts))


def _grams_of(strings: frozenset[bytes]) -> Query:
    """Any of the strings, each demanding all its trigrams."""
    return _either(_both(*(s[k : k + 3] for k in range(len(s) - 2))) if len(s) > 2 else True for s in strings)


@dataclass
class _Info:
    """What a subexpression's matches look like; ``exact`` is None when unbounded."""

    exact: frozenset[bytes] | None
    prefix: frozenset[bytes]
    suffix: frozenset[bytes]
    match: Query = True

    def settled(self) -> _Info:
        """Turn oversized string sets into trigram demands."""
        if self.exact is not None and len(self.exact) <= _MOST_STRINGS:
            return self
        if self.exact is not None:
            return _Info(None, _cut(self.exact, False), _cut(self.exact, True), _both(self.match, _grams_of(self.exact)))
        return _Info(None, _cut(self.prefix, False), _cut(self.suffix, True), _both(self.match, _grams_of(self.prefix), _grams_of(self.suffix)))

    def opened(self) -> _Info:
        if self.exact is None:
            return self
        return _Info(None, self.exact, self.exact, self.match)

    def demand(self) -> Query:
        ends = self.exact if self.exact is not None else None
        return _both(self.match, _grams_of(ends)) if ends is not None else _both(self.match, _grams_of(self.prefix), _grams_of(self.suffix))


def _cut(strings: frozenset[bytes], tail: bool) -> frozenset[bytes]:
    for n in (6, 4, 3, 2, 1, 0):
        out = frozenset((s[-n:] if n else b"") if tail else s[:n] for s in strings)
        if len(out) <= 16:
            return out
    return frozenset([b""])


_ANY = _Info(None, frozenset([b""]), frozenset([b""]))
_NOTHING = _Info(frozenset([b""]), frozenset([b""]), frozenset([b""]))


def _cross(a: frozenset[bytes], b: frozenset[bytes]) -> frozenset[bytes]:
    return frozenset(x + y for x in a for y in b)


def _concat(x: _Info, y: _Info) -> _Info:
    if x.exact is not None and y.exact is not None:
        both = _cross(x.exact, y.exact)
        return _Info(both, both, both, _both(x.match, y.match)).settled()
    seam = True if x.exact is not None or y.exact is not None else _grams_of(_cross(x.suffix, y.prefix))
    prefix = _cross(x.exact, y.prefix) if x.exact is not None else x.prefix
    suffix = _cross(x.suffix, y.exact) if y.exact is not None else y.suffix
    return _Info(None, prefix, suffix, _both(x.match, y.match, seam)).settled()


def _union(infos: list[_Info]) -> _Info:
    if all(i.exact is not None for i in infos):
        both = frozenset().union(*(i.exact for i in infos))
        return _Info(both, both, both, _either(i.match for i in infos)).settled()
    infos = [i.opened() for i in infos]
    return _Info(None, frozenset().union(*(i.prefix for i in infos)), frozenset().union(*(i.suffix for i in infos)), _either(i.demand() for i in infos)).settled()


def _literal(code: int) -> _Info:
    s = frozenset([chr(code).encode("utf-8").lower()])
    return _Info(s, s, s)


def _analyse(parsed) -> _Info:
    out = _NOTHING
    for op, arg in parsed:
        if op is sre.LITERAL:
            info = _literal(arg)
        elif op is sre.IN:
            codes: set[int] | None = set()
            for kind, value in arg:
                if kind is sre.LITERAL:
                    codes.add(value)
                elif kind is sre.RANGE and value[1] - value[0] < 8:
                    codes |= set(range(value[0], value[1] + 1))
                else:
                    codes = None
                    break
            info = _union([_literal(c) for c in codes]) if codes and len(codes) <= 8 else _ANY
        elif op is sre.SUBPATTERN:
            info = _analyse(arg[3])
        elif op is sre.BRANCH:
            info = _union([_analyse(p) for p in arg[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            low, high, inner = arg
            one = _analyse(inner)
            if low == 0:
                info = _union([one, _NOTHING]) if high == 1 and one.exact is not None else _ANY
            elif high == low and low <= 8:
                info = one
                for _ in range(low - 1):
                    info = _concat(info, one)
            else:
                info = one.opened()
                info = _Info(None, info.prefix, info.suffix, one.demand())
        elif op is sre.AT:
            info = _NOTHING
        else:
            info = _ANY
        out = _concat(out, info)
    return out


def trigram_query(pattern: str, flags: int = 0) -> Query:
    """The weakest useful demand: True when no trigram is mandatory."""
    return _analyse(sre_parse.parse(pattern, flags)).demand()


def grams(query: Query) -> set[bytes]:
    if isinstance(query, bytes):
        return {query}
    return set().union(*map(grams, query[1])) if isinstance(query, tuple) else set()


class SegmentIndex:
    """Posting lists of the wanted trigrams over one segment of texts."""

    def __init__(self, encoded: list[bytes], wanted: list[bytes]):
        self.size = len(encoded)
        data = np.frombuffer(b"\xff".join(encoded).lower() + b"\xff\xff", dtype=np.uint8)
        ends = np.cumsum(np.fromiter((len(t) + 1 for t in encoded), dtype=np.int64, count=self.size))
        slot = _slot_table(tuple(wanted))
        code = data[:-2].astype(np.uint32) << 16
        code |= data[1:-1].astype(np.uint32) << 8
        code |= data[2:]
        hit = slot[code]
        at = np.flatnonzero(hit)
        pairs = np.unique(hit[at].astype(np.int64) * (self.size + 1) + np.searchsorted(ends, at, side="right"))
        which, doc = pairs // (self.size + 1), pairs % (self.size + 1)
        cuts = np.searchsorted(which, np.arange(1, len(wanted) + 2))
        self.postings = {g: doc[cuts[k] : cuts[k + 1]] for k, g in enumerate(wanted)}

    def candidates(self, query: Query) -> np.ndarray:
        if query is True:
            return np.arange(self.size)
        if isinstance(query, bytes):
            return self.postings[query]
        lists = sorted((self.candidates(q) for q in query[1]), key=len)
        out = lists[0]
        for other in lists[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if query[0] == "and" else np.union1d(out, other)
        return out


_TABLES: dict[tuple, np.ndarray] = {}


def _slot_table(wanted: tuple[bytes, ...]) -> np.ndarray:
    """Trigram code to 1 + its place in ``wanted`` (0: not wanted); one table a worker."""
    if wanted not in _TABLES:
        _TABLES.clear()
        table = np.zeros(1 << 24, dtype=np.uint16)
        for k, g in enumerate(wanted):
            table[g[0] << 16 | g[1] << 8 | g[2]] = k + 1
        _TABLES[wanted] = table
    return _TABLES[wanted]


def find_spans(texts: list[str], rules=RULES) -> list[list[tuple[int, int, int]]]:
    """(start, rule number, end) of every secret, by start then rule, per text."""
    queries = [trigram_query(r.pattern, r.flags) for r in rules]
    wanted = sorted(set().union(*map(grams, queries)))
    index = SegmentIndex([t.encode("utf-8", "surrogatepass") for t in texts], wanted) if wanted else None
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for n, (rule, query) in enumerate(zip(rules, queries, strict=True)):
        find = re.compile(rule.pattern, rule.flags | re.ASCII).finditer
        for d in range(len(texts)) if index is None else index.candidates(query):
            for m in find(texts[d]):
                if m.end(rule.group) - m.start(rule.group) >= rule.least:
                    out[d].append((m.start(), n, m.end()))
    for spans in out:
        spans.sort()
    return out


def _scanner(rules) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    kinds = [r.kind for r in rules]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def scan(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in text_slices(texts):
                found = [[{"kind": kinds[n], "start": s, "end": e} for s, n, e in spans] for spans in find_spans(texts[a:b], rules)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(found, pa.list_(span))], ["id", "spans"])

    return scan


def scan_secrets(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id and ``spans`` array<struct<kind,start,end>>.

    Spans are code points, end exclusive, ordered by start then rule; per rule
    matches are leftmost and do not overlap, and failing ones are dropped.
    Letters of case-blind rules match in either ASCII case.  Null and empty
    texts have no spans; null ids and repeated rows pass through.
    """
    small_batches(docs.sparkSession)
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = picked.schema["id"].dataType.simpleString()
    out = picked.mapInArrow(_scanner(rules), f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    base = [r.kind for r in BASE_RULES]

    def count(kinds: list[str]):
        return F.size(F.filter("spans", lambda s: s["kind"].isin(kinds))).cast("long")

    def digest(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *(count([k]).alias(f"n_{k}") for k in base),
        F.sha2(digest(F.filter("spans", lambda s: s["kind"].isin(base))), 256).alias("base_sha256"),
        digest(F.col("spans")).alias("spans"),
        count([r.kind for r in EXTRA_RULES]).alias("n_extra"),
    )
