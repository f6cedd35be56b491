"""Finding secrets by a trigram inverted index over blocks of documents.

From each rule's regular expression a Boolean query over trigrams is derived: whatever
the rule matches has to hold them.  A block of documents is indexed once, for the
trigrams that occur in any query; postings are intersected and united as the query says,
and only the documents left are searched with the expression itself.  A rule without
mandatory trigrams (long hexadecimal runs) scans every document.  The index folds ASCII
letters to lower case, so it holds for rules in either case.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import product
from re import _parser  # the standard library's own parse trees

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm.common import table, text_or_empty
from helixlake.llm.encoding import chunks


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: Length that a group (0: the match) has to have.
    group: int = 0
    least: int = 0


#: The base rules, in order of listing.
BASE = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}", 0, 32),  # the runs of [0-9a-f]+ with 32 characters or more
)
#: Further secrets with a fixed shape.
MORE = (
    Rule("repo_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)

# A query is True (any document), a trigram, or ("and" | "or", frozenset of queries).


def _join(kind: str, parts: list) -> object:
    if kind == "and":
        parts = [p for p in parts if p is not True]
    elif True in parts:
        return True
    flat = {q for p in parts for q in (p[1] if isinstance(p, tuple) and p[0] == kind else [p])}
    return True if not flat and kind == "and" else next(iter(flat)) if len(flat) == 1 else (kind, frozenset(flat))


def _of_words(words: set[str]) -> object:
    """What holds for a text with one of ``words`` in it."""
    return _join("or", [_join("and", [w[i : i + 3] for i in range(len(w) - 2)]) for w in words])


def _walk(tree, most: int = 64) -> tuple[set[str] | None, object]:
    """(all strings that match, if few and known; query) of a sequence of parsed parts."""
    exact: set[str] | None = {""}
    whole, query = True, True
    for op, arg in tree:
        name = str(op)
        words, inner = None, True
        if name == "LITERAL":
            words = {chr(arg).lower()} if arg < 128 else None
        elif name == "IN":
            if all(str(o) == "LITERAL" and a < 128 for o, a in arg):
                words = {chr(a).lower() for _, a in arg}
            elif all(str(o) == "RANGE" and max(a) < 128 for o, a in arg) and sum(a[1] - a[0] + 1 for _, a in arg) <= 8:
                words = {chr(c).lower() for _, a in arg for c in range(a[0], a[1] + 1)}
        elif name == "SUBPATTERN":
            words, inner = _walk(arg[3])
        elif name == "BRANCH":
            found = [_walk(t) for t in arg[1]]
            words = set().union(*[w for w, _ in found]) if all(w is not None for w, _ in found) else None
            inner = _join("or", [q if w is None else _join("and", [q, _of_words(w)]) for w, q in found])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, high, body = arg
            found, q = _walk(body)
            if found is not None and low == high and low <= 4:
                words = {"".join(p) for p in product(found, repeat=low)} if len(found) ** low <= most else None
            elif found is not None and (low, high) == (0, 1):
                words = found | {""}
            inner = q if low and words is None else True
            if words is None and low and found is not None:
                inner = _join("and", [inner, _of_words(found)])
        elif name == "AT":
            words = {""}
        query = _join("and", [query, inner])
        if words is not None and exact is not None and len(exact) * len(words) <= most:
            exact = {a + b for a in exact for b in words}
        else:
            if exact is not None:
                query = _join("and", [query, _of_words(exact)])
            exact, whole = words, False
    if not whole and exact is not None:
        query = _join("and", [query, _of_words(exact)])
    return (exact if whole else None), query


def trigram_query(pattern: str) -> object:
    """The query that every text with a match of ``pattern`` meets; True if there is none."""
    words, query = _walk(_parser.parse(pattern, re.ASCII))
    return query if words is None else _join("and", [query, _of_words(words)])


def trigrams_of(query: object) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else set().union(*map(trigrams_of, query[1]))


def answer(query: object, postings: Callable[[str], np.ndarray], every: np.ndarray) -> np.ndarray:
    """Which documents meet a query."""
    if query is True:
        return every
    if isinstance(query, str):
        return postings(query)
    parts = [answer(q, postings, every) for q in query[1]]
    return np.logical_and.reduce(parts) if query[0] == "and" else np.logical_or.reduce(parts)


_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


class Scanner:
    """Rules with their queries, and the numbers of the trigrams that occur in them."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern, re.ASCII), trigram_query(r.pattern)) for r in rules]
        self.names = sorted(set().union(*[trigrams_of(q) for _, _, q in self.rules]))
        self.slot = np.zeros(1 << 24, np.uint8)
        for i, t in enumerate(self.names):
            a, b, c = t.encode("ascii")
            self.slot[a << 16 | b << 8 | c] = i + 1

    def index(self, texts: list[str]) -> np.ndarray:
        """Postings of a block: a row per trigram, a column per text."""
        raw = [t.encode("utf-8", "surrogatepass") for t in texts]
        data = _FOLD[np.frombuffer(b"\0\0".join(raw), np.uint8)]
        found = np.zeros((len(self.names), len(texts)), bool)
        if len(data) >= 3:
            hit = self.slot[data[:-2] << 16 | data[1:-1] << 8 | data[2:]]
            at = np.flatnonzero(hit)
            starts = np.cumsum([0] + [len(r) + 2 for r in raw[:-1]])
            found[hit[at].astype(np.int64) - 1, np.searchsorted(starts, at, "right") - 1] = True
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """Per text its spans (start, number of the rule, end), in that order."""
        found, number = self.index(texts), {t: i for i, t in enumerate(self.names)}
        every = np.ones(len(texts), bool)
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, expression, query) in enumerate(self.rules):
            for i in np.flatnonzero(answer(query, lambda t: found[number[t]], every)):
                for m in expression.finditer(texts[i]):
                    if m.end(rule.group) - m.start(rule.group) >= rule.least:
                        out[i].append((m.start(), k, m.end()))
        return [sorted(x) for x in out]


_scanners: dict[tuple[Rule, ...], Scanner] = {}


def find_secrets(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = BASE + MORE) -> DataFrame:
    """doc_id and spans, an array of (kind, start, end) in code points, by start, then by rule.

    Per rule, matches are leftmost and don't overlap; whole texts are searched, a null
    text is empty.  Every input row gives one row, whether its id is null, repeated or its own;
    other columns are ignored, whatever their names.  No rows in, no rows out; there is no shuffle.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = _scanners.get(rules) or _scanners.setdefault(rules, Scanner(rules))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for begin, end in chunks(texts):
                spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in scanner.scan(texts[begin:end])]
                yield pa.RecordBatch.from_arrays([batch.column(0)[begin:end], pa.array(spans, pa.list_(span))], ["doc_id", "spans"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), text_or_empty(text).alias("t"))
    return rows.mapInArrow(scan, "doc_id bigint, spans array<struct<kind:string,start:int,end:int>>")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(shown(base), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"))


QUERIES = {"op8_secret_scan": op8_secret_scan}
ORACLE: dict[str, str] = {}
