"""Operator 8: secret scans by grammar inference.

Credentials that the base patterns find in the corpus are the labelled examples.  For each kind of them a prefix tree of
character classes is built, and its states are merged where their continuations are statistically alike (ALERGIA:
Carrasco and Oncina, 1994), which gives a probabilistic automaton of the format.  Every token of every text that isn't
part of a base match is then scored by its likelihood under the automata; likely ones are spans of kind ``format``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from heapq import nsmallest

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cartlens.llm.common import map_rows, table

#: Base kinds in order, with the group that has the secret and its least length.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
BASE = (("assign", ASSIGN, 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24))
#: The same matches, from a pattern that passes over short runs at once.
_FAST = {"hex": re.compile("[0-9a-f]{24,}")}
KINDS = [k for k, *_ in BASE] + ["format"]
#: Candidates from wide to narrow, each tried inside those of the one before that aren't secrets: all characters of an
#: assigned value, without an equal sign but at the end, and without dots too.
RUN = re.compile(r"[A-Za-z0-9+/_.=-]+")
DOTTED = re.compile(r"[A-Za-z0-9+/_.-]+={0,2}")
TOKEN = re.compile(r"[A-Za-z0-9+/_-]+={0,2}")
#: Most labelled credentials of each kind, the first distinct ones by MD5.
MAX_EXAMPLES = 500
#: Fewer give no automaton: a format can't be told from a few strings.
MIN_EXAMPLES = 5
#: Confidence of the test that two states differ.
ALPHA = 0.05
#: A candidate may be less likely per character than the least likely example by so much (nats).
MARGIN = 0.1
CLASSES = (("digit", "0123456789"), ("hex", "abcdef"), ("lower", "ghijklmnopqrstuvwxyz"),
           ("upper", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), ("plus", "+"), ("slash", "/"), ("line", "_"), ("dash", "-"),
           ("equal", "="), ("dot", "."))
_CLASS = {c: i for i, (_, cs) in enumerate(CLASSES) for c in cs}


def base_matches(text: str | None) -> list[tuple[int, int, int, str]]:
    """(kind number, start, end, secret) of the base matches, leftmost and non-overlapping per kind."""
    out = []
    for number, (kind, pattern, group, least) in enumerate(BASE):
        for m in _FAST.get(kind, pattern).finditer(text or ""):
            if m.end(group) - m.start(group) >= least:
                out.append((number, m.start(), m.end(), m[group]))
    return out


@dataclass
class State:
    ends: int = 0
    arrivals: int = 0
    counts: Counter = field(default_factory=Counter)
    to: dict[int, int] = field(default_factory=dict)


def prefix_tree(strings: list[list[int]]) -> list[State]:
    states = [State()]
    for s in strings:
        at = 0
        states[0].arrivals += 1
        for c in s:
            states[at].counts[c] += 1
            if c not in states[at].to:
                states[at].to[c] = len(states)
                states.append(State())
            at = states[at].to[c]
            states[at].arrivals += 1
        states[at].ends += 1
    return states


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    """Hoeffding bound on two observed rates."""
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def _alike(states: list[State], a: int, b: int, alpha: float) -> bool:
    """Whether two states end and go on alike, and so do the states that they lead to."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        x, y = states[a], states[b]
        if _differ(x.ends, x.arrivals, y.ends, y.arrivals, alpha):
            return False
        for c in x.counts.keys() | y.counts.keys():
            if _differ(x.counts[c], x.arrivals, y.counts[c], y.arrivals, alpha):
                return False
            if c in x.to and c in y.to:
                todo.append((x.to[c], y.to[c]))
    return True


def _fold(states: list[State], a: int, b: int) -> None:
    """Add the tree under ``b`` to state ``a``."""
    todo = [(a, b)]
    while todo:
        a, b = todo.pop()
        x, y = states[a], states[b]
        x.ends += y.ends
        x.arrivals += y.arrivals
        x.counts.update(y.counts)
        for c, child in y.to.items():
            if c in x.to:
                todo.append((x.to[c], child))
            else:
                x.to[c] = child


def merge_states(states: list[State], alpha: float = ALPHA) -> list[State]:
    """Merge compatible states: kept states grow by their successors, each of which is merged into the first kept
    state like it, or kept."""
    kept = [0]
    waiting = deque((0, c) for c in sorted(states[0].to))
    while waiting:
        source, c = waiting.popleft()
        new = states[source].to[c]
        if new in kept:
            continue
        same = next((k for k in kept if _alike(states, k, new, alpha)), None)
        if same is None:
            kept.append(new)
            waiting.extend((new, d) for d in sorted(states[new].to))
        else:
            states[source].to[c] = same
            _fold(states, same, new)
            waiting.extend((k, d) for k in kept for d in sorted(states[k].to) if states[k].to[d] not in kept)
    number = {k: i for i, k in enumerate(kept)}
    return [State(states[k].ends, states[k].arrivals, states[k].counts, {c: number[t] for c, t in states[k].to.items()}) for k in kept]


class Automaton:
    """Format of one kind: a literal start, merged states over character classes, and what the examples allow."""

    def __init__(self, examples: list[str], alpha: float = ALPHA, margin: float = MARGIN,
                 lengths: tuple[int, int] | None = None):
        """``lengths``: least and greatest of all credentials of the kind, where ``examples`` are some of them."""
        low, high = min(examples), max(examples)
        self.start = low[:next((i for i, c in enumerate(low) if i >= len(high) or c != high[i]), len(low))]
        coded = [[_CLASS[c] for c in s[len(self.start):]] for s in examples]
        self.states = merge_states(prefix_tree(coded), alpha)
        self.shortest, self.longest = lengths or (min(map(len, examples)), max(map(len, examples)))
        seen = Counter(c for s in coded for c in set(s))
        #: classes that nearly every example has
        self.needed = frozenset(c for c, n in seen.items() if n >= 0.99 * len(examples))
        self.least = -math.inf
        self.least = min(self.likelihood(s) for s in examples) - margin

    def likelihood(self, token: str) -> float:
        """Log likelihood per character, minus infinity where the automaton can't make the token."""
        if not token.startswith(self.start):
            return -math.inf
        at, total = 0, 0.0
        for ch in token[len(self.start):]:
            c, state = _CLASS.get(ch), self.states[at]
            if c not in state.to:
                return -math.inf
            total += math.log(state.counts[c] / state.arrivals / len(CLASSES[c][1]))
            at = state.to[c]
        state = self.states[at]
        # where no example ends, another credential still may: half an end
        return (total + math.log(max(state.ends, 0.5) / state.arrivals)) / (len(token) + 1)

    def accepts(self, token: str) -> bool:
        return (self.shortest <= len(token) <= self.longest and self.needed <= {_CLASS.get(c) for c in token[len(self.start):]}
                and self.likelihood(token) >= self.least)


def learn(docs: DataFrame, text: str = "text", max_examples: int = MAX_EXAMPLES) -> list[Automaton]:
    """An automaton for each base kind that has enough distinct credentials in the corpus.

    Every text is searched; at most ``max_examples`` of each kind, the first by MD5, come to the driver, and the least and
    greatest length of all of them.  A task hands on no more than that, and no credential is written to a table.
    """
    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first: dict[int, dict[str, str]] = {}  # secrets of a kind with their digests
        lengths: dict[int, tuple[int, int]] = {}
        for x in batches:
            for kind, secret in ((k, s) for t in x[text] for k, _, _, s in base_matches(t) if s.isascii()):
                low, high = lengths.get(kind, (len(secret), len(secret)))
                lengths[kind] = min(low, len(secret)), max(high, len(secret))
                own = first.setdefault(kind, {})
                if secret not in own:
                    own[secret] = hashlib.md5(secret.encode()).hexdigest()
                    if len(own) > 4 * max_examples:
                        first[kind] = dict(nsmallest(max_examples, own.items(), key=lambda e: (e[1], e[0])))
        rows = [(k, None, a, b) for k, (a, b) in lengths.items()]
        for k, own in first.items():
            rows += [(k, s, None, None) for s, _ in nsmallest(max_examples, own.items(), key=lambda e: (e[1], e[0]))]
        yield pd.DataFrame(rows, columns=["kind", "secret", "shortest", "longest"]).astype({"shortest": "Int32", "longest": "Int32"})

    parts = docs.select(text).mapInPandas(found, "kind int, secret string, shortest int, longest int")
    whole = parts.groupBy("kind", "secret").agg(F.min("shortest").alias("shortest"), F.max("longest").alias("longest"))
    in_order = Window.partitionBy("kind").orderBy(F.md5("secret").asc_nulls_first(), "secret")
    # the row of the lengths comes first
    some = whole.withColumn("n", F.row_number().over(in_order)).where(F.col("n") <= max_examples + 1)
    lengths: dict[int, tuple[int, int]] = {}
    by_kind: dict[int, list[str]] = {}
    for kind, secret, shortest, longest in some.orderBy("kind", "n").drop("n").collect():
        if secret is None:
            lengths[kind] = shortest, longest
        else:
            by_kind.setdefault(kind, []).append(secret)
    return [Automaton(s, lengths=lengths[k]) for k, s in sorted(by_kind.items()) if len(s) >= MIN_EXAMPLES]


def _likely(text: str, start: int, end: int, automata: list[Automaton], hidden: list[tuple[int, int]],
            patterns: tuple[re.Pattern, ...]) -> Iterator[tuple[int, int]]:
    """Spans from ``start`` to ``end`` that match the first pattern, as they are or without dots (and equal signs) around
    them, and that an automaton accepts; where no form is, those of the further patterns inside."""
    shortest = min(x.shortest for x in automata)
    for m in patterns[0].finditer(text, start, end):
        a, b = m.span()
        if b - a < shortest:
            continue
        forms = {(a, b): None}
        for around in (".", ".="):
            left = b - len(m[0].lstrip(around))
            forms[left, left + len(m[0].strip(around))] = None
        for p, q in forms:
            if (q - p >= shortest and any(x.accepts(text[p:q]) for x in automata)
                    and not any(u < q and p < v for u, v in hidden)):
                yield p, q
                break
        else:
            if patterns[1:]:
                yield from _likely(text, a, b, automata, hidden, patterns[1:])


def scan(text: str | None, automata: list[Automaton]) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all spans in order: the base ones and likely tokens outside them."""
    text = text or ""
    base = base_matches(text)
    spans = [(a, k, b) for k, a, b, _ in base]
    if automata:
        hidden = [(a, b) for _, a, b, _ in base]
        spans += [(a, len(BASE), b) for a, b in _likely(text, 0, len(text), automata, hidden, (RUN, DOTTED, TOKEN))]
    return sorted(spans)


def find_secrets(docs: DataFrame, automata: list[Automaton], text: str = "text", name: str = "spans") -> DataFrame:
    """``docs`` with ``name``: array of (kind, start, end) in code points, by start and kind.

    Null and empty texts have none; other columns stay; repeated rows are scanned each by itself.
    """
    @F.pandas_udf("array<struct<kind:string,start:bigint,end:bigint>>")
    def scanned(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scan(t, automata)] for t in x], dtype=object)

    return docs.withColumn(name, scanned.asNondeterministic()(F.col(text)))


def redact(text: str | None, spans: list[tuple[int, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with every span (overlapping ones together) replaced by ``mark``."""
    if not spans:
        return text
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


def op8_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole document: base counts, their digest, and all spans."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    automata = learn(docs)

    def digests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = []
            for doc, spans in zip(x["doc_id"], (scan(t, automata) for t in x["text"])):
                n = Counter(k for _, k, _ in spans)
                base = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans if k < len(BASE))
                rows.append((doc, n[0], n[1], n[2], hashlib.sha256(base.encode()).hexdigest(),
                             ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    return map_rows(docs, digests, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, "
                                   "spans string", "doc_id")
