"""Secret scan with a trigram inverted index.

Each rule's regex gives a Boolean query over trigrams: a conjunction of clauses, each a set of literals of which one must
occur; a literal requires all of its trigrams, in lower case. The index is partitioned by document: every slice of texts
gets its own postings (trigram to the texts that hold it) for the trigrams that the rules ask for, found in one pass over
the bytes. Postings are intersected and united by the queries, and only a rule's candidates are searched with its regex.
A rule without mandatory trigrams scans every text.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import LOWER, bounded_batches, fresh, read_table, text_slices

try:  # the parser of re tells what a regex must contain
    from re import _constants as sre
    from re import _parser as sre_parse
except ImportError:  # pragma: no cover
    import sre_constants as sre
    import sre_parse

Clause = frozenset  # of literals


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of a regex that pass `accept` are spans of this kind; others are dropped."""

    kind: str
    pattern: str
    accept: Callable[[re.Match], bool] = field(default=lambda m: True)

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern)


BASE = (
    Rule("assign", r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[1]) >= 12),
    Rule("access", r"AKIA[A-Z0-9]+", lambda m: m.end() - m.start() >= 18),
    Rule("hex", r"[0-9a-f]+", lambda m: m.end() - m.start() >= 16),
)
#: Forms of public token formats that the base rules don't name.
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("bearer", r"(?ai:bearer)\x20+([A-Za-z0-9+/_.=-]{20,})"),
)
RULES = BASE + MORE


def required(pattern: str, most: int = 64) -> list[Clause]:
    """Clauses that every match satisfies: of each clause's literals (A-Z in lower case, 3 letters at least) one occurs in the match.

    Runs of literals and alternatives between them are multiplied out to strings while these stay few; everything that a
    match can do without, and every class of characters, ends a run.
    """
    clauses: list[Clause] = []
    run: set[str] = {""}

    def close() -> None:
        nonlocal run
        if min(map(len, run)) >= 3:
            clauses.append(Clause(run))
        run = {""}

    def letter(c: int, flags: int) -> set[str] | None:
        """A literal as texts are indexed, that is with A-Z alone lowered; None if case lets it match other bytes as well."""
        wide = flags & re.IGNORECASE and (c > 127 or not flags & re.ASCII and chr(c) in "IKSiks")  # these three have partners beyond ASCII
        return None if wide else {chr(c).lower() if c < 128 else chr(c)}

    def strings(items, flags: int) -> set[str] | None:
        """All strings that the items can match, or None if these aren't few literals."""
        got = {""}
        for op, arg in items:
            if op is sre.LITERAL:
                part = letter(arg, flags)
            elif op is sre.SUBPATTERN:
                part = strings(arg[-1], flags & ~arg[2] | arg[1])
            elif op is sre.BRANCH:
                ways = [strings(x, flags) for x in arg[1]]
                part = None if None in ways else set().union(*ways)
            elif op is sre.MAX_REPEAT and arg[1] <= 2:
                once = strings(arg[2], flags)
                part = None if once is None else {x * n for x in once for n in range(arg[0], arg[1] + 1)}
            elif op is sre.IN and all(o is sre.LITERAL for o, _ in arg):
                ways = [letter(c, flags) for _, c in arg]
                part = None if None in ways else set().union(*ways)
            else:
                return None
            if part is None or len(got) * len(part) > most:
                return None
            got = {a + b for a in got for b in part}
        return got

    def walk(items, flags: int) -> None:
        nonlocal run
        for item in items:
            op, arg = item
            part = strings([item], flags)
            if part is not None and len(run) * len(part) <= most:
                run = {a + b for a in run for b in part}
                continue
            close()
            if part is not None:
                run = part
            elif op is sre.SUBPATTERN:
                walk(arg[-1], flags & ~arg[2] | arg[1])
            elif op is sre.MAX_REPEAT and arg[0] > 0:
                walk(arg[2], flags)
                close()
        return

    parsed = sre_parse.parse(pattern)
    walk(parsed, parsed.state.flags)
    close()
    return clauses


def trigrams(literal: str) -> list[int]:
    b = literal.encode().lower()  # of bytes, A-Z alone
    return [b[i] << 16 | b[i + 1] << 8 | b[i + 2] for i in range(len(b) - 2)]


class Index:
    """Postings of one slice of texts for the trigrams that rules ask for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.queries = [[sorted(c) for c in required(r.pattern)] for r in rules]
        wanted = sorted({t for q in self.queries for c in q for s in c for t in trigrams(s)})
        self.number = {t: i for i, t in enumerate(wanted)}
        self.slot = np.full(1 << 24, -1, np.int16)
        self.slot[wanted] = np.arange(len(wanted))

    def candidates(self, raw: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        """For each rule the texts, by number and in order, that satisfy its query."""
        every = np.arange(len(offsets) - 1)
        low = LOWER[raw].astype(np.int32)
        slot = self.slot[low[:-2] << 16 | low[1:-1] << 8 | low[2:]] if len(raw) > 2 else np.zeros(0, np.int16)
        at = np.flatnonzero(slot >= 0)
        text = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[text + 1]
        pairs = np.unique(slot[at[inside]].astype(np.int64) * len(offsets) + text[inside])
        lists = np.split(pairs % len(offsets), np.searchsorted(pairs // len(offsets), np.arange(1, max(1, len(self.number)))))
        out = []
        for query in self.queries:
            texts = every
            for clause in query:
                any_of = np.zeros(0, np.int64)
                for literal in clause:
                    all_of = every
                    for t in trigrams(literal):
                        all_of = np.intersect1d(all_of, lists[self.number[t]], assume_unique=True)
                    any_of = np.union1d(any_of, all_of)
                texts = np.intersect1d(texts, any_of, assume_unique=True)
            out.append(texts)
        return out


class Scanner:
    """Finds the rules' matches in slices of texts; one for each task."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules, self.index, self.compiled = rules, Index(rules), [r.compiled() for r in rules]

    def find(self, texts: list[str | None], raw: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, int]]]:
        """For each text its (start, rule's number, end), in order."""
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        for k, (rule, regex, which) in enumerate(zip(self.rules, self.compiled, self.index.candidates(raw, offsets))):
            for i in which.tolist():
                found[i] += [(m.start(), k, m.end()) for m in regex.finditer(texts[i] or "") if rule.accept(m)]
        return [sorted(x) for x in found]


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "secrets") -> DataFrame:
    """docs with an array `name` of (kind, start, end) in code points, by start and then in the rules' order; other columns stay.

    A null or empty text has none. Matches of different kinds may overlap. If docs has a column of that name, in any case,
    the new one gets underscores at its end until it's another; it's the last column. Repeated rows are scanned each; no
    rows give none.
    """
    name = fresh(name, docs.columns)
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for rows, raw, offsets in text_slices(batches):
            found = scanner.find(rows.column(rows.schema.get_field_index("text")).to_pylist(), raw, offsets)
            spans = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in x] for x in found]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(spans, kind)], [*rows.schema.names, name])

    spans = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, spans)]))


def spans_text(spans: str, kinds: tuple[str, ...] | None = None):
    """Column of kind:start:end, comma-joined in the array's order; only of the given kinds."""
    kept = F.filter(spans, lambda x: x["kind"].isin(*kinds)) if kinds else F.col(spans)
    return F.array_join(F.transform(kept, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")


def count_of(spans: str, kind: str):
    return F.size(F.filter(spans, lambda x: x["kind"] == kind))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by all rules."""
    found = scan(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = tuple(r.kind for r in BASE)
    counts = [count_of("secrets", k).cast("long").alias(f"n_{k}") for k in kinds]
    return found.select("doc_id", *counts, F.sha2(spans_text("secrets", kinds), 256).alias("base_sha256"), spans_text("secrets").alias("spans"))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret in `text` replaced by the mark, overlapping ones by one; n_chars, where docs has it, follows.

    Texts without secrets, nulls included, stay as they are; so do rows, order and all other columns.
    """

    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for rows, raw, offsets in text_slices(batches):
            at, names, columns = rows.schema.get_field_index("text"), rows.schema.names, list(rows.columns)
            texts = rows.column(at).to_pylist()
            for i, spans in enumerate(scanner.find(texts, raw, offsets)):
                if spans:
                    parts, end = [], 0
                    for s, _, e in spans:
                        if s >= end:
                            parts += [texts[i][end:s], mark]
                        end = max(end, e)
                    texts[i] = "".join([*parts, texts[i][end:]])
            columns[at] = pa.array(texts, rows.schema.field(at).type)
            if "n_chars" in names:
                n = names.index("n_chars")
                columns[n] = pa.array([None if t is None else len(t) for t in texts], rows.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(run, docs.schema)


def digest(text: str | None) -> tuple[int, int, int, str]:
    """Counts by base kind and the digest of base spans, by the regexes alone; for small fixtures."""
    text = text or ""
    spans = sorted((m.start(), k, m.end()) for k, r in enumerate(BASE) for m in r.compiled().finditer(text) if r.accept(m))
    joined = ",".join(f"{BASE[k].kind}:{s}:{e}" for s, k, e in spans)
    return (*(sum(k == j for _, k, _ in spans) for j in range(3)), hashlib.sha256(joined.encode()).hexdigest())
