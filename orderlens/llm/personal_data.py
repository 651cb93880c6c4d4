"""Personal data: fixed kinds, and further spans by weak supervision.

Email, ip, card and phone follow fixed patterns and stay whatever the rest says. Further
candidates (grouped numbers, spelled-out addresses, titled names) and the fixed spans get votes
(for, against, none) from regex, gazetteer and context labelers. Expectation-maximisation
over the counts of all vote patterns in the corpus estimates each labeler's reliability and a
probability per pattern; these are the soft labels of a logistic classifier over features of the
span and its surroundings, which decides on the candidates.

What is gathered is one row per vote pattern and feature set that occurs; both are made of a
few small buckets, so there are at most some thousands, whatever the corpus.

Nulls and edges: a null or empty text has no spans. Without candidates nothing is learnt and
nothing is added. Repeated rows, and rows without doc_id, are searched each. Only the text
and doc_id are read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone", "number", "address", "name")
BASE = KINDS[:4]
Span = tuple[int, int, int]  # rank of the kind, start, end

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# a match can only start where a run of digits does: the lookbehind spares the other starts
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"(?<![0-9.,A-Za-z+-])\(?[0-9]+(?:[\x20().-]{1,2}[0-9]+)*(?![0-9A-Za-z])")
_ADDRESS = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}\x20?(?:\(at\)|\[at\]|\x20at\x20)\x20?[A-Za-z0-9-]{1,63}"
    r"(?:\x20?(?:\(dot\)|\[dot\]|\x20dot\x20|\.)\x20?[A-Za-z0-9-]{2,63})+"
)
_NAME = re.compile(r"\b(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Mlle|Sr|Sra)\.?\x20[A-Z][a-z]{1,30}(?:\x20[A-Z][a-z]{1,30})?")

_CONTEXT = re.compile(
    r"(?:phone|tel|call|mobile|cell|fax|contact|reach|mail|write|ssn|account|passport|born|telefon|anruf|correo|courriel)\W{0,3}[^\n]{0,20}\Z",
    re.IGNORECASE,
)
_AGAINST = re.compile(r"(?:page|version|figure|chapter|year|section|line|id|no|isbn)\.?\W{0,3}\Z", re.IGNORECASE)
TOP_DOMAINS = frozenset("com org net edu gov io de fr es uk info".split())
GIVEN_NAMES = frozenset(
    "james mary john patricia robert jennifer michael linda david maria anna peter paul hans klaus marie jean pierre "
    "carlos jose luis ana sophie julia thomas laura".split()
)
AROUND = 40


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """From each @ outwards: a scan from every letter of a long run would be quadratic."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_LETTERS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            done = found.end()
            yield start, done
        at = text.find("@", max(at + 1, done))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else 2 * n - 9 * (n > 4)
    return total % 10 == 0


def _byte(part: str) -> bool:
    """Whether digits, however many zeros lead them, are at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def _digits(value: str) -> str:
    return "".join(c for c in value if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """The fixed kinds, by kind, then start."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(_byte(p) for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = _digits(m[0])
            if 16 <= len(digits) <= 19 and _luhn(digits):
                out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return out


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Further spans that overlap no fixed one."""
    out = []
    for rank, pattern in ((4, _NUMBER), (5, _ADDRESS), (6, _NAME)):
        if rank == 5 and "at" not in text:
            continue
        for m in pattern.finditer(text):
            if rank != 4 or (m.end() - m.start() >= 7 and 7 <= len(_digits(m[0])) <= 15):
                out.append((rank, *m.span()))
    if base and out:
        taken = sorted((a, b) for _, a, b in base)
        out = [s for s in out if not any(a < s[2] and s[1] < b for a, b in taken)]
    return out


def votes(text: str, span: Span) -> tuple[int, ...]:
    """Of the labelers, in order: shape, gazetteer, context for, context against, repetition."""
    rank, start, end = span
    value = text[start:end]
    before = text[max(0, start - AROUND) : start]
    digits = _digits(value)
    shape = 1 if rank < 4 else 0
    if rank == 4:
        groups = [len(g) for g in re.findall(r"[0-9]+", value)]
        shape = 1 if groups in ([3, 3, 4], [3, 2, 4], [2, 2, 2, 2, 2]) else -1 if len(groups) == 1 else 0
    gazetteer = 0
    if rank in (0, 5):
        gazetteer = 1 if re.split(r"[^a-z]+", value.lower())[-1] in TOP_DOMAINS else -1
    elif rank == 6:
        gazetteer = 1 if GIVEN_NAMES & set(value.lower().split()) else 0
    repeated = -1 if digits and len(set(digits)) <= 2 else 0
    return shape, gazetteer, 1 if _CONTEXT.search(before) else 0, -1 if _AGAINST.search(before) else 0, repeated


def features(text: str, span: Span) -> tuple[int, ...]:
    """Small buckets: kind, digits, groups, separators, what stands before and after."""
    rank, start, end = span
    value = text[start:end]
    groups = len(re.findall(r"[0-9]+", value))
    before, after = text[start - 1 : start], text[end : end + 1]
    return (
        rank,
        min(len(_digits(value)) // 3, 5),
        min(groups, 5),
        2 * ("(" in value) + ("-" in value or "." in value),
        1 if before in (":", "=", "(") else 2 if before == " " else 0,
        1 if after in (".", ",", ";", ")") else 0,
        1 if _CONTEXT.search(text[max(0, start - AROUND) : start]) else 0,
    )


FEATURE_SIZES = (len(KINDS), 6, 6, 4, 3, 2, 2)


def one_hot(rows: np.ndarray) -> np.ndarray:
    return np.hstack([np.ones((len(rows), 1))] + [np.eye(n)[rows[:, i]] for i, n in enumerate(FEATURE_SIZES)])


def vote_posteriors(patterns: np.ndarray, counts: np.ndarray, rounds: int = 100) -> np.ndarray:
    """P(personal | votes) of each pattern, by EM over labelers that err independently in each class."""
    share = 0.5
    # how often a labeler votes -1, 0, 1 in each class: start with labelers better than chance
    table = np.zeros((2, patterns.shape[1], 3))
    table[0], table[1] = (0.4, 0.4, 0.2), (0.2, 0.4, 0.4)
    column = np.arange(patterns.shape[1])
    posterior = np.full(len(patterns), 0.5)
    for _ in range(rounds):
        like = [np.log(table[c][column, patterns + 1]).sum(axis=1) for c in (0, 1)]
        odds = like[1] - like[0] + np.log(share / (1 - share))
        posterior = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        for c, weight in ((0, counts * (1 - posterior)), (1, counts * posterior)):
            for v in (-1, 0, 1):
                # counts of a prior that knows better than chance keep the classes from trading places
                extra = 1 + 2 * (v == 2 * c - 1)
                table[c][:, v + 1] = extra + ((patterns == v) * weight[:, None]).sum(axis=0)
            table[c] /= table[c].sum(axis=1, keepdims=True)
        share = np.clip((counts * posterior).sum() / counts.sum(), 0.01, 0.99)
    return posterior


def fit_logistic(x: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int = 25, ridge: float = 1.0) -> np.ndarray:
    """Soft-label logistic regression by Newton steps."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - target)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(x.shape[1])
        w = w - np.linalg.solve(hessian, gradient)
    return w


@dataclass
class SpanModel:
    """Weights of the one-hot features; None where nothing was learnt."""

    weights: np.ndarray | None = None

    def accepts(self, rows: list[tuple[int, ...]]) -> list[bool]:
        if self.weights is None or not rows:
            return [False] * len(rows)
        return (one_hot(np.array(rows)) @ self.weights >= 0).tolist()


def train(docs: DataFrame, text: str = "text") -> SpanModel:
    """Learns from all candidates and fixed spans of all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for value in batch.column(0).to_pylist():
                base = base_spans(value or "")
                for span in base + candidates(value or "", base):
                    seen[votes(value, span), features(value, span)] += 1
        rows = sorted(seen)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([list(v) for v, _ in rows], pa.list_(pa.int32())),
                pa.array([list(f) for _, f in rows], pa.list_(pa.int32())),
                pa.array([seen[r] for r in rows], pa.int64()),
            ],
            names=["votes", "features", "n"],
        )

    counted = docs.select(F.col(text)).mapInArrow(count, "votes array<int>, features array<int>, n bigint")
    rows = counted.groupBy("votes", "features").agg(F.sum("n").alias("n")).orderBy("votes", "features").collect()
    if not rows:
        return SpanModel()
    pattern = Counter()
    for r in rows:
        pattern[tuple(r["votes"])] += r["n"]
    known = sorted(pattern)
    soft = dict(zip(known, vote_posteriors(np.array(known), np.array([pattern[k] for k in known], float)), strict=True))
    x = one_hot(np.array([r["features"] for r in rows]))
    return SpanModel(fit_logistic(x, np.array([soft[tuple(r["votes"])] for r in rows]), np.array([r["n"] for r in rows], float)))


def found(docs: DataFrame, model: SpanModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: base_spans and all spans as (kind, start, end), by kind as listed, then start."""
    span_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = lambda spans: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]
        for batch in batches:
            fixed, every = [], []
            for value in batch.column(1).to_pylist():
                base = base_spans(value or "")
                more = candidates(value or "", base)
                accepted = model.accepts([features(value, s) for s in more])
                fixed.append(named(base))
                every.append(named(base + [s for s, yes in zip(more, accepted, strict=True) if yes]))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(fixed, span_type), pa.array(every, span_type)], names=["doc_id", "base_spans", "spans"]
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    spans = "array<struct<kind:string,start:bigint,end:bigint>>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, base_spans {spans}, spans {spans}"
    )
