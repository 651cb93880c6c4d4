"""URL filter: a trie over reversed host labels and path segments.

A rule (host, path) fits a url if its host is the rule's or a subdomain of it, and its path
starts with the rule's. The longest rule (host and path together) wins; of equally long ones
the longer host, then block over allow. Where no rule fits, the default verdict holds.

Rules are put into tries of at most ``trie_rules`` rules each; tries are broadcast, a task
holds one at a time, and the best rule of all tries is kept, so memory does not follow the
number of rules.

Nulls and edges: a null url, or one without "://", has an empty host and path, which no rule
fits unless its host is empty. Rules with a null host or verdict are left out, a null path is
empty. Repeated rows are judged each; other columns are not read. In a segment only the lengths at
which rules end are tried, so a url of any length takes time in proportion to it.
"""

from __future__ import annotations

import re
from bisect import insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orderlens.llm.storage import release

ALLOW, BLOCK = "allow", "block"
Rule = tuple[str, str, str]  # verdict, host, path
TRIE_RULES = 200_000

_UPPER_TO_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_URL = re.compile(r"([^/?#]*)([^?#]*)")

# keys of a trie's nodes that no label or segment can be: labels hold no "/", segments neither
_PATHS, _ENDS, _SIZES = "/paths", "/ends", "/sizes"


def split_url(url: str | None) -> tuple[str, str]:
    """Host, with A-Z lower-cased, and path."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    host, path = _URL.match(rest).groups()
    return host.translate(_UPPER_TO_LOWER), path


def add_rule(trie: dict, rule: Rule) -> None:
    verdict, host, path = rule
    node = trie
    for label in reversed(host.split(".")):
        node = node.setdefault(label, {})
    node = node.setdefault(_PATHS, {})
    *segments, last = path.split("/")
    for segment in segments:
        node = node.setdefault(segment, {})
    ends = node.setdefault(_ENDS, {})  # the last piece may be the beginning of a segment
    sizes = node.setdefault(_SIZES, [])
    if -len(last) not in sizes:
        insort(sizes, -len(last))  # the longest first
    if ends.get(last, ("",))[0] != BLOCK:
        ends[last] = verdict, host, path


def best_rule(trie: dict, host: str, path: str) -> Rule | None:
    """The rule that wins, by one walk along the host and one along the path per host node."""
    best = None
    segments = path.split("/")
    node = trie
    for label in reversed(host.split(".")):
        node = node.get(label)
        if node is None:
            break
        paths = node.get(_PATHS)
        for segment in segments:
            if paths is None:
                break
            for less in paths.get(_SIZES, ()):
                if -less <= len(segment) and (end := paths[_ENDS].get(segment[: -less])) is not None:
                    best = winner(best, end)
                    break
            paths = paths.get(segment)
    return best


def winner(a: Rule | None, b: Rule | None) -> Rule | None:
    if a is None or b is None:
        return a or b
    return max(a, b, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[0] == BLOCK))


def tries(rules: Iterable[Rule], most: int) -> Iterator[dict]:
    trie, held = {}, 0
    for verdict, host, path in rules:
        if verdict is None or host is None:
            continue
        if held == most:
            yield trie
            trie, held = {}, 0
        add_rule(trie, (verdict, host.translate(_UPPER_TO_LOWER), path or ""))
        held += 1
    if held:
        yield trie


def rules_of(frame: DataFrame) -> Iterator[Rule]:
    """Rules of a table with the columns verdict, host and path, one partition at a time."""
    return ((r[0], r[1], r[2]) for r in frame.select("verdict", "host", "path").toLocalIterator())


def judged(
    pages: DataFrame,
    rules: Iterable[Rule],
    default: str = ALLOW,
    trie_rules: int = TRIE_RULES,
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """Per page: host, path, the rule that won (host and path, else null) and the verdict."""
    spark: SparkSession = pages.sparkSession
    shared = [spark.sparkContext.broadcast(t) for t in tries(rules, trie_rules)]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            best: list[Rule | None] = [None] * len(parts)
            for trie in shared:
                value = trie.value
                best = [winner(b, best_rule(value, *p)) for b, p in zip(best, parts, strict=True)]
                if len(shared) > 1:
                    release(trie)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([b and b[1] + b[2] for b in best], pa.string()),
                    pa.array([b[0] if b else default for b in best], pa.string()),
                ],
                names=["page_id", "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[page_id].dataType.simpleString()
    return pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")).mapInArrow(
        judge, f"page_id {kind}, host string, path string, rule string, verdict string"
    )
