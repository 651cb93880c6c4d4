"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items go into one automaton per block of items; training words are
streamed through it, which gives at each word the longest run of item words that ends
there. Runs of at least ``window`` words, and whole items shorter than that, are hits.

Items are cut into blocks of at most ``block_words`` words (a longer item is cut into
parts that overlap by ``window - 1`` words, so no window is lost). The driver holds one
block at a time, and a task loads one automaton at a time, so memory does not follow the
number of items; the same path runs for one block and for many.

Nulls and edges: a null or empty text has no words and no hits. An item without words has
no windows. An item without item_id marks words but is not listed. Items that repeat under
one item_id count once. With no items, or no documents, nothing is hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from orderlens.llm.storage import release
from orderlens.llm.text import alnum_words, word_spans

WINDOW = 10
#: Words of items in one automaton; about 1 kB of memory each at most.
BLOCK_WORDS = 100_000
#: A hit run of this many words is cut out; below it, and below the coverage limit, the text stays.
MAX_SPAN_WORDS = 10
#: Share of a text's words in hits beyond which nothing of the document is kept.
MAX_COVERAGE = 0.5


class ItemAutomaton:
    """Suffix automaton over lists of words, each list added from the start state."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.parts: list[tuple[str | None, list[bytes]]] = []
        self.items_of: dict[int, set[str]] = {}
        self.short: dict[int, int] = {}

    def add(self, item_id: str | None, words: list[bytes]) -> None:
        self.parts.append((item_id, words))
        last = 0
        for word in words:
            last = self._extend(last, word)

    def _split(self, state: int, target: int, word: bytes) -> int:
        """A copy of target for the strings that also end where state + word ends."""
        clone = len(self.next)
        self.next.append(dict(self.next[target]))
        self.link.append(self.link[target])
        self.length.append(self.length[state] + 1)
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._split(last, known, word)
        new = len(self.next)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            target = self.next[state][word]
            if self.length[target] != self.length[state] + 1:
                target = self._split(state, target, word)
            self.link[new] = target
        return new

    def finish(self) -> ItemAutomaton:
        """Note which states stand for a whole window or a whole short item, and whose."""
        by_length = sorted(range(len(self.next)), key=self.length.__getitem__)
        # the state on the way of suffix links (itself included) that stands for the last window's words
        self.windowed = [0] * len(self.next)
        for state in by_length[1:]:
            above = self.link[state]
            self.windowed[state] = self.windowed[above] if self.length[above] >= self.window else state
        full: dict[int, set[str]] = {}
        for item_id, words in self.parts:
            state, own = 0, set() if item_id is None else {item_id}
            for i, word in enumerate(words, 1):
                state = self.next[state][word]
                if i >= self.window:
                    full.setdefault(self.windowed[state], set()).update(own)
            if 0 < len(words) < self.window:
                full.setdefault(state, set()).update(own)
                self.short[state] = len(words)
        self.parts = []
        self.items_of = full
        # the nearest state on the way of suffix links (itself included) that is a short item
        self.near = [-1] * len(self.next)
        for state in by_length:
            self.near[state] = state if state in self.short else self.near[self.link[state]] if state else -1
        return self

    def state(self) -> dict:
        """Plain data, fit for a broadcast; restore with of()."""
        return vars(self)

    @classmethod
    def of(cls, state: dict) -> ItemAutomaton:
        automaton = cls.__new__(cls)
        vars(automaton).update(state)
        return automaton

    def hits(self, pieces: Iterator[list[bytes]]) -> tuple[int, list[tuple[int, int]], set[str]]:
        """Words seen, disjoint runs (first word, end) that are hit, and the items whose windows occur."""
        following, link, length, window = self.next, self.link, self.length, self.window
        near, any_short, windowed = self.near, bool(self.short), self.windowed
        state = matched = at = 0
        runs: list[tuple[int, int]] = []
        found: set[int] = set()
        for words in pieces:
            for word in words:
                at += 1
                to = following[state].get(word)
                if to is None:
                    if not state:
                        continue
                    while to is None and state:
                        state = link[state]
                        to = following[state].get(word)
                    if to is None:
                        state = matched = 0
                        continue
                    matched = length[state]
                state = to
                matched += 1
                if matched >= window:
                    found.add(windowed[state])
                    self._mark(runs, at - window, at)
                if any_short:
                    ending = near[state]
                    if ending == state and self.short[state] > matched:
                        ending = near[link[state]]
                    if ending > 0:
                        self._mark(runs, at - self.short[ending], at)
                        while ending > 0:
                            found.add(ending)
                            ending = near[link[ending]]
        return at, runs, set().union(*(self.items_of[x] for x in found)) if found else set()

    @staticmethod
    def _mark(runs: list[tuple[int, int]], first: int, end: int) -> None:
        while runs and runs[-1][1] >= first:
            first = min(first, runs.pop()[0])
        runs.append((first, end))


def item_blocks(items: DataFrame, id_column: str, text_column: str, window: int, block_words: int) -> Iterator[ItemAutomaton]:
    """Automata of bounded size; the rows stream through the driver, one partition at a time."""
    rows = items.select(F.col(id_column).cast("string"), F.col(text_column))
    block, held = ItemAutomaton(window), 0
    for item_id, text in rows.toLocalIterator():
        words = [w for part in alnum_words((text or "").encode()) for w in part]
        step = max(1, block_words - window + 1)
        for i in range(0, max(1, len(words) - window + 1), step):
            part = words[i : i + step + window - 1]
            if held and held + len(part) > block_words:
                yield block.finish()
                block, held = ItemAutomaton(window), 0
            if part:
                block.add(item_id, part)
                held += len(part)
    if held:
        yield block.finish()


def _merged(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for first, end in sorted(runs):
        if out and first <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((first, end))
    return out


def _scan(texts: list[str | None], blocks: list) -> list[tuple[int, list[tuple[int, int]], set[str]]]:
    """Per text: words, hit runs, items; one automaton in memory at a time."""
    out: list = [None] * len(texts)
    if not blocks:
        return [(sum(map(len, alnum_words((t or "").encode()))), [], set()) for t in texts]
    for block in blocks:
        automaton = ItemAutomaton.of(block.value)
        for i, text in enumerate(texts):
            n, runs, items = automaton.hits(alnum_words((text or "").encode()))
            if out[i]:
                runs, items = _merged(out[i][1] + runs), out[i][2] | items
            out[i] = n, runs, items
        if len(blocks) > 1:
            release(block)
    return out


def _broadcasts(docs: DataFrame, items: DataFrame, id_column: str, text_column: str, window: int, block_words: int) -> list:
    context = docs.sparkSession.sparkContext
    return [context.broadcast(b.state()) for b in item_blocks(items, id_column, text_column, window, block_words)]


def match_items(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    block_words: int = BLOCK_WORDS,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Per document: n_words, hit runs as (first word, end) and the items found, sorted as strings."""
    blocks = _broadcasts(docs, items, item_id, item_text, window, block_words)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _scan(batch.column(1).to_pylist(), blocks)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([n for n, _, _ in found], pa.int64()),
                    pa.array(
                        [[{"first": a, "end": b} for a, b in runs] for _, runs, _ in found],
                        pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])),
                    ),
                    pa.array([sorted(x) for _, _, x in found], pa.list_(pa.string())),
                ],
                names=["doc_id", "n_words", "runs", "items"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        scan, f"doc_id {kind}, n_words bigint, runs array<struct<first:bigint,end:bigint>>, items array<string>"
    )


def contamination(matches: DataFrame) -> DataFrame:
    """Counts and the digest of the items found, from match_items()."""
    return matches.select(
        "doc_id",
        "n_words",
        F.aggregate("runs", F.lit(0).cast("bigint"), lambda a, r: a + r["end"] - r["first"]).alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def cut_runs(text: str, runs: list[tuple[int, int]]) -> str:
    """The text without the runs of words, each replaced by a line end."""
    data = text.encode()
    edges = {x for a, b in runs for x in (a, b - 1)}
    place = {i: m.span() for i, m in enumerate(word_spans(data)) if i in edges}
    out, at = [], 0
    for first, end in runs:
        out += [data[at : place[first][0]], b"\n"]
        at = place[end - 1][1]
    return b"".join([*out, data[at:]]).decode()


def decontaminated(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    max_span: int = MAX_SPAN_WORDS,
    max_coverage: float = MAX_COVERAGE,
    block_words: int = BLOCK_WORDS,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    length: str | None = "n_chars",
) -> DataFrame:
    """The documents without benchmark passages; all columns kept, in their order.

    Runs of at least ``max_span`` hit words, and whole items shorter than a window, are cut
    out; a document of whose words more than ``max_coverage`` are hit goes. Cutting is
    repeated until nothing is hit, as a cut may bring two halves together. Texts without a
    hit are passed on unchanged, null included. ``length``, where present, is set anew.
    """
    blocks = _broadcasts(docs, items, item_id, item_text, window, block_words)
    names = docs.columns
    place, sized = names.index(text), names.index(length) if length in names else None

    def cleaned(texts: list[str | None], found: list[tuple]) -> dict[int, str | None]:
        """The new texts of the documents that are hit, None for those that go; a round rescans all cut texts together."""
        new: dict[int, str | None] = {}
        open_ = {}
        for i, (n, runs, _) in enumerate(found):
            if runs and sum(b - a for a, b in runs) > max_coverage * n:
                new[i] = None
            elif runs:
                open_[i] = (texts[i], runs)
        while open_:
            cut = {}
            for i, (value, runs) in open_.items():
                new[i] = value
                if runs := [(a, b) for a, b in runs if b - a >= max_span or b - a < window]:
                    cut[i] = cut_runs(value, runs)
            again = _scan(list(cut.values()), blocks) if cut else []
            open_ = {i: (value, runs) for (i, value), (_, runs, _) in zip(cut.items(), again, strict=True)}
        return new

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            new = cleaned(texts, _scan(texts, blocks))
            if new:
                keep = [i not in new or new[i] is not None for i in range(len(texts))]
                columns = batch.columns
                columns[place] = pa.array([new.get(i, t) for i, t in enumerate(texts)], batch.schema.field(place).type)
                if sized is not None:
                    old = batch.column(sized)
                    sizes = [len(new[i]) if new.get(i) is not None else x for i, x in enumerate(old.to_pylist())]
                    columns[sized] = pa.array(sizes, old.type)
                batch = pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(pa.array(keep))
            yield batch

    return docs.mapInArrow(rewrite, docs.schema)

