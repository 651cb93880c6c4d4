"""Secret scan: fixed patterns, and character Markov models for strings without a context.

Only DataFrame functions: patterns give matches and the gaps between them, whose lengths add up
to places in code points. Runs of ``RUN`` or more token characters outside of the fixed
patterns are scored by two first-order Markov models over ASCII characters, one of random
strings and one of ordinary identifiers; the log-likelihood ratio per transition decides.

The models are learnt from labelled samples of the corpus: values that the fixed patterns found
are random strings, words of letters are identifiers, from at most ``SAMPLE`` documents each,
drawn by a hash of doc_id. Transitions never seen fall back to a uniform choice, so without
any sample the ratio is 0 and nothing is added. The model is a table of 128 x 128 numbers.

Nulls and edges: a null or empty text has no spans; an empty table gives no rows. Texts are
scanned whole: work grows with the text and, but for 256 steps a match, with the matches. Repeated
rows, and rows without doc_id, are scanned each. Columns base_spans, spans and run_spans of the
input are replaced by with_spans(). Other columns stay as they are where the whole table is passed on.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed patterns. A run of 12 (32) or more characters is what is left of the runs of any
# length once the short ones are dropped; the value of an assignment is checked afterwards.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_ANY_CASE = "(?i)" + ASSIGN
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
MIN_VALUE = 8
KINDS = ("assign", "access", "hex", "markov")

#: Shortest run that the models judge, and the mean log ratio (in nats) from which it is a secret.
RUN, RATIO = 20, 0.75
RUNS = rf"[A-Za-z0-9+/_=-]{{{RUN},}}"
#: Documents that each model is learnt from at most; weight of the uniform choice.
SAMPLE, PRIOR = 2000, 20.0
#: Matches, or spans, whose places are added up together.
BLOCK = 256
ALPHABET_SIZE, CODES = 66, 128
MARK = "[secret]"

_SPAN = "array<struct<start:int,rank:int,end:int>>"


def _none() -> Column:
    return F.array().cast(_SPAN)


def _with(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value found once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _by_blocks(rows: Column, block: Callable[[Column, Column], Column]) -> Column:
    """block(number, its rows) for every BLOCK rows, in order."""
    numbers = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / BLOCK).cast("int"))
    of = lambda number: F.slice(rows, number * BLOCK + 1, F.lit(BLOCK))
    return F.when(F.size(rows) > 0, F.transform(numbers, lambda number: block(number, of(number)))).otherwise(F.array())


def _before(values: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """What the values before each one come to, from 0 on."""
    add = lambda found, value: F.concat(found, F.array(merge(F.element_at(found, -1), value)))
    return F.aggregate(values, F.array(F.lit(0)), add)


def _places(text: Column, pattern: str, rank: int, value_group: int = 0, keep=None) -> Column:
    """Spans of the leftmost non-overlapping matches whose value passes ``keep``.

    Lengths are added up per block of matches and then over the blocks, so no array grows with
    the number of matches one at a time.
    """
    lit = F.lit(pattern)
    hits = F.regexp_extract_all(text, lit, F.lit(0))
    values = F.regexp_extract_all(text, lit, F.lit(value_group))
    rows = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), hits.alias("hit"), values.alias("value"))
    keep = keep or (lambda value: F.lit(True))
    long = lambda row: F.length(row["gap"]) + F.coalesce(F.length(row["hit"]), F.lit(0))

    def step(state: Column, row: Column) -> Column:
        start = state["at"] + F.length(row["gap"])
        end = state["at"] + long(row)
        span = F.array(F.struct(start.alias("start"), F.lit(rank).alias("rank"), end.alias("end")))
        kept = F.when(row["hit"].isNotNull() & keep(row["value"]), F.concat(state["spans"], span)).otherwise(state["spans"])
        return F.struct(end.alias("at"), kept.cast(_SPAN).alias("spans"))

    def placed(rows: Column) -> Column:
        totals = _by_blocks(rows, lambda _, part: F.aggregate(part, F.lit(0), lambda n, row: n + long(row)))
        begin = lambda at: F.struct(at.alias("at"), _none().alias("spans"))
        spans = lambda starts: _by_blocks(
            rows, lambda number, part: F.aggregate(part, begin(F.get(starts, number)), step, lambda s: s["spans"])
        )
        return _with(_before(totals, lambda a, b: a + b), lambda starts: F.flatten(spans(starts)))

    return F.when(text.rlike(pattern), _with(rows, placed)).otherwise(_none())


def _meets(span: Column, others: Column) -> Column:
    """Whether a span overlaps one of others, which are in order and apart: binary search of the first that ends after its start."""

    def step(state: Column, _: Column) -> Column:
        middle = F.shiftright(state["low"] + state["high"], 1)
        live, past = state["low"] < state["high"], F.get(others, middle)["end"] <= span["start"]
        return F.struct(
            F.when(live & past, middle + 1).otherwise(state["low"]).alias("low"),
            F.when(live & ~past, middle).otherwise(state["high"]).alias("high"),
        )

    turns = F.sequence(F.lit(0), F.length(F.bin(F.size(others))))
    begin = F.struct(F.lit(0).alias("low"), F.size(others).alias("high"))
    return F.coalesce(F.get(others, F.aggregate(turns, begin, step, lambda s: s["low"]))["start"] < span["end"], F.lit(False))


def _apart(runs: Column, rank: int) -> Column:
    """The runs that overlap no base span of a kind; those of one kind are in order and apart."""
    of_kind = F.filter("base_spans", lambda span: span["rank"] == rank)
    return _with(of_kind, lambda kind: F.filter(runs, lambda run: ~_meets(run, kind)))


def with_base_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds base_spans, sorted by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    assign = _places(body, ASSIGN_ANY_CASE, 0, 2, lambda value: F.length(value) >= MIN_VALUE)
    return docs.withColumn("base_spans", F.array_sort(F.concat(assign, _places(body, ACCESS, 1), _places(body, HEX, 2))))


def _transitions(strings: DataFrame) -> DataFrame:
    """Counts of character pairs, as first code * 128 + second code; at most 128 x 128 rows."""
    codes = F.transform(F.split("s", ""), F.ascii)
    pairs = F.zip_with(F.slice(codes, 1, F.size(codes) - 1), F.slice(codes, 2, F.size(codes) - 1), lambda a, b: a * CODES + b)
    return strings.where(F.length("s") > 1).select(F.explode(pairs).alias("pair")).groupBy("pair").count()


def _drawn(docs: DataFrame) -> DataFrame:
    """The rows of a bounded sample of doc_ids; texts stay on the executors."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE)
    return docs.join(F.broadcast(ids), "doc_id", "left_semi")


def log_ratios(docs: DataFrame) -> list[float]:
    """log P(next | this; random) - log P(next | this; identifier), for all pairs of codes."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = _drawn(docs.where(F.col("text").rlike("|".join((ASSIGN_ANY_CASE, ACCESS, HEX)))))
    hits = lambda pattern, group: F.regexp_extract_all("text", F.lit(pattern), F.lit(group))
    assign = F.arrays_zip(hits(ASSIGN_ANY_CASE, 0).alias("hit"), hits(ASSIGN_ANY_CASE, 2).alias("value"))
    kept = F.filter(assign, lambda row: F.length(row["value"]) >= MIN_VALUE)
    ends = F.transform(kept, lambda row: F.regexp_extract(row["hit"], r"[A-Za-z0-9+/_=-]+$", 0))
    values = F.concat(ends, hits(ACCESS, 0), hits(HEX, 0))
    random = found.select(F.explode(values).alias("s"))
    words = _drawn(docs).select(F.explode(F.regexp_extract_all("text", F.lit(r"[A-Za-z_]{4,}"), F.lit(0))).alias("s"))
    models = []
    for strings in (random, words):
        seen = {r["pair"]: r["count"] for r in _transitions(strings).collect()}
        after = [0] * CODES
        for pair, n in seen.items():
            after[pair // CODES] += n
        prior = PRIOR / ALPHABET_SIZE
        models.append([math.log((seen.get(i, 0) + prior) / (after[i // CODES] + PRIOR)) for i in range(CODES * CODES)])
    return [a - b for a, b in zip(*models, strict=True)]


def _mean_ratio(run: Column, ratios: Column) -> Column:
    def step(state: Column, letter: Column) -> Column:
        code = F.ascii(letter)
        more = F.when(state["code"] < 0, F.lit(0.0)).otherwise(F.get(ratios, state["code"] * CODES + code))
        return F.struct(code.alias("code"), (state["sum"] + more).alias("sum"))

    start = F.struct(F.lit(-1).alias("code"), F.lit(0.0).alias("sum"))
    return F.aggregate(F.split(run, ""), start, step, lambda s: s["sum"]) / (F.length(run) - 1)


def with_spans(docs: DataFrame, ratios: list[float], text: str = "text") -> DataFrame:
    """Adds base_spans and spans: (start, rank of the kind, end), sorted by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")  # folded to one literal
    runs = _places(body, RUNS, 3, 0, lambda run: _mean_ratio(run, table) >= RATIO)
    docs = with_base_spans(docs, text).withColumn("run_spans", runs)
    clear = F.col("run_spans")
    for rank in range(3):
        clear = _apart(clear, rank)
    return docs.withColumn("spans", F.array_sort(F.concat("base_spans", clear))).drop("run_spans")


def joined_spans(spans: Column | str) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["rank"]), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, ratios: list[float], text: str = "text", length: str | None = "n_chars") -> DataFrame:
    """The documents with every secret replaced by a mark; all columns kept, in their order."""
    names = docs.columns
    inner = docs.select(F.struct(*(F.col(c) for c in names)).alias("row"), F.col(text).alias("text"))

    def step(state: Column, span: Column) -> Column:
        gap = F.substring(state["body"], state["at"] - state["from"] + 1, F.greatest(span["start"] - state["at"], F.lit(0)))
        out = F.when(span["start"] >= state["at"], F.concat(state["out"], F.array(gap, F.lit(MARK)))).otherwise(state["out"])
        at = F.greatest(state["at"], span["end"])
        return F.struct(at.alias("at"), state["from"].alias("from"), state["body"].alias("body"), out.alias("out"))

    def cut(spans: Column) -> Column:
        """Block by block, from the last end before a block on: places are then near its own part of the text."""
        last = _by_blocks(spans, lambda _, part: F.array_max(F.transform(part, lambda s: s["end"])))

        def block(ends: Column) -> Callable[[Column, Column], Column]:
            def joined(number: Column, part: Column) -> Column:
                at, until = F.get(ends, number), F.get(ends, number + 1)
                body = F.substring(F.col("text"), at + 1, until - at)
                nothing = F.array().cast("array<string>")
                start = F.struct(at.alias("at"), at.alias("from"), body.alias("body"), nothing.alias("out"))
                return F.aggregate(part, start, step, lambda s: F.array_join(s["out"], ""))

            return joined

        rest = lambda ends: F.substring(F.col("text"), F.element_at(ends, -1) + 1, F.length("text"))
        whole = lambda ends: F.concat(F.array_join(_by_blocks(spans, block(ends)), ""), rest(ends))
        return _with(_before(last, F.greatest), whole)

    new = F.when(F.size("spans") > 0, _with(F.col("spans"), cut)).otherwise(F.col("text"))
    found = with_spans(inner, ratios).select("row", "spans", new.alias("new"))
    out = {c: F.col("row")[c] for c in names}
    if length in names:
        kind = docs.schema[length].dataType
        out[length] = F.when(F.size("spans") > 0, F.length("new").cast(kind)).otherwise(F.col("row")[length])
    out[text] = F.col("new")
    return found.select(*(value.alias(c) for c, value in out.items()))
