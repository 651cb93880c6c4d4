"""Toxicity by non-negative positive-unlabelled learning on words.

Confirmed toxic documents are the positives; everything else in the training folds, whatever
its label, is unlabelled text that holds positives at the rate of the class prior. With
the prior pi (the share of toxic among the labelled training rows) and the logistic loss the
risk is  pi R_p(+) + max(0, R_u(-) - pi R_p(-)):  where the bracket falls below zero, a step
undoes the overfitting instead of following it.

The classifier is linear in the words and beginnings of words (4 to 7 characters, marked by
a hyphen) present in a text, fitted with numpy. Positives,
unlabelled texts and words are bounded samples (``POSITIVES``, ``UNLABELLED``, ``WORDS``),
drawn by a hash of doc_id; the prior is taken over all labels. Scores use only the text.

Nulls and edges: a null or empty text gets the score of a text without known words. Several
labels of one doc_id count as toxic if one is; null labels and rows without doc_id are not
learnt from. Without a positive every score is 0. Repeated rows are scored each.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orderlens.llm.text import alnum_words

#: Most documents learnt from, and most words that the classifier knows.
POSITIVES, UNLABELLED, WORDS = 2000, 4000, 1000
#: A word counts if it is in this many, and this share of either sample, and so many
#: standard errors more often in one than in the other.
MIN_DOCUMENTS, MIN_SHARE, MIN_DEVIATION = 8, 0.01, 4.0
BEGINNINGS = range(4, 8)
EPOCHS, BATCHES, RATE, DECAY = 300, 8, 0.02, 1e-4


def features(word: bytes) -> list[str]:
    """The word itself and its beginnings."""
    letters = word.decode("utf-8", "replace")
    return [letters, *(f"{letters[:n]}-" for n in BEGINNINGS if n < len(letters))]


def distinct_words(text: str | None) -> set[bytes]:
    return {w for words in alnum_words((text or "").encode()) for w in words}


@dataclass
class ToxicModel:
    """Weights of words and beginnings; an untrained model scores 0."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -np.inf

    def scores(self, texts: list[str | None]) -> list[float]:
        known: dict[bytes, tuple[str, ...]] = {}  # of the words of these texts
        out = []
        for text in texts:
            words = distinct_words(text)
            for w in words:
                if w not in known:
                    known[w] = tuple(f for f in features(w) if f in self.weights)
            present = {f for w in words for f in known[w]}
            total = self.bias + sum(self.weights[f] for f in sorted(present))
            out.append(float(1 / (1 + np.exp(-total))))
        return out


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, seed: int = 0) -> np.ndarray:
    """Weights and, last, the bias, of the logistic classifier that minimises the nnPU risk (Adam)."""
    rng = np.random.default_rng(seed)
    positive, unlabelled = (np.hstack([x, np.ones((len(x), 1), np.float32)]) for x in (positive, unlabelled))
    w = np.zeros(positive.shape[1], dtype=np.float32)
    w[-1] = np.log(prior / (1 - prior))
    mean, square, t = np.zeros_like(w), np.zeros_like(w), 0
    for _ in range(EPOCHS):
        for p, u in zip(
            np.array_split(rng.permutation(len(positive)), BATCHES),
            np.array_split(rng.permutation(len(unlabelled)), BATCHES),
            strict=True,
        ):
            if not len(p) or not len(u):
                continue
            xp, xu = positive[p], unlabelled[u]
            sp, su = (1 / (1 + np.exp(-np.clip(x @ w, -30, 30))) for x in (xp, xu))
            # logistic loss: -log s for a positive, -log(1 - s) for a negative
            rest = prior * np.log1p(-np.minimum(sp, 1 - 1e-6)).mean() - np.log1p(-np.minimum(su, 1 - 1e-6)).mean()
            as_negative = xu.T @ su / len(u) - prior * (xp.T @ sp) / len(p)
            if rest >= 0:
                step = as_negative - prior * (xp.T @ (1 - sp)) / len(p)
            else:
                step = -as_negative
            step[:-1] += DECAY * w[:-1]
            t += 1
            mean, square = 0.9 * mean + 0.1 * step, 0.999 * square + 0.001 * step**2
            w = (w - RATE * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return w


def _sampled(ids: DataFrame, most: int, seed: int) -> DataFrame:
    return ids.distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def train(docs: DataFrame, labels: DataFrame, in_training: Column) -> ToxicModel:
    """Learns from documents and labels whose doc_id meets ``in_training``.

    A doc_id of several rows counts once, with its greatest text in code-point order, so repeated rows
    change nothing. Its label is 1 where any of its labels is.
    """
    docs = docs.select("doc_id", "text").where(in_training & F.col("doc_id").isNotNull())
    marked = (
        labels.select("doc_id", "toxic").where(in_training).dropna().groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    )
    marked = marked.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    prior = marked.agg(F.avg("toxic")).first()[0]
    if not prior:
        return ToxicModel()
    prior = min(prior, 0.99)
    positives = [r[0] for r in _sampled(marked.where("toxic = 1").select("doc_id"), POSITIVES, 1).collect()]
    unlabelled = [r[0] for r in _sampled(docs.select("doc_id"), UNLABELLED, 2).collect()]
    both = docs.sparkSession.createDataFrame(
        [(i, True) for i in positives] + [(i, False) for i in unlabelled],
        f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, positive boolean",
    )
    sample = docs.join(F.broadcast(both), "doc_id").groupBy("doc_id", "positive").agg(F.max("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter(), Counter()
        for batch in batches:
            for text, positive in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                seen[not positive].update({f for w in distinct_words(text) for f in features(w)})
        words = sorted(seen[0] | seen[1])
        yield pa.RecordBatch.from_arrays(
            [pa.array(words, pa.string())]
            + [pa.array([s[w] for w in words], pa.int64()) for s in seen],
            names=["word", "in_positive", "in_unlabelled"],
        )

    counts = sample.select("text", "positive").mapInArrow(count, "word string, in_positive bigint, in_unlabelled bigint")
    n_p, n_u = len(positives), len(unlabelled)
    counts = counts.groupBy("word").agg(F.sum("in_positive").alias("p"), F.sum("in_unlabelled").alias("u"))
    share = (F.col("p") + F.col("u")) / (n_p + n_u)
    error = F.sqrt(share * (1 - share) * (1 / n_p + 1 / n_u) + 1e-12)
    apart = F.abs(F.col("p") / n_p - F.col("u") / n_u) / error
    often = F.greatest(F.col("p") / n_p, F.col("u") / n_u) >= MIN_SHARE
    chosen = counts.where((F.col("p") + F.col("u") >= MIN_DOCUMENTS) & often & (apart >= MIN_DEVIATION))
    chosen = chosen.orderBy(apart.desc(), "word").limit(WORDS)
    vocabulary = {r["word"]: i for i, r in enumerate(chosen.collect())}

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                sorted({vocabulary[f] for w in distinct_words(t) for f in features(w) if f in vocabulary})
                for t in batch.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(rows, pa.list_(pa.int32())), batch.column(2)], names=["doc_id", "words", "positive"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = sample.select("doc_id", "text", "positive").mapInArrow(present, f"doc_id {kind}, words array<int>, positive boolean")
    rows = sorted(rows.collect(), key=lambda r: (r["positive"], r["doc_id"]))
    matrices = []
    for positive in (True, False):
        own = [r["words"] for r in rows if r["positive"] == positive]
        x = np.zeros((len(own), len(vocabulary)), dtype=np.float32)
        for i, words in enumerate(own):
            x[i, words] = 1
        matrices.append(x)
    w = fit_nnpu(*matrices, prior)
    return ToxicModel({word: float(w[i]) for word, i in vocabulary.items()}, float(w[-1]))


def scored(docs: DataFrame, model: ToxicModel, name: str = "toxic_score") -> DataFrame:
    """All columns, and the score under this name; the model holds ``WORDS`` words at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = model.scores(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(scores, pa.float64())], names=names)

    place = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    names = [*place.values(), "score"]
    renamed = docs.select(F.col("text"), *(F.col(c).alias(n) for c, n in place.items()))
    kinds = ", ".join(f"{n} {docs.schema[c].dataType.simpleString()}" for c, n in place.items())
    return renamed.mapInArrow(run, f"{kinds}, score double").select(
        *(F.col(n).alias(c) for c, n in place.items()), F.col("score").alias(name)
    )
