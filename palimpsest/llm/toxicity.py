"""Toxicity by weak supervision.

1. A bounded sample of labelled documents (``bound`` rows, by hash order; held-out
   rows never) gives lexicon and pattern voters: words and word beginnings that
   are commoner in toxic documents, each with a least count of occurrences.
2. A generative label model (two classes, a hit rate and a false-alarm rate per
   voter, expectation-maximisation) takes the votes of all voters and of the
   labeller as one more voter. Correlations of voters within a class are
   estimated from the residuals and divide the weight of voters that repeat each
   other.
3. A logistic regression over the term densities is trained on the posterior
   labels. It alone scores documents, each over its whole text.

Scores use the text and nothing else. Defined results: null and empty texts get
the score of a text without any term; repeated rows get equal scores; with no
usable labelled row, or one class only, every score is the labels' mean (0 with
no label). Terms, model and sample are bounded; the corpus streams through one
Arrow pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimpsest.llm.common import stored
from palimpsest.session import share_package

#: Labelled rows that the model is fitted on, at most.
SAMPLE_ROWS = 6000
#: Terms that the sample's statistics keep, at most, and the toxic documents that a term needs.
MOST_TERMS, LEAST_DOCUMENTS = 1500, 5
#: Lengths of the word beginnings that serve as patterns.
BEGINNINGS = (3, 4, 5, 6, 7)
#: Counts of occurrences from which a voter votes toxic.
VOTE_COUNTS = (1, 2, 4)
MOST_VOTERS = 400
THRESHOLD = 0.3

_WORD = re.compile(r"[^\W\d_]+")


def terms_of(text: str | None) -> tuple[Counter, int]:
    """Counts of lower-case words ("=word") and word beginnings ("word~"), and the number of words."""
    words = Counter(_WORD.findall((text or "").lower()))
    out: Counter = Counter()
    for word, n in words.items():
        out["=" + word] = n
        for k in BEGINNINGS:
            if len(word) >= k:
                out[word[:k] + "~"] += n
    return out, words.total()


class _Hits(dict):
    """The known terms of a word, found once a word; emptied when it has ``most`` words."""

    def __init__(self, weights: dict[str, float], most: int = 300_000):
        self.weights, self.most = weights, most
        self.lengths = sorted({len(t) - 1 for t in weights if t.endswith("~")})

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) >= self.most:
            self.clear()
        terms = ("=" + word, *(word[:k] + "~" for k in self.lengths if k <= len(word)))
        self[word] = found = tuple(t for t in terms if t in self.weights)
        return found


@dataclass
class Model:
    """Terms with weights on log(1 + occurrences per thousand words), and a bias."""

    weights: dict[str, float] = field(default_factory=dict)
    bias: float = -20.0

    def scorer(self):
        """A function from text to score, with a cache of its own."""
        hits = _Hits(self.weights)

        def score(text: str | None) -> float:
            words = _WORD.findall((text or "").lower())
            found = Counter(t for terms in filter(None, map(hits.__getitem__, words)) for t in terms)
            total = self.bias + sum(self.weights[t] * density(n, len(words)) for t, n in sorted(found.items()))
            return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))

        return score


def density(n, words):
    return np.log1p(1000 * n / (words + 50)) if isinstance(n, np.ndarray) else math.log1p(1000 * n / (words + 50))


# --- label model -----------------------------------------------------------------


def label_model(votes: np.ndarray, gold: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of class 1, accuracies as (hit rate, false-alarm rate) rows, weights of the voters).

    ``votes``: documents x voters of 0 and 1; ``gold``: the labeller's votes. The
    labeller is one voter among the others, with rates of its own.
    """
    v = np.column_stack([votes, gold]).astype(np.float64)
    post = np.clip(gold.astype(np.float64), 0.05, 0.95)
    weights = np.ones(v.shape[1])
    for step in range(rounds):
        one, zero = post.sum() + 2, (1 - post).sum() + 2
        hit = (post @ v + 1) / one
        false = ((1 - post) @ v + 1) / zero
        if step in (1, 5):
            weights = 1 / (1 + repeats(v, post, hit, false))
            weights[-1] = 1.0
        llr = v * np.log(hit / false) + (1 - v) * np.log((1 - hit) / (1 - false))
        odds = math.log(one / zero) + llr @ weights
        after = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        if np.abs(after - post).max() < 1e-6:
            post = after
            break
        post = after
    return post, np.vstack([hit, false]), weights


def repeats(v: np.ndarray, post: np.ndarray, hit: np.ndarray, false: np.ndarray) -> np.ndarray:
    """For each voter, the sum of its positive correlations with the others within the classes."""
    total = np.zeros(v.shape[1])
    for share, mean in ((post, hit), (1 - post, false)):
        left = (v - mean) * np.sqrt(share)[:, None]
        cov = left.T @ left / max(share.sum(), 1.0)
        scale = np.sqrt(np.clip(np.diag(cov), 1e-9, None))
        corr = np.clip(cov / np.outer(scale, scale), 0, 1)
        np.fill_diagonal(corr, 0)
        total += 0.5 * np.where(corr > 0.1, corr, 0).sum(axis=1)
    return total


def linear_classifier(x: np.ndarray, target: np.ndarray, penalty: float = 0.02, rounds: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression on soft labels by accelerated gradient steps, with a ridge penalty."""
    n, d = x.shape
    w, b = np.zeros(d), math.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))
    step = 1.0 / (0.25 * (np.linalg.norm(x, 2) ** 2) / n + 0.25 + penalty)
    w0, b0 = w.copy(), b
    for k in range(rounds):
        m = k / (k + 3)
        wy, by = w + m * (w - w0), b + m * (b - b0)
        error = 1 / (1 + np.exp(-np.clip(x @ wy + by, -30, 30))) - target
        w0, b0 = w, b
        w, b = wy - step * (x.T @ error / n + penalty * wy), by - step * error.mean()
    return w, float(b)


def train(terms: list[str], docs: list[tuple[dict[int, int], int]], gold: np.ndarray) -> Model:
    """``docs``: for each document its counts by index of term, and its number of words."""
    counts, sizes = np.zeros((len(docs), len(terms)), dtype=np.float32), np.array([d[1] for d in docs], dtype=np.float32)
    for i, (found, _) in enumerate(docs):
        for j, c in found.items():
            counts[i, j] = c
    return trained(terms, counts, sizes, gold)


def trained(terms: list[str], counts: np.ndarray, sizes: np.ndarray, gold: np.ndarray) -> Model:
    """``counts``: documents x terms; ``sizes``: their numbers of words. Next to the counts there is one matrix of their size."""
    n = len(counts)
    y = gold.astype(np.float64)
    if not n or not len(terms) or y.min() == y.max():
        mean = float(y.mean()) if n else 0.0
        return Model({}, math.log((mean + 1e-9) / (1 - mean + 1e-9)))
    # One threshold at a time, as single bytes; only the chosen voters become a matrix of numbers.
    toxic, clean = gold.astype(bool), ~gold.astype(bool)
    gains = []
    for t in VOTE_COUNTS:
        vote = counts >= t
        hits, alarms = vote[toxic].sum(axis=0), vote[clean].sum(axis=0)
        lift = (hits + 0.5) / (toxic.sum() + 1) / ((alarms + 0.5) / (clean.sum() + 1))
        gains.append(np.where(lift > 3, hits * np.log(np.maximum(lift, 1e-9)), 0))
    gain = np.column_stack(gains).ravel()  # by term, then threshold
    chosen = np.argsort(-gain, kind="stable")[:MOST_VOTERS]
    chosen = chosen[gain[chosen] > 0]
    votes = np.column_stack([counts[:, k // len(VOTE_COUNTS)] >= VOTE_COUNTS[k % len(VOTE_COUNTS)] for k in chosen]).astype(np.float64) if len(chosen) else np.zeros((n, 0))
    post, _, _ = label_model(votes, gold)
    del votes
    x = counts.astype(np.float64)
    x *= 1000
    x /= sizes[:, None].astype(np.float64) + 50
    np.log1p(x, out=x)  # density(), in place
    w, b = linear_classifier(x, post)
    return Model({t: float(v) for t, v in zip(terms, w) if v != 0.0}, b)


# --- Spark ------------------------------------------------------------------------


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> DataFrame:
    """(text, toxic) of at most ``bound`` labelled documents outside the held-out part."""
    chosen = (
        labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels["toxic"].cast("int").alias("toxic"))
        .where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(bound)
    )
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    return stored(texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.first("toxic").alias("toxic"), F.max("text").alias("text")), "toxic-sample")


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_ROWS) -> Model:
    """The classifier, from a bounded sample; the driver gets at most ``MOST_TERMS`` terms and their counts in the sample."""
    sample = labelled_sample(docs, labels, bound).select("doc_id", "toxic", "text")

    def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        toxic, clean = Counter(), Counter()
        for batch in batches:
            for y, text in zip(batch.column(1).to_pylist(), batch.column(2)):
                (toxic if y else clean).update(terms_of(text.as_py())[0].keys())
        seen = list(toxic)
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.string()), pa.array([toxic[t] for t in seen], pa.int64()), pa.array([clean[t] for t in seen], pa.int64())], ["term", "toxic", "clean"]
        )
        only = [t for t in clean if t not in toxic]
        yield pa.RecordBatch.from_arrays([pa.array(only, pa.string()), pa.array([0] * len(only), pa.int64()), pa.array([clean[t] for t in only], pa.int64())], ["term", "toxic", "clean"])

    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model({}, 20.0 if n1 else -20.0)
    stats = sample.mapInArrow(term_counts, "term string, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c"))
    rate1, rate0 = (F.col("t") + 0.5) / (n1 + 1), (F.col("c") + 0.5) / (n0 + 1)
    ranked = stats.where((F.col("t") >= LEAST_DOCUMENTS) & (rate1 > 1.5 * rate0)).withColumn("gain", (rate1 - rate0) * F.log(rate1 / rate0))
    terms = [r["term"] for r in ranked.orderBy(F.desc("gain"), "term").limit(MOST_TERMS).collect()]
    index = {t: i for i, t in enumerate(terms)}

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(2):
                found, words = terms_of(text.as_py())
                hits = [(index[t], c) for t, c in found.items() if t in index]
                rows.append(([h[0] for h in hits], [h[1] for h in hits], words))
            at, count, words = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.int32()), pa.array(at, pa.list_(pa.int32())), pa.array(count, pa.list_(pa.int32())), pa.array(words, pa.int64())],
                ["doc_id", "toxic", "at", "count", "words"],
            )

    rows = sample.mapInArrow(vectors, "doc_id long, toxic int, at array<int>, count array<int>, words long").toArrow().sort_by("doc_id").combine_chunks()
    counts = np.zeros((rows.num_rows, len(terms)), dtype=np.float32)
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(rows["at"]).to_numpy())
    counts[row, pc.list_flatten(rows["at"]).to_numpy()] = pc.list_flatten(rows["count"]).to_numpy()
    return trained(terms, counts, rows["words"].to_numpy().astype(np.float32), rows["toxic"].to_numpy())


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` of ``docs``, and score and predicted."""
    share_package(docs.sparkSession)
    chosen = docs.select(*(docs[c] for c in keep), docs["text"].alias("__text"))
    kinds = chosen.schema

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            scores = [of(x.as_py()) for x in batch.column(len(keep))]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(len(keep))), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], [*keep, "score", "predicted"]
            )

    out = T.StructType([*kinds.fields[: len(keep)], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return chosen.mapInArrow(scored, out)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score is under the threshold, with all their columns."""
    share_package(docs.sparkSession)
    at = docs.columns.index("text")

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = model.scorer()
        for batch in batches:
            yield batch.filter(pa.array([of(x.as_py()) < threshold for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)
