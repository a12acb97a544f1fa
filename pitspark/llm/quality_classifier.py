"""Quality classification from positive and unlabelled texts.

Trusted positives are documents labelled good; the other side is unlabelled web text, a mixture of good and
bad. The share of good texts in the mixture (the class prior) is estimated first: a plain classifier of
positives against unlabelled text is fitted on one half, and on the other half the smallest ratio of the
unlabelled texts' share above a threshold to the positives' share above it is taken, since no threshold can
have a ratio below the prior. Then an additive model over binned text figures is trained by
the non-negative unbiased risk: the positives' loss, weighted with the prior, plus the unlabelled texts' loss
as negatives less the part that the positives among them explain; where that difference falls below zero on
a batch, the step goes the other way. The logistic loss makes the output a probability.

The model is fitted on samples of at most about ``POSITIVES`` and ``UNLABELLED`` documents. A null or empty
text has all figures zero and is scored like any other. Rows are independent; without positives every score
is 0.5, and an empty table gives an empty one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.batches import SPACE, docs_only, pieces
from pitspark.llm.sampling import one_label, thinned

POSITIVES = 6_000
UNLABELLED = 12_000
BINS = 24
_PUNCTUATION = bytes(b for b in range(33, 127) if not chr(b).isalnum())
_LETTERS_ETC = bytes(b for b in range(256) if b not in b"0123456789")
_UPPER = bytes(range(65, 91))
FIGURES = 14


def figures(text: bytes | None) -> list[float]:
    """What the model sees of a text: shares per word, character or line, none of them an id."""
    raw = text or b""
    words = raw.split()
    n, size = max(len(words), 1), max(len(raw), 1)
    lines = [x for x in raw.split(b"\n") if x.strip(SPACE)]
    threes = list(zip(words, words[1:], words[2:], strict=False))
    marks = size - len(raw.translate(None, _PUNCTUATION)) if raw else 0
    symbols = len(raw) - len(raw.translate(None, b"#*$%&|<>"))
    tails = len({w[-3:] for w in words})
    return [
        float(np.log1p(len(words))), marks / n, symbols / n, raw.count(b"!") / n, raw.count(b".") / n, raw.count(b",") / n,
        (len(raw) - len(raw.translate(None, _UPPER))) / size, len(raw.translate(None, _LETTERS_ETC)) / size,
        size / n, n / max(len(lines), 1), 1 - len(set(lines)) / max(len(lines), 1), 1 - len(set(threes)) / max(len(threes), 1),
        sum(a == b for a, b in zip(words, words[1:], strict=False)) / n, tails / n,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    weights: np.ndarray
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.weights[binned(x, self.edges)].sum(1) + self.weights[-1], -30, 30)))


def binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    """Index of each figure's bin among all figures' bins."""
    return np.column_stack([k * (BINS + 1) + np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(edges)])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """``positive``, ``unlabelled``: scores, higher for more like a positive, of texts that the scoring
    model has not seen. For every threshold, the share of unlabelled texts above it over the share of
    positives above it is at least the prior in the mean; the smallest such ratio is the estimate. Only
    thresholds that most positives pass count, as further out chance rules."""
    cuts = np.unique(np.quantile(positive, np.linspace(0.003, 0.25, 80)))
    ratios = [(unlabelled >= c).mean() / (positive >= c).mean() for c in cuts]
    return float(np.clip(min(ratios, default=1.0), 0.05, 0.99))


def _descend(p_bins: np.ndarray, u_bins: np.ndarray, n_weights: int, prior: float | None, seed: int, steps: int, batch: int, rate: float, l2: float) -> np.ndarray:
    """Adam steps on the non-negative unbiased risk; without a prior, on the risk of telling positives
    from unlabelled texts."""
    weights, first, second = np.zeros(n_weights), np.zeros(n_weights), np.zeros(n_weights)
    rng = np.random.default_rng(seed)

    def output(bins: np.ndarray) -> np.ndarray:
        return np.clip(weights[bins].sum(1) + weights[-1], -30, 30)

    def gradient(bins: np.ndarray, slope: np.ndarray) -> np.ndarray:
        g = np.bincount(bins.ravel(), np.repeat(slope, bins.shape[1]), n_weights) / len(bins)
        g[-1] = slope.mean()
        return g

    for step in range(1, steps + 1):
        p, u = p_bins[rng.integers(len(p_bins), size=min(batch, len(p_bins)))], u_bins[rng.integers(len(u_bins), size=min(batch, len(u_bins)))]
        gp, gu = output(p), output(u)
        # loss(+) = log(1 + e^-g), loss(-) = log(1 + e^g); slopes in g:
        up_p, down_p, down_u = -1 / (1 + np.exp(gp)), 1 / (1 + np.exp(-gp)), 1 / (1 + np.exp(-gu))
        if prior is None:
            g = gradient(p, up_p) + gradient(u, down_u)
        else:
            negative = gradient(u, down_u) - prior * gradient(p, down_p)
            below_zero = np.logaddexp(0, gu).mean() < prior * np.logaddexp(0, gp).mean()
            g = -negative if below_zero else prior * gradient(p, up_p) + negative
        g = g + l2 * weights / p_bins.shape[1]
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        weights = weights - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    return weights


def train(positive: np.ndarray, unlabelled: np.ndarray, seed: int = 9, steps: int = 3000, batch: int = 1024, rate: float = 0.03, l2: float = 3e-4) -> Model:
    both = np.concatenate((positive, unlabelled))
    # Edges by rank, and some by value, so that rare extremes have bins of their own.
    edges = [np.sort(np.concatenate((np.quantile(both[:, k], np.linspace(0.04, 0.96, BINS - 8)), np.quantile(both[:, k], [0.005, 0.01, 0.02, 0.98, 0.99]), np.linspace(both[:, k].min(), both[:, k].max(), 5)[1:-1]))) for k in range(both.shape[1])]
    n_weights = len(edges) * (BINS + 1) + 1
    p_bins, u_bins = binned(positive, edges), binned(unlabelled, edges)
    folds = []
    for part in (0, 1):
        plain = _descend(p_bins[part::2], u_bins[part::2], n_weights, None, seed, steps // 2, batch, rate, l2)
        folds.append(estimate_prior(*(plain[b[1 - part :: 2]].sum(1) for b in (p_bins, u_bins))))
    prior = sum(folds) / 2
    return Model(edges, _descend(p_bins, u_bins, n_weights, prior, seed, steps, batch, rate, l2), prior)


MEASURED = pa.schema([("doc_id", pa.int64()), ("x", pa.list_(pa.float64()))])
SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def measure(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the figures of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([figures(t) for t in texts], pa.list_(pa.float64()))], schema=MEASURED)

    return docs_only(docs).mapInArrow(run, "doc_id long, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, learn: Column, label: str = "quality", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model | None:
    """Positives: labelled 1 in rows with ``learn``. Unlabelled: any rows with ``learn``, labels unread."""
    good = thinned(one_label(labels, label).where(learn).where("label = 1"), "label", {1: positives}, seed=9)
    texts = docs_only(docs)
    web = thinned(texts.where(learn).withColumn("label", F.lit(0)), "label", {0: unlabelled}, seed=99).drop("label")
    # The list of sampled ids has ``positives`` rows in the mean, so it is safe to broadcast.
    rows = [measure(part).toArrow() for part in (texts.join(F.broadcast(good.select("doc_id")), "doc_id"), web)]
    # In an order of their own, as rows may come in any; rows without an id come last.
    x, u = (sorted(zip(r.column("doc_id").to_pylist(), r.column("x").to_pylist(), strict=True), key=lambda r: (r[0] is None, r[0] or 0, r[1])) for r in rows)
    if not x or not u:
        return None
    return train(np.array([r[1] for r in x], float), np.array([r[1] for r in u], float))


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score): probability that the text is good."""
    if model is None:
        return docs_only(docs).select("doc_id", F.lit(0.5).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            x = np.array([figures(t) for t in texts])
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(shared.value.score(x))], schema=SCORED)

    return docs_only(docs).mapInArrow(run, "doc_id long, score double")


def keep(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text scores ``least`` or more."""
    if model is None:
        return docs if least <= 0.5 else docs.limit(0)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in pieces(batches):
            yield part.filter(pa.array(shared.value.score(np.array([figures(t) for t in texts])) >= least))

    return docs.mapInArrow(run, docs.schema)
