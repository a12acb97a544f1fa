"""Bounded samples of labelled documents, for fitting a model on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pitspark.llm.batches import docs_only


def one_label(labels: DataFrame, name: str) -> DataFrame:
    """(doc_id, label): null ids and labels are left out; of several labels of a document the largest counts."""
    return labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(name).cast("int").alias("label")).dropna().groupBy("doc_id").agg(F.max("label").alias("label"))


def thinned(rows: DataFrame, by: str, most: dict, seed: int) -> DataFrame:
    """About ``most[value]`` rows of each value of ``by``, picked by a hash of doc_id: the same rows on
    every run, and all rows where there are fewer."""
    sizes = {r[by]: r["count"] for r in rows.groupBy(by).count().collect() if r[by] in most}
    point = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1_000_000_007)) / F.lit(1_000_000_007.0)
    take: Column = F.lit(False)
    for value, n in sizes.items():
        take = take | ((F.col(by) == F.lit(value)) & (point < F.lit(min(1.0, most[value] / n))))
    return rows.where(take)


def labelled_texts(docs: DataFrame, labels: DataFrame, name: str, learn: Column, most: dict[int, int], seed: int) -> list[tuple[int, bytes, int]]:
    """(doc_id, text, label) of a bounded sample. Only rows with ``learn`` are read for labels. The list
    of sampled ids has sum(most) rows in the mean, so it is safe to broadcast."""
    picked = thinned(one_label(labels, name).where(learn), "label", most, seed)
    texts = docs_only(docs).join(F.broadcast(picked), "doc_id").where("text is not null")
    rows = texts.select("doc_id", F.col("text").cast("binary").alias("text"), "label").toArrow()
    return sorted(zip(*(rows.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True))


def logistic(x, y, l2: float = 1e-3, steps: int = 3000, rate: float = 0.3):
    """Weights and intercept of a logistic regression, by gradient steps on standardised columns."""
    import numpy as np

    mean, scale = x.mean(0), x.std(0) + 1e-9
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w -= rate * (z.T @ (p - y) / len(y) + l2 * w)
    weights = w[:-1] / scale
    return weights, float(w[-1] - weights @ mean)
