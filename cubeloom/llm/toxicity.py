"""Toxicity categories from a classifier chain.

Categories are predicted one after another by linear models; each model sees the
text's n-gram indicators and the probabilities of the categories before it. In
training these are out-of-fold predictions, so that later models meet them as
unsure as they will be on new texts. The fit sees a bounded sample of labelled
rows in one task; scoring reads every text and shuffles nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import features as X
from . import words as W
from .nbsvm import SAMPLE_ROWS, fit_margin, in_one_task, labelled, out_of_fold

#: Numbers kept for each category: weights, scale, tail, slope and shift.
_PARTS = 4


def fit(docs: DataFrame, labels: DataFrame, chain: list[str], most: int = SAMPLE_ROWS) -> list[list[np.ndarray]]:
    """A model for each category of ``chain``, in this order; ``labels`` has a 0/1 column for each."""

    def run(marks: dict[str, np.ndarray], rows: list[np.ndarray]) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        earlier = np.zeros((len(rows), 0))
        for category in chain:
            y = np.where(marks[category] > 0, 1.0, -1.0)
            weights, tail, scale = fit_margin(rows, y, earlier)
            held_out = out_of_fold(rows, y, marks["doc_id"], earlier)
            slope, shift = X.sigmoid_fit(held_out, y)
            earlier = np.column_stack((earlier, X.probability(held_out, slope, shift)))
            out += [weights, scale, tail, np.array([slope, shift])]
        return out

    flat = in_one_task(labelled(docs, labels, chain, most), run)
    return [flat[k : k + _PARTS] for k in range(0, len(flat), _PARTS)]


def score(docs: DataFrame, models: list[list[np.ndarray]], chain: list[str]) -> DataFrame:
    """``doc_id`` and ``p_<category>`` for every row; a null text is scored as an empty one."""
    light = [[m[0].astype(np.float32), m[1].astype(np.float32), m[2], m[3]] for m in models]
    table = docs.sparkSession.sparkContext.broadcast(light)

    def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        owner, feature = X.indicators(texts)
        earlier = np.zeros((len(texts), 0))
        for weights, scale, tail, (slope, shift) in table.value:
            margin = X.margins(owner, feature, len(texts), weights, scale, tail, earlier)
            earlier = np.column_stack((earlier, X.probability(margin, slope, shift)))
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), *[pa.array(p) for p in earlier.T]], ["doc_id", *[f"p_{c}" for c in chain]])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(W.by_step(make), "doc_id bigint, " + ", ".join(f"p_{c} double" for c in chain))
