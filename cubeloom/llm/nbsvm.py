"""Quality scores from Naive Bayes support vectors.

Each n-gram indicator is scaled by the log-count ratio of its feature between
good and bad training rows; a linear model with a hinge loss is fitted on these
by dual coordinate descent; held-out margins turn its margins into probabilities.

The fit sees at most ``most`` labelled rows, those with the smallest hash of
their id, in one task. Scoring reads every text and shuffles nothing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import features as X
from . import words as W

#: Labelled rows that a fit sees at most, and folds of its held-out margins.
SAMPLE_ROWS, FOLDS = 8_000, 3


def labelled(docs: DataFrame, labels: DataFrame, marks: list[str], most: int = SAMPLE_ROWS) -> DataFrame:
    """``doc_id``, the marks and the features of a bounded, repeatable sample of labelled documents.

    Rows without an id or a mark are left out. An id that is labelled or stored
    more than once counts once, with its largest marks and its first text in
    byte order.
    """
    whole = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(m).cast("int").alias(m) for m in marks]).dropna()
    once = whole.groupBy("doc_id").agg(*[F.max(m).alias(m) for m in marks])
    chosen = stored(once.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most), "labelled")
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # at most ``most`` short rows
    found = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", *marks).agg(F.min("text").alias("text"))

    def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        owner, feature = X.indicators(texts)
        at = np.searchsorted(owner, np.arange(len(texts) + 1))
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))
        return pa.RecordBatch.from_arrays([*[rows.column(c) for c in ("doc_id", *marks)], lists], ["doc_id", *marks, "features"])

    columns = ", ".join(f"{m} int" for m in marks)
    return stored(found.mapInArrow(W.by_step(make), f"doc_id bigint, {columns}, features array<int>"), "labelled-features")


def in_one_task(sample: DataFrame, fit: Callable[[dict[str, np.ndarray], list[np.ndarray]], list[np.ndarray]]) -> list[np.ndarray]:
    """Run ``fit`` on a bounded sample on one executor; it returns arrays of numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = pa.Table.from_batches(list(batches), schema).sort_by("doc_id")
        rows = [r.values.to_numpy() for r in got.column("features")] if got.num_rows else []
        marks = {c: got.column(c).to_numpy() for c in got.column_names if c != "features"}
        made = [np.asarray(a, "<f8").tobytes() for a in fit(marks, rows)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(made)), pa.int32()), pa.array(made, pa.binary())], ["k", "numbers"])

    kinds = {"bigint": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32())}
    schema = pa.schema([(c, kinds[t]) for c, t in sample.dtypes])
    got = sample.coalesce(1).mapInArrow(run, "k int, numbers binary").collect()
    return [np.frombuffer(r["numbers"], "<f8") for r in sorted(got, key=lambda r: r["k"])]


def out_of_fold(rows: list[np.ndarray], y: np.ndarray, ids: np.ndarray, extra: np.ndarray | None = None) -> np.ndarray:
    """Margins of each row from a model that hasn't seen it."""
    fold = ids * 2654435761 % 2**32 % FOLDS
    out = np.zeros(len(rows))
    for k in range(FOLDS):
        seen, held = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if len(held):
            out[held] = margins_of(fit_margin([rows[i] for i in seen], y[seen], None if extra is None else extra[seen]), [rows[i] for i in held], None if extra is None else extra[held])
    return out


def fit_margin(rows: list[np.ndarray], y: np.ndarray, extra: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    scale = X.log_count_ratios(rows, y)
    return (*X.hinge(rows, y, scale, extra), scale)


def margins_of(model: tuple[np.ndarray, np.ndarray, np.ndarray], rows: list[np.ndarray], extra: np.ndarray | None = None) -> np.ndarray:
    weights, tail, scale = model
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    return X.margins(owner, np.concatenate(rows) if rows else np.zeros(0, int), len(rows), weights, scale, tail, extra)


def fit(docs: DataFrame, labels: DataFrame, mark: str = "quality", most: int = SAMPLE_ROWS) -> list[np.ndarray]:
    """Weights, scale, intercept, and slope and shift of the probability of ``mark`` = 1."""

    def run(marks: dict[str, np.ndarray], rows: list[np.ndarray]) -> list[np.ndarray]:
        y = np.where(marks[mark] > 0, 1.0, -1.0)
        weights, tail, scale = fit_margin(rows, y)
        return [weights, scale, tail, np.array(X.sigmoid_fit(out_of_fold(rows, y, marks["doc_id"]), y))]

    return in_one_task(labelled(docs, labels, [mark], most), run)


def score(docs: DataFrame, model: list[np.ndarray]) -> DataFrame:
    """``doc_id, score`` for every row of ``docs``; a null text is scored as an empty one."""
    weights, scale, tail, (slope, shift) = model
    table = docs.sparkSession.sparkContext.broadcast((weights.astype(np.float32), scale.astype(np.float32)))

    def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        owner, feature = X.indicators(texts)
        margin = X.margins(owner, feature, len(texts), *table.value, tail)
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(X.probability(margin, slope, shift))], ["doc_id", "score"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(W.by_step(make), "doc_id bigint, score double")
