"""Quality by weak supervision: rules vote or abstain, and a posterior decides.

Each rule votes good, bad or abstains on counts of a whole text. How often each
rule votes which way on good and on bad documents is estimated by expectation
maximisation, without labels, from all documents that pass the base rules; the
posterior probability of being good then replaces a demand that every rule passes.

Votes form at most 3 ** rules patterns. Spark counts documents by pattern, so
the estimation works on these counts and not on rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended", "n_upper", "n_letters",
    "n_letter_words", "n_shouts",
)
BAD, ABSTAIN, GOOD = 0, 1, 2
#: Rule: numerator, denominator, good from and to, bad below, bad above.
RULES = {
    "length": ("n_words", None, 80, np.inf, 50, np.inf),
    "symbols": ("n_symbols", "n_words", 0, 0.02, -1, 0.1),
    "word_size": ("word_chars", "n_words", 3, 9, 2, 13),
    "repeated_lines": ("n_dup_lines", "n_lines", 0, 0.05, -1, 0.3),
    "repeated_words": ("n_repeat_words", "n_words", 0, 0.1, -1, 0.3),
    "capitals": ("n_upper", "n_letters", 0, 0.15, -1, 0.4),
    "line_ends": ("n_ended", "n_lines", 0.5, 1, 0.1, 2),
    "letter_words": ("n_letter_words", "n_words", 0.9, 1, 0.7, 2),
    "shouts": ("n_shouts", "n_words", 0, 0.01, -1, 0.1),
}
#: Start of the estimation: how a rule votes (bad, abstain, good) on bad and on good documents, and the share of good ones.
START = ((0.3, 0.1, 0.6), (0.01, 0.04, 0.95))
START_GOOD = 0.8
#: A rule is taken to call at most this share of good documents bad. Without such a bound the two classes may
#: settle on any two groups of documents that differ, and not on good and bad.
MOST_FALSE_ALARMS = 0.01
#: Weight of ``START`` against the counted documents, in documents.
PRIOR = 20.0

_byte = np.arange(256)
_SYMBOL = np.isin(_byte, list(b"#*$%&|<>"))
_UPPER, _LOWER = (_byte >= 65) & (_byte <= 90), (_byte >= 97) & (_byte <= 122)
_LETTER = _UPPER | _LOWER | (_byte >= 128)
_FIRST = (_byte & 0xC0) != 0x80
_END = np.isin(_byte, list(b".!?"))


def counts(texts: list[bytes | None]) -> dict[str, np.ndarray]:
    """The counts of every text; a null text has none of anything.

    A symbol is one of ``#*$%&|<>``; lines are split at line feeds and counted if
    they hold a word; ``n_repeat_words`` are words inside a run of three that the
    text has at least twice; a shout is ``!!``. Letters are A-Z, a-z and anything
    beyond ASCII.
    """
    w = W.split(texts)
    data = np.frombuffer(w.data, np.uint8)

    def per(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[at])

    def between(mask: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(mask)))
        return total[end] - total[start]

    n = len(texts)
    text = w.text
    space, letter = W.SPACE[data], _LETTER[data]
    out = {
        "n_words": w.counts,
        "word_chars": per(_FIRST[data] & ~space, w.at),
        "n_symbols": per(_SYMBOL[data], w.at),
        "n_upper": per(_UPPER[data], w.at),
        "n_letters": per(letter, w.at),
        "n_shouts": per((data == 33) & np.append(data[1:] == 33, False), w.at),
        "n_letter_words": per(between(letter, w.start, w.end) > 0, w.first),
    }
    stop = np.flatnonzero(data == 10)
    begin = np.concatenate(([0], stop[:-1] + 1))
    last = np.searchsorted(w.start, stop) - 1
    has = (last >= 0) & (w.start[np.maximum(last, 0)] >= begin) if len(w.start) else np.zeros(len(stop), bool)
    begin, stop, last = begin[has], stop[has], last[has]
    of = text[last]
    hashed = W.combine(of.astype(np.uint64), W.hashes(W.Words(w.data, begin, stop, w.first, w.at)))
    _, where = np.unique(hashed, return_index=True)
    again = np.ones(len(of), bool)
    again[where] = False
    out["n_lines"] = np.bincount(of, minlength=n)
    out["n_dup_lines"] = np.bincount(of[again], minlength=n)
    out["n_ended"] = np.bincount(of[_END[data[w.end[last] - 1]]], minlength=n)
    three, ok = W.grams(W.hashes(w), 3), W.inside(w, 3)
    at = np.flatnonzero(ok)
    _, back, many = np.unique(W.combine(text[at].astype(np.uint64), three[at]), return_inverse=True, return_counts=True)
    covered = np.zeros(len(text), bool)
    for k in range(3):
        covered[at[many[back] > 1] + k] = True
    out["n_repeat_words"] = np.bincount(text[covered], minlength=n)
    return out


def votes(found: dict[str, np.ndarray]) -> np.ndarray:
    """A row of votes for each document; a rule abstains where its denominator is zero."""
    out = []
    for top, bottom, low, high, below, above in RULES.values():
        share = found[top].astype(float)
        if bottom:
            share = np.divide(share, found[bottom], out=np.full(len(share), np.nan), where=found[bottom] > 0)
        vote = np.full(len(share), ABSTAIN)
        vote[(share >= low) & (share <= high)] = GOOD
        vote[(share < below) | (share > above)] = BAD
        out.append(vote)
    return np.stack(out, axis=1)


def pattern(voted: np.ndarray) -> np.ndarray:
    return voted @ (3 ** np.arange(voted.shape[1]))


def estimate(patterns: np.ndarray, weights: np.ndarray, rules: int, rounds: int = 200) -> np.ndarray:
    """Posterior of being good for each of the 3 ** rules patterns, by expectation maximisation."""
    every = np.stack([(np.arange(3**rules) // 3**j) % 3 for j in range(rules)], axis=1)
    seen = every[patterns]
    rate = np.array([[START[y]] * rules for y in (0, 1)])
    good = START_GOOD

    def posterior(voted: np.ndarray) -> np.ndarray:
        odds = sum(np.log(rate[1, j, voted[:, j]]) - np.log(rate[0, j, voted[:, j]]) for j in range(rules))
        return 1 / (1 + np.exp(-np.clip(odds + np.log(good / (1 - good)), -500, 500)))

    for _ in range(rounds if len(patterns) else 0):
        p = posterior(seen)
        before = rate.copy()
        for y, share in ((0, (1 - p) * weights), (1, p * weights)):
            for j in range(rules):
                rate[y, j] = np.bincount(seen[:, j], share, 3) + PRIOR * np.array(START[y])
                rate[y, j] /= rate[y, j].sum()
        over = rate[1, :, BAD] - np.minimum(rate[1, :, BAD], MOST_FALSE_ALARMS)
        rate[1, :, BAD] -= over
        rate[1, :, ABSTAIN] += over
        good = (np.sum(p * weights) + PRIOR * START_GOOD) / (weights.sum() + PRIOR)
        if np.abs(rate - before).max() < 1e-7:
            break
    return posterior(every)


def measure(docs: DataFrame) -> DataFrame:
    """``doc_id``, the counts and the vote pattern of every row of ``docs``."""

    def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
        found = counts(texts)
        cells = [pa.array(found[c].astype(np.int64)) for c in COUNTS]
        return pa.RecordBatch.from_arrays(
            [rows.column("doc_id"), *cells, pa.array(pattern(votes(found)), pa.int32())], ["doc_id", *COUNTS, "pattern"]
        )

    columns = ", ".join(f"{c} bigint" for c in COUNTS)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(W.by_step(make), f"doc_id bigint, {columns}, pattern int")


def fit(measured: DataFrame) -> np.ndarray:
    """The posterior of each pattern, from the patterns of all documents that the base rules leave undecided."""
    rows = measured.where(~base_failed()).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    return estimate(np.array([r["pattern"] for r in rows], int), np.array([r["n"] for r in rows], float), len(RULES))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def judge(measured: DataFrame, posterior: np.ndarray, least: float = 0.5) -> DataFrame:
    """``measured`` plus ``base_failed``, ``posterior`` and ``kept``."""

    @F.pandas_udf("double")
    def of(pattern: pd.Series) -> pd.Series:
        return pd.Series(posterior[pattern.to_numpy()])

    told = measured.withColumns({"base_failed": base_failed(), "posterior": of("pattern")})
    return told.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))


def keep(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that stay, unchanged and with all their columns.

    Texts are measured twice, once to estimate and once to decide, so nothing is
    shuffled. Null and short texts fail the base rules and go; repeated rows
    share a fate; an empty table stays empty.
    """
    posterior = fit(measure(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = W.binary(batch.column("text"))
            for part in W.steps(texts):
                found = counts(texts[part])
                n, again = found["n_words"], found["n_repeat_words"]
                ok = (n >= 50) & (100 * again <= 50 * n) & (posterior[pattern(votes(found))] >= least)
                yield batch.slice(part.start, part.stop - part.start).filter(pa.array(ok))

    return docs.mapInArrow(run, docs.schema)
