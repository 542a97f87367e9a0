"""Remove passages that a document with a smaller id already has.

In place of a greedy Relative Lempel-Ziv parse: the documents with smaller ids
are the reference, kept as indexed blocks, and blocks and windows of a document
are looked up there by hash. No longest match is extended; a "factor" below is
a run of words covered by blocks that were found. ``span`` words or more that
the reference has are a duplicate.

* Blocks are cut by content. Every run of ``span`` words (a window) has an
  anchor, its lowest k-gram; the words under neighbouring windows of one anchor
  form a block. Equal passages are therefore cut into equal blocks wherever they
  stand, and about a fifth as many blocks as words are sent over the network.
* The index groups blocks by anchor. A block that an earlier document has
  continues a factor. Most factors are found here.
* At the ends of factors a block differs from the reference's blocks of the same
  anchor, yet windows in it may be shared. There, and only there, the windows
  themselves are looked up, among the first documents of each such block: a later
  document with the same block is settled by the block. So the result is exact:
  a window is covered if and only if it starts in an earlier document.

Copies inside one batch are settled there, so one block sends at most one row
from each batch, however many documents share it. What comes back to a document
is at most its own blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..session import scratch_path, stored
from . import words as W

#: Words in a window, and in the k-grams that anchor it.
SPAN, GRAM = 13, 4
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


class Blocks:
    """Blocks of all texts of a step: windows ``first..last``, anchor and content as hashes."""

    def __init__(self, texts: list[bytes | None], span: int = SPAN):
        self.words = w = W.split(texts)
        hashed = W.hashes(w)
        n, text = len(hashed), w.text
        gram = min(GRAM, span)
        grams = W.grams(hashed, gram)
        m, wide = max(0, n - span + 1), span - gram + 1
        # long k-grams first: they are rarer than those of short, common words
        size = w.end - w.start
        total = np.concatenate(([0], np.cumsum(size)))
        long = total[gram : gram + len(grams)] - total[: len(grams)]
        order = (grams >> np.uint64(2)) | (np.where(long >= 5 * gram, 0, np.where(long >= 3 * gram, 1, 2)).astype(np.uint64) << np.uint64(62))
        low, at = order[:m].copy(), np.zeros(m, np.int64)
        for k in range(1, wide):
            less = order[k : k + m] < low
            low[less] = order[k : k + m][less]
            at[less] = k
        at += np.arange(m)
        self.valid = text[:m] == text[span - 1 : span - 1 + m]
        self.windows = np.flatnonzero(self.valid)
        with np.errstate(over="ignore"):
            power = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE))), dtype=np.uint64)
            self._back = np.cumprod(np.concatenate(([np.uint64(1)], np.full(n, _BASE_INVERSE))), dtype=np.uint64)
            self._sums = np.concatenate(([np.uint64(0)], np.cumsum(hashed * power[:n], dtype=np.uint64)))
        self.span = span
        own_at, own_text = at[self.windows], text[self.windows]
        new = np.ones(len(self.windows), bool)
        new[1:] = (np.diff(own_at) != 0) | (np.diff(own_text) != 0)
        begin = np.flatnonzero(new)
        end = np.append(begin[1:], len(self.windows))
        self.first, self.last = self.windows[begin], self.windows[end - 1] if len(end) and len(self.windows) else self.windows[:0]
        self.text = own_text[begin]
        self.anchor = grams[own_at[begin]]
        self.content = self.hash(self.first, self.last + span)

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words ``start:end`` of each pair."""
        with np.errstate(over="ignore"):
            return W.combine((end - start).astype(np.uint64), (self._sums[end] - self._sums[start]) * self._back[start])

    def window_hashes(self, at: np.ndarray) -> np.ndarray:
        return self.hash(at, at + self.span)

    def cover(self, windows: np.ndarray) -> np.ndarray:
        """Mask over words under any of these windows."""
        edge = np.zeros(len(self.words.start) + 1, np.int64)
        np.add.at(edge, windows, 1)
        np.add.at(edge, windows + self.span, -1)
        return np.cumsum(edge)[:-1] > 0


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def _asked(rows: pa.RecordBatch, texts: list[bytes | None], span: int) -> pa.RecordBatch:
    """A row for each different block of a step with its first document; later ones are known to repeat it."""
    ids = rows.column("doc_id")
    known_id = ids.is_valid().to_numpy(zero_copy_only=False)
    blocks = Blocks([t if ok else None for t, ok in zip(texts, known_id, strict=True)], span)
    doc = ids.fill_null(0).to_numpy()[blocks.text]
    order = np.lexsort((doc, blocks.content, blocks.anchor))
    anchor, content, doc = blocks.anchor[order], blocks.content[order], doc[order]
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(anchor) != 0) | (np.diff(content) != 0)
    again = ~new
    again[1:] &= np.diff(doc) != 0
    repeats = again & (doc != doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))]) if len(doc) else again
    keep = new | repeats
    # what is known needs no meeting with others, so it is spread at random
    key = np.where(new, anchor, W.combine(content, doc.view(np.uint64)))
    return pa.RecordBatch.from_arrays(
        [_signed(key[keep]), _signed(content[keep]), pa.array(doc[keep]), pa.array(repeats[keep])], ["key", "block", "doc_id", "repeats"]
    )


def _cut(blocks: Blocks, covered: np.ndarray, texts: list[bytes | None]) -> tuple[list[bytes | None], pa.Array, np.ndarray, list[str]]:
    """Texts without the covered words, the spans cut out, how many words, and the digest of the kept words."""
    w = blocks.words
    text = w.text
    removed = np.bincount(text[covered], minlength=len(texts))
    start = covered.copy()
    start[1:] &= ~covered[:-1] | (np.diff(text) != 0)
    begin = np.flatnonzero(start)
    stop = covered.copy()
    stop[:-1] &= ~covered[1:] | (np.diff(text) != 0)
    end = np.flatnonzero(stop) + 1
    at = np.searchsorted(text[begin], np.arange(len(texts) + 1))
    inner = pa.StructArray.from_arrays(
        [pa.array(begin - w.first[text[begin]], pa.int32()), pa.array(end - begin, pa.int32())], ["start", "n"]
    )
    spans = pa.ListArray.from_arrays(pa.array(at, pa.int32()), inner)
    out = list(texts)
    for t in np.flatnonzero(removed):
        parts, here = [], int(w.at[t])
        for k in range(at[t], at[t + 1]):
            parts.append(w.data[here : w.start[begin[k]]])
            here = int(w.start[end[k]]) if end[k] < w.first[t + 1] else int(w.at[t + 1]) - 1
        parts.append(w.data[here : int(w.at[t + 1]) - 1])
        out[t] = b"".join(parts)
    return out, spans, removed, [sha256(b" ".join((t or b"").split())).hexdigest() for t in out]


_FOUND = "text string, spans array<struct<start:int,n:int>>, n_words bigint, n_removed bigint, kept_sha256 string"
_NAMES = ["text", "spans", "n_words", "n_removed", "kept_sha256"]


def _found(blocks: Blocks, covered: np.ndarray, texts: list[bytes | None]) -> list[pa.Array]:
    out, spans, removed, digests = _cut(blocks, covered, texts)
    return [pa.array(out, pa.binary()).cast(pa.string()), spans, pa.array(blocks.words.counts), pa.array(removed), pa.array(digests)]


def _lists(column: pa.Array, own: np.ndarray, values: np.ndarray) -> np.ndarray:
    """True for each ``values[i]`` that is in row ``own[i]`` of a list column."""
    flat = column.flatten().to_numpy().view(np.uint64)
    sizes = column.value_lengths().fill_null(0).to_numpy()
    held = W.combine(np.repeat(np.arange(len(sizes)), sizes).astype(np.uint64), flat)
    return np.isin(W.combine(own.astype(np.uint64), values), held)


def dedup(docs: DataFrame, span: int = SPAN, with_text: bool = True) -> DataFrame:
    """``rest`` (all other columns of a row as a struct), ``doc_id``, the text without
    duplicate spans, these spans (start and length in words), ``n_words``,
    ``n_removed`` and ``kept_sha256`` (of the kept words, joined by one space).

    A text that loses nothing is unchanged. Windows are judged on the input.
    Rows that repeat an id never remove words of each other; a row without an id
    neither loses words nor removes any; null and short texts lose nothing; an
    empty table gives no rows. Without ``with_text`` the text is null, and fewer
    texts are read a second time.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    asked = texts.mapInArrow(
        W.by_step(lambda rows, texts: _asked(rows, texts, span)), "key bigint, block bigint, doc_id bigint, repeats boolean"
    )
    of_block, of_anchor = Window.partitionBy("key", "block"), Window.partitionBy("key")
    judged = asked.withColumn("first", F.min("doc_id").over(of_block)).withColumns(
        {"least": F.min("block").over(of_anchor), "most": F.max("block").over(of_anchor)}
    )
    old = F.col("repeats") | (F.col("doc_id") > F.col("first"))
    told = judged.where(old | (F.col("least") != F.col("most"))).select("doc_id", "block", old.alias("old"))
    by_doc = told.groupBy("doc_id").agg(
        F.collect_list(F.when(F.col("old"), F.col("block"))).alias("_old"),
        F.collect_list(F.when(~F.col("old"), F.col("block"))).alias("_open"),
    )
    rest = [F.col(c) for c in docs.columns if c != "text"]
    rows = docs.select(
        F.struct(*rest).alias("rest"), F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.xxhash64("text").alias("mark")
    )

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            blocks = Blocks(texts, span)
            old = _lists(rows.column("_old"), blocks.text, blocks.content)
            open_ = _lists(rows.column("_open"), blocks.text, blocks.content) & ~old
            covered = blocks.cover(W.spread(blocks.first[old], (blocks.last - blocks.first + 1)[old]))
            at = W.spread(blocks.first[open_], (blocks.last - blocks.first + 1)[open_])
            own = np.repeat(blocks.text[open_], (blocks.last - blocks.first + 1)[open_])
            asks = np.unique(np.stack((own.astype(np.uint64), blocks.window_hashes(at)), axis=1), axis=0)
            held = pa.ListArray.from_arrays(pa.array(np.searchsorted(asks[:, 0], np.arange(len(texts) + 1).astype(np.uint64)), pa.int32()), _signed(np.ascontiguousarray(asks[:, 1])))
            found = _found(blocks, covered, texts)
            pending = np.bincount(own, minlength=len(texts)) > 0
            # no text is written here: the spans and the open windows say all
            found[0] = pa.nulls(len(texts), pa.string())
            return pa.RecordBatch.from_arrays(
                [rows.column("rest"), rows.column("doc_id"), *found, rows.column("mark"), pa.array(pending), held],
                ["rest", "doc_id", *_NAMES, "mark", "pending", "asks"],
            )

        return W.by_step(make)(batches)

    parsed = rows.join(by_doc, "doc_id", "left").select("rest", "doc_id", "text", "mark", "_old", "_open")
    path = scratch_path(spark, "parsed")
    out = parsed.mapInArrow(parse, _schema(parsed, _FOUND + ", mark bigint, pending boolean, asks array<bigint>"))
    out.write.parquet(path)
    out = spark.read.schema(out.schema).parquet(path)
    asks = out.where("pending").select("doc_id", F.explode("asks").alias("window"))
    hits = asks.withColumn("first", F.min("doc_id").over(Window.partitionBy("window"))).where("doc_id > first")
    hits = stored(hits.groupBy("doc_id").agg(F.collect_set("window").alias("_hits")), "hits")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def make(rows: pa.RecordBatch, texts: list[bytes | None]) -> pa.RecordBatch:
            blocks = Blocks(texts, span)
            text = blocks.words.text[blocks.windows]
            hit = _lists(rows.column("_hits"), text, blocks.window_hashes(blocks.windows))
            covered = blocks.cover(blocks.windows[hit])
            spans = rows.column("spans")
            inner = spans.flatten()
            begin = inner.field("start").to_numpy() + np.repeat(blocks.words.first[:-1], spans.value_lengths().fill_null(0).to_numpy())
            covered[W.spread(begin, inner.field("n").to_numpy().astype(np.int64))] = True
            found = _found(blocks, covered, texts)
            if not with_text:
                found[0] = pa.nulls(len(texts), pa.string())
            return pa.RecordBatch.from_arrays([rows.column("rest"), rows.column("doc_id"), *found], ["rest", "doc_id", *_NAMES])

        return W.by_step(make)(batches)

    spans = out.select("doc_id", "mark", "spans").join(hits, "doc_id", "left" if with_text else "inner").dropDuplicates(["doc_id", "mark"])
    # with texts all rows are read once more, else those with a hit; the others are done
    ready = rows.join(spans, ["doc_id", "mark"], "left" if with_text else "inner")
    ready = ready.select("rest", "doc_id", "text", "spans", "_hits")
    finished = ready.mapInArrow(finish, _schema(ready, _FOUND))
    if with_text:
        return finished
    return out.join(hits, "doc_id", "left_anti").drop("mark", "pending", "asks").unionByName(finished)


def _schema(df: DataFrame, more: str) -> StructType:
    """``rest`` and ``doc_id`` as they are in ``df``, and the columns of a schema text."""
    return StructType([df.schema["rest"], df.schema["doc_id"], *StructType.fromDDL(more).fields])
