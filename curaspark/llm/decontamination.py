"""Benchmark decontamination: a prefix-filtered join for exact containment.

An item's windows are its runs of ``size`` words (an item of fewer words is one
window).  Words are ordered by how rare they are over all documents; as a
window must occur whole, its prefix is its one rarest word.  Documents are
probed with prefix words only; a hit at a place proposes the windows with that
word, the positional bound (the words before and after the hit must exist in
the text) and the length cut proposals, and the rest is verified word by word.

The index of a block of benchmark items is broadcast; blocks are cut by size,
and a benchmark of several blocks makes several passes over the documents whose
spans are merged.

Edge cases: a null text or one without words has no windows and no hits; items
with the same id are one item; items without an id are one item whose id is the
empty string; repeated documents are judged each; very long texts are read
whole; empty tables give no hits; extra columns are ignored, whatever their
names (``drop_contaminated`` keeps them).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrays, shared


@dataclass(frozen=True)
class LeakParams:
    size: int = 10  # words in a window
    block_bytes: int = 4 << 20  # of benchmark text in a broadcast index, which is about four times as large


def _item_blocks(items: DataFrame, limit: int) -> Iterator[list[tuple[str, str]]]:
    """Items in blocks of ``limit`` bytes of text or one longer item; only one block is held at a time."""
    block, size = [], 0
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), F.coalesce("text", F.lit("")).alias("t"))
    for r in named.distinct().toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t.encode())
        if size >= limit:
            yield block
            block, size = [], 0
    if block:
        yield block


class Index:
    """Windows of a block of items, as places in one array of its words' hashes: about 20 bytes a word."""

    def __init__(self, block: list[tuple[str, str]], size: int):
        self.ids = sorted({i for i, _ in block})
        place = {x: k for k, x in enumerate(self.ids)}
        data, off = arrays.utf8(pa.array([t for _, t in block], pa.string()))
        self.size = size
        self.words, _, _, woff = arrays.words(data, off, arrays.ALNUM)
        n = np.diff(woff)
        windows = np.where(n > 0, np.maximum(1, n - size + 1), 0)
        first = np.repeat(woff[:-1] - np.cumsum(windows) + windows, windows)
        self.begin = (first + np.arange(len(first))).astype(np.int32)
        self.owner = np.repeat(np.array([place[i] for i, _ in block], np.int32), windows)
        self.length = np.repeat(np.minimum(n, size), windows).astype(np.int16)
        self.vocabulary = np.unique(self.words)

    def order(self, count: np.ndarray) -> None:
        """Fix each window's prefix word by the documents' counts of the vocabulary."""
        n = count[np.searchsorted(self.vocabulary, self.words)] if len(self.words) else np.zeros(0, np.int64)
        self.at, least = np.zeros(len(self.begin), np.int16), np.full(len(self.begin), np.iinfo(np.int64).max)
        for j in range(self.size):
            there = np.flatnonzero(self.length > j)
            here = n[self.begin[there] + j]
            less = here < least[there]
            self.at[there[less]], least[there[less]] = j, here[less]
        key = self.words[self.begin + self.at]
        order = np.argsort(key, kind="stable")
        self.prefix, first = np.unique(key[order], return_index=True)
        self.first = np.append(first, len(order))
        self.begin, self.owner, self.length, self.at = self.begin[order], self.owner[order], self.length[order], self.at[order]
        self.vocabulary = None  # not needed by probes

    def probe(self, h: np.ndarray, woff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts among the words, lengths and item numbers of all occurrences."""
        none = np.zeros(0, np.int64)
        if not len(self.prefix) or not len(h):
            return none, none, none
        k = np.minimum(np.searchsorted(self.prefix, h), len(self.prefix) - 1)
        hit = np.flatnonzero(self.prefix[k] == h)
        k = k[hit]
        n = self.first[k + 1] - self.first[k]
        at = np.repeat(hit, n)
        w = np.repeat(self.first[k] - np.cumsum(n) + n, n) + np.arange(n.sum())
        text = np.repeat(np.searchsorted(woff, hit, "right") - 1, n)
        start = at - self.at[w]
        ok = (start >= woff[text]) & (start + self.length[w] <= woff[text + 1])  # positional and length bounds
        start, w = start[ok], w[ok]
        for j in range(self.size):  # exact: word by word, the failing ones leave at once
            inside = self.length[w] > j
            same = ~inside
            same[inside] = h[start[inside] + j] == self.words[self.begin[w[inside]] + j]
            start, w = start[same], w[same]
        return start, self.length[w].astype(np.int64), self.owner[w].astype(np.int64)


def _count_vocabulary(docs: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Occurrences of each vocabulary word over all documents."""
    if not len(vocabulary):
        return np.zeros(0, np.int64)
    held = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches):
        v = held.value
        total = np.zeros(len(v), np.int64)
        for _, data, off in arrays.slices(batches, "text"):
            h = arrays.words(data, off, arrays.ALNUM)[0]
            if len(h):
                k = np.minimum(np.searchsorted(v, h), len(v) - 1)
                total += np.bincount(k[v[k] == h], minlength=len(v))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["k", "n"])

    out = np.zeros(len(vocabulary), np.int64)
    for r in shared.map_arrow(docs.select("text"), count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.k] = r.n
    return out


def _scan(docs: DataFrame, index: Index | None, columns: list[str]) -> DataFrame:
    """The columns of docs with n_words, spans (merged, in words) and items."""
    held = docs.sparkSession.sparkContext.broadcast(index)
    schema = docs.select(*columns).schema
    made = "n_words bigint, spans array<struct<start:int,n:int>>, items array<string>"

    def scan(batches):
        ix = held.value
        for rows, data, off in arrays.slices(batches, "_text"):
            h, _, _, woff = arrays.words(data, off, arrays.ALNUM)
            start, n, item = ix.probe(h, woff) if ix else (np.zeros(0, np.int64),) * 3
            step = np.zeros(len(h) + 1, np.int64)
            np.add.at(step, start, 1)
            np.add.at(step, start + n, -1)
            a, b = arrays.ranges(np.cumsum(step[:-1]) > 0, woff)
            text = np.searchsorted(woff, a, "right") - 1
            spans = pa.StructArray.from_arrays([pa.array(a - woff[text], pa.int32()), pa.array(b - a, pa.int32())], ["start", "n"])
            owner = np.unique(np.stack([np.searchsorted(woff, start, "right") - 1, item]), axis=1)
            ids = pa.array([ix.ids[x] for x in owner[1]] if ix else [], pa.string())
            docs_n = np.arange(rows.num_rows + 1)
            yield pa.RecordBatch.from_arrays(
                [*(rows.column(c) for c in columns), pa.array(np.diff(woff), pa.int64()), arrays.list_array(spans, np.searchsorted(text, docs_n)), arrays.list_array(ids, np.searchsorted(owner[0], docs_n))],
                [*columns, "n_words", "spans", "items"],
            )

    from pyspark.sql.types import StructType

    full = StructType([*schema.fields, *StructType.fromDDL(made).fields])
    return shared.map_arrow(docs, scan, full)


def _index(docs: DataFrame, block: list[tuple[str, str]], params: LeakParams) -> Index:
    index = Index(block, params.size)
    index.order(_count_vocabulary(docs, index.vocabulary))
    return index


def find(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:  # noqa: B008
    """doc_id, n_words, spans, items of every row of docs."""
    given = docs.select("doc_id", F.col("text").alias("_text"))
    blocks = _item_blocks(items, params.block_bytes)
    block, after = next(blocks, None), next(blocks, None)
    if after is None:
        return _scan(given, _index(docs, block, params) if block else None, ["doc_id"])
    # several blocks: one index at a time, each pass written before the next block is read
    keyed = given.withColumn("th", F.sha2(F.coalesce("_text", F.lit("")), 256))
    out = None
    while block is not None:
        one = shared.spill(_scan(keyed, _index(docs, block, params), ["doc_id", "th"]).withColumn("first", F.lit(int(out is None))), "pass")
        out = one if out is None else out.unionByName(one)
        block, after = after, next(blocks, None)
    out = out.groupBy("doc_id", "th").agg(F.max("n_words").alias("n_words"), F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.sum("first").alias("copies"))
    return out.select("doc_id", "n_words", F.array_sort("spans").alias("spans"), "items", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("col")


def judge(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:  # noqa: B008
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("n"))
    step = lambda acc, s: F.struct(F.greatest(acc["at"], s["start"] + s["n"]).alias("at"), (acc["n"] + F.greatest(F.lit(0), s["start"] + s["n"] - F.greatest(acc["at"], s["start"]))).alias("n"))
    hit = F.aggregate("spans", start, step)["n"].cast("long")
    ids = F.array_join(F.array_sort("items"), ",")
    return find(docs, items, params).select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), (hit > 0).alias("contaminated"), "spans"
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, params: LeakParams = LeakParams()) -> DataFrame:  # noqa: B008
    """The rows of docs without a benchmark window, columns unchanged."""
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc_id"), "text")
    return find(whole, items, params).filter(F.size("spans") == 0).select("doc_id.*")
