"""Removal of repeated substrings: every byte covered by a ``length``-byte string that starts at two places or more.

1. Anchors.  The minimiser of a window (the first least hash of its ``gram``-byte
   substrings) depends on the window's bytes alone, so equal windows have equal
   anchors at equal offsets.  The windows of one anchor are consecutive; their
   union is the anchor's segment.  Anchors are compared by hashes; copies of a
   segment are counted before they are shuffled.
2. A segment met twice repeats whole.  Segments that share an anchor with other
   segments, and were met once, may repeat in part: their bytes are fetched.
3. Column-wise construction.  The segments of an anchor are aligned at it and
   read column by column: each round inserts one symbol of every segment,
   updates the order of the collection (segments sorted by what was read, last
   symbol first: the positional Burrows-Wheeler order) by one stable sort, and
   updates the common lengths of neighbours.  Columns come from, and repeated
   windows go to, sequential external files.  A window ending in a round
   repeats if its common length with a neighbour reaches ``length``.
   An anchor with more than ``hot`` different segments is split first: its windows
   fall into ranges of offsets, all windows of a range share a core, and a core
   that one segment alone has, or whose segments are the same over the range, is
   settled by a grouped count.  Only ranges across an edge of what is common are
   left; their windows are counted one by one.  So no task holds one anchor's
   segments, however many there are.
4. Repeated windows go back to every place of their segment, are merged in each
   document, and the bytes are cut out.

Strings are judged on the input.  Edge cases: a null text is empty; texts
shorter than ``length`` lose nothing; repeated rows are copies of each other, so
that both lose what they share; overlapping repeats in one document count; an
empty table gives an empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import itertools
import tempfile
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import arrays, shared


@dataclass(frozen=True)
class RepeatParams:
    length: int = 400  # bytes of a string
    gram: int = 50  # bytes of an anchor
    batch: int = 16_384  # segments that go through the columns together, at least
    hot: int = 1_024  # different segments over which an anchor is split
    span: int = 19  # offsets in a range of a split anchor

    @property
    def windows(self) -> int:
        return self.length - self.gram + 1


def _sliding_argmin(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the first least value of each run of w values, by block-wise running minima from both sides."""
    n = len(h)
    pad = -n % w
    big = np.concatenate([h, np.full(pad, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, w)
    right = np.minimum.accumulate(big, axis=1).ravel()  # least of block start .. i
    left = np.minimum.accumulate(big[:, ::-1], axis=1)[:, ::-1].ravel()  # least of i .. block end
    m = n - w + 1
    least = np.minimum(left[:m], right[w - 1 : w - 1 + m])
    # the place of the value: the first one at or after the window's start
    change = np.ones(m, bool)
    change[1:] = least[1:] != least[:-1]
    out = np.empty(m, np.int64)
    order = np.argsort(h, kind="stable")
    # places of equal values are looked up by (value, first place not before the window)
    runs = np.flatnonzero(change)
    bounds = np.append(runs, m)
    sorted_h = h[order]
    lo = np.searchsorted(sorted_h, least[runs], "left")
    hi = np.searchsorted(sorted_h, least[runs], "right")
    single = hi - lo == 1
    out[:] = np.repeat(np.where(single, order[np.minimum(lo, n - 1)], -1), np.diff(bounds))
    for a, b, x, y in zip(runs[~single], bounds[1:][~single], lo[~single], hi[~single], strict=True):
        places = order[x:y]  # ascending, as the sort is stable
        out[a:b] = places[np.searchsorted(places, np.arange(a, b))]
    return out


def anchors(data: np.ndarray, off: np.ndarray, params: RepeatParams) -> tuple[np.ndarray, ...]:
    """Of each anchor: text, anchor hash, segment hash, place, start and end of its segment (from the text's start)."""
    n = len(data)
    none = (np.zeros(0, np.int64),) * 6
    if n < params.length:
        return none
    p, inv = arrays.powers(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p, out=total[1:])
    grams = arrays.mix((total[params.gram :] - total[: n + 1 - params.gram]) * inv[: n + 1 - params.gram])
    at = _sliding_argmin(grams, params.windows)  # of the window that starts here
    window = np.arange(len(at))
    text = np.repeat(np.arange(len(off) - 1), np.diff(off))
    ok = text[window] == text[window + params.length - 1]
    window, at = window[ok], at[ok]
    if not len(window):
        return none
    first = np.ones(len(window), bool)
    first[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1)
    lo = window[first]
    hi = np.append(window[np.flatnonzero(first)[1:] - 1], window[-1]) + params.length
    a = at[first]
    seg = arrays.mix((total[hi] - total[lo]) * inv[lo] + ((a - lo).astype(np.uint64) << np.uint64(20)) + (hi - lo).astype(np.uint64))
    t = text[lo]
    return t, grams[a].view(np.int64), seg.view(np.int64), a - off[t], lo - off[t], hi - off[t]


def find_anchors(docs: DataFrame, params: RepeatParams) -> DataFrame:
    """did, h, seg, at, lo, hi of every anchor. ``docs``: did, text. A long text is read in pieces that overlap by a window."""
    piece = 1 << 20

    def run(batches):
        for rows, data, off in arrays.slices(batches, "text", piece):
            for start in range(0, max(1, len(data)), piece) if rows.num_rows == 1 else (0,):
                if rows.num_rows == 1:
                    part = data[start : start + piece + params.length - 1]
                    t, h, seg, at, lo, hi = anchors(part, np.array([0, len(part)]), params)
                else:
                    t, h, seg, at, lo, hi = anchors(data, off, params)
                yield pa.RecordBatch.from_arrays([rows.column("did").take(pa.array(t)), pa.array(h), pa.array(seg), *(pa.array(x + start, pa.int32()) for x in (at, lo, hi))], ["did", "h", "seg", "at", "lo", "hi"])

    return shared.map_arrow(docs, run, StructType([docs.schema["did"], *StructType.fromDDL("h bigint, seg bigint, at int, lo int, hi int").fields]))


class Columns:
    """Segments of whole anchors, aligned at them: symbols in a temporary file, numbers in memory (batch + hot at most).

    Column k holds the symbol k - windows + 1 bytes after the anchor. Rows become columns a block at a time, and
    lie in the file block by block.
    """

    def __init__(self, params: RepeatParams):
        self.params, self.zero = params, params.windows - 1
        self.width = self.zero + params.length
        self.step = max(1, (8 << 20) // self.width)
        self.file = tempfile.TemporaryFile()
        self.block = np.zeros((self.step, self.width), np.uint8)
        self.blocks = self.fill = self.n = 0
        self.numbers: list[tuple[np.ndarray, ...]] = []

    def add(self, h: np.ndarray, seg: np.ndarray, before: np.ndarray, data: np.ndarray, off: np.ndarray) -> None:
        """Segments in order of h; ``before``: bytes before the anchor in the segment."""
        start = (self.zero - before).astype(np.int32)
        end = start + np.diff(off).astype(np.int32)
        for i in range(len(h)):
            if self.fill == self.step:
                self.file.write(self.block.T.tobytes())
                self.block[:] = 0
                self.blocks, self.fill = self.blocks + 1, 0
            self.block[self.fill, start[i] : end[i]] = data[off[i] : off[i + 1]]
            self.fill += 1
        self.n += len(h)
        self.numbers.append((np.array(h), np.array(seg), start, end))

    def _column(self, k: int) -> np.ndarray:
        out = np.empty(self.n, np.uint8)
        for b in range(self.blocks):
            self.file.seek((b * self.width + k) * self.step)
            self.file.readinto(out[b * self.step : (b + 1) * self.step])
        out[self.blocks * self.step :] = self.block[: self.fill, k]
        return out

    def runs(self):
        """Record batches of h, seg, a (first byte), b (end) of the runs of repeated windows, by columns."""
        n, length, windows = self.n, self.params.length, self.params.windows
        h, seg, start, end = (np.concatenate(x) for x in zip(*self.numbers, strict=True))
        self.numbers = []
        with self.file, tempfile.TemporaryFile() as marks:
            order = np.arange(n, dtype=np.int32)  # segments sorted by (anchor, what was read backwards)
            since = np.zeros(n, np.int32)  # column from which a segment equals its predecessor in that order
            edge = np.ones(n, bool)  # first of its anchor; anchors keep their places
            edge[1:] = h[1:] != h[:-1]
            groups = int(edge.sum())
            base = ((np.cumsum(edge) - 1) * 256).astype(np.uint16 if groups <= 256 else np.int32 if groups < 1 << 23 else np.int64)
            for k in range(self.width):
                symbol = self._column(k)[order]
                # one stable sort inside each anchor; the common start of new neighbours is the latest of those between them
                place = np.argsort(base + symbol, kind="stable")  # old place of each new place
                same = np.zeros(n, bool)
                same[1:] = ~edge[1:] & (symbol[place[1:]] == symbol[place[:-1]])
                fresh = np.full(n, k + 1, np.int32)
                near = same.copy()
                near[1:] &= place[1:] == place[:-1] + 1
                fresh[near] = since[place[near]]
                far = np.flatnonzero(same & ~near)
                if len(far):
                    cuts = np.stack([place[far - 1] + 1, place[far] + 1], axis=1).ravel()
                    fresh[far] = np.maximum.reduceat(np.append(since, np.int32(0)), cuts)[::2]
                order, since = order[place], fresh
                # nothing outside a segment equals anything
                out = (k < start[order]) | (k >= end[order])
                broken = out.copy()
                broken[1:] |= out[:-1]
                since[broken | edge] = k + 1
                w = k - length + 1
                if w >= 0:
                    equal = since <= w
                    hit = equal.copy()
                    hit[:-1] |= equal[1:]
                    found = np.zeros(n, bool)
                    found[order[hit]] = True
                    marks.write(found.tobytes())
            for lo in range(0, n, self.step):
                hi = min(n, lo + self.step)
                wide = np.zeros((hi - lo, windows + 2), np.int8)
                for w in range(windows):
                    marks.seek(w * n + lo)
                    wide[:, w + 1] = np.frombuffer(marks.read(hi - lo), np.int8)
                d = np.diff(wide, axis=1)
                i, a = np.nonzero(d == 1)
                _, b = np.nonzero(d == -1)
                i += lo
                yield pa.RecordBatch.from_arrays([pa.array(h[i]), pa.array(seg[i]), pa.array((a - start[i]).astype(np.int32)), pa.array((b - 1 + length - start[i]).astype(np.int32))], ["h", "seg", "a", "b"])


def column_runs(params: RepeatParams):
    """The Arrow function of ``_columns``."""

    def run(batches):
        held, last = Columns(params), None
        for batch in batches:
            if not batch.num_rows:
                continue
            h, seg, before = (batch.column(c).to_numpy() for c in ("h", "seg", "before"))
            parts = batch.column("bytes").cast(pa.binary())
            off = np.frombuffer(parts.buffers()[1], np.int32)[parts.offset : parts.offset + len(parts) + 1]
            data = np.frombuffer(parts.buffers()[2], np.uint8)
            lo = 0
            for i in np.flatnonzero(np.append(last is not None and last != h[0], h[1:] != h[:-1])):
                if held.n + i - lo >= params.batch:
                    held.add(h[lo:i], seg[lo:i], before[lo:i], data, off[lo : i + 1])
                    yield from held.runs()
                    held, lo = Columns(params), i
            held.add(h[lo:], seg[lo:], before[lo:], data, off[lo:])
            last = h[-1]
        if held.n:
            yield from held.runs()

    return run


RUNS = "h bigint, seg bigint, a int, b int"


def _columns(segments: DataFrame, params: RepeatParams) -> DataFrame:
    """h, seg, a, b: the repeated runs of segments (h, seg, before, bytes), which lie together by h, in order."""
    return shared.map_arrow(segments, column_runs(params), RUNS)


def _batched(rows, schema: pa.Schema, most: int = 16_384):
    """Record batches of an iterator of tuples."""
    rows = iter(rows)
    while part := list(itertools.islice(rows, most)):
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*part, strict=True), schema.types, strict=True)], schema=schema)


def _digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=16).digest()


def _split(segments: DataFrame, params: RepeatParams) -> DataFrame:
    """h, seg, a, b: the same for anchors with any number of segments, by grouped counts alone."""
    length, span = params.length, params.span

    def ranges(batches):
        for batch in batches:
            for h, seg, before, data in zip(*(batch.column(c).to_pylist() for c in ("h", "seg", "before", "bytes")), strict=True):
                least = before - (len(data) - length)  # fewest bytes of a window before the anchor
                for r in range(least // span, before // span + 1):
                    lo, hi = r * span, min(r * span + span, params.windows) - 1
                    a, b = before - min(hi, before), before - max(lo, least) + length
                    yield h, seg, r, _digest(data[before - lo : before - hi + length]), _digest(data[a:b] + f"{before - a}".encode()), a, b

    def windows(batches):
        for batch in batches:
            for h, r, trim, c, a, b, before, data in zip(*(batch.column(c).to_pylist() for c in ("h", "r", "trim", "c", "a", "b", "before", "bytes")), strict=True):
                for x in range(a, b - length + 1):
                    yield h, r, trim, c, x - a, before - x, _digest(data[x : x + length])

    made = pa.schema([("h", pa.int64()), ("seg", pa.int64()), ("r", pa.int32()), ("core", pa.binary()), ("trim", pa.binary()), ("a", pa.int32()), ("b", pa.int32())])
    each = shared.spill(shared.map_arrow(segments, lambda x: _batched(ranges(x), made), "h bigint, seg bigint, r int, core binary, trim binary, a int, b int"), "ranges")
    met = each.groupBy("h", "r", "core").agg(F.count(F.lit(1)).alias("n"), F.min("trim").alias("x"), F.max("trim").alias("y")).filter("n > 1").select("h", "r", "core", (F.col("x") == F.col("y")).alias("same"))
    each = shared.spill(each.join(shared.spill(met, "cores"), ["h", "r", "core"]), "edges")
    open_ = each.filter(~F.col("same"))
    one = open_.groupBy("h", "r", "trim").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("seg", "a", "b")).alias("s")).select("h", "r", "trim", "c", "s.*")
    read = one.join(segments, ["h", "seg"]).select("h", "r", "trim", "c", "a", "b", "before", "bytes")
    made2 = pa.schema([("h", pa.int64()), ("r", pa.int32()), ("trim", pa.binary()), ("c", pa.int64()), ("off", pa.int32()), ("i", pa.int32()), ("w", pa.binary())])
    single = shared.spill(shared.map_arrow(read, lambda x: _batched(windows(x), made2), "h bigint, r int, trim binary, c bigint, off int, i int, w binary"), "windows")
    twice = single.groupBy("h", "i", "w").agg(F.sum("c").alias("n")).filter("n > 1").select("h", "i", "w")
    found = single.join(shared.spill(twice, "twice"), ["h", "i", "w"]).select("h", "r", "trim", "off")
    parts = open_.join(shared.spill(found, "found"), ["h", "r", "trim"]).select("h", "seg", (F.col("a") + F.col("off")).alias("a"), (F.col("a") + F.col("off") + length).alias("b"))
    return each.filter("same").select("h", "seg", "a", "b").unionByName(parts)


def _fetch(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """h, seg, before, bytes of the wanted (h, seg, did, at, lo, hi)."""
    lists = wanted.groupBy("did").agg(F.collect_list(F.struct("h", "seg", "at", "lo", "hi")).alias("want"))
    joined = docs.join(lists, "did").select("text", "want")

    def run(batches):
        for batch in batches:
            text, want = batch.column("text"), batch.column("want")
            for i in range(batch.num_rows):
                data = text[i].as_py().encode()
                for w in want[i].as_py():
                    yield w["h"], w["seg"], w["at"] - w["lo"], data[w["lo"] : w["hi"]]

    def packed(batches):
        rows = []
        size = 0
        for r in run(batches):
            rows.append(r)
            size += len(r[3])
            if size > 4 << 20:
                yield _rows(rows)
                rows, size = [], 0
        yield _rows(rows)

    def _rows(rows):
        c = list(zip(*rows, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary())], ["h", "seg", "before", "bytes"])

    return shared.map_arrow(joined, packed, "h bigint, seg bigint, before int, bytes binary")


def repeats(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:  # noqa: B008
    """did, spans: array of (a, b) bytes to remove, in any order and overlapping; documents that lose nothing are absent.

    ``docs``: did (equal for equal rows only), text.
    """
    found = shared.spill(find_anchors(docs, params), "anchors")
    # most anchors are met once: only the others' segments go on
    busy = found.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.min("seg").alias("x"), F.max("seg").alias("y")).filter("n > 1").select("h", (F.col("x") != F.col("y")).alias("mixed"))
    # written first, so that the join has both sides' partitions to itself and a hot anchor's can be split
    found = shared.spill(found.join(shared.spill(busy, "met"), "h"), "busy")
    segs = found.groupBy("h", "seg").agg(F.count(F.lit(1)).alias("c"), F.first("mixed").alias("mixed"), F.min(F.struct("did", "at", "lo", "hi")).alias("r")).select("h", "seg", "c", "mixed", "r.*")
    segs = shared.spill(segs, "segments")
    whole = segs.filter("c > 1").select("h", "seg", F.lit(0).alias("a"), (F.col("hi") - F.col("lo")).alias("b"))
    mixed = segs.filter("mixed")
    hot = shared.spill(mixed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > params.hot).select("h"), "hot")
    parts = _columns(_fetch(docs, mixed.join(hot, "h", "left_anti")).repartition("h").sortWithinPartitions("h"), params)
    if not hot.isEmpty():
        parts = parts.unionByName(_split(shared.spill(_fetch(docs, mixed.join(hot, "h", "left_semi")), "split"), params))
    # runs of one segment as one row, so that a document's places are joined once
    cut = whole.unionByName(parts).groupBy("h", "seg").agg(F.collect_list(F.struct("a", "b")).alias("runs"))
    spans = found.join(shared.spill(cut, "repeated"), ["h", "seg"]).select("did", F.transform("runs", lambda r: F.struct((F.col("lo") + r["a"]).alias("a"), (F.col("lo") + r["b"]).alias("b"))).alias("s"))
    return spans.groupBy("did").agg(F.flatten(F.collect_list("s")).alias("spans"))


def remove(docs: DataFrame, params: RepeatParams = RepeatParams(), with_text: bool = True) -> DataFrame:  # noqa: B008
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if asked for, kept: the remaining bytes (a character may be cut)."""
    given = docs.select(F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).alias("did"), F.coalesce("text", F.lit("")).alias("text"))
    whole = given.join(repeats(given, params), "did", "left").select("did.doc_id", "text", "spans")
    made = "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", kept binary" * with_text
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL(made).fields])

    def run(batches):
        for rows in batches:
            out = []
            for text, spans in zip(rows.column("text"), rows.column("spans"), strict=True):
                data = text.as_py().encode()
                kept, at, removed, runs = [], 0, 0, 0
                end = -1
                for a, b in sorted((s["a"], s["b"]) for s in spans.as_py() or ()):
                    if b <= end:
                        continue
                    if a > end:
                        runs += 1
                    kept.append(data[at : max(a, at)])
                    removed += b - max(a, at)
                    at = end = b
                kept.append(data[at:])
                rest = b"".join(kept)
                out.append((len(data), removed, runs, hashlib.sha256(rest).hexdigest(), rest))
            c = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array(x, pa.int64()) for x in c[:3]), pa.array(c[3], pa.string()), *([pa.array(c[4], pa.binary())] if with_text else [])], schema.names)

    return shared.map_arrow(whole, run, schema)


def judge(docs: DataFrame, params: RepeatParams = RepeatParams()) -> DataFrame:  # noqa: B008
    return remove(docs, params, with_text=False)
