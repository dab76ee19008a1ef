"""Near-duplicate documents by odd sketches of MinHash samples, confirmed on full sets.

1. Texts with the same set of word shingles, told by a 128-bit digest of the
   whole set, form a class; only one text of a class goes on, so copies cost
   one row each.
2. A class has ``bands`` x ``rows`` MinHash samples and an odd sketch: a bitmap
   in which each sample flips one bit.  The population count of two sketches'
   XOR estimates the number of samples in which they differ.
3. Classes that share a band meet.  First every member of a band meets the
   band's most central members only (those with most company in all bands);
   pairs whose sketches rule the similarity out go, the others are confirmed on
   the full shingle sets, and confirmed links give components.
4. Classes that are joined by shared bands form a cluster.  In clusters that
   still hold several components, the members outside the largest one are held
   against all members of other components: their sets meet in salted blocks of
   bounded size, where all overlaps of a pair of blocks are one matrix product
   over the shingles.  Only links leave a block; pairs inside one component
   change nothing, so they are not made.

A pair at the threshold shares no band with probability (1 - s**rows)**bands
(3e-7 at 0.85), and the sketch margin is over five standard deviations.

Edge cases: a null text or one without words has an empty set, is linked with
nothing and is its own component; fewer words than a shingle are one shingle;
repeated rows are copies of each other; very long texts are read whole; an empty
table gives an empty result; extra columns are ignored, whatever their names
(``keep_one`` keeps them).
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import arrays, components, shared


@dataclass(frozen=True)
class NearParams:
    shingle: int = 5  # words
    percent: int = 80  # of the union that the intersection must reach
    bands: int = 32
    rows: int = 6
    sketch_bits: int = 512
    margin: float = 0.2  # by which the estimated similarity may fall short of the threshold
    centres: int = 2  # members of a band that all others meet
    block_rows: int = 1024  # members of a cluster in one block, and their shingles
    block_shingles: int = 1 << 19

    @property
    def samples(self) -> int:
        return self.bands * self.rows

    def most_flips(self) -> int:
        """XOR population count up to which a pair is plausible: from the sketch's estimate, at the threshold less the margin."""
        j = max(0.0, self.percent / 100 - self.margin)
        return int(np.ceil(self.sketch_bits / 2 * (1 - np.exp(-4 * self.samples * (1 - j) / self.sketch_bits))))


def _set_keys(g: np.ndarray, off: np.ndarray) -> pa.Array:
    """A 128-bit digest of each whole set, whose shingles are distinct and in order; null for an empty one."""
    raw, at = g.astype("<u8").tobytes(), (8 * off).tolist()
    return pa.array([hashlib.blake2b(raw[a:b], digest_size=16).digest() if b > a else None for a, b in zip(at, at[1:], strict=False)], pa.binary())


def _salts(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20240229)
    return r.integers(1, 1 << 63, n, np.uint64) | np.uint64(1), r.integers(0, 1 << 63, n, np.uint64)


def samples(g: np.ndarray, off: np.ndarray, k: int) -> np.ndarray:
    """MinHash samples of each non-empty set: for every sample, the least of a multiply-shift permutation."""
    a, b = _salts(k)
    out = np.empty((len(off) - 1, k), np.uint64)
    step = max(1, (1 << 21) // k)
    for i in range(len(off) - 1):
        least = None
        for lo in range(off[i], off[i + 1], step):
            h = (g[lo : min(lo + step, off[i + 1]), None] * a + b).min(axis=0)
            least = h if least is None else np.minimum(least, h)
        out[i] = 0 if least is None else least
    return arrays.mix(out)


def fold(sample: np.ndarray, bits: int) -> np.ndarray:
    """Odd sketches: bit (sample number, value) mod ``bits`` flips for each sample; packed bytes."""
    n, k = sample.shape
    at = (arrays.mix(sample + np.arange(k, dtype=np.uint64) * np.uint64(arrays.P)) % np.uint64(bits)).astype(np.int64)
    counts = np.zeros((n, bits), np.uint8)
    np.add.at(counts, (np.repeat(np.arange(n), k), at.ravel()), 1)
    return np.packbits(counts & 1, axis=1)


def signatures(docs: DataFrame, params: NearParams) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, key (null for an empty set), bands (64-bit keys) and sketch of each document."""
    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("th bigint, n_shingles bigint, key binary, bands array<bigint>, sketch binary").fields])

    def run(batches):
        for rows, data, off in arrays.slices(batches, "text"):
            g, goff = arrays.shingle_sets(data, off, params.shingle)
            n = np.diff(goff)
            s = samples(g, goff, params.samples)
            band = np.zeros((len(s), params.bands), np.uint64)
            for j in range(params.rows):
                band = band * np.uint64(arrays.Q) + s[:, j :: params.rows]
            band = arrays.mix(band + np.arange(params.bands, dtype=np.uint64) * np.uint64(arrays.P)).view(np.int64)
            there = n > 0
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id"), rows.column("th"), pa.array(n, pa.int64()), _set_keys(g, goff),
                    arrays.list_array(pa.array(band[there].ravel(), pa.int64()), np.append(0, np.cumsum(there)) * params.bands), pa.array([x.tobytes() for x in fold(s, params.sketch_bits)], pa.binary()),
                ],
                schema.names,
            )

    return shared.map_arrow(docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text"), run, schema)


def plausible(pairs: DataFrame, params: NearParams) -> DataFrame:
    """The pairs (a, b, sa, sb) whose sketches and sizes do not rule the similarity out."""
    most = params.most_flips()

    def run(batches):
        for rows in batches:
            if not rows.num_rows:
                continue
            x, y = (np.frombuffer(b"".join(rows.column(c).to_pylist()), np.uint8).reshape(rows.num_rows, -1) for c in ("sa", "sb"))
            ok = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= most
            yield pa.RecordBatch.from_arrays([rows.column(c).filter(pa.array(ok)) for c in ("a", "b")], ["a", "b"])

    low = params.percent / 100
    sized = pairs.filter((F.col("na") >= low * F.col("nb") - 1) & (F.col("nb") >= low * F.col("na") - 1))
    return shared.map_arrow(sized.select("a", "b", "sa", "sb"), run, "a bigint, b bigint")


def confirm(pairs: DataFrame, texts: DataFrame, params: NearParams) -> DataFrame:
    """The pairs (a, b) whose full shingle sets reach the similarity."""
    left = pairs.join(texts.select(F.col("key").alias("a"), F.col("text").alias("ta")), "a")
    both = left.join(texts.select(F.col("key").alias("b"), F.col("text").alias("tb")), "b")

    def run(batches):
        for rows, data, off in arrays.slices(batches, "ta"):
            g, goff = arrays.shingle_sets(data, off, params.shingle)
            tb = rows.column("tb")
            ok = np.zeros(rows.num_rows, bool)
            for piece, data2, off2 in arrays.slices(iter([pa.RecordBatch.from_arrays([tb, pa.array(np.arange(rows.num_rows))], ["tb", "i"])]), "tb"):
                g2, goff2 = arrays.shingle_sets(data2, off2, params.shingle)
                for j, i in enumerate(piece.column("i").to_pylist()):
                    x, y = g[goff[i] : goff[i + 1]], g2[goff2[j] : goff2[j + 1]]
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    ok[i] = 100 * common >= params.percent * (len(x) + len(y) - common)
            keep = pa.array(ok)
            yield pa.RecordBatch.from_arrays([rows.column(c).filter(keep) for c in ("a", "b")], ["a", "b"])

    return shared.map_arrow(both.select("a", "b", "ta", "tb"), run, "a bigint, b bigint")


def shingle_arrays(texts: DataFrame, params: NearParams) -> DataFrame:
    """key, g: the sorted shingle hashes of each text (key, text)."""

    def run(batches):
        for rows, data, off in arrays.slices(batches, "text"):
            g, goff = arrays.shingle_sets(data, off, params.shingle)
            yield pa.RecordBatch.from_arrays([rows.column("key"), arrays.list_array(pa.array(g.view(np.int64)), goff)], ["key", "g"])

    return shared.map_arrow(texts.select("key", "text"), run, "key bigint, g array<bigint>")


def block_links(outer: tuple[np.ndarray, np.ndarray, np.ndarray], inner: tuple[np.ndarray, np.ndarray, np.ndarray], percent: int, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Places of the linked pairs of two blocks, each given as (shingles, offsets, components)."""
    (g, goff, gc), (h, hoff, hc) = outer, inner
    shared_tokens = np.intersect1d(g, h)  # the others are in no overlap
    n, m = len(goff) - 1, len(hoff) - 1
    overlap = np.zeros((n, m), np.float32)

    def entries(x, off):
        row = np.repeat(np.arange(len(off) - 1), np.diff(off))
        k = np.searchsorted(shared_tokens, x)
        ok = (k < len(shared_tokens)) & (shared_tokens[np.minimum(k, max(0, len(shared_tokens) - 1))] == x) if len(shared_tokens) else np.zeros(len(x), bool)
        order = np.argsort(k[ok], kind="stable")
        return k[ok][order], row[ok][order]

    (gk, gr), (hk, hr) = entries(g, goff), entries(h, hoff)
    for lo in range(0, len(shared_tokens), step):
        a, b = np.zeros((n, step), np.float32), np.zeros((m, step), np.float32)
        for (k, r), x in (((gk, gr), a), ((hk, hr), b)):
            i, j = np.searchsorted(k, [lo, lo + step])
            x[r[i:j], k[i:j] - lo] = 1
        overlap += a @ b.T
    union = np.diff(goff)[:, None] + np.diff(hoff)[None, :] - overlap
    return np.nonzero((100 * overlap >= percent * union) & (gc[:, None] != hc[None, :]))


def _cross(cells: DataFrame, params: NearParams) -> DataFrame:
    """Links between components, from rows (cell, outer, key, component, g) of which ``cell`` is one pair of blocks."""
    percent = params.percent

    def run(key, table):
        table = table.combine_chunks()
        outer = np.array(table.column("outer").to_pylist(), bool)
        number = table.column("component").combine_chunks().dictionary_encode().indices.to_numpy() if len(table) else np.zeros(0, np.int64)

        def block(mask):
            t = table.filter(pa.array(mask))
            lists = t.column("g").combine_chunks()
            sizes = np.array([len(x) for x in lists], np.int64)
            g = lists.flatten().to_numpy(zero_copy_only=False)
            return t.column("key"), (g, np.append(0, np.cumsum(sizes)), number[mask])

        (a, x), (b, y) = block(outer), block(~outer)
        i, j = block_links(x, y, percent)
        # one link between two components is enough
        _, first = np.unique(np.stack([x[2][i], y[2][j]]), axis=1, return_index=True)
        return pa.table({"a": a.take(pa.array(i[first])), "b": b.take(pa.array(j[first]))})

    shared.ship_package(cells.sparkSession)
    return cells.groupBy("cell").applyInArrow(run, "a bigint, b bigint")


def classes_of(docs: DataFrame, params: NearParams) -> tuple[DataFrame, DataFrame]:
    """(doc_id, th, n_shingles, key) of every row, and (node, component) of the linked keys; components are numbers."""
    signed = shared.spill(signatures(docs, params), "signed")
    # one row of each class stands for it; copies go no further, and whole rows are shuffled once
    row = F.struct("doc_id", "th", "n_shingles", "bands", "sketch")
    firsts = signed.filter("key is not null").groupBy("key").agg(F.min_by(row, F.struct("doc_id", "th")).alias("r")).select("r.*", "key")
    # classes go by a number from here on: what is written has it for good, and least numbers need no sorts
    firsts = shared.spill(firsts.withColumnRenamed("n_shingles", "n").withColumnRenamed("key", "digest").withColumn("key", F.monotonically_increasing_id()), "classes")
    # bands that several classes share, and their most central members
    each = firsts.select(F.explode("bands").alias("band"), "key")
    shared_bands = each.groupBy("band").agg(F.count(F.lit(1)).alias("c")).filter("c > 1")
    member = shared.spill(each.join(shared_bands, "band"), "members")
    company = member.groupBy("key").agg(F.sum("c").alias("company"))
    rank = F.row_number().over(Window.partitionBy("band").orderBy(F.desc("company"), "key"))
    centre = shared.spill(member.join(company, "key").withColumn("rank", rank).filter(F.col("rank") <= params.centres).select("band", F.col("key").alias("centre"), "rank"), "centres")
    # the texts that a confirmation may need
    met = shared.spill(firsts.join(member.select("key").distinct(), "key", "left_semi").select("key", F.col("doc_id").alias("d"), F.col("th").alias("t")), "wanted")
    hashed = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")).withColumn("h", F.xxhash64("doc_id", "th"))
    named = met.withColumn("w", F.xxhash64("d", "t"))
    # dealt by one hash alone, the rest compared so that it is no join key: repeated rows then meet without another shuffle of texts
    same = (F.col("h") == F.col("w")) & (F.col("th").bitwiseXOR(F.col("t")) == 0) & F.coalesce(F.col("doc_id") == F.col("d"), F.col("doc_id").isNull() & F.col("d").isNull())
    texts = shared.spill(shared.likely(hashed, F.col("h"), named, F.col("w")).join(named, same).dropDuplicates(["h", "key"]).select("key", "text"), "texts")
    sketches = firsts.select("key", "n", "sketch")
    side = lambda s: sketches.select(F.col("key").alias(s), F.col("n").alias(f"n{s}"), F.col("sketch").alias(f"s{s}"))
    pairs = member.join(centre, "band").filter("key <> centre").select(F.least("key", "centre").alias("a"), F.greatest("key", "centre").alias("b")).distinct()
    links = shared.spill(confirm(plausible(pairs.join(side("a"), "a").join(side("b"), "b"), params), texts, params), "confirmed")
    comp = shared.spill(components.components(links), "components")
    # clusters of bands that still hold several components
    met = member.join(centre.filter("rank = 1"), "band").select(F.col("key").alias("a"), F.col("centre").alias("b"))
    cluster = components.components(met).select(F.col("node").alias("key"), F.col("component").alias("cluster"))
    named = cluster.join(comp.withColumnRenamed("node", "key"), "key", "left").select("key", "cluster", F.coalesce("component", "key").alias("component")).join(firsts.select("key", "n"), "key")
    named = shared.spill(named, "named")
    per = named.groupBy("cluster", "component").agg(F.count(F.lit(1)).alias("m"), F.sum("n").alias("s"))
    wide = per.groupBy("cluster").agg(F.max(F.struct("m", "s", "component")).alias("main"), F.sum("m").alias("m"), F.sum("s").alias("s"), F.count(F.lit(1)).alias("parts")).filter("parts > 1")
    blocks = lambda m, s: F.greatest(F.ceil(m / params.block_rows), F.ceil(s / params.block_shingles))
    wide = wide.select("cluster", F.col("main.component").alias("main"), blocks(F.col("m"), F.col("s")).alias("na"), blocks(F.col("m") - F.col("main.m"), F.col("s") - F.col("main.s")).alias("no"))
    open_rows = shared.spill(named.join(shared.spill(wide, "clusters"), "cluster"), "open")
    sets = shared.spill(shingle_arrays(texts.join(open_rows.select("key"), "key", "left_semi"), params), "shingles")
    placed = open_rows.join(sets, "key")
    salt = lambda n: F.pmod(F.xxhash64("key"), F.col(n))
    every = lambda n: F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1)
    cell = F.xxhash64("cluster", "i", "j").alias("cell")
    outer = placed.filter("component <> main").select(F.lit(True).alias("outer"), "cluster", "key", "component", "g", salt("no").alias("i"), F.explode(every("na")).alias("j"))
    inner = placed.select(F.lit(False).alias("outer"), "cluster", "key", "component", "g", salt("na").alias("j"), F.explode(every("no")).alias("i"))
    extra = shared.spill(_cross(outer.unionByName(inner).select(cell, "outer", "key", "component", "g"), params), "confirmed")
    if not extra.isEmpty():
        comp = shared.spill(components.components(comp.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(extra)), "components")
    named = comp.join(firsts.select(F.col("key").alias("node"), "digest"), "node").select(F.col("digest").alias("node"), "component")
    return signed.select("doc_id", "th", "n_shingles", "key"), named


def _with_class(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with _class: the component of their key, null for an empty set."""
    return rows.join(comp.withColumnRenamed("node", "key"), "key", "left").withColumn("_class", F.coalesce(F.encode(F.concat(F.lit("component number "), F.col("component").cast("string")), "utf-8"), "key"))  # longer than any digest


def _with_component(rows: DataFrame, comp: DataFrame) -> DataFrame:
    """rows with the component as its least doc_id."""
    named = _with_class(rows, comp)
    # written first, so that the join's partitions are its own and a hot class can be split
    least = shared.spill(named.filter("_class is not null").groupBy("_class").agg(F.min("doc_id").alias("_least")), "least")
    return named.join(least, "_class", "left").withColumn("component_id", F.coalesce("_least", "doc_id"))


def judge(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:  # noqa: B008
    """doc_id, n_shingles, component_id (least doc_id reachable) and kept of every document."""
    rows, comp = classes_of(docs, params)
    return _with_component(rows, comp).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, params: NearParams = NearParams()) -> DataFrame:  # noqa: B008
    """One row of each component, columns unchanged: that of its least doc_id (null is last), then text hash.

    Of rows with the same doc_id and text, with or without words, one stays: the least as JSON.
    """
    rows, comp = classes_of(docs, params)
    named = _with_class(rows, comp)
    least = F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("d"), F.col("th").alias("t")))
    firsts = shared.spill(named.filter("_class is not null").groupBy("_class").agg(least.alias("r")).select("_class", "r.d", "r.t"), "least")
    stays = F.col("_class").isNull() | (F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("th") == F.col("t")))
    fate = named.join(firsts, "_class", "left").groupBy("doc_id", "th").agg(F.bool_and(stays).alias("stays"), F.count(F.lit(1)).alias("n"))
    odd = shared.spill(fate.filter("n > 1 or not stays").select(F.col("doc_id").alias("_d"), F.col("th").alias("_t"), "stays"), "odd")
    # rows as one column, so that no column of theirs meets one of the joins'
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    whole = docs.select(row.alias("_row"), F.col("doc_id").alias("_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_th"))
    same = F.col("_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_t"))
    # only rows that may be odd are shuffled to be told exactly; the others stay as they are
    marked = shared.marked(whole, F.xxhash64("_id", "_th"), odd, F.xxhash64("_d", "_t"))
    maybe = marked.filter("_likely")
    left = marked.filter("not _likely").unionByName(maybe.join(odd.select("_d", "_t"), same, "left_anti")).select("_row.*")
    twice = odd.filter("stays").select("_d", "_t")
    if twice.isEmpty():
        return left
    again = maybe.join(twice, same).groupBy("_d", "_t").agg(F.min_by("_row", F.to_json("_row")).alias("r"))
    return left.unionByName(again.select("r.*"))
