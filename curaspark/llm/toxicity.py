"""Toxicity: a learned lexicon, misspellings by Levenshtein automata, and the context of each hit.

Lexicon: words whose labelled texts are toxic far more often than others, by a
likelihood ratio over families of similar texts, so that copies count once.  The lexicon's trie is intersected with the
Levenshtein automata of its terms (one edit, or a swap of neighbours, for terms
of ``fuzzy_from`` letters or more) and made deterministic; all distinct words of
a batch walk the result together, one letter per step.  A hit inside quotation
marks, or right after a reporting word, counts as a quotation.  A logistic
model over the hits of a document gives the score.

Learning uses a bounded sample of labelled rows (``train_rows``, by a hash of
the id) that are not held out: crc32 of the id as text, modulo 3, is not 1.

Edge cases: a null or empty text has no hits and gets the model's lowest score;
without labels the score is the same for every document; repeated rows score
alike; very long texts are read whole; an empty table gives an empty result;
extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import arrays, shared

#: Words after which a term is reported rather than used: fixed values.
REPORTING = ("said", "says", "called", "calls", "word", "term", "quote", "quoted", "wrote", "named", "saying", "calling")
MARKS = {b'"': b'"', b"\xe2\x80\x9c": b"\xe2\x80\x9d", b"\xc2\xab": b"\xc2\xbb"}
FEATURES = 6


@dataclass(frozen=True)
class ToxicParams:
    train_rows: int = 20_000  # labelled rows that learning may use at most
    min_families: int = 4  # families of texts with a term
    min_prevalence: float = 0.002  # the same as a share of the toxic families
    min_ratio: float = 16.0  # likelihood ratio (G) of a term
    min_share: float = 0.6  # of a term's families that are toxic
    fuzzy_from: int = 5  # letters of a term from which misspellings count
    window: int = 120  # bytes on each side of a hit in which quotation marks are looked for
    threshold: float = 0.7


@dataclass
class Model:
    terms: list[str] = field(default_factory=list)
    known: frozenset[bytes] = frozenset()  # ordinary words one edit from a term
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES))
    params: ToxicParams = field(default_factory=ToxicParams)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


class Automaton:
    """The union of the terms' Levenshtein automata along their trie, determinised over bytes.

    ``to``: next state by state * symbols + symbol; ``kind``: 0 no term, 1 the term itself, 2 a misspelling.
    """

    def __init__(self, terms: list[str], fuzzy_from: int):
        raw = sorted({t.encode() for t in terms})
        letters = sorted({c for t in raw for c in t})
        self.symbol = np.full(256, len(letters), np.uint8)
        self.symbol[letters] = np.arange(len(letters))
        children: list[dict[int, int]] = [{}]
        ends, reach = [0], [0]  # term length at its node; the longest term below
        for t in raw:
            node = 0
            reach[0] = max(reach[0], len(t))
            for c in t:
                if c not in children[node]:
                    children[node][c] = len(children)
                    children.append({})
                    ends.append(0)
                    reach.append(0)
                node = children[node][c]
                reach[node] = max(reach[node], len(t))
            ends[node] = len(t)
        # a position: (node, edits, owed letter or -1); an edit is only worth while a long enough term lies below
        may = lambda n: reach[n] >= fuzzy_from

        def close(positions):
            out, todo = set(), list(positions)
            while todo:
                p = todo.pop()
                if p in out:
                    continue
                out.add(p)
                node, edits, owed = p
                if owed < 0 and not edits and may(node):  # a letter of the term is missing
                    todo += [(child, 1, -1) for child in children[node].values() if may(child)]
            return frozenset(out)

        def move(state, c):
            out = set()
            for node, edits, owed in state:
                if owed >= 0:
                    if owed == c:
                        out.add((node, 1, -1))
                    continue
                if c in children[node]:
                    out.add((children[node][c], edits, -1))
                if not edits and may(node):
                    out.add((node, 1, -1))  # a letter too many
                    for x, child in children[node].items():
                        if may(child):
                            out.add((child, 1, -1))  # another letter
                            if x != c and c in children[child] and may(children[child][c]):
                                out.add((children[child][c], 1, x))  # two letters swapped
            return close(out)

        def kind(state):
            found = 0
            for node, edits, owed in state:
                if owed < 0 and ends[node]:
                    if not edits:
                        return 1
                    if ends[node] >= fuzzy_from:
                        found = 2
            return found

        start = close({(0, 0, -1)})
        index, order, rows = {frozenset(): 0, start: 1}, [frozenset(), start], []
        k = 0
        while k < len(order):
            row = []
            for c in [*letters, -2]:
                nxt = move(order[k], c)
                if nxt not in index:
                    index[nxt] = len(order)
                    order.append(nxt)
                row.append(index[nxt])
            rows.append(row)
            k += 1
        self.to, self.kind = np.array(rows, np.int32).ravel(), np.array([kind(s) for s in order], np.uint8)
        self.symbols, self.longest = len(letters) + 1, max(map(len, raw), default=0) + 1

    def classify(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """kind of each word, all words one letter at a time."""
        out = np.zeros(len(starts), np.uint8)
        live = np.flatnonzero(ends - starts <= self.longest)
        state = np.ones(len(live), np.int32)
        for t in range(self.longest + 1):
            done = ends[live] - starts[live] == t
            out[live[done]] = self.kind[state[done]]
            go = ~done & (state > 0)
            live, state = live[go], state[go]
            if not len(live):
                break
            state = self.to[state * self.symbols + self.symbol[data[starts[live] + t]]]
        return out


def _quoted(raw: bytes, lo: int, hi: int, a: int, b: int, before: bytes, window: int) -> bool:
    if before in _REPORTING:
        return True
    left, right = raw[max(lo, a - window) : a], raw[b : min(hi, b + window)]
    for opening, closing in MARKS.items():
        if opening == closing:
            if left.count(opening) % 2 and opening in right:
                return True
        elif left.rfind(opening) > left.rfind(closing) and closing in right:
            return True
    return False


_REPORTING = frozenset(x.encode() for x in REPORTING)


def features(automaton: Automaton, known: frozenset[bytes], params: ToxicParams, data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row per text: 1, terms used (a misspelling is most of one), misspelled, quoted, any of them used, share of the words."""
    out = np.zeros((len(off) - 1, FEATURES))
    out[:, 0] = 1
    h, starts, ends, woff = arrays.words(data, off, arrays.ALNUM)
    if not len(h):
        return out
    low = arrays.ALNUM[0][data]
    _, first, which = np.unique(h, return_index=True, return_inverse=True)
    kinds = automaton.classify(low, starts[first], ends[first])[which]
    hits = np.flatnonzero(kinds)
    if not len(hits):
        return out
    raw = low.tobytes()
    text = np.searchsorted(woff, hits, "right") - 1
    used, bent, quoted = (np.zeros(len(out)) for _ in range(3))
    for k, d in zip(hits.tolist(), text.tolist(), strict=True):
        before = raw[starts[k - 1] : ends[k - 1]] if k > woff[d] else b""
        if _quoted(raw, off[d], off[d + 1], starts[k], ends[k], before, params.window):
            quoted[d] += 1
        elif kinds[k] == 1:
            used[d] += 1
        elif raw[starts[k] : ends[k]] not in known:
            bent[d] += 1
    n, all_used = np.maximum(np.diff(woff), 1), used + 0.75 * bent
    out[:, 1], out[:, 2], out[:, 3] = np.log1p(all_used), np.log1p(bent), np.log1p(quoted)
    out[:, 4], out[:, 5] = (all_used > 0), np.minimum(1.0, 20 * all_used / n)
    return out


def sample(docs: DataFrame, labels: DataFrame, params: ToxicParams) -> DataFrame:
    """Text and toxic (0 or 1) of the labelled rows that learning uses."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    # bounded by train_rows ids, so it may be broadcast
    ids = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(params.train_rows)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), "doc_id").select("text", "toxic").groupBy(F.xxhash64("text").alias("th")).agg(F.first("text").alias("text"), F.max("toxic").alias("toxic"))


def lexicon(rows: DataFrame, params: ToxicParams) -> tuple[list[str], frozenset[bytes]]:
    """Terms by their likelihood ratio, and ordinary words that a misspelling must not be; counts are of families of texts over the whole sample.

    A family is a MinHash of a text's three-word runs: near copies mostly share it and count once.
    """
    w = shared.words(F.translate("text", shared.UPPER, shared.LOWER), shared.ALNUM_BETWEEN)
    triples = lambda x: F.transform(F.sequence(F.lit(1), F.greatest(F.size(x) - 2, F.lit(1))), lambda i: F.xxhash64(F.slice(x, i, 3)))
    listed = rows.select("toxic", shared.let(w, lambda x: F.struct(F.array_distinct(x).alias("w"), F.array_min(triples(x)).alias("family"))).alias("_x")).select("toxic", "_x.w", "_x.family")
    listed = shared.spill(listed, "families")
    each = listed.select("toxic", "family", F.explode("w").alias("t")).groupBy("t", "family").agg(F.max("toxic").alias("toxic"))
    families = listed.groupBy("family").agg(F.max("toxic").alias("toxic")).agg(F.avg("toxic"), F.sum("toxic")).first()
    base, toxic = families[0] or 0.0, families[1] or 0
    if not 0 < base < 1:
        return [], frozenset()
    counts = shared.spill(each.groupBy("t").agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("p")), "words")
    terms = counts.filter(F.col("n") >= max(params.min_families, params.min_prevalence * toxic))
    share = F.col("p") / F.col("n")
    part = lambda x, ref: F.when(x > 0, x * F.log(x / (F.col("n") * ref))).otherwise(0.0)
    ratio = 2 * (part(F.col("p"), F.lit(base)) + part(F.col("n") - F.col("p"), F.lit(1 - base)))
    found = terms.withColumn("g", ratio).filter((share >= params.min_share) & (F.col("g") >= params.min_ratio) & (F.length("t") >= 3))
    # every term over the limits; their number is bounded by the sample's families over min_families
    chosen = [r.t for r in found.select("t").orderBy("t").collect()]
    automaton = Automaton(chosen, params.fuzzy_from)

    def near(batches):
        for _, data, off in arrays.slices(batches, "t"):
            hit = automaton.classify(data, off[:-1], off[1:]) == 2
            raw = data.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([raw[off[i] : off[i + 1]] for i in np.flatnonzero(hit)], pa.binary())], ["w"])

    ordinary = counts.filter(F.col("n") - F.col("p") >= 2).select("t")
    return chosen, frozenset(bytes(r.w) for r in shared.map_arrow(ordinary, near, "w binary").collect())


def fit(rows: DataFrame, terms: list[str], known: frozenset[bytes], params: ToxicParams) -> Model:
    """Logistic weights by Newton steps, from at most train_rows rows of FEATURES numbers."""
    automaton = Automaton(terms, params.fuzzy_from)

    def run(batches):
        for piece, data, off in arrays.slices(batches, "text"):
            x = features(automaton, known, params, data, off)
            yield pa.RecordBatch.from_arrays([piece.column("toxic"), arrays.list_array(pa.array(x.ravel()), np.arange(len(x) + 1) * FEATURES)], ["toxic", "x"])

    got = shared.map_arrow(rows.select("text", "toxic"), run, "toxic int, x array<double>").groupBy("toxic", "x").agg(F.count(F.lit(1)).alias("n")).collect()
    if not got:
        return Model(terms, known, np.zeros(FEATURES), params)
    x, y, n = np.array([r.x for r in got]), np.array([float(r.toxic) for r in got]), np.array([float(r.n) for r in got])
    # a misspelling counts like a use and a quotation like nothing, unless the data say otherwise
    prior = np.array([0, 1.0, 0, 0, 1.5, 0])
    w, ridge = prior.copy(), np.array([1e-3, 0.5, 10.0, 0.5, 0.5, 0.5])

    def loss(w):
        z = x @ w
        return float(n @ (np.logaddexp(0, z) - y * z) + 0.5 * ridge @ (w - prior) ** 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (n * (p - y)) + ridge * (w - prior)
        step = np.linalg.solve((x.T * (n * p * (1 - p))) @ x + np.diag(ridge), grad)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return Model(terms, known, w, params)


def learn(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> Model:  # noqa: B008
    rows = shared.spill(sample(docs, labels, params), "labelled")
    return fit(rows, *lexicon(rows, params), params)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    automaton = Automaton(model.terms, model.params.fuzzy_from)
    held = docs.sparkSession.sparkContext.broadcast((automaton, model.known, model.weights))
    params = model.params

    def run(batches):
        automaton, known, weights = held.value
        for piece, data, off in arrays.slices(batches, "text"):
            z = features(automaton, known, params, data, off) @ weights
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], ["doc_id", "score"])

    schema = StructType([docs.schema["doc_id"], *StructType.fromDDL("score double").fields])
    out = shared.map_arrow(docs.select("doc_id", "text"), run, schema)
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= params.threshold).cast("int").alias("predicted"))


def judge(docs: DataFrame, labels: DataFrame, params: ToxicParams = ToxicParams()) -> DataFrame:  # noqa: B008
    return score(docs, learn(docs, labels, params))
