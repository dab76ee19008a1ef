"""Quality rules: a learned decision list over text statistics.

Sequential covering: each rule grows a conjunction of thresholds that covers
low-quality labelled rows, is pruned on rows held out from growing, and then
takes the rows it covers out of the training set.  All counts are Spark
aggregates over every labelled row; the driver only sees one histogram of
(feature, bin) counts per step.  The list is emitted as one ordered
``CASE WHEN`` expression, so that judging a corpus is a narrow projection.

Edge cases: a null text has no words and fails the base test; without usable
labels the list is empty and everything that passes the base test is kept;
repeated label rows of a document count as one with their mean (ties count as
good); extra columns are kept by :func:`filter_quality` and ignored elsewhere.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

N = 8  #: words in a window of the repetition statistic
FEATURES = ("symbol_share", "mean_word", "dup_line_share", "repeat_share", "upper_share", "bang_share", "bar_share", "digit_share", "log_words", "distinct_share")


@dataclass(frozen=True)
class ListParams:
    n_cuts: int = 24  # thresholds tried per feature
    max_rules: int = 6
    max_conditions: int = 3
    min_covered: int = 12  # labelled rows that a rule must cover
    min_precision: float = 0.75


@dataclass(frozen=True)
class DecisionList:
    """Rules in order; each is a list of (feature, '<' or '>=', threshold). The first that fires rejects."""

    rules: list[list[tuple[str, str, float]]] = field(default_factory=list)

    def rejects(self) -> Column:
        out = F.lit(False)
        for rule in reversed(self.rules):
            out = F.when(_conjunction(rule), F.lit(True)).otherwise(out)
        return out

    def which(self) -> Column:
        """1-based number of the rule that fires, 0 if none does."""
        out = F.lit(0)
        for k, rule in reversed(list(enumerate(self.rules, 1))):
            out = F.when(_conjunction(rule), F.lit(k)).otherwise(out)
        return out


def _conjunction(rule) -> Column:
    out = F.lit(True)
    for name, op, at in rule:
        out &= (F.col(name) < at) if op == "<" else (F.col(name) >= at)
    return out


def _repeat_words(words: Column) -> Column:
    """Words inside N-word windows that occur twice or more (first ones included)."""
    size = F.size(words)

    def covered(hashes):
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_covered(hashes))

    # each word is hashed once; a window's hash is that of its words' hashes
    windows = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - N), lambda i: F.xxhash64(*(F.get(h, i + j) for j in range(N))))
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(size < N, F.lit(0)).otherwise(shared.let(hashes, lambda h: shared.let(windows(h), covered))).cast("long")


def _covered(hashes: Column) -> Column:
    # windows sorted by (hash, place); equal neighbours are repeats; their places in order give the cover
    pairs = F.array_sort(F.arrays_zip(hashes.alias("h"), F.sequence(F.lit(0), F.size(hashes) - 1).alias("i")))

    def places(s):
        last = F.size(s) - 1
        at = lambda j: F.get(s, j)["h"]
        hit = F.filter(F.sequence(F.lit(0), last), lambda j: ((j > 0) & (at(j) == at(j - 1))) | ((j < last) & (at(j) == at(j + 1))))
        return F.array_sort(F.transform(hit, lambda j: F.get(s, j)["i"]))

    def cover(p):
        steps = F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda j: F.least(F.lit(N), F.get(p, j + 1) - F.get(p, j)))
        return F.aggregate(steps, F.lit(N), lambda a, x: a + x)

    return shared.let(pairs, lambda s: shared.let(places(s), cover))


def statistics(docs: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns of each row and its text statistics (prefixed by nothing; ``keep`` must not clash)."""
    keep = ["doc_id"] if keep is None else keep
    text = F.coalesce(F.col("text"), F.lit(""))
    # the characters that are counted are drawn out in one pass; what is left of most texts is short
    without = lambda cls: F.length("_c") - F.length(F.regexp_replace("_c", cls, ""))
    drawn = F.regexp_replace("_t", r"[^#*$%&|<>!0-9\p{Lu}]+", "")
    has_word = F.filter(F.split("_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    base = docs.select(*keep, text.alias("_t")).withColumn("_w", shared.words(F.col("_t"))).withColumn("_c", drawn)
    base = base.select(
        *keep,
        F.size("_w").cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        without("[#*$%&|<>]+").cast("long").alias("n_symbols"),
        shared.let(has_word, lambda x: F.struct((F.size(x) - F.size(F.array_distinct(x))).alias("d"), F.size(x).alias("n"))).alias("_l"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        without(r"\p{Lu}+").alias("_up"),
        without("[!]+").alias("_bang"),
        without("[|]+").alias("_bar"),
        without("[0-9]+").alias("_dig"),
        F.size(F.array_distinct("_w")).alias("_dist"),
    )
    n, c = F.greatest(F.col("n_words"), F.lit(1)).cast("double"), F.greatest(F.col("word_chars"), F.lit(1)).cast("double")
    return base.select(
        *keep, "n_words", "word_chars", "n_symbols", F.col("_l.d").cast("long").alias("n_dup_lines"), "n_repeat_words",
        ((F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / c).alias("symbol_share"), (F.col("word_chars") / n).alias("mean_word"),
        (F.col("_l.d") / F.greatest(F.col("_l.n"), F.lit(1))).alias("dup_line_share"), (F.col("n_repeat_words") / n).alias("repeat_share"),
        (F.col("_up") / c).alias("upper_share"), (F.col("_bang") / n).alias("bang_share"), (F.col("_bar") / n).alias("bar_share"), (F.col("_dig") / c).alias("digit_share"),
        F.log1p(F.col("n_words")).alias("log_words"), (F.col("_dist") / n).alias("distinct_share"),
    )


def learn(labelled: DataFrame, params: ListParams = ListParams()) -> DecisionList:  # noqa: B008
    """``labelled``: FEATURES, ``bad`` (0 or 1) and ``fold`` (0 or 1 grow, 2 prune). Small columns, read once per step."""
    q = [i / params.n_cuts for i in range(params.n_cuts + 1)]
    got = labelled.agg(*(F.percentile_approx(f, q, 2000).alias(f) for f in FEATURES)).first()
    # quantiles and the middles between them, which part two groups wherever the quantiles fall
    cuts = {f: sorted({*q, *((a + b) / 2 for a, b in zip(q, q[1:], strict=False))}) for f in FEATURES for q in [sorted(set(got[f] or []))]}
    # the bin of each value is found once and written: the steps' plans stay small
    bins = [_bin(f, cuts[f]) for f in FEATURES]
    rows = shared.spill(labelled.select("bad", "fold", *FEATURES, F.array(*(F.struct(F.lit(k).alias("f"), b.alias("b")) for k, b in enumerate(bins))).alias("_bins")), "bins")
    left, rules = F.lit(True), []
    for _ in range(params.max_rules):
        rule = _grow(rows.filter(left & (F.col("fold") < 2)), cuts, params)
        if not rule:
            break
        rule, n, p = _prune(rows.filter(left), rule)
        if n < params.min_covered or p < params.min_precision * n:
            break
        rules.append(rule)
        left &= ~_conjunction(rule)
    return DecisionList(rules)


def _bin(feature: str, cuts: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: F.col(feature) >= c)) if cuts else F.lit(0)


def _grow(rows: DataFrame, cuts: dict[str, list[float]], params: ListParams) -> list:
    rule: list[tuple[str, str, float]] = []
    for _ in range(params.max_conditions):
        tally = {(r.f, r.b): (r.n, r.p) for r in rows.filter(_conjunction(rule)).select("bad", F.explode("_bins").alias("x")).groupBy("x.f", "x.b").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").alias("p")).collect()}
        best = None
        for k, f in enumerate(FEATURES):
            n, p = (sum(v[i] for (g, _), v in tally.items() if g == k) for i in (0, 1))
            if not p:
                return rule
            below_n = below_p = 0
            for b, at in enumerate(cuts[f]):
                dn, dp = tally.get((k, b), (0, 0))
                below_n, below_p = below_n + dn, below_p + dp
                for op, m, q in (("<", below_n, below_p), (">=", n - below_n, p - below_p)):
                    if m >= params.min_covered and q and m < n and (gain := q * (math.log2(q / m) - math.log2(p / n))) > 0 and (best is None or gain > best[0]):
                        best = gain, (f, op, float(at)), q / m
        if best is None:
            break
        rule = [*rule, best[1]]
        if best[2] > 0.97:
            break
    return rule


def _prune(rows: DataFrame, rule: list) -> tuple[list, int, int]:
    """The rule without final conditions, as long as (p - n) / (p + n) on the held-out rows does not fall; all rows it covers, and the bad ones."""
    sizes = range(1, len(rule) + 1)
    count = lambda c: F.struct(F.count_if(c).alias("n"), F.sum(F.when(c, F.col("bad")).otherwise(0)).alias("p"))
    held = F.col("fold") == 2
    got = rows.agg(*(x for k in sizes for x in (count(held & _conjunction(rule[:k])).alias(f"h{k}"), count(_conjunction(rule[:k])).alias(f"a{k}")))).first()
    worth = {k: (2 * got[f"h{k}"].p - got[f"h{k}"].n) / got[f"h{k}"].n if got[f"h{k}"].n else -1.0 for k in sizes}
    best = max(sizes, key=lambda k: (worth[k], -k))
    return rule[:best], got[f"a{best}"].n, got[f"a{best}"].p or 0


def labelled_statistics(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled documents with ``bad`` and ``fold``."""
    one = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg((F.avg("quality") < 0.5).cast("int").alias("bad"))
    return stats.join(one, "doc_id").select("bad", F.pmod(F.xxhash64("doc_id"), F.lit(3)).alias("fold"), *FEATURES)


def judge(docs: DataFrame, labels: DataFrame, params: ListParams = ListParams()) -> DataFrame:  # noqa: B008
    """One row per document: the statistics, the rule that fires and ``kept``."""
    stats = shared.spill(statistics(docs), "stats")
    rules = learn(shared.spill(labelled_statistics(stats, labels), "labelled"), params)
    return stats.withColumn("rule", rules.which()).withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def filter_quality(docs: DataFrame, labels: DataFrame, params: ListParams = ListParams()) -> DataFrame:  # noqa: B008
    """The rows of ``docs`` that are kept, columns unchanged.

    Rows are written with their statistics, which are so computed once; learning reads the small columns only.
    """
    whole = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col("text"))
    stats = shared.spill(statistics(whole, ["_row"]), "stats")
    small = stats.select(F.col("_row.doc_id").alias("doc_id"), *FEATURES)
    rules = learn(shared.spill(labelled_statistics(small, labels), "labelled"), params)
    return stats.filter(~F.col("base_failed") & ~rules.rejects()).select("_row.*")
