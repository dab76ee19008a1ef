"""Personal data: patterns with checks, and information-theoretic sanitisation.

Base kinds are leftmost non-overlapping pattern matches that pass a check.
Their values are the protected entities.  A term (a lower-cased alphanumeric
word) next to an entity discloses it by pointwise mutual information, estimated
over documents: log(p(entity | term) / p(entity)) / -log p(entity), which is 1
where the term fully determines the entity.  Terms over the threshold, seen next
to the entity in enough different texts, become spans of kind ``term`` wherever
they occur: they are removed where they determine the entity, else generalised.

Matches and their places come from the same regular expression twice: ``split``
gives the gaps, ``regexp_extract_all`` the matches between them, and lengths in
code points add up to offsets.

Edge cases: a null text is empty and has no spans; repeated rows are judged
alike and count as documents, but copies of one text count once towards a
term's support; long runs of name characters or digits cost linear time (each
run is tried from its start only), and so do very many matches in one text; an
empty table gives an empty result; extra columns are kept by ``sanitise`` and
ignored elsewhere, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

# A match can start only where a run starts or where the last match ended (\G): from any other place in the run
# it would end, or fail, at the same point.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap test that any text with a match passes.
HINTS = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}
KINDS = tuple(PATTERNS)
SPAN = "array<struct<start:bigint,end:bigint,hit:string,before:string,after:string,last:boolean>>"


@dataclass(frozen=True)
class PiiParams:
    context_chars: int = 64  # on each side of an entity
    context_words: int = 6
    min_term: int = 4  # characters of a term
    min_texts: int = 3  # different texts in which a term stands next to an entity
    threshold: float = 0.8  # of the normalised mutual information
    min_given: float = 0.5  # p(entity | term)
    remove_from: float = 0.999  # p(entity | term) from which a term is removed, not generalised
    broadcast_bytes: int = 8 << 20  # of terms up to which they are sent to all tasks; more are joined by a shuffle


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    def add(acc, i):
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d * 2 > 9, d * 2 - 9).otherwise(d * 2)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(hit, r"\."), lambda x: F.regexp_replace(x, "^0+(?=[0-9])", "").rlike("^([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    if kind == "card":
        n = F.length(_digits(hit))
        return F.when(n.between(16, 19), shared.let(_digits(hit), _luhn)).otherwise(False)
    if kind == "phone":
        return F.length(_digits(hit)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str, context: int) -> Column:
    """Valid matches of a kind in order, with the text next to them."""
    pattern = PATTERNS[kind]
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def place(z):
        hits = F.slice(z, F.lit(1), F.size(z) - 1)
        return shared.let(shared.running(hits, F.lit(0), lambda at, x: at + F.length(x["gap"]) + F.length(x["hit"])), lambda at: F.filter(F.transform(hits, lambda x, i: one(z, at, x, i)), lambda s: _valid(kind, s["hit"])))

    def one(z, at, x, i):
        lo = F.get(at, i) + F.length(x["gap"])
        sides = F.right(x["gap"], F.lit(context)).alias("before"), F.left(F.get(z, i + 1)["gap"], F.lit(context)).alias("after")
        return F.struct(lo.alias("start"), (lo + F.length(x["hit"])).alias("end"), x["hit"].alias("hit"), *sides, (i + 2 == F.size(z)).alias("last"))

    placed = shared.let(pairs, lambda z: F.when(F.size(z) > 1, place(z)).otherwise(F.array().cast(SPAN)))
    return F.when(text.rlike(HINTS[kind]), placed).otherwise(F.array().cast(SPAN))


def with_base(docs: DataFrame, keep: list, params: PiiParams) -> DataFrame:
    """``keep`` columns, _rid, _t and one array of spans per kind (_email ...); written, so that the patterns run once.

    Contexts have one character more than the parameter, which tells whether they are cut.
    """
    t = docs.select(*keep, F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    made = t.select("*", F.monotonically_increasing_id().alias("_rid"), *(base_spans(F.col("_t"), k, params.context_chars + 1).alias(f"_{k}") for k in KINDS))
    return shared.spill(made, "base")


def _tagged(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s.alias("s"))


def _placed(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("generalise").alias("action"))


def _context_terms(params: PiiParams) -> Column:
    clean = lambda x: F.regexp_extract_all(F.translate(F.regexp_replace(x, r"\S*[@+0-9]\S*", " "), shared.UPPER, shared.LOWER), F.lit(shared.ALNUM_WORD), F.lit(0))
    # the outer word goes if the width of the context cuts it, and what adjoins another match, as it is part of a word
    part = lambda x, pattern: F.regexp_replace(F.translate(x, shared.UPPER, shared.LOWER), pattern, "")
    cut = lambda x: F.length(x) > params.context_chars
    left = F.when(cut("s.before"), F.regexp_replace("s.before", r"^\S*", "")).when(F.length("s.before") < F.col("s.start"), part("s.before", "^" + shared.ALNUM_WORD)).otherwise(F.col("s.before"))
    right = F.when(cut("s.after"), F.regexp_replace("s.after", r"\S*$", "")).when(~F.col("s.last"), part("s.after", shared.ALNUM_WORD + "$")).otherwise(F.col("s.after"))
    before = shared.let(clean(left), lambda w: F.slice(w, F.greatest(F.size(w) - params.context_words + 1, F.lit(1)), F.lit(params.context_words)))
    before = F.when(F.length(F.trim("s.before")) > 0, before).otherwise(F.array().cast("array<string>"))
    after = F.slice(clean(right), 1, params.context_words)
    return F.filter(F.array_distinct(F.concat(before, after)), lambda x: F.length(x) >= params.min_term)


def _words(text: Column, params: PiiParams) -> Column:
    """The distinct words of a text that may be terms, in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), shared.ALNUM_BETWEEN, -1)), lambda w: F.length(w) >= params.min_term)


def _holders(base: DataFrame, wanted: DataFrame, params: PiiParams) -> DataFrame:
    """_rid, term: which rows hold which of the wanted terms. Words that are not wanted go before any shuffle if the wanted ones are small."""
    size = wanted.agg(F.sum(F.octet_length("term") + 16)).first()[0] or 0
    small = F.broadcast(wanted) if size <= params.broadcast_bytes else wanted
    return base.select("_rid", F.explode(_words(F.col("_t"), params)).alias("term")).join(small, "term", "left_semi")


def disclosing_terms(base: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:  # noqa: B008
    """term, given (p(entity | term)), score: the terms that disclose an entity. ``base``: the whole corpus, of ``with_base``."""
    listed = F.concat(*(F.transform(f"_{k}", _tagged(k)) for k in KINDS))
    spans = base.filter(F.greatest(*(F.size(f"_{k}") for k in KINDS)) > 0).select(F.xxhash64("_t").alias("did"), F.explode(listed).alias("x")).select("did", "x.kind", "x.s")
    value = F.when(F.col("kind").isin("card", "phone"), _digits(F.col("s.hit"))).otherwise(F.lower("s.hit"))
    # a span of each different text, with the rows that hold it: all probabilities below are of rows
    held = spans.groupBy("did", "kind", "s").agg(F.count(F.lit(1)).alias("rows")).select("did", "rows", "s", F.sha2(F.concat_ws(":", "kind", value), 256).alias("entity"))
    held = shared.spill(held, "entities")
    near = held.select("did", "rows", "entity", F.explode(_context_terms(params)).alias("term"))
    # a text counts once, whatever the number of its contexts
    pairs = near.groupBy("entity", "term", "did").agg(F.max("rows").alias("rows")).groupBy("entity", "term").agg(F.sum("rows").alias("together"), F.count(F.lit(1)).alias("texts"))
    # a term stands in at least the rows where it is next to any entity; that bounds p(entity | term) from above, so
    # what cannot reach min_given needs no count over the corpus
    around = near.groupBy("term", "did").agg(F.max("rows").alias("rows")).groupBy("term").agg(F.sum("rows").alias("n_near"))
    pairs = pairs.filter(F.col("texts") >= params.min_texts).join(around, "term").filter(F.col("together") >= params.min_given * F.col("n_near"))
    pairs = shared.spill(pairs, "pairs")
    if pairs.isEmpty():  # nothing stands next to an entity often enough: the corpus counts would meet no term
        return pairs.select("term", F.lit(0.0).alias("given"), F.lit(0.0).alias("score"))
    entities = held.groupBy("entity", "did").agg(F.max("rows").alias("rows")).groupBy("entity").agg(F.sum("rows").alias("n_entity"))
    counts = _holders(base, shared.spill(pairs.select("term").distinct(), "wanted"), params).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    n = base.count()
    given, p = F.col("together") / F.greatest("n_term", "n_near"), F.col("n_entity") / F.lit(float(max(n, 1)))
    scored = pairs.join(counts, "term").join(entities, "entity").select("term", given.alias("given"), (1 - F.log(given) / F.log(F.least(p, F.lit(0.999999)))).alias("score"))
    return scored.filter((F.col("score") >= params.threshold) & (F.col("given") >= params.min_given)).groupBy("term").agg(F.max("given").alias("given"), F.max("score").alias("score"))


def find(docs: DataFrame, params: PiiParams = PiiParams(), keep: list | None = None) -> DataFrame:  # noqa: B008
    """``keep`` columns, _t and _spans: array of (kind, start, end, action) by kind as listed, then start.

    ``keep`` defaults to doc_id. Rows are joined by a number of their own, so that any row, repeated or without an id, keeps its spans.
    """
    base = with_base(docs, [F.col("doc_id")] if keep is None else keep, params)
    terms = shared.spill(disclosing_terms(base, params), "terms")
    if terms.isEmpty():
        with_terms = base.withColumn("_terms", F.array().cast(TERMS))
    else:
        met = _holders(base, terms.select("term"), params).join(terms, "term").groupBy("_rid").agg(F.map_from_entries(F.collect_list(F.struct("term", "given"))).alias("_met"))
        with_terms = base.join(shared.spill(met, "met"), "_rid", "left").withColumn("_terms", _term_spans())
    base_part = F.concat(*(F.transform(f"_{k}", _placed(k)) for k in KINDS))
    term_part = F.transform("_terms", lambda s: F.struct(F.lit("term").alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.when(s["given"] >= params.remove_from, "remove").otherwise("generalise").alias("action")))
    rest = [c for c in with_terms.columns if c not in ("_rid", "_met", "_terms", *(f"_{k}" for k in KINDS))]
    return with_terms.select(*(F.col(f"`{c}`") for c in rest), F.concat(base_part, term_part).alias("_spans"))


#: Characters of no alphanumeric word, of either case.
NO_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
TERMS = "array<struct<start:bigint,end:bigint,given:double>>"


def _term_spans() -> Column:
    # words of either case in the text as it is, so that places hold whatever a letter becomes in lower case
    pairs = F.arrays_zip(F.split("_t", f"[^{NO_WORD}]+", -1).alias("gap"), shared.words(F.col("_t"), f"[{NO_WORD}]+").alias("hit"))

    def place(z):
        return shared.let(shared.running(z, F.lit(0), lambda a, x: a + F.length(x["gap"]) + F.length(F.coalesce(x["hit"], F.lit("")))), lambda a: F.filter(F.transform(z, lambda x, i: one(a, x, i)), lambda s: s["given"].isNotNull()))

    def one(at, x, i):
        lo = F.get(at, i) + F.length(x["gap"])
        return F.struct(lo.alias("start"), (lo + F.length(x["hit"])).alias("end"), F.try_element_at(F.col("_met"), F.lower(x["hit"])).alias("given"))

    return F.when(F.col("_met").isNull(), F.array().cast(TERMS)).otherwise(shared.let(pairs, place))


def detect(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:  # noqa: B008
    """doc_id, n_<kind>, base_sha256, spans and n_term of every document."""
    found = find(docs, params)
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("_spans", lambda s: s["kind"] != "term")
    count = lambda k: F.size(F.filter("_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in KINDS),
        F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("_spans", text), ",").alias("spans"), count("term").alias("n_term"),
    )


def sanitise(docs: DataFrame, params: PiiParams = PiiParams()) -> DataFrame:  # noqa: B008
    """``docs`` with its texts' spans generalised to [KIND] or removed; other columns and null texts unchanged."""
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row")
    found = find(docs, params, [whole])
    by_start = F.array_sort(F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg"), s["end"].alias("end"), s["kind"].alias("kind"), s["action"].alias("action"))))
    # the end of what is covered before each span; a span that starts inside is cut to what it adds, without a label of its own
    covered = lambda s: shared.let(shared.running(s, F.lit(0), lambda at, x: F.greatest(at, x["end"])), lambda at: F.filter(F.transform(s, lambda x, i: piece(F.get(at, i), x)), lambda x: x["end"] > x["at"]))

    def piece(at, x):
        label = F.when((x["action"] == "remove") | (x["start"] < at), "").otherwise(F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))
        return F.struct(at.alias("at"), F.greatest(x["start"], at).alias("start"), x["end"].alias("end"), label.alias("label"))

    def rebuilt(cuts):
        return shared.let(shared.cut_blocks(F.col("_t")), lambda b: F.concat(F.array_join(F.transform(cuts, lambda x: F.concat(shared.cut(b, x["at"], x["start"]), x["label"])), ""), shared.cut(b, F.element_at(cuts, -1)["end"], F.length("_t"))))

    made = F.when(F.col("_row.text").isNull(), F.lit(None)).when(F.size("_spans") == 0, F.col("_t")).otherwise(shared.let(shared.let(by_start, covered), rebuilt))
    return found.select("_row", made.alias("_new")).select(*((F.col("_new").alias("text") if c == "text" else F.col(f"_row.`{c}`").alias(c)) for c in docs.columns))
