"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, map_arrow, ship_package, spill, written

__all__ = ["ALNUM_BETWEEN", "ALNUM_WORD", "LOWER", "UPPER", "cut", "cut_blocks", "discard", "let", "likely", "map_arrow", "marked", "n_words", "running", "ship_package", "spill", "table", "words", "written"]
#: What lies between words: ASCII white space.
BETWEEN = r"[\x20\x09-\x0D]+"
#: The same for alphanumeric words, and such a word, of lower-cased text.
ALNUM_BETWEEN, ALNUM_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the package goes to the executors first."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once.

    A plain reference inside a lambda may be inlined by the optimizer and then
    evaluated for every element.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, zero: Column, step) -> Column:
    """The state before each element of an array: ``zero``, then ``step(state, element)``.

    An accumulator that collects an array copies it at every step; here it collects inside pieces of 256 elements,
    and then the pieces, so that rows with very many elements cost about linear time.
    """
    width = 256
    kind = F.array().cast("array<bigint>")

    def within(state, piece):
        start = F.struct(state.cast("bigint").alias("at"), kind.alias("out"))
        return F.aggregate(piece, start, lambda a, x: F.struct(step(a["at"], x).cast("bigint").alias("at"), F.concat(a["out"], F.array(a["at"])).alias("out")))

    def whole(v):
        pieces = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / width).cast("int")), lambda k: F.slice(v, k * width + 1, F.lit(width)))
        start = F.struct(zero.cast("bigint").alias("at"), F.array().cast("array<array<bigint>>").alias("out"))

        def join(a, piece):
            return let(within(a["at"], piece), lambda w: F.struct(w["at"].alias("at"), F.concat(a["out"], F.array(w["out"])).alias("out")))

        return F.when(F.size(v) > 0, F.flatten(F.aggregate(pieces, start, join)["out"])).otherwise(kind)

    return let(values, whole)


BLOCK = 1024


def cut_blocks(text: Column) -> Column:
    """The text in blocks of BLOCK code points, for ``cut``."""
    return F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{BLOCK}}}"), F.lit(0))


def cut(blocks: Column, start: Column, end: Column) -> Column:
    """Code points [start, end) of a text in blocks: a substring of the whole text would be looked for from its beginning."""
    first = F.floor(start / BLOCK).cast("int")
    last = F.floor((end - 1) / BLOCK).cast("int")
    part = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
    return F.when(end > start, F.substr(part, (start - first * BLOCK + 1).cast("int"), (end - start).cast("int"))).otherwise("")


CELLS = 1 << 18


def marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows with ``_likely``: false only where the 64-bit hash ``key`` is not among ``wanted_key``; true for some others too.

    Hashes share a bitmap of CELLS numbers of 64 bits, so that what is broadcast is at most 4 MB of numbers whatever the
    input. It spares a following join the shuffle of what it does not want; with very many wanted hashes, of hardly anything.
    """
    cell = lambda h: F.pmod(h, F.lit(CELLS))
    bit = lambda h: F.pmod(F.shiftright(h, 18), F.lit(64)).cast("int")
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), bit(wanted_key))
    bitmap = wanted.select(cell(wanted_key).alias("_cell"), mask.alias("_mask")).groupBy("_cell").agg(F.bit_or("_mask").alias("_mask"))
    met = rows.withColumn("_cell", cell(key)).withColumn("_bit", bit(key)).join(F.broadcast(bitmap), "_cell", "left")
    return met.withColumn("_likely", F.coalesce(F.getbit("_mask", F.col("_bit")) == 1, F.lit(False))).drop("_cell", "_mask", "_bit")


def likely(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The rows whose 64-bit hash ``key`` may be among ``wanted_key``: no wanted row is lost, some others stay."""
    return marked(rows, key, wanted, wanted_key).filter("_likely").drop("_likely")


def words(text: Column, between: str = BETWEEN) -> Column:
    """The words of a whole text; null has none. Cutting between the words is several times as fast as extracting them."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), between, -1), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def hex_sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)
