"""Chat formatting with typed content parts.

A turn's content is an array of parts (kind, text, ref, units).  A visitor
flattens the parts of all turns in order: text is escaped and written out, an
image, audio or document part becomes a placeholder, and its attachment
reference, place and expanded token count are recorded.

Template: ``<|turn|>role\\ncontent<|end|>\\n``.  Inside texts ``\\`` becomes
``\\e``, ``<`` ``\\l`` and ``[`` ``\\b`` (in roles also a line feed ``\\k``), so that
no control string of this or of another template survives in a text; the
reading side undoes it.  The loss mask is a list of code-point spans of the
formatted string that hold assistant text.

Edge cases: null role or text: empty; rows of a conversation are ordered by
(turn, role, text), nulls first, and repeated rows all count; a null conv_id is
one conversation; an unknown part kind is written as a document placeholder;
an empty table gives an empty result; a conversation of very many turns or very
long texts costs about linear time; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared

START, END = "<|turn|>", "<|end|>\n"
#: Tokens that one unit of a part stands for: an image tile, a second of audio, a document page.
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,ref:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\e")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("[")), F.lit("\\e"), F.lit("\\"))


def _visit(part: Column) -> Column:
    """One part's text in the formatted string."""
    kind = F.when(part["kind"].isin(*EXPANSION), part["kind"]).otherwise("document")
    return F.when(F.coalesce(part["kind"], F.lit("text")) == "text", escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), kind, F.lit("|>")))


def _cost(part: Column) -> Column:
    each = F.lit(0)
    for kind, n in EXPANSION.items():
        each = F.when(part["kind"] == kind, n).otherwise(each)
    each = F.when(~part["kind"].isin("text", *EXPANSION), EXPANSION["document"]).otherwise(each)
    return F.coalesce(each * F.coalesce(part["units"], F.lit(1)), F.lit(0)).cast("long")


def text_parts(text: Column) -> Column:
    """A plain text as typed parts."""
    return F.array(F.struct(F.lit("text").alias("kind"), F.coalesce(text, F.lit("")).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("bigint").alias("units")))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``turns``: conv_id, turn, role, parts (array of PART).

    Returns conv_id, formatted, loss_spans (array of start, end in code points), attachments
    (array of turn place, kind, ref, expanded tokens; in order) and n_expanded.
    """
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("\n"), F.lit("\\k"))
    body = F.array_join(F.transform("parts", _visit), "")
    media = F.transform(F.filter("parts", lambda p: F.coalesce(p["kind"], F.lit("text")) != "text"), lambda p: F.struct(F.col("turn").alias("turn"), p["kind"].alias("kind"), p["ref"].alias("ref"), _cost(p).alias("tokens")))
    each = turns.select("conv_id", F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.concat(F.lit(START), role, F.lit("\n")).alias("head"), body.alias("body"), media.alias("media")).alias("t"))
    # the formatted conversation is one value, so its turns have to meet; nothing else is gathered with them
    whole = each.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    starts = shared.running(F.col("ts"), F.lit(0), lambda at, t: at + F.length(t["head"]) + F.length(t["body"]) + len(END))

    def span(at, t):
        lo = at + F.length(t["head"])
        return F.struct((t["role"] == "assistant").alias("on"), lo.alias("start"), (lo + F.length(t["body"])).alias("end"))

    spans = F.filter(F.zip_with(starts, "ts", span), lambda s: s["on"])
    attachments = F.flatten(F.transform("ts", lambda t: t["media"]))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("ts", lambda t: F.concat(t["head"], t["body"], F.lit(END))), "").alias("formatted"),
        F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))).alias("loss_spans"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_expanded"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (array of role, text) and loss_texts, from the formatted string and the mask alone."""
    pieces = F.filter(F.split("formatted", r"<\|turn\|>", -1), lambda x: x != "")
    cut = lambda x: F.struct(unescape(F.replace(F.substring_index(x, "\n", 1), F.lit("\\k"), F.lit("\n"))).alias("role"), unescape(F.substr(x, F.locate("\n", x) + F.lit(1), F.length(x) - F.locate("\n", x) - F.lit(len(END)))).alias("text"))
    masked = shared.let(shared.cut_blocks(F.col("formatted")), lambda b: F.transform("loss_spans", lambda s: unescape(shared.cut(b, s["start"], s["end"]))))
    return formatted.select("*", F.transform(pieces, cut).alias("turns"), masked.alias("loss_texts"))


def digests(formatted: DataFrame) -> DataFrame:
    back = read_back(formatted)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.size("attachments").cast("long").alias("n_attachments"),
        F.col("n_expanded").alias("n_expanded_tokens"),
    )
