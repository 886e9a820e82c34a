r"""Chat formatting: typed content parts become one training string, with DataFrame functions only.

A message has ordered parts (kind, text, ref, amount). A visitor flattens them: text parts are escaped and written out,
image, audio and document parts become numbered placeholders, whose references and expanded token counts are recorded.

    <turn:ROLE>BODY</turn>

Escapes inside roles, texts and references: "\" -> "\b", "<" -> "\l", ">" -> "\g". So "<" and ">" occur in control
strings only, and reading back needs no knowledge of the texts.

Defined results: null text or role counts as empty; a null or empty part list gives an empty turn; equal turns are
ordered by role and text and repeated rows are kept; a null conversation id is a conversation; an unknown kind is an
attachment of no tokens; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PART = "struct<kind:string,text:string,ref:string,amount:double>"

#: Tokens of an attachment: amount (pixels, seconds, pages) times the rate, rounded up.
TOKEN_RATES = {"image": 1 / 784, "audio": 25.0, "document": 600.0}


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<")), F.lit("\\b"), F.lit("\\"))


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def visit(parts: Column) -> Column:
    """struct<body, attachments: array<struct<place, kind, ref, tokens>>> of an array of parts, in order."""
    parts = F.coalesce(parts, F.array().cast(f"array<{PART}>"))
    body = F.array_join(
        F.transform(parts, lambda p, i: F.when(F.coalesce(p.kind, F.lit("text")) == "text", escape(_text(p.text))).otherwise(F.concat(F.lit("<"), escape(p.kind), F.lit(":"), i.cast("string"), F.lit(">")))),
        "",
    )
    tokens = lambda p: F.ceil(F.coalesce(p.amount, F.lit(0.0)) * _rate(p.kind))
    other = F.filter(F.transform(parts, lambda p, i: F.struct(i.alias("place"), p.kind.alias("kind"), p.ref.alias("ref"), tokens(p).cast("long").alias("tokens"))), lambda a: F.coalesce(a.kind, F.lit("text")) != "text")
    return F.struct(body.alias("body"), other.alias("attachments"))


def _rate(kind: Column) -> Column:
    out = F.lit(0.0)
    for name, rate in TOKEN_RATES.items():
        out = F.when(kind == name, F.lit(rate)).otherwise(out)
    return out


def text_parts(text: Column) -> Column:
    """The part list of a message that is only text."""
    return F.array(F.struct(F.lit("text").alias("kind"), _text(text).alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("double").alias("amount")))


def format_conversations(messages: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """messages: conv_id, turn, role, parts. One row per conversation:

    conv_id, n_turns, formatted, mask: array<struct<turn, start, length, offset>> (the bodies of roles to learn: start
    in code points of `formatted`, offset inside their own turn), attachments: array<struct<turn, place, kind, ref,
    tokens>>, attachment_tokens.
    """
    rows = messages.select("conv_id", F.col("turn").alias("__t"), _text(F.col("role")).alias("__role"), visit(F.col("parts")).alias("__v"))
    rows = rows.withColumn("__head", F.concat(F.lit("<turn:"), escape(F.col("__role")), F.lit(">")))
    rows = rows.withColumn("__piece", F.concat(F.col("__head"), F.col("__v.body"), F.lit("</turn>")))
    order = Window.partitionBy("conv_id").orderBy(F.col("__t").asc_nulls_first(), "__role", F.col("__piece"))
    rows = rows.withColumn("__i", F.row_number().over(order) - 1)
    rows = rows.withColumn("__start", F.coalesce(F.sum(F.length("__piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    turn = F.struct(
        F.col("__i").alias("turn"),
        F.col("__piece").alias("piece"),
        F.col("__role").isin(list(learn)).alias("learn"),
        (F.col("__start") + F.length("__head")).alias("start"),
        F.length("__v.body").cast("long").alias("length"),
        F.length("__head").cast("long").alias("offset"),
        F.col("__v.attachments").alias("attachments"),
    )
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("__turns"))
    mask = F.transform(F.filter("__turns", lambda t: t.learn), lambda t: F.struct(t.turn.alias("turn"), t.start.alias("start"), t.length.alias("length"), t.offset.alias("offset")))
    held = F.flatten(F.transform("__turns", lambda t: F.transform(t.attachments, lambda a: F.struct(t.turn.alias("turn"), a.place.alias("place"), a.kind.alias("kind"), a.ref.alias("ref"), a.tokens.alias("tokens")))))
    out = whole.select("conv_id", F.size("__turns").cast("long").alias("n_turns"), F.array_join("__turns.piece", "").alias("formatted"), mask.alias("mask"), held.alias("attachments"))
    return out.withColumn("attachment_tokens", F.aggregate("attachments.tokens", F.lit(0).cast("long"), lambda a, b: a + b))


def pieces_of(formatted: Column) -> Column:
    """The turns of a formatted string, without their end marks."""
    cut = F.split(formatted, "</turn>")
    return F.slice(cut, 1, F.size(cut) - 1)


def read_back(pieces: Column) -> Column:
    """array<struct<role, text>> of pieces_of(); placeholders stay in the text as they are."""
    return F.transform(pieces, lambda p: F.struct(unescape(F.substring_index(F.substr(p, F.lit(7)), ">", 1)).alias("role"), unescape(F.substr(p, F.length(F.substring_index(p, ">", 1)) + 2)).alias("text")))


def masked_text(pieces: Column, mask: Column) -> Column:
    """The unescaped text under the mask, in order; pieces: pieces_of() as a column of its own."""
    return F.array_join(F.transform(mask, lambda m: unescape(F.substr(F.get(pieces, m.turn), (m.offset + 1).cast("int"), m.length.cast("int")))), "")
