"""Chat formatting with typed content parts, as DataFrame expressions only.

A message is (role, parts); a part is a struct (kind, text, uri, units). ``flatten_parts`` visits the parts in order: a run of text
parts becomes its escaped text (joined first, so that no control string hides across parts), every other kind becomes one placeholder ``<|kind:k|>`` (k counts attachments in the
conversation from 0) and an attachment record with its reference, its place and the number of tokens the placeholder expands
to (``units`` times the kind's rate in ``EXPANSION``).

Template: every turn is ``<|turn|>ROLE\\nCONTENT<|end|>\\n``. Control strings (``CONTROL``) inside texts are escaped by one
backslash after their first character, and those that already carry backslashes there by one more, so escaping is
reversible and an escaped text never holds a control string of the template, in however many parts it came. Loss spans are the contents of assistant turns.

Defined results: turns are ordered by (turn, role, text), nulls first, so ties and repeated rows give one order; a null
text is empty, a null role is the empty role; a conversation with a null id is a conversation of its own; an empty table
gives no rows. A conversation is one record: its turns meet in one row, as its formatted text does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import let, whole_text

TURN, END = "<|turn|>", "<|end|>\n"
#: First characters of control strings, and what follows them (after any backslashes).
CONTROL = r"(?=\\*(?:\||/?s>|</?SYS>>|/?INST\]))"
#: Tokens for one unit of an attachment: a 14-pixel image patch group, a 20 ms audio frame pair, a document page.
EXPANSION = {"image": 256, "audio": 25, "document": 512}
PART = "struct<kind:string,text:string,uri:string,units:bigint>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])" + CONTROL, r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\" + CONTROL, "$1")


def escape_role(role: Column) -> Column:
    """A role stands on its own line: newlines and backslashes in it are written as \\n and \\\\."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.array_join(F.transform(F.split(unescape(role), r"\\\\"), lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("kind"), text.alias("text"), F.lit(None).cast("string").alias("uri"), F.lit(None).cast("bigint").alias("units"))).cast(f"array<{PART}>")


def _tokens(part: Column) -> Column:
    rate = F.lit(1)
    for kind, n in EXPANSION.items():
        rate = F.when(part["kind"] == kind, F.lit(n)).otherwise(rate)
    return (F.coalesce(part["units"], F.lit(1)) * rate).cast("bigint")


def _is_text(part: Column) -> Column:
    return F.coalesce(part["kind"], F.lit("text")) == "text"


def flatten_parts(turns: Column) -> Column:
    """Turns (role, parts) -> turns (role, content, attachments): the visitor over typed parts."""
    empty = F.array().cast("array<struct<turn:int,part:int,kind:string,uri:string,placeholder:string,tokens:bigint>>")

    def visit_turn(acc: Column, turn: Column) -> Column:
        def visit_part(inner: Column, part: Column) -> Column:
            k = acc["seen"] + F.size(inner["attachments"])
            mark = F.concat(F.lit("<|"), F.regexp_replace(F.coalesce(part["kind"], F.lit("")), r"[^a-z0-9_]", "_"), F.lit(":"), k.cast("string"), F.lit("|>"))
            record = F.array(F.struct(F.size(acc["turns"]).alias("turn"), inner["at"].alias("part"), part["kind"].alias("kind"), part["uri"].alias("uri"), mark.alias("placeholder"), _tokens(part).alias("tokens")))
            return F.struct(
                F.when(_is_text(part), inner["content"]).otherwise(F.concat(inner["content"], escape(inner["open"]), mark)).alias("content"),
                F.when(_is_text(part), F.concat(inner["open"], F.coalesce(part["text"], F.lit("")))).otherwise(F.lit("")).alias("open"),  # text since the last attachment
                F.when(_is_text(part), inner["attachments"]).otherwise(F.concat(inner["attachments"], record)).alias("attachments"),
                (inner["at"] + 1).alias("at"),
            )

        start = F.struct(F.lit("").alias("content"), F.lit("").alias("open"), empty.alias("attachments"), F.lit(0).alias("at"))
        flat = F.aggregate(F.coalesce(turn["parts"], F.array().cast(f"array<{PART}>")), start, visit_part)
        return let(
            flat,
            lambda f: F.struct(
                F.concat(acc["turns"], F.array(F.struct(turn["role"].alias("role"), F.concat(f["content"], escape(f["open"])).alias("content"), f["attachments"].alias("attachments")))).alias("turns"),
                (acc["seen"] + F.size(f["attachments"])).alias("seen"),
            ),
        )

    start = F.struct(F.array().cast("array<struct<role:string,content:string,attachments:array<struct<turn:int,part:int,kind:string,uri:string,placeholder:string,tokens:bigint>>>>").alias("turns"), F.lit(0).alias("seen"))
    return F.aggregate(turns, start, visit_turn)["turns"]


def conversations_of(messages: DataFrame) -> DataFrame:
    """conv_id and its turns in order, from rows (conv_id, turn, role, text) or (conv_id, turn, role, parts)."""
    parts = F.col("parts") if "parts" in messages.columns else text_parts(whole_text())
    rows = messages.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), parts.alias("parts")).alias("message"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("message")).alias("turns"))
    return grouped.select("conv_id", F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["parts"].alias("parts"))).alias("turns"))


def format_conversations(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (start and end code points), attachments, expanded_tokens."""
    flat = conversations_of(messages).select("conv_id", flatten_parts(F.col("turns")).alias("flat"))
    head = lambda t: F.concat(F.lit(TURN), escape_role(t["role"]), F.lit("\n"))
    pieces = flat.select("conv_id", F.transform("flat", lambda t: F.struct(head(t).alias("head"), t["content"].alias("content"), (t["role"] == "assistant").alias("loss"))).alias("pieces"), F.flatten(F.transform("flat", lambda t: t["attachments"])).alias("attachments"))

    def place(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["head"])
        end = start + F.length(p["content"])
        return F.struct(F.when(p["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["spans"]).alias("spans"), (end + len(END)).alias("at"))

    placed = F.aggregate("pieces", F.struct(F.array().cast("array<struct<start:int,end:int>>").alias("spans"), F.lit(0).alias("at")), place)
    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["content"], F.lit(END))), "").alias("formatted"),
        placed["spans"].alias("loss_spans"),
        "attachments",
        F.aggregate("attachments", F.lit(0).cast("bigint"), lambda a, x: a + x["tokens"]).alias("expanded_tokens"),
    )


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted text."""
    blocks = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)

    def turn(block: Column) -> Column:
        cut = F.locate("\n", block)
        return F.struct(unescape_role(F.substring(block, F.lit(1), cut - 1)).alias("role"), unescape(F.substring(block, cut + 1, F.length(block) - cut - F.lit(len(END)))).alias("text"))

    return F.transform(blocks, turn)


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["end"] - s["start"]))), "")
