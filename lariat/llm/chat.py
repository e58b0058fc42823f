"""Chat formatting with Spark expressions only.

A conversation's turns are sorted structs; adjacent turns of a role become one block by slices of the sorted array:

    ### user: first text</part>second text</turn>
    ### assistant: answer</turn>

Inside texts and roles the control strings, and the backslash that escapes them, become codes of a backslash and a
letter, so no control string can come from a text and each code has one reading. The loss mask is a list of ranges of
code points: every assistant text, one range each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed codes; the backslash's is applied first and undone last.
CODES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t"), ("</part>", "\\p")]
ROLE_CODES = [(": ", "\\c"), ("\n", "\\n")]


def escape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in codes:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in reversed(codes):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def format_chats(rows: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans) per conversation of rows (conv_id, turn, role, text).

    Turns stand in the order of (turn, role, text), nulls first; null roles and texts are empty; repeated rows are turns
    of their own; null conv_ids are one conversation. loss_spans: (start, length) in code points from 0. One
    conversation is one output string, so its turns meet in one row. An empty table gives no rows.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    turns = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", role.alias("role"), text.alias("text")))).alias("turns"))
    at = lambda i: F.element_at("turns", i.cast("int"))
    starts = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: (i == 1) | (at(F.greatest(i - 1, F.lit(1)))["role"] != at(i)["role"]))
    turns = turns.withColumn("starts", starts)
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("turns") + 1))
    blocks = F.zip_with("starts", ends, lambda s, e: F.struct(at(s)["role"].alias("role"), F.transform(F.slice("turns", s, e - s), lambda t: escape(t["text"])).alias("texts")))
    blocks = turns.select("conv_id", blocks.alias("blocks"))
    # A part is the marks before a text, the text, and the marks after it.
    parts = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, i: F.struct(
                    F.when(i == 0, F.concat(F.lit("### "), escape(b["role"], CODES + ROLE_CODES), F.lit(": "))).otherwise(F.lit("</part>")).alias("before"),
                    t.alias("text"),
                    F.when(i == F.size(b["texts"]) - 1, F.lit("</turn>\n")).otherwise(F.lit("")).alias("after"),
                    (b["role"] == F.lit(loss_role)).alias("loss"),
                ),
            ),
        )
    )
    parts = blocks.select("conv_id", parts.alias("parts"))
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["before"], p["text"], p["after"])), "")
    size = lambda c: F.length(c).cast("long")
    # One pass along the parts carries the place of the next one.
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))
    walked = F.aggregate(
        "parts",
        start,
        lambda a, p: F.struct(
            (a["at"] + size(p["before"]) + size(p["text"]) + size(p["after"])).alias("at"),
            F.when(p["loss"], F.concat(a["spans"], F.array(F.struct((a["at"] + size(p["before"])).alias("start"), size(p["text"]).alias("length"))))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return parts.select("conv_id", formatted.alias("formatted"), walked.alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_text) out of formatted strings and masks alone; turns: array of (role, text)."""
    blocks = F.filter(F.split("formatted", "</turn>\n"), lambda b: b.startswith("### "))

    def turns_of(block: Column) -> Column:
        role = F.substring_index(block, ": ", 1)
        body = F.substring(block, F.length(role) + 3, F.length(block))
        return F.transform(F.split(body, "</part>"), lambda t: F.struct(unescape(F.substring(role, F.lit(5), F.length(role)), CODES + ROLE_CODES).alias("role"), unescape(t).alias("text")))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int")))), "")
    return chats.select("conv_id", F.flatten(F.transform(blocks, turns_of)).alias("turns"), loss.alias("loss_text"), "formatted")
