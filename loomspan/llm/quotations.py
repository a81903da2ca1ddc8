"""Conversations from quotations: quoted passages are linked to the messages they come from, and quotes are taken out.

A line's quote level is the number of > at its start. Lines of level 0 are a message's own words. A passage is a line's
text without marks, or a sentence of neighbouring lines of one level, joined over their ends, so that a quote which a
mail client wraps anew has the same passages; it is lower-cased, with single spaces, and hashed. A quoted passage belongs
to the first message of the conversation (smallest turn) that has it as its own, if that is an earlier turn. A message
answers the message that most of its quoted words come from, among the passages of the lowest level that has links
(deeper levels were quoted by that one in turn); on a tie the later one. Passages of fewer than least_words words decide
only where a message has no longer one that is linked. A thread is what a message without such links starts; a thread in
order of turns has every answer after what it answers.

All of it are DataFrame functions. Originals are aggregated to one turn for each passage before anything is joined, so
common lines make no products, and no task collects a conversation. Originals and steps of threads are written before they
are joined, so a passage that all quote, or a message that all answer, is split over tasks by adaptive execution.

Defined results: a null text is empty; a passage without words links nothing; lines that announce a quote
("... wrote:") go with the quotes, in messages that quote; a null turn or conversation starts a thread of its own and is
never an original; rows of equal conversation and turn keep a row each; an empty table gives an empty one. Columns other
than conv_id, turn, role and text are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.session import durable


@dataclass(frozen=True)
class QuoteOptions:
    least_words: int = 3  #: of passages that decide before shorter ones
    announcement: str = r"(?i)\b(wrote|writes|schrieb|a écrit|escribió)\s*:\s*$"
    shape: str = "<|%s|>\n%s\n"  #: of a formatted message: role and text


MARKS = r"^(?:[ \t]*>)+"


def lines(text: Column) -> Column:
    """(level, raw, passage) of each line."""
    cut = F.split(F.coalesce(text.cast("string"), F.lit("")), "\r?\n", -1)

    def line(x: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(x, MARKS, 0), r"[^>]", ""))
        passage = F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, MARKS, ""), r"[\x20\x09-\x0D]+", " ")))
        return F.struct(level.alias("level"), x.alias("raw"), passage.alias("passage"))

    return F.transform(cut, line)


def sentences(passages: Column) -> Column:
    """The sentences of lines, joined over line ends; an empty line ends one."""
    text = F.regexp_replace(F.array_join(passages, "\n"), r"(?<=[^\n])\n(?=[^\n])", " ")
    return F.split(text, r"\n+|(?<=[.!?])\s+")


def own_passages(own: Column) -> Column:
    """The distinct passages of a message's own lines."""
    lines = F.transform(own, lambda x: x["passage"])
    return F.filter(F.array_distinct(F.concat(lines, sentences(lines))), lambda p: p != "")


def quoted_passages(lines: Column) -> Column:
    """The distinct (level, passage) of a message's quoted lines."""

    def of(level: Column) -> Column:
        held = F.transform(lines, lambda x: F.when(x["level"] == level, x["passage"]).otherwise(""))
        return F.transform(F.concat(held, sentences(held)), lambda p: F.struct(level.alias("level"), p.alias("passage")))

    levels = F.filter(F.array_distinct(F.transform(lines, lambda x: x["level"])), lambda n: n > 0)
    return F.filter(F.array_distinct(F.flatten(F.transform(levels, of))), lambda q: q["passage"] != "")


def words_of(passage: Column) -> Column:
    return F.when(passage == "", 0).otherwise(F.size(F.split(passage, " ")))


def linked(messages: DataFrame, options: QuoteOptions = QuoteOptions()) -> DataFrame:
    """(conv_id, turn, role, text, formatted, n_quoted, n_linked, reply_to, thread): one row for each message.

    text is without quotes; n_quoted and n_linked count distinct passages of a level; reply_to and thread are turns.
    """
    o = options
    rows = messages.select(F.monotonically_increasing_id().alias("row"), "conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), lines(F.col("text")).alias("lines"))
    quotes = F.exists("lines", lambda x: x["level"] > 0)
    own = F.filter("lines", lambda x: (x["level"] == 0) & ~(quotes & F.rlike(x["raw"], F.lit(o.announcement))))
    text = F.trim(F.array_join(F.transform(own, lambda x: x["raw"]), "\n"), F.lit(" \t\r\n"))
    # hashes of passages, so that texts are not written twice
    hashed = F.transform(quoted_passages(F.col("lines")), lambda q: F.struct(q["level"].alias("level"), words_of(q["passage"]).alias("words"), F.xxhash64(q["passage"]).alias("hash")))
    rows = rows.select("row", "conv_id", "turn", "role", text.alias("text"), hashed.alias("quoted"), F.transform(own_passages(own), lambda p: F.xxhash64(p)).alias("own"))
    rows = durable(rows, "messages")
    mine = rows.where("conv_id is not null and turn is not null").select("conv_id", "turn", F.explode("own").alias("hash"))
    first = durable(mine.groupBy("conv_id", "hash").agg(F.min("turn").alias("original")), "first")
    cited = rows.select("row", "conv_id", "turn", F.explode("quoted").alias("q")).select("row", "conv_id", "turn", "q.*")
    links = cited.join(first, ["conv_id", "hash"]).where("original < turn")
    ways = links.groupBy("row", "level", "original").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("words") >= o.least_words, F.col("words")).otherwise(0)).alias("long"), F.count(F.lit(1)).alias("passages"))
    decides = F.struct(F.col("long") == 0, F.col("level"), -F.when(F.col("long") > 0, F.col("long")).otherwise(F.col("words")), -F.col("original"))
    answer = ways.groupBy("row").agg(F.sum("passages").alias("n_linked"), F.min_by("original", decides).alias("reply_to"))
    answer = durable(answer, "answers")
    out = rows.join(answer, "row", "left")
    edges = out.where("reply_to is not null").groupBy("conv_id", "turn").agg(F.min("reply_to").alias("up"))
    edges = roots(durable(edges, "edges"))
    out = out.join(edges, ["conv_id", "turn"], "left")
    return out.select(
        "conv_id",
        "turn",
        "role",
        "text",
        F.format_string(o.shape, F.coalesce("role", F.lit("")), "text").alias("formatted"),
        F.size("quoted").cast("long").alias("n_quoted"),
        F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"),
        "reply_to",
        F.coalesce("up", "turn").alias("thread"),
    )


def roots(edges: DataFrame) -> DataFrame:
    """edges (conv_id, turn, up) with up replaced by the end of the chain that it begins: doubles the steps each round."""
    while True:
        nxt = edges.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"))
        jumped = edges.join(nxt, ["conv_id", "up"], "left")
        new = durable(jumped.select("conv_id", "turn", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved")), "roots")
        edges = new.drop("moved")
        if not new.where("moved").take(1):
            return edges


def conversations(messages: DataFrame, options: QuoteOptions = QuoteOptions()) -> DataFrame:
    """linked, in reply order: by conversation, thread and turn."""
    return linked(messages, options).orderBy("conv_id", "thread", "turn", "role", "text")
