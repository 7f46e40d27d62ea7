"""Chat formatting: quotation linking, in DataFrame functions alone.

Lines that begin with quote marks are quoted, as deep as there are marks.  The
quoted passages of a message (each line, and all lines of a level together) are
normalised and hashed, and joined to the first message of the conversation that
says the same itself.  The message quoted at the lowest level is the one that is
answered.  Messages come back without quotes, with the path of turns from the
first message of their thread, by which they sort in the order of replies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import stored

#: Shorter lines, in characters, link nothing where they are a part of what is quoted; a whole quoted level links at any length.
MIN_PASSAGE = 12
_MARKS = r"^[ \t]{0,3}((?:>[ \t]?)+)"
_ATTRIBUTION = r"(?i)^on .+ wrote:\s*$"


def normal(text: Column) -> Column:
    """Lower case, with white space collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def parsed(text: Column) -> Column:
    """The lines of a text as structs (level, body); attributions of quotes have level -1."""

    def line(x: Column) -> Column:
        marks = F.regexp_extract(x, _MARKS, 1)
        level = F.length(F.regexp_replace(marks, "[^>]", ""))
        return F.struct(F.when(x.rlike(_ATTRIBUTION), F.lit(-1)).otherwise(level).alias("level"), F.regexp_replace(x, _MARKS, "").alias("body"))

    return F.transform(F.split(F.coalesce(text, F.lit("")), "\r?\n"), line)


def _passages(messages: DataFrame, min_passage: int) -> DataFrame:
    """(conv_id, turn, level, passage, size): hashes of the lines of ``min_passage`` characters and of the whole levels of each message."""
    levels = F.filter(F.array_distinct(F.transform("lines", lambda x: x["level"])), lambda n: n >= 0)
    whole = F.transform(levels, lambda n: F.struct(n.alias("level"), normal(F.concat_ws(" ", F.transform(F.filter("lines", lambda x: x["level"] == n), lambda x: x["body"]))).alias("text")))
    single = F.transform(F.filter("lines", lambda x: x["level"] >= 0), lambda x: F.struct(x["level"].alias("level"), normal(x["body"]).alias("text")))
    single = F.filter(single, lambda p: F.length(p["text"]) >= min_passage)
    every = messages.select("conv_id", "turn", F.explode(F.array_distinct(F.concat(whole, single))).alias("p")).filter(F.length("p.text") > 0)
    return every.select("conv_id", "turn", F.col("p.level").alias("level"), F.sha2(F.col("p.text"), 256).alias("passage"), F.length("p.text").alias("size"))


def linked(conversations: DataFrame, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """Rows (conv_id, turn, reply_to): the earlier message that each message quotes.

    Of several the one quoted at the lowest level, then with most characters,
    then the latest.  The original of a passage is the first message that says it.
    """
    messages = conversations.select("conv_id", "turn", parsed(F.col("text")).alias("lines"))
    quoting = messages.filter(F.exists("lines", lambda x: x["level"] > 0))
    quotes = _passages(quoting, min_passage).filter("level > 0").groupBy("conv_id", "turn", "passage", "size").agg(F.min("level").alias("level"))
    said = _passages(messages, 1).filter("level = 0").groupBy("conv_id", "passage").agg(F.min("turn").alias("original"))
    pairs = quotes.join(said, ["conv_id", "passage"]).filter("original < turn")
    strength = pairs.groupBy("conv_id", "turn", "original").agg(F.min("level").alias("level"), F.sum("size").alias("size"))
    best = F.max_by("original", F.struct(-F.col("level"), F.col("size"), F.col("original")))
    return strength.groupBy("conv_id", "turn").agg(best.alias("reply_to"))


def reply_ordered(conversations: DataFrame, min_passage: int = MIN_PASSAGE) -> DataFrame:
    """conv_id, turn, role, text (without quotes), reply_to, thread, depth, path, n_quoted, formatted.

    thread is the turn of the first message of the thread and path the turns from
    there; conversations read in the order of replies by (conv_id, path).  A
    message that quotes no earlier one begins a thread.

    conversations: conv_id, turn, role, text; other columns are ignored.  A null
    text is empty and a null role counts as ``user``.  Rows with a null conv_id or
    turn link nothing and have an empty path.  Repeated rows of a turn each get
    their row.  An empty table gives an empty one.
    """
    rows = conversations.select("conv_id", "turn", "role", "text")
    replies = stored(linked(rows.filter("conv_id is not null and turn is not null"), min_passage), "replies")
    # path of each reply up to an ancestor; ancestors are replaced by theirs until none is a reply
    state = replies.select("conv_id", "turn", F.col("reply_to").alias("top"), F.array("reply_to", "turn").alias("path"))
    while True:
        above = state.select("conv_id", F.col("turn").alias("top"), F.col("top").alias("higher"), F.col("path").alias("lead"))
        if not state.join(above, ["conv_id", "top"], "left_semi").take(1):
            break
        step = state.join(above, ["conv_id", "top"], "left")
        longer = F.when(F.col("lead").isNull(), F.col("path")).otherwise(F.concat("lead", F.slice("path", F.lit(2), F.size("path"))))
        state = stored(step.select("conv_id", "turn", F.coalesce("higher", "top").alias("top"), longer.alias("path")), "paths")
    paths = state.select("conv_id", "turn", "path").join(replies, ["conv_id", "turn"])
    out = rows.join(paths, ["conv_id", "turn"], "left").withColumn("lines", parsed(F.col("text")))
    own = F.filter("lines", lambda x: x["level"] == 0)
    path = F.coalesce("path", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), F.array("turn")), F.array().cast("array<bigint>"))
    text = F.trim(F.regexp_replace(F.concat_ws("\n", F.transform(own, lambda x: x["body"])), r"\n{3,}", "\n\n"))
    text = F.regexp_replace(text, r"^\n+|\n+$", "")
    out = out.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), text.alias("text"), "reply_to", path.alias("path"), F.size(F.filter("lines", lambda x: x["level"] > 0)).cast("long").alias("n_quoted"))
    formatted = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("text"), F.lit("\n<|end|>\n"))
    return out.select("conv_id", "turn", "role", "text", "reply_to", F.get("path", F.lit(0)).alias("thread"), (F.size("path") - 1).cast("long").alias("depth"), "path", "n_quoted", formatted.alias("formatted"))
