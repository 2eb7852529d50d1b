"""Chats in reply order, without quotes.

A line is quoted at the level of its leading `>` signs. A passage is a run of lines of one level in a message, without
the lines that are empty; it is normalised (white space, case) and hashed. A passage quoted at one level is found,
within the conversation, by its hash in the first message that has it at the level below: what is quoted once was said,
what is quoted twice was quoted once. Lines of a passage that no earlier message has whole are looked up one by one in
the first messages that say them. A message replies to the source of its shallowest quotes: the one that most of those
lines come from, the latest of equals. Quotes go from the text; messages are put in threads, each under its first
message, ordered by turn.

Only DataFrame functions are used. What many messages say is one row (the first) before it is joined, and what many
quote is joined to that row, so nothing grows with the square of a group. Roots are found by doubling reply
links. Positions come from one sort by range and two prefix sums, so a conversation of any size is spread over tasks.

Defined cases: null and empty texts stay as they are, without quotes; a message that quotes only itself, or what
nobody said before, has no reply_to; rows that share conversation and turn share their quotes; without conversation or
turn a message links with nothing, and without conversation it has no position; equal rows get positions in any
order; an empty table gives an empty result; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.common import shared_dir, stored

QUOTED = r"^(?:[ \t]*>)+"
_SPACE = r"[ \t\x0B\f\r]+"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, QUOTED, 0), "[^>]", ""))


def _plain(line: Column) -> Column:
    """A line without its quote signs, white space and case apart."""
    return F.trim(F.lower(F.regexp_replace(F.regexp_replace(line, QUOTED, ""), _SPACE, " ")))


def passages(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text) -> (conv_id, turn, level, passage, lines): every passage with its hash and those of its lines."""
    read = messages.select("conv_id", "turn", F.transform(_lines(F.col("text")), lambda x: F.struct(_level(x).alias("level"), _plain(x).alias("plain"))).alias("ls"))
    n = F.size("ls")
    new = lambda k: (k == 0) | (F.get("ls", k)["level"] != F.get("ls", k - 1)["level"])
    cut = read.withColumn("starts", F.filter(F.sequence(F.lit(0), n - 1), new))
    words = lambda s, j: F.filter(F.transform(F.slice("ls", s + 1, F.coalesce(F.get("starts", j + 1), n) - s), lambda x: x["plain"]), lambda x: x != "")
    runs = cut.select("conv_id", "turn", F.explode(F.transform("starts", lambda s, j: F.struct(F.get("ls", s)["level"].alias("level"), words(s, j).alias("lines")))).alias("run"))
    kept = runs.select("conv_id", "turn", "run.level", "run.lines").where(F.size("lines") > 0)
    return kept.select("conv_id", "turn", "level", F.md5(F.array_join("lines", "\n")).alias("passage"), F.transform("lines", F.md5).alias("lines"))


def reply_links(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, text) -> (conv_id, turn, reply_to): what each message with quotes replies to."""
    known = messages.where(F.col("conv_id").isNotNull() & F.col("turn").isNotNull())
    quoting = known.where(F.col("text").rlike("(?m)" + QUOTED))
    quotes = passages(quoting).where("level > 0")
    there = passages(known.join(quoting.select("conv_id").distinct(), "conv_id", "left_semi"))
    whole = there.groupBy("conv_id", (F.col("level") + 1).alias("level"), "passage").agg(F.min("turn").alias("source"))
    said = there.where("level = 0").select("conv_id", "turn", F.explode("lines").alias("line")).groupBy("conv_id", "line").agg(F.min("turn").alias("source"))
    traced = quotes.join(whole, ["conv_id", "level", "passage"], "left").withColumn("source", F.when(F.col("source") < F.col("turn"), F.col("source")))
    of_passages = traced.where("source is not null").select("conv_id", "turn", "level", "source", F.size("lines").alias("n"))
    loose = traced.where("source is null").select("conv_id", "turn", "level", F.explode("lines").alias("line"))
    of_lines = loose.join(said, ["conv_id", "line"]).where("source < turn").select("conv_id", "turn", "level", "source", F.lit(1).alias("n"))
    votes = of_passages.union(of_lines).groupBy("conv_id", "turn", "level", "source").agg(F.sum("n").alias("n"))
    return votes.groupBy("conv_id", "turn").agg(F.max(F.struct((-F.col("level")).alias("near"), "n", "source")).getField("source").alias("reply_to"))


def roots(links: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(conv_id, turn, reply_to) -> (conv_id, turn, thread): the message at the end of the reply links, which fall in turn.

    Each round doubles the links that a message has followed; rounds end as checkpoints in the shared folder.
    """
    shared_dir(links.sparkSession)
    now = links.select("conv_id", "turn", F.col("reply_to").alias("thread")).checkpoint()
    for _ in range(max_rounds):
        above = now.select("conv_id", F.col("turn").alias("thread"), F.col("thread").alias("next"))
        now = now.join(above, ["conv_id", "thread"], "left").select("conv_id", "turn", F.coalesce("next", "thread").alias("thread"), F.col("next").isNotNull().alias("moved")).checkpoint()
        if not now.where("moved").limit(1).count():
            break
        now = now.drop("moved")
    return now.select("conv_id", "turn", "thread")


def conversations(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row for each row of df: conv_id, position, turn, role, text (without quotes), n_quoted, reply_to, thread."""
    spark = df.sparkSession
    rows = df.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("text"))
    links = stored(reply_links(rows))
    threads = links.join(roots(links), ["conv_id", "turn"])
    is_quote = lambda x: x.rlike(QUOTED)
    plain = rows.select("conv_id", "turn", "role", F.array_join(F.filter(_lines(F.col("text")), lambda x: ~is_quote(x)), "\n").alias("text"), F.coalesce(F.size(F.filter(_lines(F.col("text")), is_quote)), F.lit(0)).cast("long").alias("n_quoted"))
    linked = plain.join(threads, ["conv_id", "turn"], "left").withColumn("thread", F.coalesce("thread", "turn"))
    order = [F.col("conv_id").asc_nulls_last(), F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last()]
    # written before its places are used, as a range partitioning that is computed again may cut elsewhere
    placed = stored(linked.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part, place = F.shiftright("__place", 33), F.col("__place").bitwiseAND((1 << 33) - 1)
    before, bases = 0, []
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():  # one row a partition
        bases.append((r["part"], before))
        before += r["count"]
    base = spark.createDataFrame(bases, "__part long, __base long")
    global_place = placed.join(base, part == F.col("__part")).withColumn("__at", F.col("__base") + place)
    first = global_place.where("conv_id is not null").groupBy("conv_id").agg(F.min("__at").alias("__first"))
    return global_place.join(first, "conv_id", "left").select("conv_id", (F.col("__at") - F.col("__first")).alias("position"), "turn", "role", "text", "n_quoted", "reply_to", "thread")
