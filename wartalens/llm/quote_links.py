"""Conversations from messages that quote each other. DataFrame functions only.

Lines that begin with ``>`` are quotes; the number of marks is the level. Neighbouring lines of one level
form a passage. A passage is normalised, hashed and joined to the first message whose own text
(without quotes) has the same hash. A message answers the original of its passage of the lowest
level, of several the latest; parents are always earlier. Roots and depths follow by pointer jumps,
and the messages of a root are numbered in reply order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wartalens.llm.common import let, quoted
from wartalens.session import stage

MARKS = r"^(?:[ \t]*>)+"
BLANK = r"[ \t\r\n]+"
ATTRIBUTION = r"^On .* wrote:\s*$"


def blocks(text: Column) -> Column:
    """Runs of lines of one quote level: array of ``struct(level, text)``, without the marks."""
    def tagged(line: Column) -> Column:
        marks = F.regexp_extract(line, MARKS, 0)
        rest = F.substr(line, F.length(marks) + 1)
        return F.struct(
            F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"),
            F.when(marks == "", line).otherwise(F.regexp_replace(rest, "^ ", "")).alias("line"))

    def runs(lines: Column) -> Column:
        starts = F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: (i == 0) | (
            F.get(lines, i)["level"] != F.get(lines, i - 1)["level"]))
        return let(starts, lambda s: F.zip_with(
            s, F.concat(F.slice(s, F.lit(2), F.size(s)), F.array(F.size(lines))),
            lambda a, b: F.struct(
                F.get(lines, a)["level"].alias("level"),
                F.array_join(F.slice(lines["line"], a + 1, b - a), "\n").alias("text"))))

    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: ~x.rlike(ATTRIBUTION))
    return let(F.transform(lines, tagged), lambda t: F.when(F.size(t) > 0, runs(t)).otherwise(
        F.array().cast("array<struct<level:int,text:string>>")))


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \t\r\n]+|[ \t\r\n]+$", "")


def passage_hash(text: Column) -> Column:
    """MD5 of the lower-cased text with single spaces; null without visible text."""
    plain = trimmed(F.lower(F.regexp_replace(text, BLANK, " ")))
    return F.when(plain != "", F.md5(plain))


def parse(messages: DataFrame, message: str = "msg_id", text: str = "text") -> DataFrame:
    """``msg_id, body, passages``: own text without quotes, and the quoted passages with levels."""
    parts = messages.select(quoted(message).cast("bigint").alias("msg_id"), blocks(quoted(text).cast("string")).alias("_b"))
    own = F.array_join(F.transform(F.filter("_b", lambda b: b["level"] == 0), lambda b: b["text"]), "\n")
    quotes = F.transform(F.filter("_b", lambda b: b["level"] > 0), lambda b: F.struct(
        b["level"].alias("level"), passage_hash(b["text"]).alias("hash")))
    return parts.select("msg_id", trimmed(own).alias("body"), F.filter(quotes, lambda q: q["hash"].isNotNull()).alias("passages"))


def parents(parsed: DataFrame) -> DataFrame:
    """``msg_id, parent_id`` of the messages that answer a known earlier one."""
    originals = parsed.select(passage_hash(F.col("body")).alias("hash"), "msg_id").filter(
        "hash is not null and msg_id is not null").groupBy("hash").agg(F.min("msg_id").alias("_first"))
    said = parsed.filter("msg_id is not null").select("msg_id", F.explode("passages").alias("p")).select(
        "msg_id", "p.level", "p.hash").distinct()
    hits = said.join(originals, "hash").filter(F.col("_first") < F.col("msg_id"))
    nearest = hits.groupBy("msg_id").agg(F.min(F.struct("level", (-F.col("_first")).alias("_late"))).alias("_n"))
    return nearest.select("msg_id", (-F.col("_n._late")).alias("parent_id"))


def roots(links: DataFrame) -> DataFrame:
    """``msg_id, root_id, depth`` of linked messages.

    Every jump doubles the reach and is written out; messages that have arrived at their root stay
    where they are, as targets, and only the others jump again.
    """
    moving = stage(links.select("msg_id", F.col("parent_id").alias("root_id"), F.lit(1).cast("bigint").alias("depth")), "reach")
    arrived: list[DataFrame] = []
    while True:
        ahead = reduce(DataFrame.unionByName, [*arrived, moving]).select(
            F.col("msg_id").alias("_at"), F.col("root_id").alias("_root"), F.col("depth").alias("_more"))
        after = stage(moving.join(ahead, F.col("root_id") == F.col("_at"), "left").select(
            "msg_id", F.coalesce("_root", "root_id").alias("root_id"),
            (F.col("depth") + F.coalesce("_more", F.lit(0))).alias("depth"), F.col("_root").isNotNull().alias("_moved")), "reach")
        arrived.append(after.filter("not _moved").drop("_moved"))
        moving = after.filter("_moved").drop("_moved")
        if moving.isEmpty():
            return reduce(DataFrame.unionByName, arrived)


def numbered(rows: DataFrame) -> DataFrame:
    """Add ``position``, from 0 within each root, in order of depth and message.

    Rows are dealt by ranges of root, depth and message, so one conversation may be of any size: a
    row's place is its place within its range plus the root's rows in the ranges before.
    """
    order = ["root_id", "depth", "msg_id"]
    ranged = stage(
        rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(*order, "_row")
        .withColumn("_range", F.spark_partition_id()), "reply-order")
    counts = ranged.groupBy("root_id", "_range").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("root_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(F.col("root_id").alias("_root"), F.col("_range").alias("_in"),
                          F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    nth = F.row_number().over(Window.partitionBy("root_id", "_range").orderBy("depth", "msg_id", "_row"))
    placed = ranged.withColumn("_nth", nth).join(
        bases, F.col("root_id").eqNullSafe(F.col("_root")) & (F.col("_range") == F.col("_in")))
    return placed.select(*rows.columns, (F.col("_base") + F.col("_nth") - 1).alias("position"))


def conversations(messages: DataFrame, message: str = "msg_id", text: str = "text") -> DataFrame:
    """``root_id, position, msg_id, parent_id, depth, n_passages, body``, one row per message.

    Message ids order the messages in time. Messages with a null id come out as rows without links and
    with a null root. Null texts have an empty body. An id given twice is answered and answers by
    each of its rows' passages; both rows take the same parent. Rows, not arrays: a conversation of
    any size is spread over tasks.
    """
    parsed = stage(parse(messages, message, text), "parsed-messages")
    links = stage(parents(parsed), "reply-links")
    placed = (
        parsed.select("msg_id", F.size("passages").cast("bigint").alias("n_passages"), "body")
        .join(links, "msg_id", "left").join(roots(links), "msg_id", "left")
        .select(F.coalesce("root_id", "msg_id").alias("root_id"), "msg_id", "parent_id",
                F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"), "n_passages", "body")
    )
    return numbered(placed)
