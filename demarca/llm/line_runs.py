"""Line dedup over a suffix array of line ids, in DataFrame functions only.

All lines of all documents form one sequence of line ids. Prefix doubling ranks the
suffixes: after k rounds suffixes with equal ranks share their first 2^k lines, and the
ranks are in suffix order, so each rank is an interval of the suffix array whose common
prefix has 2^k lines or more. Only suffixes in intervals of two or more go on, so unique
text leaves after the first round. A run of any length is the meeting of two such
intervals, at its first and its last 2^k lines; the earliest occurrence is kept and later
ones are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demarca.llm.common import keyed, ordered, same_document, stored, words

#: Words that a repeated run of lines must hold.
LEAST_WORDS = 10

DOC = ["doc_id", "text_key"]


def lines(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text_key, pos, line, n_words) of keyed documents; ``line`` is a 64-bit id.

    An end row (null line, no words) follows the last line. Rows repeated in id and text
    are one document.
    """
    parts = F.concat(F.split("text", "\n"), F.array(F.lit(None).cast("string")))
    rows = docs.select(*DOC, F.posexplode(parts).alias("pos", "whole"))
    line = F.when(F.col("whole").isNotNull(), F.xxhash64("whole"))
    return rows.select(*DOC, "pos", line.alias("line"), F.size(words(F.col("whole"))).alias("n_words")).distinct()


def stretches(marked: DataFrame, least_words: int) -> DataFrame:
    """Rows (at, size): the shortest stretches of ``least_words`` words from each line on and up to each line.

    Every run of lines with that many words is a union of such stretches inside it. The
    words before a line are a running sum over its document; the partner line is the
    nearest one whose sum is far enough, which a range frame finds in sorted order.
    """
    doc = Window.partitionBy(*DOC)
    before = F.coalesce(F.sum("n_words").over(doc.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    summed = marked.withColumn("before", before.cast("long"))
    far = lambda order: doc.orderBy(order).rangeBetween(Window.unboundedPreceding, -least_words)
    end = F.min("pos").over(far(F.col("before").desc()))  # the first line that such a stretch need not hold
    start = F.max("pos").over(far(F.col("before")))
    rows = summed.select("at", "pos", end.alias("end"), start.alias("start"))
    ahead = rows.where("end IS NOT NULL").select("at", (F.col("end") - F.col("pos")).alias("size"))
    size = F.col("pos") - F.col("start")
    behind = rows.where("start IS NOT NULL").select((F.col("at") - size).alias("at"), size.alias("size"))
    return ahead.unionByName(behind).distinct()


def ranks(pairs: DataFrame) -> DataFrame:
    """Rows (at, doc, rank) of suffixes whose (first, second) recur; ranks are in the order of the pairs."""
    again = pairs.groupBy("first", "second").count().where("count > 1").select("first", "second")
    named, _ = ordered(again, [F.col("first"), F.col("second")], "rank")
    return stored(pairs.join(named, ["first", "second"]).select("at", "doc", "rank"))


def levels(marked: DataFrame, longest: int) -> DataFrame:
    """Rows (level, at, rank) of the suffixes that share their first 2^level lines with another one."""
    line, none = marked.where("line IS NOT NULL"), F.lit(0).cast("long").alias("second")
    doc = (F.col("at") - F.col("pos")).alias("doc")  # the place of its document's first line
    now, level = ranks(line.select("at", doc, F.col("line").alias("first"), none)), 0
    out = now.select(F.lit(0).alias("level"), "at", "rank")
    while (2 << level) <= longest and not now.isEmpty():
        after = now.select((F.col("at") - (1 << level)).alias("at"), "doc", F.col("rank").alias("second"))
        now, level = ranks(now.withColumnRenamed("rank", "first").join(after, ["at", "doc"])), level + 1
        out = out.unionByName(now.select(F.lit(level).alias("level"), "at", "rank"))
    return out


def later_runs(marked: DataFrame, least_words: int) -> DataFrame:
    """Rows (at, size): stretches whose lines came before, at an earlier place of the sequence."""
    wanted = stored(stretches(marked, least_words))
    longest = wanted.agg(F.max("size")).first()[0] or 0
    rank = levels(marked, longest)
    level = F.floor(F.log2(F.col("size") + F.lit(0.5))).cast("int")
    whole = wanted.withColumn("level", level)
    head = rank.select("level", "at", F.col("rank").alias("head"))
    tail = rank.select("level", F.col("at").alias("tail_at"), F.col("rank").alias("tail"))
    found = whole.join(head, ["level", "at"])
    found = found.withColumn("tail_at", F.expr("at + size - shiftleft(1, level)")).join(tail, ["level", "tail_at"])
    found = stored(found.select("size", "head", "tail", "at"))
    first = stored(found.groupBy("size", "head", "tail").agg(F.min("at").alias("first_at")))  # a very common run can be split
    return found.join(first, ["size", "head", "tail"]).where(F.col("at") > F.col("first_at")).select("at", "size")


def kept_flags(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """Rows (doc_id, text_key, flags): per line whether it stays, for documents that lose lines."""
    marked, _ = ordered(lines(docs), [F.col(c) for c in (*DOC, "pos")], "at")
    starts = later_runs(marked, least_words).groupBy("at").agg(F.max("size").alias("size"))
    doc = Window.partitionBy(*DOC).orderBy("pos")
    covered = F.coalesce(F.max(F.col("at") + F.col("size")).over(doc) > F.col("at"), F.lit(False))
    flagged = marked.join(starts, "at", "left").withColumn("gone", covered).where("line IS NOT NULL")
    flags = F.array_sort(F.collect_list(F.struct("pos", "gone"))).alias("flags")
    lost = flagged.groupBy(*DOC).agg(flags, F.max("gone").alias("any")).where("any")
    return lost.select(*DOC, F.transform("flags", lambda x: ~x["gone"]).alias("flags"))


def kept_lines(text: Column) -> Column:
    """The lines of a text whose flag is set, or all of them without flags."""
    kept = F.array_join(F.filter(F.split(text, "\n"), lambda x, i: F.get("flags", i)), "\n")
    return F.when(F.col("flags").isNull(), text).otherwise(kept)


def dedup(docs: DataFrame, least_words: int = LEAST_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc_id, text, n_lines, n_removed): whole texts without later copies of repeated line runs.

    A run is any number of whole lines in a row, in one document, that hold ``least_words``
    words or more; it is deleted wherever the same lines came before in the order of
    (doc_id, text hash, line), overlaps within one document included. Judged on the input.
    A deleted line goes with its line break. Null texts count as empty ones, an empty text
    is one empty line, rows repeated in id and text are one document and get the same
    result, a null id comes first, and an empty table gives no rows.
    """
    rows = keyed(docs, doc_id, text)
    met = same_document(rows, kept_flags(rows, least_words), "left")
    count = F.size(F.split("text", "\n"))
    gone = F.coalesce(F.size(F.filter("flags", lambda x: ~x)), F.lit(0))
    return met.select(
        "doc_id",
        kept_lines(F.col("text")).alias("text"),
        count.cast("long").alias("n_lines"),
        gone.cast("long").alias("n_removed"),
    )


def without_runs(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """The rows of ``docs`` with later copies of line runs deleted from ``text``; null texts stay null."""
    flags = kept_flags(keyed(docs), least_words)
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own")
    rows = docs.select("doc_id", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("text_key"), own)
    met = same_document(rows, flags, "left")
    text = F.when(F.col("own.text").isNotNull(), kept_lines(F.col("own.text"))).alias("text")
    return met.select(*[text if c == "text" else F.col(f"own.`{c}`") for c in docs.columns])
