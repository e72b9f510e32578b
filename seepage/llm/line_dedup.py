"""Repeated line runs across documents, found by prefix doubling over line ids; later copies are deleted.

The corpus is one sequence of line ids, document after document. Doubling
gives every position a rank for its next 1, 2, 4, ... lines, equal for equal
runs inside documents: the rank of a run of 2n lines comes from the ranks of
its halves. Ranks are the first positions of their runs, so no job numbers
rows globally, and positions whose run occurs once leave at once. From the
longest runs down, positions with equal ranks are then gathered into groups
that share a prefix of as many lines as they do (the intervals of equal
longest common prefix of the suffix array, whatever the order of the lines).
A group stands in the group around it by its first position alone. In the one
group where a position is not the first, the group's length is that of the
longest run here that also occurs earlier.

A line is deleted if such a run of ``least_words`` words or more covers it, a
word being what ASCII white space separates. The first copy of every run stays. Earlier
means a lower id; a null id comes first; texts of one id come in the order of
their hashes, and rows equal in id and text are one document, each with the
same result. A null text has no lines and stays null; an empty one has one
empty line. An empty table gives no rows. Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.llm.blocks import unused
from seepage.session import settle

LEAST_WORDS = 50


def line_table(docs: DataFrame, *, id_col: str, text_col: str) -> DataFrame:
    """(pos, doc, doc_id, copy, line, h1, h2, words) of every line; pos counts on by one within a document, in order."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("copy"),
                       F.posexplode(F.split(F.col(text_col), "\n", -1)).alias("line", "t"))
    rows = rows.select(
        "doc_id", "copy", "line", F.xxhash64("t").alias("h1"), F.xxhash64(F.lit(1), "t").alias("h2"),
        F.size(F.array_remove(F.split("t", r"[\x09-\x0D\x20]+", -1), "")).alias("words"))
    rows = settle(rows, "lines")
    # In range partitions sorted alike, the running id of Spark's rows is in the order of the documents.
    ordered = rows.repartitionByRange("doc_id", "copy").dropDuplicates(["doc_id", "copy", "line"]).sortWithinPartitions(
        "doc_id", "copy", "line")
    return settle(ordered.withColumn("pos", F.monotonically_increasing_id()).withColumn(
        "doc", F.col("pos") - F.col("line")), "positions")


def _repeated(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(pos, doc, name) of the positions that share their keys with another; name is the first such position.

    The groups are written before the join, so that both its sides are plain
    exchanges, of which Spark splits the partition of a hot key.
    """
    found = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.min("pos").alias("name")).filter("n > 1").drop("n")
    found = settle(found, "repeated")
    return rows.join(found, keys).select("pos", "doc", "name")


def _candidates(lines: DataFrame, least_words: int) -> DataFrame:
    """Positions of repeated lines, with first ranks, in stretches of such lines that have words enough for a run."""
    names = _repeated(lines, ["h1", "h2"])
    rows = names.join(lines.select("pos", "words"), "pos")
    order = Window.partitionBy("doc").orderBy("pos")
    rows = rows.withColumn("stretch", F.col("pos") - F.row_number().over(order))
    own = Window.partitionBy("doc", "stretch")
    rows = rows.withColumn("total", F.sum("words").over(own)).filter(F.col("total") >= least_words)
    return rows.withColumn("words_to", F.sum("words").over(own.orderBy("pos"))).select(
        "pos", "doc", "name", "words", "words_to")


def _doubled(names: DataFrame, step: int) -> DataFrame:
    """Ranks of runs twice as long."""
    second = names.select((F.col("pos") - step).alias("pos"), F.col("doc").alias("doc2"), F.col("name").alias("then"))
    pairs = names.join(second, "pos").filter("doc = doc2").select("pos", "doc", F.col("name").alias("now"), "then")
    return _repeated(settle(pairs, "pairs"), ["now", "then"])


def earlier_runs(ranks: list[DataFrame]) -> DataFrame:
    """(pos, doc, length) of the longest run at each position that also occurs earlier, from the ranks of 1, 2, 4, ... lines."""
    items = ranks[0].select("pos", "doc", F.lit(-1).cast("long").alias("first"), F.lit(0).cast("long").alias("length"))
    for level in range(len(ranks) - 1, -1, -1):
        step = 1 << level
        ahead = ranks[level].select(F.col("pos").alias("at"), F.col("doc").alias("doc2"), F.col("name").alias("next"))
        here = items.join(ahead, (F.col("pos") + F.col("length") == F.col("at")) & (F.col("doc") == F.col("doc2")), "left")
        here = settle(here.select("pos", "doc", "first", "length", "next"), "ahead")
        keys = ["first", "length", "next"]
        groups = here.filter("next IS NOT NULL").groupBy(*keys).agg(
            F.count("*").alias("n"), F.min("pos").alias("head")).filter("n > 1").drop("n")
        groups = settle(groups, "groups")
        marked = settle(here.join(groups, keys, "left"), "runs")
        deeper = marked.filter("head IS NOT NULL").select(
            "pos", "doc", F.col("head").alias("first"), (F.col("length") + step).alias("length"))
        stay = marked.filter("head IS NULL OR head = pos").select("pos", "doc", "first", "length")
        items = deeper.unionByName(stay)
    return items.filter("length > 0 AND pos <> first").select("pos", "doc", "length")


def deleted_lines(docs: DataFrame, least_words: int = LEAST_WORDS, *, id_col: str = "doc_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, copy, gone): the numbers of the deleted lines, from 0, of each document that loses any."""
    lines = line_table(docs, id_col=id_col, text_col=text_col)
    first = settle(_candidates(lines, least_words), "candidates")
    ranks, level = [first.select("pos", "doc", "name")], 0
    while True:
        longer = settle(_doubled(ranks[level], 1 << level), "ranks")
        if longer.isEmpty():
            break
        ranks.append(longer)
        level += 1
    runs = earlier_runs(ranks)
    ends = first.select((F.col("pos") + 1).alias("end"), F.col("words_to").alias("words_end"))
    starts = first.select("pos", (F.col("words_to") - F.col("words")).alias("words_before"))
    runs = runs.withColumn("end", F.col("pos") + F.col("length")).join(ends, "end").join(starts, "pos")
    runs = runs.filter(F.col("words_end") - F.col("words_before") >= least_words).select("pos", "end")
    reach = F.max("end").over(Window.partitionBy("doc").orderBy("pos"))
    covered = first.select("pos", "doc").join(runs, "pos", "left").withColumn("reach", reach).filter(
        F.col("reach") > F.col("pos")).select("pos")
    return lines.join(covered, "pos").groupBy("doc_id", "copy").agg(F.collect_set("line").alias("gone"))


def remaining(text: Column, gone: Column) -> Column:
    """The text without the lines numbered in ``gone``."""
    lines = F.split(text, "\n", -1)
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), gone))
    return F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n")


def without_repeats(docs: DataFrame, least_words: int = LEAST_WORDS, *, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_lines, n_gone, and text without the deleted lines (null if it was null)."""
    gone = deleted_lines(docs, least_words, id_col=id_col, text_col=text_col).select(
        F.col("doc_id").alias("gone_id"), F.col("copy").alias("gone_copy"), "gone")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.withColumn("copy", F.xxhash64("text"))
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("copy") == F.col("gone_copy")), "left")
    text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(remaining(F.col("text"), F.col("gone")))
    n_lines = F.when(F.col("text").isNotNull(), F.size(F.split("text", "\n", -1)))
    return rows.select(
        "doc_id", F.coalesce(n_lines, F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_gone"), text.alias("text"))


def digest(rows: DataFrame) -> DataFrame:
    """``without_repeats`` with the crc32 and the size of the remaining text in the text's place."""
    data = F.coalesce("text", F.lit("")).cast("binary")
    return rows.select("doc_id", "n_lines", "n_gone", F.octet_length(data).cast("long").alias("n_bytes"),
                       F.crc32(data).alias("text_crc32"))


def cleaned(docs: DataFrame, least_words: int = LEAST_WORDS, *, id_col: str = "doc_id", text_col: str = "text",
            size_col: str = "n_chars") -> DataFrame:
    """The documents with all their columns and the remaining texts; those of which no line remains go.

    ``size_col``, if there is one, is set to the characters of a text that has changed.
    """
    gone = deleted_lines(docs, least_words, id_col=id_col, text_col=text_col)
    copy, line_id, line_copy, line_gone = unused(docs.columns, "copy", "line_id", "line_copy", "line_gone")
    key = docs.withColumn(copy, F.xxhash64(F.col(text_col)))
    gone = gone.select(F.col("doc_id").alias(line_id), F.col("copy").alias(line_copy), F.col("gone").alias(line_gone))
    rows = key.join(gone, F.col(id_col).eqNullSafe(F.col(line_id)) & (F.col(copy) == F.col(line_copy)), "left")
    rows = rows.filter(F.col(line_gone).isNull() | (F.size(line_gone) < F.size(F.split(F.col(text_col), "\n", -1))))
    changed = F.col(line_gone).isNotNull()
    rows = rows.withColumn(text_col, F.when(changed, remaining(F.col(text_col), F.col(line_gone))).otherwise(F.col(text_col)))
    if size_col in docs.columns:
        kind = docs.schema[size_col].dataType
        rows = rows.withColumn(size_col, F.when(changed, F.length(F.col(text_col)).cast(kind)).otherwise(F.col(size_col)))
    return rows.select(*docs.columns)
