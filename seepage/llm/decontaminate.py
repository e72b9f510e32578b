"""Benchmark decontamination by a prefix-filtered join of item windows with document words.

Every window of an item is a set of shingles that a document must contain
whole, so one necessary shingle, its rarest, is all the prefix it needs. The
documents are read once: a Python pass cuts each into words and keeps the runs
of benchmark words that are long enough to hold a window (the length bound).
The runs' shingles meet the windows' prefix shingles in an equi-join; where
the shingle stands in the window fixes where the window would start
(the positional bound), and the words there are compared exactly.

A null text, an empty one and one without words have no words and no hits. An
item without words is in no document. Equal items are hit together. Repeated
documents each have their row; the rows of one doc_id count as one document's
separate texts, told apart by their text. Empty tables give no rows, or no
hits. Other columns are ignored.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.llm.blocks import unused
from seepage.session import settle

#: Fixed by the contract, in bytes: what is not a digit, a small letter or beyond ASCII.
WORD_BYTES = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 10
SHINGLE = 3
#: Benchmark words that one pass over the documents looks for at most; more words take more passes.
PASS_WORDS = 500_000

_BLANKED = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else c + 32 if 0x41 <= c <= 0x5A else 32
                 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased."""
    return text.encode().translate(_BLANKED).split() if text else []


def words(text: Column) -> Column:
    """The same as a column of strings."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"), F.lit(1))


def windows(items: DataFrame, size: int = WINDOW, *, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Distinct windows (win, words) with the ids of the items that hold them."""
    cut = items.select(F.col(id_col).alias("item_id"), words(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - size + 1, F.lit(1)))
    each = cut.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("words"))
    return each.groupBy("words").agg(F.collect_set("item_id").alias("item_ids")).select(
        F.xxhash64("words").alias("win"), "words", "item_ids"
    )


def _runs(needed: dict[int, frozenset]):
    """Arrow function: every document's word count, and its runs of the words that windows of each length need."""
    def found(ws: list[bytes]) -> list[tuple[int, list[bytes]]]:
        spans = []
        for length, vocabulary in needed.items():
            marks = bytes(map(vocabulary.__contains__, ws))  # 1 for a word of the windows, 0 for another
            spans += [m.span() for m in re.finditer(b"\x01{%d,}" % length, marks)]
        if not spans:
            return []
        spans.sort()
        out = [list(spans[0])]
        for a, b in spans[1:]:
            if a <= out[-1][1]:
                out[-1][1] = max(out[-1][1], b)
            else:
                out.append([a, b])
        return [(a, ws[a:b]) for a, b in out]

    kind = pa.list_(pa.struct([("at", pa.int32()), ("words", pa.list_(pa.string()))]))

    def run(batches):
        for batch in batches:
            counts, all_runs = [], []
            for text in batch.column("text").to_pylist():
                ws = words_of(text)
                counts.append(len(ws))
                all_runs.append([{"at": a, "words": [w.decode() for w in x]} for a, x in found(ws)])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("copy"), pa.array(counts, pa.int64()), pa.array(all_runs, kind)],
                ["doc_id", "copy", "n_words", "runs"],
            )
    return run


def _shingles(words_col: str, size: int) -> Column:
    """Hashes of the runs of ``size`` words of an array, or of the whole array if it is shorter, with their places."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(words_col) - size + 1, F.lit(1)))
    return F.transform(starts, lambda i: F.struct((i - 1).alias("off"), F.xxhash64(F.slice(words_col, i, size)).alias("h")))


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW, *, id_col: str = "doc_id", text_col: str = "text",
         item_id_col: str = "item_id", item_text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Word counts (doc_id, copy, n_words) of all documents, and every occurrence (doc_id, copy, at, n, item_ids).

    ``copy`` tells texts of one doc_id apart. Windows shorter than a shingle
    are joined by themselves as a whole.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("copy"), F.col(text_col).alias("text")
    )
    wins = settle(windows(items, size, id_col=item_id_col, text_col=item_text_col), "windows")
    n_words = wins.select(F.explode("words").alias("word")).distinct().count()
    # A window has at most ``size`` words, so this many passes keep every pass below the bound.
    passes = 1 if n_words <= PASS_WORDS else -(-wins.count() * size // PASS_WORDS)
    scans = []
    for k in range(passes):
        # Windows go to a pass by their own hash; all their words go with them.
        mine = wins.filter(F.pmod("win", F.lit(passes)) == k)
        pairs = mine.select(F.size("words").alias("n"), F.explode("words").alias("word")).distinct().collect()
        full = frozenset(r.word.encode() for r in pairs if r.n == size)
        short = [r for r in pairs if r.n < size]
        needed = {size: full} if full else {}
        if short:
            needed[min(r.n for r in short)] = frozenset(r.word.encode() for r in short)
        scan = rows.mapInArrow(
            _runs(needed),
            f"doc_id {kind}, copy long, n_words long, runs array<struct<at: int, words: array<string>>>",
        )
        scans.append(scan.withColumn("pass", F.lit(k)))
    scanned = scans[0]
    for scan in scans[1:]:
        scanned = scanned.unionByName(scan)
    scanned = settle(scanned, "runs")
    runs = scanned.filter(F.size("runs") > 0).select("doc_id", "copy", "pass", F.inline("runs"))
    runs = runs.select("doc_id", "copy", "pass", "at", "words")

    def match(wins: DataFrame, shingle: int) -> DataFrame:
        of_runs = runs.select("*", F.explode(_shingles("words", shingle)).alias("s")).select(
            "doc_id", "copy", "pass", "at", F.col("s.off").alias("off"), F.col("s.h").alias("h")
        )
        counts = of_runs.groupBy("h").agg(F.count("*").alias("seen"))
        of_wins = wins.select(
            "win", "words", F.pmod("win", F.lit(passes)).cast("int").alias("pass"),
            F.explode(_shingles("words", shingle)).alias("s"),
        )
        # Rarity order: the count in the corpus, then the hash. A shingle that no run holds rules its window out.
        ranked = of_wins.select("win", "pass", F.col("s.off").alias("w_off"), F.col("s.h").alias("h")).join(counts, "h", "left")
        prefix = ranked.groupBy("win", "pass").agg(
            F.min(F.struct(F.coalesce("seen", F.lit(0)).alias("seen"), "h", "w_off")).alias("p")
        ).filter("p.seen > 0").select("win", "pass", F.col("p.h").alias("h"), F.col("p.w_off").alias("w_off"))
        places = of_runs.join(prefix, ["h", "pass"]).select("doc_id", "copy", "pass", "at", (F.col("off") - F.col("w_off")).alias("start"), "win")
        places = places.filter("start >= 0")
        # Verify: the run's words at the place, against the window's.
        texts = wins.select("win", F.col("words").alias("wanted"), "item_ids")
        same = F.slice("words", F.col("start") + 1, F.size("wanted")) == F.col("wanted")
        keyed = runs.withColumnRenamed("doc_id", "r_id")
        on = (F.col("doc_id").eqNullSafe(F.col("r_id"))) & (places["copy"] == keyed["copy"]) & (
            places["pass"] == keyed["pass"]) & (places["at"] == keyed["at"])
        placed = places.join(texts, "win").join(keyed, on).filter(same)
        return placed.select("doc_id", places["copy"], (places["at"] + F.col("start")).alias("at"),
                             F.size("wanted").alias("n"), "item_ids").distinct()

    found = match(wins.filter(F.size("words") >= SHINGLE), SHINGLE)
    for n in range(1, SHINGLE):
        found = found.unionByName(match(wins.filter(F.size("words") == n), n))
    return scanned.filter("pass = 0").select("doc_id", "copy", "n_words"), found


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, **options) -> DataFrame:
    """One row per document: doc_id, copy, n_words, n_hit (words inside an occurrence), item_ids (sorted as strings)."""
    counts, found = hits(docs, items, size, **options)
    per_place = found.groupBy("doc_id", "copy", "at").agg(
        F.max("n").alias("n"), F.flatten(F.collect_set("item_ids")).alias("item_ids")
    )
    later = Window.partitionBy("doc_id", "copy").orderBy("at")
    own = per_place.withColumn("end", F.col("at") + F.col("n"))
    reached = F.max("end").over(later.rowsBetween(Window.unboundedPreceding, -1))
    new = F.greatest(F.lit(0), F.col("end") - F.greatest(F.coalesce(reached, F.lit(0)), "at"))
    marked = own.select("doc_id", "copy", "item_ids", new.alias("new"))
    per_doc = marked.groupBy("doc_id", "copy").agg(
        F.sum("new").alias("n_hit"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("item_ids")
    ).withColumnsRenamed({"doc_id": "h_id", "copy": "h_copy"})
    on = F.col("doc_id").eqNullSafe(F.col("h_id")) & (F.col("copy") == F.col("h_copy"))
    ids = F.array_sort(F.transform(F.coalesce("item_ids", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    return counts.join(per_doc, on, "left").select(
        "doc_id", "copy", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), ids.alias("item_ids")
    )


def digest(rows: DataFrame) -> DataFrame:
    """The contract's columns of ``contamination``'s rows."""
    return rows.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents without hits, with all their columns."""
    dirty = contamination(docs, items, id_col=id_col, text_col=text_col, **options).filter("n_hit > 0")
    dirty_id, dirty_copy = unused(docs.columns, "dirty_id", "dirty_copy")
    dirty = dirty.select(F.col("doc_id").alias(dirty_id), F.col("copy").alias(dirty_copy))
    on = docs[id_col].eqNullSafe(F.col(dirty_id)) & (F.xxhash64(docs[text_col]) == F.col(dirty_copy))
    return docs.join(dirty, on, "left_anti")
