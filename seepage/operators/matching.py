"""Joins of texts, hosts and addresses with watch tables."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage import rules as R
from seepage.functions import hosts as H
from seepage.functions import text as X
from seepage.functions.pieces import pieces
from seepage.operators.dedupe import keep_first
from seepage.session import MAX_BROADCAST_BYTES, MAX_BROADCAST_ROWS, fits, settle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Bytes of a gram of the phrase index, and how many grams may be broadcast (they are numbers; the bytes are bounded as well).
GRAM = 6
MAX_GRAMS = 2_000_000
#: Bits of the table that sorts out other grams: a prime.
MARKS = 16_777_213


def lookup_join(facts: DataFrame, lookup: DataFrame, keys, how: str = "inner",
                max_rows: int = MAX_BROADCAST_ROWS, small: bool | None = None) -> DataFrame:
    """Join a large table with a lookup that has one row per key.

    The lookup is written to the shared folder once and measured there; within
    the broadcast bounds it is broadcast. A larger one is joined by its keys,
    where Spark splits the partitions of hot keys at run time. Both give the
    same rows. ``small`` is the measurement if the caller has it already; the
    lookup is then used as it is.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(how)
    if small is None:
        lookup = settle(lookup, "lookup")
        small = fits(lookup, max_rows)
    return facts.join(F.broadcast(lookup) if small else lookup, keys, how)


def watchlist_hits(df: DataFrame, host: str, watchlist: DataFrame, domain: str = "domain") -> DataFrame:
    """Rows whose host is a watched domain or below one, once per watched domain.

    The host's parents are the join keys, so the test is an equality and not a
    suffix comparison with every watched domain.
    """
    watched = watchlist.select(F.lower(F.col(domain)).alias("watched_domain")).distinct()
    keyed = df.withColumn("watched_domain", F.explode(H.suffixes(F.lower(F.col(host)))))
    return lookup_join(keyed, watched, "watched_domain")


def known_hosts(words: DataFrame, domains: DataFrame, passive_dns: DataFrame) -> DataFrame:
    """Hosts ``word.domain`` that the user's passive-DNS table knows, with the first record type of A, AAAA, CNAME.

    No candidate is generated: each known host is cut at its dots and both
    parts are looked up, which gives what testing every word with every domain
    would.
    """
    order = F.array_position(F.array(F.lit("A"), F.lit("AAAA"), F.lit("CNAME")), F.col("rtype"))
    known = (
        passive_dns.select(F.lower("host").alias("host"), F.upper("rtype").alias("rtype"))
        .where(F.col("rtype").isin("A", "AAAA", "CNAME"))
        .groupBy("host")
        .agg(F.min(F.struct(order.alias("rank"), F.col("rtype").alias("rtype"))).alias("best"))
        .select("host", F.explode(H.splits("host")).alias("cut"), F.col("best.rtype").alias("record_type"))
        .select("host", "record_type", F.col("cut.head").alias("word"), F.col("cut.tail").alias("domain"))
    )
    words = words.select(F.lower("word").alias("word")).distinct()
    domains = domains.select(F.lower("domain").alias("domain")).distinct()
    hits = lookup_join(lookup_join(known, domains, "domain", "left_semi"), words, "word", "left_semi")
    return hits.groupBy("host").agg(F.min("record_type").alias("record_type"))


def new_only(df: DataFrame, seen: DataFrame, key: str, order, unique: bool = False) -> DataFrame:
    """First row per key whose key is not in the history table; what the history knows goes before the rows are compared."""
    fresh = lookup_join(df, seen.select(key).distinct(), key, "left_anti")
    return keep_first(fresh, [key], order, unique)


def with_templates(df: DataFrame, templates, columns, name: str, **values) -> DataFrame:
    """One row per input row and template: struct ``_t`` of the template's columns and, in ``name``, the template with the row's values.

    ``templates`` are tuples of the columns, the template last, which become
    literals, or a table of them, which is one value that tasks receive (a
    scalar subquery); a table beyond the broadcast bounds is refused.
    """
    if not isinstance(templates, DataFrame):
        rows = [t if isinstance(t, tuple) else (t,) for t in templates]
        return df.withColumn("_t", F.explode(F.array(*[
            F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, row)], X.fill_template(row[-1], **values).alias(name))
            for row in rows])))
    if not fits(templates):
        raise ValueError("more templates than a broadcast may hold")
    listed = templates.select(*columns).distinct().agg(F.sort_array(F.collect_list(F.struct(*columns))))
    filled = F.transform(F.col("_listed"), lambda t: F.struct(
        *[t[c].alias(c) for c in columns], X.fill_templates(t[columns[-1]], **values).alias(name)))
    return df.withColumn("_listed", listed.scalar()).withColumn("_t", F.explode(filled)).drop("_listed")


def mention_patterns(watchlist: DataFrame, domain: str = "domain", templates=R.MENTION_TEMPLATES) -> DataFrame:
    """Search phrases (domain, category, pattern) of every watched domain.

    ``templates`` are (category, template) pairs or a table of them.
    """
    d = F.col("domain")
    values = {"domain": d, "query": d, "spaced": F.replace(d, F.lit("."), F.lit(" ")), "label": H.first_label(d)}
    domains = watchlist.select(F.lower(F.col(domain)).alias("domain"))
    phrases = with_templates(domains, templates, ["category", "template"], "pattern", **values)
    return phrases.select("domain", "_t.category", "_t.pattern").distinct()


def expand_templates(df: DataFrame, templates, name: str, **values) -> DataFrame:
    """One row per input row and template, the filled template in column ``name``.

    ``templates`` are strings or a table with a ``template`` column.
    """
    return with_templates(df, templates, ["template"], name, **values).select("*", "_t.*").drop("_t")


def _marks(grams: DataFrame) -> tuple[np.ndarray, tuple[int, ...]]:
    """A bit for the remainder of every gram by a fixed prime, and the grams' sizes; what has no bit is no gram.

    The table's size does not follow the number of grams.
    """
    place = f"pmod(g, {MARKS}L)"
    words = grams.select(
        F.expr(f"div({place}, 64)").alias("word"), F.expr(f"shiftleft(1L, CAST({place} % 64 AS INT))").alias("bit"),
        F.expr("shiftleft(1, CAST(shiftright(g, 56) AS INT))").alias("size"))
    marks, sizes = np.zeros(MARKS // 64 + 1, np.int64), 0
    for word, bits, size in words.groupBy("word").agg(F.bit_or("bit"), F.bit_or("size")).collect():
        marks[word], sizes = bits, sizes | size
    return marks.view(np.uint64), tuple(n for n in range(1, 8) if sizes >> n & 1)


def _byte_grams(gram: int, sizes: tuple[int, ...] | None, marks=None):
    """Arrow function: runs of bytes in each text, each once, as numbers that hold the bytes and their count.

    With ``sizes`` runs of these sizes that ``marks`` (a broadcast) lets
    through; without, of ``gram`` bytes or of the whole of a shorter text.
    """
    def of_piece(texts):
        held = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary())
        ends = np.frombuffer(held.buffers()[1], np.int64)[held.offset: held.offset + len(held) + 1]
        data = np.frombuffer(held.buffers()[2] or b"", np.uint8)[ends[0]: ends[-1]].astype(np.uint64)
        starts, room = ends[:-1] - ends[0], np.diff(ends)
        owner = np.repeat(np.arange(len(room)), room)
        left = np.repeat(starts + room, room) - np.arange(len(data))  # bytes from here to the text's end
        rows, values = [], []
        for n in range(1, gram + 1) if sizes is None else sizes:
            if n > len(data):
                break
            value = np.full(len(data) - n + 1, n << 56, np.uint64)
            for j in range(n):
                value |= data[j: len(data) - n + 1 + j] << np.uint64(8 * j)
            # Those that end within their text, and without sizes those of the text's own size.
            fine = left[: len(value)] >= n
            if sizes is None:
                fine &= np.minimum(np.repeat(room, room)[: len(value)], gram) == n
            if marks is not None:
                place = value % np.uint64(MARKS)
                fine &= (marks.value[(place >> np.uint64(6)).astype(np.intp)] >> (place & np.uint64(63)) & np.uint64(1)).astype(bool)
            at = np.flatnonzero(fine)
            rows.append(owner[at])
            values.append(value[at])
        rows, values = (np.concatenate(x) if x else np.array([], np.int64) for x in (rows, values))
        order = np.lexsort((values, rows))
        rows, values = rows[order], values[order]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:] != rows[:-1]) | (values[1:] != values[:-1])
        counts = np.bincount(rows[new], minlength=len(room))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), pa.array(values[new].astype(np.int64)))

    def found(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            for texts, in pieces([batch]):  # some ninety bytes are held for each byte of a piece
                yield of_piece(texts)

    return F.arrow_udf(found, T.ArrayType(T.LongType()))


def pattern_hits(corpus: DataFrame, keys, text: str, patterns: DataFrame, pattern: str = "pattern", gram: int = GRAM) -> DataFrame:
    """Rows (keys, pattern) for every phrase that occurs in the text, whatever the case.

    An n-gram index: each phrase is keyed by the one of its grams that the
    fewest texts hold, texts are exploded into their distinct grams, both
    meet by equality, and ``contains`` verifies. A gram is a run of ``gram``
    bytes (7 at most), or the whole phrase if that is shorter. Phrases of which some
    gram is in no text leave before the join. A bit table of a fixed size keeps
    most grams of texts that no phrase has from being exploded at all. The grams
    of phrases are broadcast within the measured bounds of ``lookup_join``, so
    that those of texts need no shuffle; beyond them grams and then the texts they point
    to are joined by key, where Spark splits hot ones. Phrases are never
    collected. The grams of a piece of a batch, or of one long text, are held at once. A null text
    holds nothing; the empty phrase is none. A row of keys that occurs twice
    has its hits twice.
    """
    names = [f"_key{i}" for i in range(len(keys))]
    back = [F.col(n).alias(k) for k, n in zip(keys, names)]
    base = corpus.select(*[F.col(k).alias(n) for k, n in zip(keys, names)], F.lower(F.col(text)).alias("_low"))
    phrases = patterns.select(F.lower(F.col(pattern)).alias("p")).where("p <> ''").distinct()
    own = settle(phrases.select("p", F.explode(_byte_grams(gram, None)("p")).alias("g")), "phrases")
    small = fits(own, MAX_GRAMS)  # and so are tables of fewer grams

    def of_texts(grams):
        marks, sizes = _marks(grams)
        return F.explode(_byte_grams(gram, sizes, corpus.sparkSession.sparkContext.broadcast(marks))("_low")).alias("g")

    held = base.select(of_texts(own))
    counts = settle(lookup_join(held, own.select("g").distinct(), "g", "left_semi", small=small).groupBy("g").agg(
        F.count(F.lit(1)).alias("n")), "grams")
    rated = lookup_join(own, counts, "g", "left", small=small).groupBy("p").agg(
        F.min(F.coalesce("n", F.lit(0))).alias("least"), F.min_by("g", F.coalesce("n", F.lit(0))).alias("g"))
    index = settle(rated.where("least > 0").select("g", "p"), "index")
    if small:
        met = base.select("*", of_texts(index)).join(F.broadcast(index), "g")
    else:  # texts travel by number, and only to phrases whose gram they hold
        base = settle(base.withColumn("_row", F.monotonically_increasing_id()), "texts")
        pairs = base.select("_row", of_texts(index)).join(index, "g").select("_row", "p")
        met = base.join(pairs, "_row")
    return met.where(F.contains("_low", F.col("p"))).select(*back, F.col("p").alias(pattern))


def reachable(links: DataFrame, starts: DataFrame, stored: DataFrame | None = None,
              max_pages: int | None = None) -> DataFrame:
    """Pages reachable from the start pages (url) over (src, dst) links, with their distance.

    One join per level until a level is empty; every level is written to the
    shared folder, so it is computed once, the plan stays short and a lost
    executor does not restart the walk. ``stored`` (url) limits the walk to
    pages at hand: links to others are dropped once, before the walk, and so
    are links back to the start pages, which reach nothing new and are often
    the most frequent. A repeated link does no harm, so links are not compared
    with each other. With ``max_pages`` the walk ends after the level that
    reaches the limit and the nearest pages (then by URL) are kept.
    """
    def by(column, urls, n=MAX_BROADCAST_ROWS + 1, size=0):  # Spark guesses from compressed files, which URLs make too small
        small = n <= MAX_BROADCAST_ROWS and size <= MAX_BROADCAST_BYTES
        return urls.select(F.col("url").alias(column)).hint("broadcast" if small else "merge")

    def measure(urls):
        return urls.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("url")), F.lit(0))).first()

    visited = frontier = settle(starts.select("url").distinct().withColumn("depth", F.lit(0)), "level")
    n, size = reached, held = measure(frontier)
    links = links.select("src", "dst").join(by("dst", frontier, n, size), "dst", "left_anti")
    if stored is not None:
        links = links.join(by("dst", stored), "dst", "left_semi")
    links, level = settle(links.select("src", "dst"), "links"), 0
    while n and (max_pages is None or reached < max_pages):
        level += 1
        found = links.join(by("src", frontier, n, size), "src", "left_semi")
        new = found.select(F.col("dst").alias("url")).distinct().join(by("url", visited, reached, held), "url", "left_anti")
        frontier = settle(new.withColumn("depth", F.lit(level)), "level")
        n, size = measure(frontier)
        visited, reached, held = visited.unionByName(frontier), reached + n, held + size
        if level % 20 == 0:
            visited = settle(visited, "visited")
    return visited if max_pages is None else visited.orderBy("depth", "url").limit(max_pages)
