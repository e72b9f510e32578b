"""Prefix trie of conversations that share heads, from composable fingerprints.

A sequence of turns has a fingerprint in a monoid: its length n and, for each
of ``LANES`` primes p, the sum of t(i) * B**i modulo p over its turns, t being
a hash of role and text. Two of them compose to (n + m, x + B**n * y), and a
known beginning can be taken off again. So one ordered scan of all turns gives
every prefix of every conversation, also where a conversation lies across many
tasks, and the prefixes of a rebuilt conversation, the head of its base and then its
own turns after the head, follow by arithmetic. Rebuilt texts are never made:
a row of the trie holds a reference to the turn it ends with.

Prefixes of equal length and fingerprint form a node. That each node is one
sequence is verified: its members end with turns of one hash, their prefixes one
turn shorter have one fingerprint, and all stored turns with one hash have
one role and text. By induction over the length the members are equal. If a
test fails, everything is computed again with other bases and hashes.

A node belongs to its smallest member. The nodes that a conversation owns are
the lower end of its path, so sums over subtrees are sums over members, and no
level-by-level walk is needed, however deep the trie.

Turns are ordered by turn, null first, then by role and text; a null role or text
is empty. Repeated rows are turns of their own. Rows without a conversation id
belong to none and are left out. An empty table gives no rows. Other columns are
ignored. A very long conversation, or a node with very many members, is spread
over tasks; only the ids that end at one node pass through one task, in
order, joined in chunks, as SHA-256 is a chain.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.session import settle, spread

PRIMES = (2147483647, 2147483629, 2147483587)
SALT_ROWS = 8192
CHUNK_IDS = 4096
WORD = r"[^\x20\x09-\x0D]+"


class Lanes:
    """Arithmetic modulo the primes, for numpy arrays and for columns; ``attempt`` chooses the bases."""

    def __init__(self, primes=PRIMES, attempt: int = 0):
        self.primes = primes
        rng = np.random.default_rng([13, attempt])
        self.bases = [int(rng.integers(2, p - 1)) for p in primes]

    def powers(self, lane: int, exponents: np.ndarray) -> np.ndarray:
        """B**e modulo p of every exponent."""
        p, square = self.primes[lane], self.bases[lane] % self.primes[lane]
        out, left = np.ones(len(exponents), np.int64), exponents.astype(np.int64)
        while left.any():
            out = np.where(left & 1, out * square % p, out)
            square, left = square * square % p, left >> 1
        return out

    def power(self, lane: int, exponent: Column, bits: int = 40) -> Column:
        """B**exponent modulo p, for exponents of 0 or more."""
        p, square, out = self.primes[lane], self.bases[lane] % self.primes[lane], F.lit(1).cast("long")
        for bit in range(bits):
            out = out * F.when(F.getbit(exponent, F.lit(bit)) == 1, F.lit(square).cast("long")).otherwise(1) % p
            square = square * square % p
        return out

    def small_power(self, lane: int, exponent: Column, most: int) -> Column:
        """B**exponent modulo p, for exponents of -most to most."""
        p, b = self.primes[lane], self.bases[lane]
        return F.get(F.array(*[F.lit(pow(b, e, p)).cast("long") for e in range(-most, most + 1)]), (exponent + most).cast("int"))


def head_size(conv_id: Column, most: int = 3) -> Column:
    """How many turns a conversation takes from its base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % (most + 1)).cast("int")


def _scan(lanes: Lanes):
    """Arrow function over ordered turns: place in the task's part of the conversation, and running sums up to each turn."""
    sums = [f"s{i}" for i in range(len(lanes.primes))]

    def run(batches):
        conv, carry = None, [0] * (2 + len(sums))  # turns, words and sums of the conversation so far
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("conv_id").to_numpy()
            new = np.r_[conv is None or ids[0] != conv, ids[1:] != ids[:-1]]
            start = np.maximum.accumulate(np.where(new, np.arange(len(ids)), 0))
            open_run = np.cumsum(new) == 0  # rows that go on with the conversation before this batch
            pos = np.arange(len(ids)) - start + 1 + np.where(open_run, carry[0], 0)

            def running(values, before, p=None):
                total = np.cumsum(values)
                total = total - np.where(start > 0, total[start - 1], 0) + np.where(open_run, before, 0)
                return total if p is None else total % p

            words = running(batch.column("n_words").to_numpy(), carry[1])
            found = []
            for i, p in enumerate(lanes.primes):
                turn = batch.column("k1").to_numpy() % p
                found.append(running(turn * lanes.powers(i, pos) % p, carry[2 + i], p))
            conv, carry = ids[-1], [int(pos[-1]), int(words[-1]), *(int(s[-1]) for s in found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("part"), batch.column("conv_id"), pa.array(pos), batch.column("k1"), batch.column("k2"),
                 batch.column("n_words"), pa.array(words), *(pa.array(s) for s in found)],
                ["part", "conv_id", "pos", "k1", "k2", "n_words", "words", *sums])
    return run, "part int, conv_id long, pos long, k1 long, k2 long, n_words long, words long, " + ", ".join(f"{s} long" for s in sums)


def hashed(turns: DataFrame, attempt: int, *, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv_id, turn, role, text, k1, k2, n_words); k1 and k2 are two hashes of role and text."""
    rows = turns.select(
        F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.where("conv_id IS NOT NULL").select(
        "*", F.xxhash64(F.lit(2 * attempt), "role", "text").alias("k1"),
        F.xxhash64(F.lit(2 * attempt + 1), "role", "text").alias("k2"),
        F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))


def prefixes(rows: DataFrame, lanes: Lanes) -> tuple[DataFrame, DataFrame]:
    """Every turn with its place and the running sums of its conversation, and every conversation's totals."""
    names = ["words", *(f"s{i}" for i in range(len(lanes.primes)))]
    # The random number parts rows that are equal in everything; which of them comes first makes no difference.
    keyed = rows.withColumn("_lot", F.rand(13))
    order = ["conv_id", "turn", "role", "text", "_lot"]
    dealt = keyed.repartitionByRange(*order).sortWithinPartitions(*order)
    run, schema = _scan(lanes)
    scanned = settle(dealt.select(F.spark_partition_id().alias("part"), "conv_id", "k1", "k2", "n_words").mapInArrow(run, schema), "scan")

    last = F.max(F.struct("pos", *names)).alias("last")  # fixed-width fields
    parts = scanned.groupBy("conv_id", "part").agg(last).select("conv_id", "part", "last.*")
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("n_before", F.coalesce(F.sum("pos").over(before), F.lit(0)))
    moved = {"words": F.col("words")} | {
        f"s{i}": lanes.power(i, F.col("n_before")) * F.col(f"s{i}") % p for i, p in enumerate(lanes.primes)}
    parts = settle(parts.select("conv_id", "part", "pos", "n_before", *[c.alias(n) for n, c in moved.items()]), "parts")
    carried = parts.select("conv_id", "part", "n_before",
                           *[F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"{n}_before") for n in names]).where("n_before > 0")
    # A task's part goes on with one conversation at most, so these rows are no more than there are parts.
    at = scanned.join(F.broadcast(carried), ["conv_id", "part"], "left")
    n_before = F.coalesce("n_before", F.lit(0))
    sums = {f"s{i}": (F.coalesce(f"s{i}_before", F.lit(0)) + lanes.power(i, n_before) * F.col(f"s{i}")) % p
            for i, p in enumerate(lanes.primes)}
    # Few rows need the powers; the others are as scanned.
    sums = {n: F.when(F.col("n_before").isNull(), F.col(n)).otherwise(c) for n, c in sums.items()}
    rows = at.select("conv_id", (F.col("pos") + n_before).alias("pos"), "k1", "k2", "n_words",
                     (F.col("words") + F.coalesce("words_before", F.lit(0))).alias("words"), *[c.alias(n) for n, c in sums.items()])
    totals = parts.groupBy("conv_id").agg(F.sum("pos").alias("length"), F.sum("words").alias("own_words"))
    return rows, totals


def rebuilt(rows: DataFrame, totals: DataFrame, lanes: Lanes, family: int, most_head: int) -> tuple[DataFrame, DataFrame]:
    """Rows (conversation, depth) of all rebuilt conversations and their fingerprints, from references alone."""
    n = range(len(lanes.primes))
    sums = [f"s{i}" for i in n]
    fields = ["pos", "k1", "k2", "n_words", "words", *sums]
    first = rows.where(F.col("pos") <= most_head).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("first"))
    convs = totals.join(first, "conv_id").withColumn("h", head_size(F.col("conv_id"), most_head)).withColumn(
        "base", F.col("conv_id") - F.col("conv_id") % family)
    bases = convs.where("conv_id = base").select("base", F.col("first").alias("base_first"))
    convs = convs.join(bases, "base", "left")
    head = F.coalesce(F.slice("base_first", F.lit(1), F.col("h")), F.slice("first", 1, 0))
    convs = convs.withColumn("head", head).withColumn("n_head", F.size("head"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    cut = F.try_element_at("first", F.least("h", F.size("first")))  # the last own turn that the head takes the place of
    own = F.when(F.col("h") > 0, cut)
    joint = F.when(F.col("n_head") > 0, F.try_element_at("head", F.greatest("n_head", F.lit(1))))
    has_own = F.col("length") > F.col("h")
    convs = convs.withColumns({"joint": joint, "own": own}).select(
        "conv_id", "base", "length", "h", "n_head", "head",
        (F.col("n_head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).alias("depths"),
        (zero(F.col("joint.words")) + F.when(has_own, F.col("own_words") - zero(F.col("own.words"))).otherwise(0)).alias("all_words"),
        (zero(F.col("joint.words")) - zero(F.col("own.words"))).alias("words_moved"),
        *[zero(F.col(f"joint.s{i}")).alias(f"j{i}") for i in n], *[zero(F.col(f"own.s{i}")).alias(f"o{i}") for i in n])
    convs = settle(convs, "conversations")

    # One row a conversation meets its turns; a long one's row is copied for every SALT_ROWS of them.
    sides = convs.drop("head", "base").withColumn(
        "salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("length") / SALT_ROWS))))
    after = rows.withColumn("salt", F.floor(F.col("pos") / SALT_ROWS)).join(sides, ["conv_id", "salt"]).where("pos > h")
    prints = {}
    for i, p in enumerate(lanes.primes):
        moved = lanes.small_power(i, F.col("n_head") - F.col("h"), most_head)
        prints[f"g{i}"] = (F.col(f"j{i}") + F.pmod(F.col(f"s{i}") - F.col(f"o{i}"), F.lit(p)) * moved) % p
    after = after.withColumns(prints).withColumn("depth", F.col("pos") - F.col("h") + F.col("n_head")).select(
        "conv_id", "depth", "k1", "k2", "n_words", (F.col("words") + F.col("words_moved")).alias("words"),
        *[f"g{i}" for i in n], F.col("conv_id").alias("ref_conv"), F.col("pos").alias("ref_pos"), "depths", "all_words")
    heads = convs.select("conv_id", "base", "depths", "all_words", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.pos").alias("depth"), "t.k1", "t.k2", "t.n_words", "t.words",
        *[F.col(f"t.s{i}").alias(f"g{i}") for i in n], F.col("base").alias("ref_conv"), F.col("t.pos").alias("ref_pos"), "depths", "all_words")
    roots = convs.select(
        "conv_id", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(c) for c in ("k1", "k2", "n_words", "words")],
        *[F.lit(0).cast("long").alias(f"g{i}") for i in n], *[F.lit(None).cast("long").alias(c) for c in ("ref_conv", "ref_pos")],
        "depths", "all_words")
    members = reduce(DataFrame.unionByName, [after, heads, roots])
    # The prefix one turn shorter lacks this turn's term.
    for i, p in enumerate(lanes.primes):
        term = F.pmod("k1", F.lit(p)) * lanes.power(i, F.col("depth")) % p
        members = members.withColumn(f"p{i}", F.when(F.col("depth") > 0, F.pmod(F.col(f"g{i}") - term, F.lit(p))).otherwise(0))
    return members, convs


def one_text_a_hash(rows: DataFrame) -> bool:
    """Have all stored turns with one pair of hashes one role and text? Hashes that occur once need no look."""
    often = rows.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k1", "k2")
    texts = rows.select("k1", "k2", "role", "text").distinct()  # merged in each task first
    several = texts.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    return not several.join(often, ["k1", "k2"], "left_semi").limit(1).count()


def _chunks(keys: list[str]):
    """Arrow function over (keys, conv_id) in order: the ids of each run of equal keys, joined, in pieces."""
    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy() for k in keys]
            ids = batch.column("conv_id").to_pylist()
            new = np.zeros(len(ids), bool)
            new[::CHUNK_IDS] = True
            for c in columns:
                new[1:] |= c[1:] != c[:-1]
            starts = np.flatnonzero(new)
            ends = np.append(starts[1:], len(ids))
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c[starts]) for c in columns), pa.array([ids[a] for a in starts], pa.int64()),
                 pa.array([",".join(map(str, ids[a:b])) for a, b in zip(starts.tolist(), ends.tolist())])],
                [*keys, "first_id", "ids"])
    return run


def _chain(keys: list[str]):
    """Arrow function over chunks in order: the SHA-256 of each run of equal keys, fed chunk by chunk."""
    def run(batches):
        key, digest = None, None

        def row():
            return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([digest.hexdigest()])],
                                              [*keys, "ends_sha256"])
        for batch in batches:
            found = []
            for *own, ids in zip(*(batch.column(k).to_pylist() for k in keys), batch.column("ids").to_pylist()):
                if own != key:
                    if key is not None:
                        found.append(row())
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if found:
                yield pa.Table.from_batches(found).combine_chunks().to_batches()[0]
        if key is not None:
            yield row()
    return run


def ends_digests(ends: DataFrame, keys: list[str]) -> DataFrame:
    """SHA-256 of each key's conversation ids, ascending and joined by commas; a hot key is sorted and joined by many tasks."""
    schema = ", ".join(f"{k} long" for k in keys)
    order = [*keys, "conv_id"]
    dealt = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    chunks = dealt.mapInArrow(_chunks(keys), f"{schema}, first_id long, ids string")
    chunks = chunks.repartition(*keys).sortWithinPartitions(*keys, "first_id")
    return chunks.mapInArrow(_chain(keys), f"{schema}, ends_sha256 string")


def trie(turns: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
         family: int = 20, most_head: int = 3, primes=PRIMES, attempts: int = 4) -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id, ref_conv and ref_pos (the turn it ends with),
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    lanes_of = range(len(primes))
    prints, above = [f"g{i}" for i in lanes_of], [f"p{i}" for i in lanes_of]
    key = ["depth", *prints]
    dealt = spread(turns.select(id_col, turn_col, role_col, text_col))
    for attempt in range(attempts):
        lanes = Lanes(primes, attempt)
        rows = hashed(dealt, attempt, id_col=id_col, turn_col=turn_col, role_col=role_col, text_col=text_col)
        members, convs = rebuilt(*prefixes(rows, lanes), lanes, family, most_head)
        members = settle(members, "members")
        same = ["k1", "k2", *above]
        nodes = settle(members.groupBy(*key).agg(
            F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("n_words").alias("n_words"),
            F.min("words").alias("words"), F.sum("all_words").alias("sum_words"),
            *[F.min(c).alias(c) for c in same], *[F.max(c).alias(f"{c}_max") for c in same]), "nodes")
        mixed = reduce(Column.__or__, [F.col(c) != F.col(f"{c}_max") for c in same])
        if not nodes.where(mixed).limit(1).count() and one_text_a_hash(rows):
            break
    else:
        raise ValueError(f"fingerprints of different conversations are equal in {attempts} attempts")
    nodes = nodes.drop(*[f"{c}_max" for c in same], "k1", "k2")

    up = [(F.col("depth") - 1).alias("depth"), *[F.col(p).alias(g) for p, g in zip(above, prints)]]
    children = nodes.where("depth > 0").select(*up).groupBy(*key).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, key, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = settle(nodes, "nodes")

    # What a conversation owns: the nodes from ``top`` down, their words, and whether the last one is a leaf.
    owners = nodes.groupBy("conv_id").agg(
        F.min("depth").alias("top"), F.max("depth").alias("bottom"), F.sum("n_words").alias("owned_words"),
        F.max(F.when(F.col("n_children") == 0, 1).otherwise(0)).alias("leaf"))
    sides = owners.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.col("bottom") / SALT_ROWS))))
    met = members.withColumn("salt", F.floor(F.col("depth") / SALT_ROWS)).join(sides, ["conv_id", "salt"])
    owned = F.col("depth") >= F.col("top")
    below = F.when(owned, F.col("all_words") - F.col("words") + F.col("n_words")).otherwise(F.col("owned_words"))
    sums = met.groupBy(*key).agg(
        F.sum("leaf").alias("n_leaves"), F.sum(below).alias("node_words"),
        F.max(F.when(owned, F.col("ref_conv"))).alias("ref_conv"), F.max(F.when(owned, F.col("ref_pos"))).alias("ref_pos"))

    # A node below another of its owner has it as parent; the others look their parent's owner up.
    placed = nodes.join(sums, key).join(ends_digests(members.where("depth = depths"), key), key, "left")
    tops = owners.where("top > 0").select("conv_id", F.col("top").alias("depth"))
    heads = nodes.join(tops, ["conv_id", "depth"], "left_semi").select("conv_id", *up)
    parents = heads.join(nodes.where("n_children > 0").select(*key, F.col("conv_id").alias("parent")), key).select(
        "conv_id", (F.col("depth") + 1).alias("depth"), "parent")
    placed = placed.join(parents, ["conv_id", "depth"], "left")
    words_below = F.col("sum_words") - F.col("n_convs") * (F.col("words") - F.col("n_words"))
    return placed.select(
        "conv_id", "depth", F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"), "ref_conv", "ref_pos",
        "n_convs", "n_children", F.col("n_leaves").cast("long").alias("n_leaves"),
        (words_below - F.col("node_words")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))
