"""SimHash near duplicates: fingerprints of word shingles, linked by the generalised pigeonhole principle.

Two fingerprints of 64 bits differ in at most t bits only if, for partitions
of the bits with thresholds that add up to t - m + 1, they differ in at most
its threshold in one of the m partitions (-1: the partition is left out).
Correlated bits are put together, the thresholds are chosen by dynamic
programming on estimated candidate counts, every fingerprint probes the values
around its own, and each candidate is verified. Both sides of a pair probe, so
values within r of each side's own cover a threshold of 2 r.

The rows are distinct fingerprints. Buckets are compared inside tasks, in
blocks (``blocks``), and give each member one link to its group, so no pairs
of a group are emitted and no link between groups is lost.

``near_duplicates`` names each document's component; ``first_copies`` keeps one
row of each.

A null text has no words like an empty one: fingerprint zero, linked like any
other. Texts of fewer words than a shingle are one shingle. Repeated rows have
a row each and are linked. A null id keeps its row; the component of null ids
alone is null. Very long texts are read whole, a batch of Arrow rows at a time.
An empty table gives no rows.
"""

from __future__ import annotations

import math
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seepage.llm.blocks import block_pairs, unused, whole_groups
from seepage.llm.graph import components, local_roots
from seepage.session import settle

BITS = 64
#: Cost of a probe against that of a verified pair, in the choice of thresholds.
PROBE_COST = 100.0
PARTITIONS = (2, 3, 4, 5, 6)
MOST_RADIUS = 2


def shingle_hashes(text: str | None, words: int) -> np.ndarray:
    """Hashes of the shingles of one text, repeats included."""
    from xxhash import xxh64_intdigest

    own = text.encode().lower().split() if text else []  # bytes: A-Z and ASCII white space only
    if not own:
        return np.zeros(0, np.uint64)
    whole = b" ".join(own)
    if len(own) <= words:
        pieces = [whole]
    else:
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        ends = np.cumsum(sizes + 1) - 1
        starts = (ends - sizes)[: len(own) - words + 1]
        pieces = [whole[a:b] for a, b in zip(starts.tolist(), ends[words - 1:].tolist())]
    return np.fromiter(map(xxh64_intdigest, pieces, repeat(42)), np.uint64, len(pieces))


def text_fingerprint(text: str | None, words: int) -> tuple[int, int]:
    """Number of shingles of one text, and its fingerprint as a signed 64-bit integer."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(BITS, np.int64)
    for a in range(0, len(hashes), 65_536):
        bits = np.unpackbits(hashes[a: a + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int32)
    return len(hashes), int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, words: int = 3, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, copy, n, fp) of every whole text: a hash of it, its number of shingles and its fingerprint."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("copy"), F.col(text_col).alias("text"))

    def run(batches):
        for batch in batches:
            found = [text_fingerprint(x, words) for x in batch.column("text").to_pylist()]
            columns = [pa.array([x[k] for x in found], pa.int64()) for k in range(2)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("copy"), *columns], ["doc_id", "copy", "n", "fp"])
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, copy long, n long, fp long")


def hex_digits(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def bit_counts(fps: DataFrame) -> tuple[np.ndarray, int]:
    """For each pair of bits, in how many fingerprints both are 1; and the number of fingerprints."""
    def run(batches):
        both = np.zeros((BITS, BITS))
        for batch in batches:
            values = batch.column("fp").to_numpy().astype(">i8").view(np.uint8).reshape(-1, 8)
            bits = np.unpackbits(values, axis=1)[:, ::-1].astype(np.float64)  # bit b is column b
            both += bits.T @ bits
        i, j = np.divmod(np.arange(BITS * BITS), BITS)
        yield pa.RecordBatch.from_pydict({"i": i.astype(np.int32), "j": j.astype(np.int32), "n": both.ravel()})
    sums = fps.select("fp").mapInArrow(run, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n"))
    both = np.zeros((BITS, BITS))
    for r in sums.collect():  # 4,096 rows
        both[r.i, r.j] = r.n
    return both, fps.count()


def grouped_bits(both: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Partitions of equal size, each grown from the most correlated free pair by the bit closest to it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    near = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(near, -1.0)
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        left = sorted(free)
        sub = near[np.ix_(left, left)]
        own = [left[int(x)] for x in np.unravel_index(int(sub.argmax()), sub.shape)] if size < len(left) else left
        while len(own) < size:
            rest = sorted(free - set(own))
            own.append(rest[int(near[np.ix_(rest, own)].mean(axis=1).argmax())])
        out.append(sorted(own))
        free -= set(own)
    return out


def allocate(costs: list[list[float]], needed: int) -> tuple[float, list[int]] | None:
    """A radius for each partition, -1 upwards, at the least cost; ``costs[i][r + 1]`` is partition i's at r.

    A radius r covers a threshold of 2 r, so the partitions' 2 r + 1 (0 for a
    partition left out) must add up to ``needed`` at least.
    """
    best = {0: (0.0, [])}
    for own in costs:
        nxt: dict[int, tuple[float, list[int]]] = {}
        for covered, (cost, chosen) in best.items():
            for r, more in enumerate(own, -1):
                at = min(needed, covered + (2 * r + 1 if r >= 0 else 0))
                if at not in nxt or cost + more < nxt[at][0]:
                    nxt[at] = (cost + more, [*chosen, r])
        best = nxt
    return best.get(needed)


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >= 1 << (BITS - 1) else mask


def choose(fps: DataFrame, distance: int = 3) -> list[tuple[list[int], int]]:
    """Partitions (their bits) with radii, of the least estimated work.

    The candidates at radius 0 are counted over all fingerprints (the sum of
    squared bucket sizes); a radius multiplies both sides of a bucket by the
    values within it.
    """
    both, n = bit_counts(fps)
    plans = {m: grouped_bits(both, n, m) for m in PARTITIONS}
    masks = [F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"),
                      F.col("fp").bitwiseAND(F.lit(_signed(sum(1 << b for b in bits)))).alias("v"))
             for m, parts in plans.items() for i, bits in enumerate(parts)]
    buckets = fps.select(F.explode(F.array(*masks)).alias("x")).groupBy("x.m", "x.i", "x.v").agg(F.count("*").alias("n"))
    pairs = {(r.m, r.i): r.pairs for r in buckets.groupBy("m", "i").agg(
        F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs")).collect()}
    best = None
    for m, parts in plans.items():
        costs = []
        for i, bits in enumerate(parts):
            balls = [sum(math.comb(len(bits), k) for k in range(r + 1)) for r in range(MOST_RADIUS + 1)]
            costs.append([0.0, *(pairs.get((m, i), 0.0) * ball**2 + PROBE_COST * n * ball for ball in balls)])
        found = allocate(costs, distance + 1)
        if found and (best is None or found[0] < best[0]):
            best = (found[0], list(zip(parts, found[1])))
    return best[1]


def probes(fps: DataFrame, plan: list[tuple[list[int], int]]) -> DataFrame:
    """The rows of ``fps`` with (part, value): under the values within the radius of their own, partition by partition."""
    rows = []
    for part, (bits, radius) in enumerate(plan):
        if radius < 0:
            continue
        mask = _signed(sum(1 << b for b in bits))
        flips = [_signed(sum(1 << b for b in some)) for k in range(radius + 1) for some in combinations(bits, k)]
        own = F.col("fp").bitwiseAND(F.lit(mask))
        around = F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: own.bitwiseXOR(x))
        rows.append(fps.select(F.lit(part).alias("part"), F.explode(around).alias("value"), "*"))
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out


def _compare(words: list[str], distance: int, size_ratio: float):
    """Arrow function: in each pair of blocks, links every member to the least one that links reach there."""
    def run(batches):
        for table, group in whole_groups(batches, ["part", "value", "lo", "hi"]):
            node, n = table.column("node").to_numpy(), table.column("n").to_numpy()
            bits = [table.column(w).to_numpy().view(np.uint64) for w in words]
            own = table.column("own").to_numpy()
            within = table.column("lo").to_numpy() == table.column("hi").to_numpy()
            at, lag, us, vs = np.arange(len(node)), 0, [], []
            while True:
                lag += 1
                at = at[at + lag < len(node)]
                at = at[group[at] == group[at + lag]]
                if not len(at):
                    break
                u, apart = at, np.bitwise_count(bits[0][at] ^ bits[0][at + lag]).astype(np.int16)
                for more in bits[1:]:  # most pairs are out after the first words
                    near = apart <= distance
                    u, apart = u[near], apart[near] + np.bitwise_count(more[u[near]] ^ more[u[near] + lag])
                v = u + lag
                close = (apart <= distance) & (within[u] | (own[u] != own[v])) & (
                    np.minimum(n[u], n[v]) >= size_ratio * np.maximum(n[u], n[v]))
                us.append(u[close])
                vs.append(v[close])
            if not us:
                continue
            root = local_roots(len(node), np.concatenate(us), np.concatenate(vs))
            some = np.flatnonzero(root != np.arange(len(node)))
            if len(some):
                yield pa.RecordBatch.from_pydict({"a": node[some], "b": node[root[some]]})
    return run


def links(fps: DataFrame, words: list[str], searched: int, distance: int, size_ratio: float = 0.0,
          plan: list | None = None) -> DataFrame:
    """Links (a, b) of nodes whose components are those of all verified pairs.

    ``fps``: distinct fingerprints (node, n, words). Pairs are searched whose
    first words differ in at most ``searched`` bits, and verified if all
    ``words`` together differ in at most ``distance`` and the numbers of
    shingles have the ratio at least.
    """
    dealt = block_pairs(probes(fps, plan or choose(fps, searched)), ["part", "value"], "node")
    return dealt.mapInArrow(_compare(words, distance, size_ratio), "a long, b long").distinct()


def _components(own: DataFrame, words: list[str], **how) -> DataFrame:
    """``own`` with component_id."""
    node = F.col("fp") if words == ["fp"] else F.xxhash64(*words)
    own = settle(own.withColumn("node", node), "fingerprints")
    reps = settle(own.groupBy("node", *words).agg(F.min("doc_id").alias("first"), F.min("n").alias("n")), "distinct")
    roots = components(links(reps.select("node", "n", *words), words, **how))
    roots = roots.select(F.col("node").alias("linked"), "root")
    merged = reps.join(roots, reps["node"] == roots["linked"], "left").select(
        "node", "first", F.coalesce("root", "node").alias("root"))
    least = merged.groupBy("root").agg(F.min("first").alias("component_id"))
    named = merged.join(least, "root").select(F.col("node").alias("named"), "component_id").distinct()
    return own.join(named, own["node"] == named["named"]).select("doc_id", *words, "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, distance: int = 3, **options) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id that links reach, its own included)."""
    return _components(fingerprints(docs, words, **options), ["fp"], searched=distance, distance=distance)


def first_copies(docs: DataFrame, words: int = 3, distance: int = 3, *, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """The documents that are the first of their component, with all their columns: one row of each component.

    Rows are told apart by id and text, so texts that share an id or have a
    null one are kept or go each for itself. The first is the one of the least
    id, then of the least hash of its text, a null id being the last.
    """
    own = settle(fingerprints(docs, words, id_col=id_col, text_col=text_col), "fingerprints")
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "copy")
    reps = settle(own.groupBy("fp").agg(F.min(key).alias("first"), F.min("n").alias("n")), "distinct")
    roots = components(links(reps.select(F.col("fp").alias("node"), "n", "fp"), ["fp"], searched=distance, distance=distance))
    merged = reps.select("fp", "first").join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root"))
    least = merged.groupBy("root").agg(F.min("first").alias("first"))
    named = settle(merged.drop("first").join(least, "root").select("fp", "first"), "firsts")
    row_id, row_copy, text_copy = unused(docs.columns, "row_id", "row_copy", "text_copy")
    is_first = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("copy") == F.col("first.copy"))
    rows = settle(own.join(named, "fp").select(
        F.col("doc_id").alias(row_id), F.col("copy").alias(row_copy), is_first.alias("is_first")), "copies")
    keyed = docs.withColumn(text_copy, F.xxhash64(F.col(text_col)))
    same = F.col(id_col).eqNullSafe(F.col(row_id)) & (F.col(text_copy) == F.col(row_copy))
    kept = keyed.join(rows.filter(~F.col("is_first")).select(row_id, row_copy).distinct(), same, "left_anti")
    again = rows.filter("is_first").groupBy(row_id, row_copy).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    again = settle(again, "again")
    if not again.isEmpty():  # rows equal in id and text, of which one stays
        whole = settle(kept.join(again, same, "left_semi"), "repeated")
        kept = kept.join(again, same, "left_anti").unionByName(whole.dropDuplicates([id_col, text_copy]))
    return kept.select(*docs.columns)
