"""Embedding near duplicates: cells of a spherical k-means, cosines in blocks of cells, one vector kept of each group.

A vector lies in the cell of its nearest centre. Two unit vectors at a chord
of r are on different sides of the plane between centres c and h only if each
is within r of it, so of two cells only the vectors that near to their plane
are compared. Links are thus exact whatever the
centres, which may be fitted on a bounded sample.

Vectors are written once, as flat files in the order of their cells. Work is
dealt out as pairs of blocks, each a file, a place and a size; a task maps the
two blocks from the shared folder. No vector is copied for the cells that it
is compared with, so what is shuffled and written grows with the vectors and
not with their pairs.

Equal vectors are compared once and weighted by their number. Only vectors of
one label, not null, and of one length meet. A vector that is null, empty,
zero or holds null or non-finite components links with nothing and stands for
itself. Repeated ids have a row each. An empty table gives no rows.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seepage.llm.graph import components, local_roots
from seepage.llm.token_files import _filesystem, _mapped
from seepage.session import scratch, settle

#: Vectors that the centres are fitted on at most, and how many of a label a cell shall hold.
SAMPLE = 8192
PER_CELL = 1024
MOST_CELLS = 1024
#: Most vectors of a block.
BLOCK = 2048


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of a spherical k-means over unit vectors."""
    cells = max(1, min(cells, len(sample)))
    centres = sample[np.sort(np.random.default_rng(seed).choice(len(sample), cells, replace=False))]
    for _ in range(rounds):
        home = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, sample)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(size > 0, sums / np.where(size > 0, size, 1), centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of a list column whose lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _cells(centres: np.ndarray, threshold: float, visits: bool = True):
    """Arrow function: a vector's rows, one in its home cell and, with ``visits``, one in each cell before it that it may have a partner in."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9
    apart = np.sqrt(np.maximum(0.0, 2 - 2 * (centres @ centres.T)))

    def run(batches):
        for batch in batches:
            sizes = np.diff(batch.column("vector").offsets.to_numpy())
            fits = np.flatnonzero(sizes == centres.shape[1])
            rows, cells, homes = [np.flatnonzero(sizes != centres.shape[1])], [], []
            cells.append(np.full(len(rows[0]), -1))  # vectors of another length share one cell, where all meet
            homes.append(cells[0])
            for a in range(0, len(fits), 2048):
                at = fits[a: a + 2048]
                x = _matrix(batch.column("vector").take(pa.array(at)))
                cos = (x / np.linalg.norm(x, axis=1, keepdims=True)) @ centres.T
                home = cos.argmax(axis=1)
                if visits:
                    near = cos.max(axis=1, keepdims=True) - cos <= reach * apart[home]
                    near &= np.arange(len(centres)) < home[:, None]
                    near[np.arange(len(at)), home] = True
                    i, c = np.nonzero(near)
                else:
                    i, c = np.arange(len(at)), home
                rows.append(at[i])
                cells.append(c)
                homes.append(home[i])
            taken = batch.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [*taken.columns, pa.array(np.concatenate(cells), pa.int32()), pa.array(np.concatenate(homes), pa.int32())],
                [*taken.schema.names, "cell", "home"],
            )
    return run


def _merged(batches):
    """Arrow function: equal vectors of a batch as one row, so that a vector of very many rows is dealt out as few."""
    for batch in batches:
        if not batch.num_rows:
            continue
        own = pa.table({c: batch.column(c) for c in ("rep", "first", "times")}).append_column("at", pa.array(np.arange(batch.num_rows)))
        own = own.group_by("rep").aggregate([("first", "min"), ("times", "sum"), ("at", "min")]).combine_chunks()
        out = batch.take(own.column("at_min").combine_chunks())
        new = {"first": own.column("first_min").combine_chunks(), "times": own.column("times_sum").combine_chunks()}
        yield pa.RecordBatch.from_arrays([new.get(c, out.column(c)) for c in out.schema.names], out.schema.names)


def _write(folder: str, dtype: str):
    """Arrow function: a task's vectors as one flat file, and their ids and numbers as another; every vector's place there."""
    def run(batches):
        fs, root = _filesystem(folder)
        name, row, start, vectors_out, ids_out = uuid.uuid4().hex, 0, 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if vectors_out is None:
                vectors_out = fs.open_output_stream(f"{root}/{name}.vec")
                ids_out = fs.open_output_stream(f"{root}/{name}.ids")
            vectors_out.write(batch.column("vector").flatten().to_numpy().astype(dtype).tobytes())
            ids_out.write(np.column_stack([batch.column("rep").to_numpy(), batch.column("times").to_numpy()]).astype("<i8").tobytes())
            dims = batch.column("dim").to_numpy().astype(np.int64)
            starts = start + np.cumsum(dims) - dims
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in ("rep", "first", "times", "label", "dim", "home")],
                 pa.array([name] * n), pa.array(np.arange(row, row + n)), pa.array(starts)],
                ["rep", "first", "times", "label", "dim", "home", "file", "row", "start"])
            row, start = row + n, start + int(dims.sum())
        if vectors_out is not None:
            vectors_out.close()
            ids_out.close()
    return run


def _blocks(placed: DataFrame, block: int) -> DataFrame:
    """Runs of at most ``block`` neighbouring vectors of one label, length and cell in one file."""
    runs = placed.groupBy("label", "dim", "home", "file").agg(
        F.min("row").alias("row"), F.min("start").alias("start"), F.count("*").alias("n"))
    cut = runs.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))))
    return cut.select("label", "dim", "home", "file", (F.col("row") + F.col("k")).alias("row"),
                      (F.col("start") + F.col("k") * F.col("dim")).alias("start"),
                      F.least(F.col("n") - F.col("k"), F.lit(block)).alias("n"))


def _compare(folder: str, dtype: str, centres: np.ndarray, threshold: float):
    """Arrow function: in each pair of blocks, every member's number of links there and the least member reached."""
    reach = np.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9

    def block(file, row, start, n, dim):
        x = np.array(_mapped(folder, f"{file}.vec", dtype)[start: start + n * dim]).reshape(n, dim).astype(np.float64)
        own = np.array(_mapped(folder, f"{file}.ids", "<i8")[2 * row: 2 * (row + n)]).reshape(n, 2)
        return x / np.linalg.norm(x, axis=1, keepdims=True), own[:, 0], own[:, 1]

    def run(batches):
        for batch in batches:
            for u in batch.to_pylist():
                same = u["a"] == u["b"]
                if same and u["a"]["n"] < 2:
                    continue
                x, ids, times = block(*(u["a"][c] for c in ("file", "row", "start", "n")), u["dim"])
                if same:
                    y, far_ids, far_times = x, ids, times
                else:
                    y, far_ids, far_times = block(*(u["b"][c] for c in ("file", "row", "start", "n")), u["dim"])
                c, h = u["a"]["home"], u["b"]["home"]
                if c != h:  # only those near to the plane between the cells
                    across = centres[c] - centres[h]
                    limit = reach * np.linalg.norm(across) + 1e-12
                    near, far = x @ across <= limit, y @ across >= -limit
                    x, ids, times = x[near], ids[near], times[near]
                    y, far_ids, far_times = y[far], far_ids[far], far_times[far]
                linked = x @ y.T >= threshold
                if same:
                    np.fill_diagonal(linked, False)
                if not linked.any():
                    continue
                n = linked @ far_times
                if same:
                    i, j = np.nonzero(np.triu(linked))
                else:
                    i, j = np.nonzero(linked)
                    j = j + len(ids)
                    n = np.r_[n, times @ linked]
                    ids = np.r_[ids, far_ids]
                some = np.flatnonzero(n)
                root = local_roots(len(ids), i, j)
                yield pa.RecordBatch.from_pydict(
                    {"rep": ids[some], "n": n[some].astype(np.int64), "reached": ids[root[some]]})
    return run


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, *, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", sample: int = SAMPLE, block: int = BLOCK,
) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id and kept, over all pairs of one label with a cosine of
    ``threshold`` or more, in double precision."""
    spark = vectors.sparkSession
    exact = vectors.schema[vector_col].dataType
    single = isinstance(exact, T.ArrayType) and isinstance(exact.elementType, T.FloatType)
    kind, dtype = ("float", "<f4") if single else ("double", "<f8")
    rows = vectors.select(
        F.col(id_col).alias("vec_id"),
        F.transform(F.col(vector_col).cast(f"array<{kind}>"), lambda x: x + F.lit(0.0).cast(kind)).alias("vector"),  # no -0.0
        F.col(label_col).cast("string").alias("label"),
    )
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    sound = F.col("label").isNotNull() & (F.size("vector") > 0) & finite & F.exists("vector", lambda x: x != 0)
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    whole = rows.filter("sound").select(
        F.xxhash64("label", "vector").alias("rep"), F.col("vec_id").alias("first"), F.lit(1).cast("long").alias("times"),
        "label", F.size("vector").alias("dim"), "vector")
    count, labels = whole.agg(F.count("*"), F.approx_count_distinct("label")).first()
    if count:
        # A bounded sample of the vectors, the least by hash; it shapes the cells and not the result.
        picked = whole.select("vector").orderBy(F.xxhash64("rep", "first")).limit(sample)
        held = list(dict.fromkeys(tuple(r.vector) for r in picked.collect()))
        dim = max({len(v) for v in held}, key=lambda d: (sum(len(v) == d for v in held), d))
        x = np.array([v for v in held if len(v) == dim])
        centres = fit_centres(x / np.linalg.norm(x, axis=1, keepdims=True), min(MOST_CELLS, -(-count // (labels * PER_CELL))))
    else:
        centres = np.ones((1, 1))
    id_kind = vectors.schema[id_col].dataType.simpleString()
    named = f"rep long, first {id_kind}, times long, label string, dim int, vector array<{kind}>"
    homes = _cells(centres, threshold, visits=False)
    celled = whole.mapInArrow(lambda batches: homes(_merged(batches)), f"{named}, cell int, home int").drop("cell")
    folder, by = scratch(spark, "vectors"), ["label", "dim", "home", "rep"]
    files, inner = _filesystem(folder)
    files.create_dir(inner, recursive=True)
    dealt = celled.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *by).groupBy(*by, "vector").agg(
        F.sum("times").alias("times"), F.min("first").alias("first")).sortWithinPartitions(*by)
    reps = settle(dealt.mapInArrow(
        _write(folder, dtype),
        f"rep long, first {id_kind}, times long, label string, dim int, home int, file string, row long, start long"), "vectors")
    blocks = settle(_blocks(reps, block), "blocks")
    one = F.struct("home", "file", "row", "start", "n")
    pairs = blocks.select("label", "dim", one.alias("a")).join(blocks.select("label", "dim", one.alias("b")), ["label", "dim"])
    units = pairs.where("a <= b").select("dim", "a", "b").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    found = settle(units.mapInArrow(
        _compare(folder, dtype, centres, threshold), "rep long, n long, reached long"), "cosines")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    roots = components(found.select(F.col("rep").alias("a"), F.col("reached").alias("b")))
    merged = reps.select("rep", "first", "times").join(
        roots.withColumnsRenamed({"node": "rep"}), "rep", "left").join(counts, "rep", "left").select(
        "rep", "first", "times", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("root", "rep").alias("root"))
    least = merged.groupBy("root").agg(F.min("first").alias("least"))
    merged = merged.join(least, "root").select(
        F.col("rep").alias("key"), (F.col("n") + F.col("times") - 1).alias("links"), "least")
    own = rows.withColumn("key", F.when(F.col("sound"), F.xxhash64("label", "vector"))).drop("vector", "label")
    component = F.coalesce("least", "vec_id")
    return own.join(merged, "key", "left").select(
        "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"),
        (F.col("vec_id") == component).alias("kept"),
    )
