"""Token ids as flat binary files: unsigned integers in document order, with 64-bit offsets, read by memory mapping.

Every task writes two files: the ids of its documents one after another, and
an index of (doc_id, offset) pairs of 64-bit integers, where the offset counts
the ids before the document in its file. A task that runs again writes files
under new names; the manifest, a table committed by Spark, names the files
that count and gives each its base, the prefix sum of the ids before it.

A null text is an empty one: it has the end id alone. Documents are in
ascending order of their ids, null first; rows of one id are in the order of
their texts. An empty table gives an empty manifest. Other columns of the input
are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seepage.llm.tokens import batches_of_texts, encoder
from seepage.session import scratch

MANIFEST = "part int, file string, n_docs long, n_tokens long"
NO_ID = -(2**63)  # stands for a null id in the index


def _filesystem(folder: str):
    """The folder's file system and the path there; works for any store that pyarrow knows."""
    return pafs.FileSystem.from_uri(folder) if ":" in folder else (pafs.LocalFileSystem(), folder)


def _writer(folder: str, path: str, spaced: bool, dtype: str, end_id: int):
    def run(batches):
        fs, root = _filesystem(folder)
        part = TaskContext.get().partitionId()
        name, n_docs, n_tokens = f"{part:06d}-{uuid.uuid4().hex[:12]}", 0, 0
        end = np.array([end_id], dtype).tobytes()
        enc, ids_out, index_out = encoder(path, spaced, dtype), None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if ids_out is None:
                ids_out = fs.open_output_stream(f"{root}/{name}.bin")
                index_out = fs.open_output_stream(f"{root}/{name}.idx")
            doc_ids = batch.column("doc_id").cast(pa.int64()).fill_null(NO_ID).to_numpy(zero_copy_only=False)
            texts = batch.column("text").to_pylist()
            for a, b in batches_of_texts(texts):
                ids = enc.encode(texts[a:b])
                sizes = np.array([len(x) for x in ids], np.int64) // np.dtype(dtype).itemsize + 1
                starts = n_tokens + np.cumsum(sizes) - sizes
                index_out.write(np.column_stack([doc_ids[a:b], starts]).astype("<i8").tobytes())
                ids_out.write(end.join(ids) + end)
                n_docs, n_tokens = n_docs + b - a, n_tokens + int(sizes.sum())
        if ids_out is not None:
            ids_out.close()
            index_out.close()
            yield pa.RecordBatch.from_pydict(
                {"part": pa.array([part], pa.int32()), "file": [name], "n_docs": [n_docs], "n_tokens": [n_tokens]}
            )
    return run


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str, *, spaced: bool = False, end_id: int = 2, dtype: str = "<u2",
    id_col: str = "doc_id", text_col: str = "text", parts: int | None = None,
) -> DataFrame:
    """Encode whole texts, ``end_id`` after each, into files in ``folder``; returns the manifest with each file's bases.

    The folder must be one that all executors share. ``tokenizer`` is the path
    of a file of the tokenizers library on every machine. A range partition
    holds neighbouring ids, so files in the order of ``part`` are in the order
    of the documents.
    """
    spark = docs.sparkSession
    fs, root = _filesystem(folder)
    fs.create_dir(root, recursive=True)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions(
        "doc_id", F.xxhash64("text"), "text"
    )
    listed = f"{folder}/manifest"
    spread.mapInArrow(_writer(folder, tokenizer, spaced, dtype, end_id), MANIFEST).write.parquet(listed)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    return spark.read.schema(MANIFEST).parquet(listed).select(
        "part", "file", "n_docs", "n_tokens",
        F.coalesce(F.sum("n_docs").over(before), F.lit(0)).alias("docs_before"),
        F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("tokens_before"),
    )


def _mapped(folder: str, name: str, dtype: str) -> np.ndarray:
    """A file as an array: mapped if the folder is a mounted one, else read."""
    fs, root = _filesystem(folder)
    if isinstance(fs, pafs.LocalFileSystem):
        return np.memmap(f"{root}/{name}", dtype, "r")
    with fs.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read_buffer(), dtype)


def read_document(folder: str, name: str, row: int, dtype: str = "<u2") -> np.ndarray:
    """Ids of the ``row``-th document of a file, by its offset, without reading the others."""
    index, ids = _mapped(folder, f"{name}.idx", "<i8").reshape(-1, 2), _mapped(folder, f"{name}.bin", dtype)
    return ids[index[row, 1]: index[row + 1, 1] if row + 1 < len(index) else len(ids)]


def _reader(folder: str, dtype: str, rows: int = 4096):
    def run(batches):
        for batch in batches:
            for name, base in zip(batch.column("file").to_pylist(), batch.column("tokens_before").to_pylist()):
                index, ids = _mapped(folder, f"{name}.idx", "<i8").reshape(-1, 2), _mapped(folder, f"{name}.bin", dtype)
                for a in range(0, len(index), rows):
                    own = index[a: a + rows]
                    ends = np.append(own[1:, 1], index[a + rows, 1] if a + rows < len(index) else len(ids))
                    wide = ids[own[0, 1]: ends[-1]].astype("<u4").tobytes()
                    at = (np.append(own[:, 1], ends[-1]) - own[0, 1]).tolist()
                    crcs = [zlib.crc32(memoryview(wide)[4 * x: 4 * y]) for x, y in zip(at, at[1:])]
                    yield pa.RecordBatch.from_pydict({
                        "doc_id": pa.array(own[:, 0], mask=own[:, 0] == NO_ID), "start": own[:, 1] + base,
                        "n_tokens": ends - own[:, 1], "ids_crc32": pa.array(crcs, pa.int64()),
                    })
    return run


def read_tokens(manifest: DataFrame, folder: str, dtype: str = "<u2") -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    files = manifest.select("file", "tokens_before").repartition(
        int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    )
    return files.mapInArrow(_reader(folder, dtype), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Write into the shared folder and read back."""
    folder = scratch(docs.sparkSession, "tokens")
    dtype = options.get("dtype", "<u2")
    return read_tokens(write_tokens(docs, folder, tokenizer, **options), folder, dtype)
