"""Shuffled shards by a two-pass external shuffle.

Pass 1 scatters every record by seeded hashes: to a shard, which its id and
the shard count alone decide, and within it to a bucket that fits in memory.
A shard has as many buckets as its own bytes ask for, so a shard that one id
makes large has more of them, not larger ones. Pass 2 puts each bucket through
a Fisher-Yates shuffle and writes it.

Null ids take part like any value, and share a shard. A null text has no bytes
and counts one byte of size, its crc32 is that of no bytes. Repeated rows stay
repeated rows, each with its own slot; a seeded number for each row deals them
over the buckets as well. A text larger than a bucket makes its bucket larger,
as no record is cut. An empty table gives no rows. Other columns of the input
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seepage.session import scratch

LAW = "key"
SEED = 20_011
BUCKET_BYTES = 32 << 20


def key_shard(key: Column, shards: int, seed: int = SEED) -> Column:
    """Shard of a key: the last k whose own uniform number, hashed from (seed, k, key), is below 1 / (k + 1).

    Shard k thus takes an equal share of what the shards before it held, and
    growing from n to n + 1 shards moves rows into the new shard only.
    """
    def taken(k: Column) -> Column:
        draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), k, key), 11) * F.lit(2.0**-53)
        return draw * (k + 1) < 1
    last = F.array_max(F.filter(F.sequence(F.lit(0), F.lit(shards - 1)), lambda k: (k == 0) | taken(k)))
    return last.cast("int")


def _fisher_yates(seed: int):
    """Arrow function: each run of equal ``bucket`` is held as a whole, shuffled, and numbered from 0."""
    def shuffled(parts: list[pa.RecordBatch], bucket: int):
        table = pa.Table.from_batches(parts)
        order = np.arange(table.num_rows)
        np.random.Generator(np.random.PCG64([seed, bucket])).shuffle(order)  # numpy's shuffle is Fisher and Yates's
        out = table.take(pa.array(order)).append_column("pos", pa.array(np.arange(len(order))))
        return out.combine_chunks().to_batches(max_chunksize=4096)

    def run(batches):
        held, current = [], None
        for batch in batches:
            buckets = batch.column("bucket").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(buckets)) + 1).tolist(), len(buckets)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and buckets[a] != current:
                    yield from shuffled(held, current)
                    held = []
                current = int(buckets[a])
                held.append(batch.slice(a, b - a))
        if held:
            yield from shuffled(held, current)
    return run


def write_shards(
    docs: DataFrame, out: str, shards: int = 16, *, id_col: str = "doc_id", text_col: str = "text",
    seed: int = SEED, bucket_bytes: int = BUCKET_BYTES,
) -> DataFrame:
    """Write the documents as shuffled Parquet shards below ``out`` (folders shard=0, shard=1, ...).

    Returns the files' rows without the texts: doc_id, size, text_crc32,
    shard, bucket, pos, and slot, which counts gapless from 0 in each shard.
    The shard is ``key_shard`` of the id. The bucket hashes id, text and the
    row's place in the scan. Every task has one bucket and orders it before
    shuffling it, so a task that runs again writes the same rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    shard = key_shard(F.col("doc_id"), shards, seed)
    bytes_of = {r.shard: r.bytes for r in rows.groupBy(shard.alias("shard")).agg(F.sum(size).alias("bytes")).collect()}  # a row a shard
    buckets = [max(1, -(-bytes_of.get(k, 0) // bucket_bytes)) for k in range(shards)]
    firsts = [sum(buckets[:k]) for k in range(shards)]
    at = lambda numbers: F.get(F.array(*[F.lit(n).cast("long") for n in numbers]), F.col("shard"))
    # Equal rows have equal hashes; the row's own number, drawn in the order of the scan, parts them.
    rows = rows.select(
        "doc_id", "text", size.alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), shard.alias("shard"),
        F.xxhash64(F.lit(seed + 1), "doc_id", "text", F.monotonically_increasing_id()).alias("mixed"),
    ).withColumn("bucket", at(firsts) + F.pmod("mixed", at(buckets)))
    kind = rows.schema["doc_id"].dataType.simpleString()
    dealt = (
        rows.repartitionById(sum(buckets), F.col("bucket").cast("int"))
        .sortWithinPartitions("bucket", "mixed", "doc_id", "text")
        .select("doc_id", "text", "size", "text_crc32", "shard", "bucket")
    )
    schema = f"doc_id {kind}, text string, size long, text_crc32 long, shard int, bucket long, pos long"
    dealt.mapInArrow(_fisher_yates(seed), schema).write.partitionBy("shard").parquet(out)
    written = spark.read.schema(schema).parquet(out)
    counts = written.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return written.join(bases, ["shard", "bucket"]).select(
        "doc_id", "size", "text_crc32", "shard", "bucket", "pos", (F.col("base") + F.col("pos")).alias("slot")
    )


def sharded(docs: DataFrame, shards: int = 16, **options) -> DataFrame:
    """``write_shards`` into the shared folder, with the law's name and each row's shard if there were one shard more."""
    seed = options.get("seed", SEED)
    rows = write_shards(docs, scratch(docs.sparkSession, "shards"), shards, **options)
    return rows.select(
        "doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot",
        key_shard(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
    )
