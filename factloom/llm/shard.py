"""Sharding by a two-pass external shuffle.

Pass one scatters the records uniformly into memory-sized buckets by a seeded hash of the whole record and its
place in the input, so neither a hot key nor copies fill one bucket. Pass two shuffles each bucket in memory with
Fisher and Yates' method, seeded by the bucket, and writes it to the shared folder. The buckets one after another
are the shuffled order; record k of it goes to shard k mod n, slot k div n. So the law `rows` holds: the shards'
counts are at most one apart.

The texts are shuffled once, by bucket, and written once. Where a bucket begins in the order follows from the buckets'
counts: a table of at most MAX_BUCKETS rows of two numbers, which goes to every task, so the texts stay where they are
(beyond MAX_BUCKETS * BUCKET_BYTES of input, buckets get larger instead of more). A task takes its buckets one after
another, so its memory is that of one bucket, and there are no more than MAX_TASKS of them. A record is never cut: one
that is larger than a bucket is a bucket's worth of memory by itself.

The same input files, splits and seed give the same order, also where a task runs again: records are put into the
order of their hashes before they are shuffled.

Edge cases: null ids and texts are records like any other; repeated rows keep their number; an empty table gives
no rows; all columns of the input are kept, of whatever type, and those that this adds (shard, slot) replace columns of
that name. Columns named __key, __bucket and __place are dropped.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm.common import hashable, place, schema_with, session, table

SHARDS = 8
SEED = 7
BUCKET_BYTES = 16 << 20
MAX_BUCKETS = 1 << 20
MAX_TASKS = 8192


def fisher_yates(n: int, seed: int) -> list[int]:
    order = list(range(n))
    draws = np.random.default_rng(seed).random(n)
    for k in range(n - 1, 0, -1):
        j = int(draws[k] * (k + 1))
        order[k], order[j] = order[j], order[k]
    return order


def external_shuffle(records: DataFrame, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records with __bucket and __place, in files of the shared folder."""
    spark = session(records.sparkSession)
    records = records.drop("__key", "__bucket", "__place")
    total = records.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 64)).first()[0] or 0
    buckets = min(MAX_BUCKETS, max(1, -(-total // bucket_bytes)))
    key = F.xxhash64(F.lit(seed), *hashable(records), F.monotonically_increasing_id())
    scattered = records.withColumn("__key", key).withColumn("__bucket", F.pmod(F.xxhash64("__key", F.lit(seed)), F.lit(buckets)))

    def shuffled(bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by("__key")
        number = bucket.column("__bucket")[0].as_py()
        bucket = bucket.take(pa.array(fisher_yates(bucket.num_rows, seed * 1_000_003 + number), pa.int64()))
        return bucket.append_column("__place", pa.array(range(bucket.num_rows), pa.int64()))

    path = place(spark, "shuffled")
    dealt = scattered.repartition(min(buckets, MAX_TASKS), "__bucket")
    dealt.groupBy("__bucket").applyInArrow(shuffled, schema_with(scattered, scattered.columns, "__place long")).drop("__key").write.parquet(path)
    return spark.read.parquet(path)


def begins(shuffled: DataFrame) -> DataFrame:
    """(__bucket, __before): how many records stand in the buckets before; at most MAX_BUCKETS rows."""
    counts = shuffled.groupBy("__bucket").agg(F.count("*").alias("n")).toPandas().sort_values("__bucket")
    n = counts["n"].to_numpy(np.int64)
    rows = pa.table({"__bucket": pa.array(counts["__bucket"].to_numpy(np.int64)), "__before": pa.array(np.cumsum(n) - n)})
    return shuffled.sparkSession.createDataFrame(rows)


def shard(records: DataFrame, shards: int = SHARDS, text: str = "text", seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All records with shard and slot."""
    shuffled = external_shuffle(records.drop("shard", "slot"), text, seed, bucket_bytes)
    at = F.col("__before") + F.col("__place")
    placed = shuffled.join(F.broadcast(begins(shuffled)), "__bucket")
    return placed.select(*(c for c in shuffled.columns if c not in ("__bucket", "__place")), F.pmod(at, F.lit(shards)).cast("int").alias("shard"), F.floor(at / shards).cast("long").alias("slot"))


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
