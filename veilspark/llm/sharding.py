"""Sharding by an external shuffle of whole rows, in DataFrame functions only.

Rows are scattered into memory-sized buckets by a seeded hash. Each bucket is permuted with Spark's ``shuffle`` function,
which is a seeded Fisher-Yates shuffle of an array in the JVM, and its rows are dealt round robin over the shards, so that
shard sizes differ by one row at most. The tasks that permute the buckets write the shards; rows are shuffled once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import shared_dir, table, utf8

MAX_BUCKETS, BUCKET_BYTES, TASK_BYTES = 1 << 20, 4 << 20, 64 << 20


def row_bytes(df: DataFrame, cols: list[str]) -> F.Column:
    """About the bytes of a row: strings and binaries by length, nested values by that of their text, others 8."""
    total = F.lit(8)
    for name, kind in df.dtypes:
        if name in cols:
            col = F.col(f"`{name}`")
            nested = kind.startswith(("array", "map", "struct"))
            total = total + (F.coalesce(F.octet_length(col.cast("string") if nested else col), F.lit(0)) if nested or kind.startswith(("string", "varchar", "char", "binary")) else F.lit(8))
    return total.cast("long")


def shuffle_into_shards(df: DataFrame, shards: int, key: list[str], seed: int = 20, bucket_rows: int = 16_384, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All rows of ``df`` with ``shard`` (0 to ``shards`` - 1) and ``slot`` (gapless from 0 in each shard).

    The bucket comes from a hash of the ``key`` columns; the rows of a bucket are sorted by a second hash before they are
    shuffled, so a task that runs again gives the same order. Buckets hold about ``bucket_bytes`` or ``bucket_rows`` rows,
    whichever is less, and a task gets buckets of about 64 MB together. There are at most 1,048,576 buckets, and their counts are
    the only thing that is broadcast. Nulls hash like any value; equal rows stay separate rows; an empty table gives no
    rows; columns of ``df`` named like the new ones are replaced. ``df`` is read three times and has to give the same rows
    each time. Rows equal in all key columns share a bucket, which one task holds in memory.
    """
    cols = [c for c in df.columns if c not in ("shard", "slot")]
    keep = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(cols)])
    keys = [F.col(f"`{c}`") for c in key]
    n, size = df.select(row_bytes(df, cols).alias("b")).agg(F.count("*"), F.coalesce(F.sum("b"), F.lit(0))).first()
    buckets = min(MAX_BUCKETS, max(64, -(-n // bucket_rows), -(-size // bucket_bytes)))
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES))
    rows = df.select(F.xxhash64(F.lit(seed), *keys).alias("h"), F.xxhash64(F.lit(seed + 1), *keys).alias("o"), keep.alias("r"))
    rows = rows.select(F.pmod("h", F.lit(buckets)).cast("int").alias("bucket"), "o", "h", "r")
    sizes = rows.groupBy("bucket").count()
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    dealt = (
        rows.repartition(tasks, "bucket")
        .groupBy("bucket")
        .agg(F.sort_array(F.collect_list(F.struct("o", "h", "r"))).alias("rows"))
        .sortWithinPartitions("bucket")
        .select("bucket", F.shuffle("rows", seed).alias("rows"))
        .join(F.broadcast(offsets), "bucket")
        .select("offset", F.posexplode("rows").alias("pos", "row"))
        .withColumn("at", F.col("offset") + F.col("pos"))
    )
    return dealt.select(
        *[F.col(f"row.r.c{i}").alias(c) for i, c in enumerate(cols)],
        F.pmod("at", F.lit(shards)).cast("int").alias("shard"),
        F.floor(F.col("at") / shards).cast("long").alias("slot"),
    )


def write_shards(df: DataFrame, path: str, shards: int, key: list[str], seed: int = 20, bucket_rows: int = 16_384) -> None:
    """Write every column of ``df`` as one folder per shard; a shard's files each hold rows in slot order, and ``slot`` orders them over all files."""
    out = shuffle_into_shards(df, shards, key, seed, bucket_rows)
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def read_shards(spark: SparkSession, path: str, df: DataFrame) -> DataFrame:
    """The rows of the shards that ``write_shards`` made of ``df``, with ``slot`` and ``shard``, from the files alone."""
    fields = [f for f in df.schema.fields if f.name not in ("shard", "slot")]
    return spark.read.schema(T.StructType([*fields, T.StructField("slot", T.LongType()), T.StructField("shard", T.IntegerType())])).parquet(path)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Law ``rows``: all documents in 24 shards whose counts differ by one at most. The shards, with all columns, are written to the
    shared folder; the result is derived from what is read back."""
    docs = table(spark, sf_dir, "documents")
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    write_shards(docs, path, 24, ["doc_id", "text"])
    text = utf8(F.col("text"))
    return read_shards(spark, path, docs).select("doc_id", (F.length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
