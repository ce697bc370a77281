"""Sharding by a two-pass external shuffle.

Pass one scatters records: a seeded hash of doc_id chooses the shard (highest of one weight per
shard, so another shard takes records only into itself), a second seeded hash of id and text a
bucket inside it; there are as many buckets as keep each within BUCKET bytes on average, and as many
tasks as buckets. Spark's shuffle files are the scattered buckets. Pass two reads a bucket at a time, puts it into a fixed
order, shuffles it by Fisher-Yates with a seed of its own and writes it. A record's slot is the
number of records in earlier buckets of its shard plus its place in its bucket.

Law: `key`. doc_id and the shard count alone decide the shard; rows with equal doc_id share one.
Equal texts of different ids are different records and scatter; records equal in id and text share a
bucket. Defined cases: null text counts as empty, null doc_id is one key, a very long text makes a
bucket as long as itself, further columns are written along (but those named like a result
are replaced), an empty table writes no records. A bucket is ordered by id, text and a hash
of all other columns before it is shuffled, so the result depends on the rows and the seed, not on
their order or partitions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import freed_shuffles, shared_path, spare, table, widened

#: Text bytes that a bucket holds on average.
BUCKET = 8 << 20


def shard_of(doc_id: Column, shards: int, seed: int) -> Column:
    """The shard with the highest weight; a shard's weight does not depend on how many there are."""
    weighed = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda i: F.struct(F.xxhash64(F.lit(seed), i, doc_id).alias("w"), i.alias("i")))
    return F.array_max(weighed)["i"]


def write_shards(docs: DataFrame, path: str, shards: int = 8, seed: int = 7, bucket_bytes: int = BUCKET) -> None:
    """Write docs under `path` as shard=0 ... with columns `slot` and `grown_shard` (by one more shard)."""
    docs = docs.drop("shard", "grown_shard", "slot")  # replaced
    in_bucket, order_hash = spare(docs, "_bucket"), spare(docs, "_order")
    text = F.coalesce(F.col("text"), F.lit(""))
    with freed_shuffles(docs.sparkSession):
        total = docs.agg(F.coalesce(F.sum(F.octet_length(text).cast("long") + 1), F.lit(0))).first()[0]
        buckets = max(1, -(-total // (bucket_bytes * shards)))
        place = docs.select(
            *docs.columns,
            shard_of(F.col("doc_id"), shards, seed).alias("shard"),
            shard_of(F.col("doc_id"), shards + 1, seed).alias("grown_shard"),
            F.pmod(F.xxhash64(F.lit(seed + 1), "doc_id", text), F.lit(buckets)).alias(in_bucket),
            F.xxhash64(*(F.col(f"`{f.name}`") for f in docs.schema if not f.dataType.simpleString().startswith(("map", "variant")))).alias(order_hash),
        )
        counts = place.groupBy("shard", in_bucket).agg(F.count("*").alias("_n"))
        before = Window.partitionBy("shard").orderBy(in_bucket).rowsBetween(Window.unboundedPreceding, -1)
        offsets = counts.select("shard", in_bucket, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("slot"))

        def shuffle(bucket: pa.Table) -> pa.Table:
            n = bucket.num_rows
            first = bucket.column("slot")[0].as_py() if n else 0
            keys = (bucket.column("shard")[0].as_py(), bucket.column(in_bucket)[0].as_py()) if n else (0, 0)
            order = pc.sort_indices(bucket, sort_keys=[(c, "ascending") for c in ("doc_id", "text", order_hash)]).to_numpy().copy()
            random = np.random.default_rng([seed, *keys])
            for i in range(n - 1, 0, -1):  # Fisher-Yates
                j = int(random.integers(i + 1))
                order[i], order[j] = order[j], order[i]
            out = bucket.take(pa.array(order))
            return out.set_column(out.schema.get_field_index("slot"), "slot", pa.array(first + np.arange(n, dtype=np.int64)))

        scattered = place.repartition(shards * buckets, "shard", in_bucket).join(offsets, ["shard", in_bucket])
        dealt = scattered.select(*place.columns, "slot").groupBy("shard", in_bucket).applyInArrow(shuffle, widened(place, "slot long"))
        dealt.drop(in_bucket, order_hash).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "shards")
    write_shards(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    text = F.coalesce(F.col("text"), F.lit(""))
    written = spark.read.schema("doc_id long, text string, grown_shard int, slot long, shard int").parquet(path)
    return written.select(
        "doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"), F.lit("key").alias("law"),
        "shard", "slot", "grown_shard",
    )
