"""Two-pass external shuffle into shards, with DataFrame functions only.

Pass one scatters whole records uniformly into buckets that fit in memory, by a seeded hash
of the row's key (its file and its place there). Pass two brings each bucket into one row as
a sorted array, applies Spark's ``shuffle``, a Fisher-Yates shuffle with a seed, and writes the
records. Buckets one after another are then one random order of all records. Shard s of S
takes the places from s N / S to (s + 1) N / S, so shards differ by one record at most (the
law ``rows``) and records move once: a bucket is written where it was shuffled.

The sizes of the buckets are counted beforehand, from the keys alone, and summed up in ranges.
A rerun gives the same order: row keys are fixed, ``shuffle`` draws from a stream for each
partition, and here the number of partitions depends on the data alone, each partition's
buckets are sorted, and so is each bucket's array. The hash of a row key spreads a hot source,
a group of copies and repeated rows like all else.

Files are written below ``shard=N``, in slot order, with the record's columns inside ``doc``, so
that no column's name can clash with another.

Memory: a task holds at most ``TASK_BUCKETS`` buckets of about ``bucket_bytes``, or one record
where that is longer. Raise ``bucket_bytes`` with the executors' memory: tasks are the bytes of
all records divided by both.

Defined results: a null text has no bytes, thus size 16 and the checksum of no bytes; a very
long text is a record like any other and makes its bucket longer; null ids, ties and repeated
rows are records like any other; an empty table writes no record; other columns, of any name,
are written too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from ..operators.ranges import running_total
from .common import ROW_KEY, keyed, new_folder, staged

SHARDS = 40
SEED = 20_240_501
RECORD_OVERHEAD = 16
BUCKET_BYTES = 4 << 20
TASK_BUCKETS = 4


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> None:
    """Write the records of ``docs`` as Parquet under ``path``/shard=N, each file a range of slots in order."""
    columns = docs.columns
    rows = keyed(docs)
    text = F.col(f"_c{columns.index(text_col)}")
    size = F.octet_length(F.coalesce(text, F.lit("")).cast("binary")).cast("long") + RECORD_OVERHEAD
    total, n = rows.agg(F.sum(size), F.count("*")).first()
    buckets = max(1, -(-(total or 0) // bucket_bytes))
    tasks = -(-buckets // TASK_BUCKETS)
    dealt = rows.withColumn("_h", F.xxhash64(F.lit(seed), *ROW_KEY)).withColumn("_bucket", F.pmod("_h", F.lit(buckets)))

    sizes = staged(dealt.groupBy("_bucket").agg(F.count("*").alias("_n")), "bucket-sizes")
    before = running_total(sizes, ["_bucket"], "_n", "_to").select(task_of(F.col("_bucket")).alias("_task"), "_bucket", (F.col("_to") - F.col("_n")).alias("_before"))
    before = before.groupBy("_task").agg(F.map_from_entries(F.collect_list(F.struct("_bucket", "_before"))).alias("_starts"))

    record = F.struct("_h", *ROW_KEY, F.struct(*[f"_c{i}" for i in range(len(columns))]).alias("doc"))
    filled = (
        dealt.withColumn("_task", task_of(F.col("_bucket")))
        .repartition(tasks, "_task")
        .groupBy("_task", "_bucket")
        .agg(F.sort_array(F.collect_list(record)).alias("_all"))
        .sortWithinPartitions("_task", "_bucket")
    )
    # The join is by task, as the buckets are dealt, so it moves no record.
    mixed = filled.select("_task", "_bucket", F.shuffle("_all", seed).alias("_all")).join(before, "_task")
    each = mixed.select(F.col("_starts")[F.col("_bucket")].alias("_before"), F.posexplode("_all").alias("_at", "_r"))
    each = each.select(F.col("_r.doc").cast(docs.schema).alias("doc"), (F.col("_before") + F.col("_at")).alias("p"))
    each = each.withColumn("shard", F.expr(f"cast(((p + 1) * {shards} - 1) div {max(1, n)} as int)"))
    each = each.select("doc", "shard", F.expr(f"p - (cast(shard as bigint) * {n}) div {shards}").alias("slot"))
    each.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def task_of(bucket: Column) -> Column:
    return F.floor(bucket / TASK_BUCKETS)


def sharded(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, text_col: str = "text", bucket_bytes: int = BUCKET_BYTES, path: str | None = None) -> DataFrame:
    """Write the shards and read them back: ``doc`` (a record's columns), size, text_crc32, law, shard, slot, grown_shard."""
    path = path or new_folder(docs.sparkSession, "shards")
    write_shards(docs, path, shards, seed, text_col, bucket_bytes)
    schema = StructType([StructField("doc", docs.schema), StructField("slot", LongType()), StructField("shard", IntegerType())])
    back = docs.sparkSession.read.schema(schema).parquet(path)
    raw = F.coalesce(F.col("doc").getField(text_col), F.lit("")).cast("binary")
    return back.select(
        "doc",
        (F.octet_length(raw).cast("long") + RECORD_OVERHEAD).alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
