"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch of changes (inserts, revisions, deletes) becomes signed rows: the old counts of a
changed document with -1, its new counts with +1. Signed rows are summed into a delta of the
totals; totals are the sum of all deltas, so they never need the documents again. A batch is
written to a pending folder and renamed to ``batches/<id>`` in one step. A batch id that is
there already is left alone, so committing a batch again, or after a lost driver, changes
nothing.

Only changed documents are looked up, by id, among the counts in force. Logs are sorted by
bucket (a hash of the id) and id, so that a small batch reads only the files and row groups
of its own buckets. When the logs since the last compaction outweigh the compacted state, they are merged into a
new one (one row for each document in force), again by one rename; so a commit never reads
more than about twice the state, and all compactions together cost about as much as the
logs. Texts are counted in one scan and never shuffled.

Defined results: a null text has no tokens but is a document; a very long text is counted
whole; null sources and languages are groups of their own; of several changes to an id in one
batch, repeated rows among them, the one with the largest ``seq``, then the largest counts,
holds; deleting an unknown id does nothing; inserting a known one revises it; rows with a null
id are counted on insert, each by itself, and can't be changed later; groups without documents
left are not reported; an empty table is an empty batch, and an empty batch is a batch; other
columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words
from .common import lower_ascii, staged

COUNTS = "map<string, bigint>"
LOG = "doc_id long, source string, lang string, counts map<string, bigint>, sign int"
TOTALS = "source string, lang string, version string, n_docs long, n_tokens long"
CHANGE = "doc_id long, source string, lang string, counts map<string, bigint>, deleted boolean, seq long"

BUCKETS = 4096
PUSHED = 10  # Parquet's readers skip row groups by so many literals at most
LEAST_BYTES = 1 << 20  # logs smaller than this aren't worth a compaction

#: Tokenizer versions that SQL can count: white-space words; runs of digits, a-z and non-ASCII.
VERSIONS = {
    "words-1": lambda text: F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")),
    "words-2": lambda text: F.regexp_count(lower_ascii(text), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")),
}


def counts_of(text: Column, versions: dict = VERSIONS) -> Column:
    """A map from tokenizer version to the number of tokens of ``text``."""
    whole = F.coalesce(text, F.lit(""))
    return F.create_map(*[x for name, count in versions.items() for x in (F.lit(name), count(whole).cast("long"))])


#: The same versions over bytes: whether to lower-case, and the bytes of words.
BYTES = {"words-1": (False, words.NOT_SPACE), "words-2": (True, words.ALNUM)}


def word_counts(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text", blank: str | None = None) -> DataFrame:
    """``keep`` columns with ``counts`` and, where ``blank`` is given, ``bare``: counts with that ASCII character as a space.

    Counts as ``counts_of`` does, many texts at once. A kept column named like a result gives way to it.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    results = ("counts", "bare")[: 1 + (blank is not None)]
    keep = tuple(c for c in keep if c not in results)
    kept = [f"k{i}" for i in range(len(keep))]
    plan = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(text_col).alias("text"))
    result = StructType([*plan.select(*kept).schema.fields])
    numbers = [f"{part}{i}" for part in "nb"[: len(results)] for i in range(len(BYTES))]
    for n in numbers:
        result = result.add(n, "long")
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in words.chunks(batches, "text"):
            out = []
            for bare in (False, True)[: len(results)]:
                own = np.where(data == ord(blank), np.uint8(32), data) if bare else data
                for lower, letters in BYTES.values():
                    out.append(np.diff(words.spans(words.LOWER[own] if lower else own, offsets, letters)[2]))
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in kept), *(pa.array(x, pa.int64()) for x in out)], schema=schema)

    as_map = lambda part: F.create_map(*[x for i, name in enumerate(BYTES) for x in (F.lit(name), F.col(f"{part}{i}"))])
    return plan.mapInArrow(run, result).select(*kept, *[as_map(part) for part in "nb"[: len(results)]]).toDF(*keep, *results)


def bpe_counts(docs: DataFrame, tokenizer_path: str, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    """``keep`` columns with n_tokens under a byte-level vocabulary of the tokenizers library, for versions that SQL can't count.

    A kept column named n_tokens gives way to the count.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    from .token_files import PIECES_CHUNK, encoder

    keep = tuple(c for c in keep if c != "n_tokens")
    kept = [f"k{i}" for i in range(len(keep))]
    plan = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(text_col).alias("text"))
    result = StructType([*plan.select(*kept).schema.fields]).add("n_tokens", "long")
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        for rows, data, offsets in words.chunks(batches, "text", PIECES_CHUNK):
            _, counts = encode.encode(data, offsets)
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in kept), pa.array(np.asarray(counts) - 1, pa.int64())], schema=schema)

    return plan.mapInArrow(run, result).toDF(*keep, "n_tokens")


def changes(rows: DataFrame, counts: Column | None, seq: int = 0) -> DataFrame:
    """A batch from ``rows`` (doc_id, and source and lang unless they are deleted): new counts, or None to delete."""
    gone = counts is None
    text = F.lit(None).cast("string")
    return rows.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (text if gone else F.col("source")).alias("source"),
        (text if gone else F.col("lang")).alias("lang"),
        (F.lit(None).cast(COUNTS) if gone else counts.cast(COUNTS)).alias("counts"),
        F.lit(gone).alias("deleted"),
        F.lit(seq).cast("long").alias("seq"),
    )


class TokenLedger:
    """Totals in a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, least_bytes: int = LEAST_BYTES):
        self.spark, self.folder, self.buckets, self.least_bytes = spark, folder.rstrip("/"), buckets, least_bytes
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # ------------------------------------------------------------ files

    def _names(self, folder: str) -> list[str]:
        top = self._path(f"{self.folder}/{folder}")
        return sorted(s.getPath().getName() for s in self._fs.listStatus(top)) if self._fs.exists(top) else []

    def batches(self) -> list[str]:
        return self._names("batches")

    def _bytes(self, folders: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._path(f"{self.folder}/{f}")).getLength() for f in folders if self._fs.exists(self._path(f"{self.folder}/{f}")))

    def _read(self, folders: list[str], schema: str) -> DataFrame:
        """Rows of the tables that are there."""
        there = [f"{self.folder}/{f}" for f in folders if self._fs.exists(self._path(f"{self.folder}/{f}"))]
        return self.spark.read.schema(schema).parquet(*there) if there else self.spark.createDataFrame([], schema)

    def _bucket(self):
        return F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int")

    def _write_log(self, log: DataFrame, folder: str) -> None:
        """Rows with an id in ranges of buckets and ids, and the others apart, as nothing looks them up."""
        log.where("doc_id is not null").withColumn("bucket", self._bucket()).repartitionByRange("bucket", "doc_id").sortWithinPartitions("bucket", "doc_id").write.parquet(f"{folder}/log")
        log.where("doc_id is null").write.parquet(f"{folder}/nameless")

    def _state(self) -> tuple[str | None, set[str]]:
        """The newest compacted state and the batches it holds."""
        states = self._names("states")
        if not states:
            return None, set()
        rows = self.spark.read.schema("name string").parquet(f"{self.folder}/states/{states[-1]}/batches").collect()  # one name a batch
        return states[-1], {r["name"] for r in rows}

    def _logs(self) -> tuple[list[str], list[str]]:
        """Folders of the compacted log (one or none) and of the later logs."""
        state, held = self._state()
        return [f"states/{state}/log"] if state else [], [f"batches/{b}/log" for b in self.batches() if b not in held]

    # ------------------------------------------------------------ changes

    def _publish(self, name: str, log: DataFrame) -> bool:
        """Write signed rows and their sums, and make them one batch by a rename. False if the batch is there."""
        if name in self.batches():
            return False
        pending = f"{self.folder}/pending/{name}"
        self._fs.delete(self._path(pending), True)
        self._write_log(staged(log, "signed"), pending)
        signed = self.spark.read.schema(f"{LOG}, bucket int").parquet(f"{pending}/log").drop("bucket").unionByName(self.spark.read.schema(LOG).parquet(f"{pending}/nameless"))
        each = signed.select("source", "lang", "sign", F.explode("counts").alias("version", "tokens"))
        sums = each.groupBy("source", "lang", "version").agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("tokens")).alias("n_tokens"))
        sums.where("n_docs <> 0 or n_tokens <> 0").write.parquet(f"{pending}/totals")
        self._fs.mkdirs(self._path(f"{self.folder}/batches"))
        return self._fs.rename(self._path(pending), self._path(f"{self.folder}/batches/{name}"))

    def commit(self, name: str, batch: DataFrame) -> bool:
        """Apply a batch once. False if a batch of that name was applied before."""
        if name in self.batches():
            return False
        state = F.struct("seq", (~F.col("deleted")).alias("live"), F.map_entries("counts").alias("entries"), "source", "lang")
        last = batch.where("doc_id is not null").groupBy("doc_id").agg(F.max(state).alias("s"))
        fresh = last.where("s.live").select("doc_id", "s.source", "s.lang", F.map_from_entries("s.entries").alias("counts"), F.lit(1).alias("sign"))
        nameless = batch.where("doc_id is null and not deleted").select("doc_id", "source", "lang", "counts", F.lit(1).alias("sign"))
        log = fresh.unionByName(nameless)
        if self.batches():
            log = log.unionByName(self._live(last.select("doc_id")).withColumn("sign", F.lit(-1)))
        done = self._publish(name, log)
        before, since = self._logs()
        if self._bytes(since) > max(self.least_bytes, self._bytes(before)):
            self.compact()
        return done

    def _live(self, ids: DataFrame | None) -> DataFrame:
        """Counts in force of the given documents, or of all: what is left where signed rows cancel."""
        before, since = self._logs()
        log = self._read([*before, *since], f"{LOG}, bucket int")
        if ids is not None:
            ids = staged(ids, "ids")
            asked = [r[0] for r in ids.select(self._bucket()).distinct().limit(PUSHED + 1).collect()]
            if len(asked) <= PUSHED:
                log = log.where(F.col("bucket").isin(asked))
            log = log.join(ids, "doc_id", "left_semi")
        rows = log.groupBy("doc_id", "source", "lang", F.map_entries("counts").alias("entries")).agg(F.sum("sign").alias("n")).where("n > 0")
        return rows.select("doc_id", "source", "lang", F.map_from_entries("entries").alias("counts"))

    def compact(self) -> None:
        """Merge all logs into one state. Batches stay, with their names and totals; their logs are read no more."""
        names = self.batches()
        number = f"{len(names):012d}"
        pending = f"{self.folder}/pending-state/{number}"
        if not names or number in self._names("states"):
            return
        self._fs.delete(self._path(pending), True)
        self._write_log(self._live(None).withColumn("sign", F.lit(1)), pending)
        self.spark.createDataFrame([(n,) for n in names], "name string").coalesce(1).write.parquet(f"{pending}/batches")
        self._fs.mkdirs(self._path(f"{self.folder}/states"))
        self._fs.rename(self._path(pending), self._path(f"{self.folder}/states/{number}"))

    def totals(self) -> DataFrame:
        sums = self._read([f"batches/{b}/totals" for b in self.batches()], TOTALS).groupBy("source", "lang", "version").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return sums.where("n_docs > 0")
