"""A training corpus from ``documents``, in five stages of the llm subpackage.

Each stage takes what the one before kept, is written as Parquet to the shared folder and
read again. All but the last return the columns of ``documents``; the last returns the records
read back from the shards.

Stages decide by row, not by doc_id: a row's key is its file and its place there. Defined
results: a text that is null or has no letter is rejected by the language stage; empty texts
that reach a later stage are documents like any other (one near-duplicate class, no match,
size 0 in the mix, which takes none); of rows with equal texts one stays, whatever their ids,
and rows with equal ids but different texts all stay; very long texts are read whole; ties
go to the smaller id, then the earlier row; an empty table gives an empty result; further
columns, of any name, are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, langid, mixing, near_dedup, sharding
from lodestone.llm.common import ROW_KEY, discard, keyed, plainly, read, staged

#: A text is rejected by language only if it has no letters or its best language is less likely than this.
LEAST_SCORE = 0.4


def places(docs: DataFrame) -> tuple[dict[str, str], list[str]]:
    """The plain names of the columns of ``docs``, by name and in order."""
    names = plainly(docs)[1]
    return names, list(names.values())


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; ``und`` and hopelessly unsure ones go."""
    plain, at = plainly(docs)
    found = langid.predict(plain, langid.fit(docs), at["text"], tuple(plain.columns))
    sure = found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return sure.select(*plain.columns).toDF(*docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate class stays, the one with the smallest id; of rows that share it, one."""
    rows, (at, columns) = keyed(docs), places(docs)
    classes = near_dedup.near_classes(rows, at["doc_id"], at["text"], keep=ROW_KEY)
    gone = staged(classes.where("not kept").select(*ROW_KEY), "gone")
    return rows.join(gone, list(ROW_KEY), "left_anti").select(*columns).toDF(*docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no window with a benchmark item."""
    plain, at = plainly(docs)
    found = decontaminate.with_matches(plain, read(spark, sf_dir, "benchmark"), text_col=at["text"], keep=tuple(plain.columns))
    return found.where(F.size("matches") == 0).select(*plain.columns).toDF(*docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it."""
    rows, (at, columns) = keyed(docs), places(docs)
    taken = staged(mixing.mix(rows, id_col=at["doc_id"], text_col=at["text"], source_col=at["source"], keep=ROW_KEY).where("copies > 0").select(*ROW_KEY, "copies"), "taken")
    # Taken rows grow with the input, so this is a sort merge join at every size.
    picked = rows.join(taken.hint("merge"), list(ROW_KEY))
    copies = F.explode(F.sequence(F.lit(1), F.col("copies")))
    return picked.select(*columns, copies.alias("copy")).drop("copy").toDF(*docs.columns)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The records, read back from the shards they were written to, with size, text_crc32, law, shard and slot.

    A column of ``docs`` that is named like one of these stays in the files only.
    """
    found = sharding.sharded(docs)
    place = ["size", "text_crc32", "law", "shard", "slot"]
    return found.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in place], *place)


STAGES = [
    ("language", language_stage),
    ("near-dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("sharding", sharding_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = first = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, staged(stage(spark, docs, sf_dir), name)
        if before is not first:
            discard(spark, before)
    return docs


#: Language ID and near-duplicate classes can't be expressed in SQL.
ORACLE_SQL = None
