"""Exact dedup by deterministic block naming, with DataFrame functions only.

Equal texts get equal integers without trusting any hash. Texts are cut into blocks of
a fixed number of bytes. The distinct blocks are sorted, and a block's rank is its
name. Then adjacent names are paired, the distinct pairs are sorted and ranked in turn,
and so on until each text has one name left: log2(blocks) rounds over shrinking rows.

Texts can be equal only if their sizes and first characters are. A text that is alone
with both has its identity already; only the others bring all their blocks into the
sort. This is no estimate: size and first characters are compared by value.

Names are ranks: values are dealt to partitions by hash and sorted there; a name is the
partition's offset plus the place in its order. Equal values always meet in one partition and
are compared by value, so names are free of collisions, and no step needs all rows in one
task or a sample of the values. Each round's names are written to the shared folder before
use, so a lost executor can't change them.

Defined results: a null text counts as empty; empty texts are equal to each other; a very long
text is as many blocks as it needs; rows with a null id are members too, and any id beats
null; of tied largest ids all rows are kept; repeated rows are members like any other; an
empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, lower_ascii, staged

BLOCK = 2048
HEAD = 64


def named(rows: DataFrame, by: list[str]) -> DataFrame:
    """``rows`` with a name in place of their ``by`` values; staged.

    The distinct values are dealt by hash, so equal ones meet; each partition sorts its own, and
    a name is the partition's offset plus the rank in it. No value is sampled or leaves its task.
    """
    keys = rows.select(*by).distinct().sortWithinPartitions(*by)
    names = staged(keys.select(*by, F.monotonically_increasing_id().alias("name")), "names")
    out = staged(rows.join(names, by).drop(*by), "named")
    discard(rows.sparkSession, names)
    return out


def block_names(texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """(row, round, name): rows with equal texts, and only they, share round and name. ``texts``: (row, text)."""
    spark = texts.sparkSession
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block))).cast("int")
    # Bytes, not characters: a block is cut where it is, without reading what comes before it.
    cut = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.substring(F.col("text"), i * block + 1, F.lit(block)))
    rows = texts.select("row", F.col("text").cast("binary").alias("text")).withColumn("blocks", count).select("row", "blocks", F.posexplode(cut).alias("at", "part"))
    rows, number = named(rows, ["part"]), 0
    identities = rows.where("blocks = 1").select("row", F.lit(0).alias("round"), "name")
    most = rows.agg(F.max("blocks")).first()[0] or 0
    while most > 1:
        number += 1
        pairs = rows.where("blocks > 1").groupBy("row", "blocks", F.shiftright("at", 1).alias("at")).agg(
            F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
            # A last name without a partner is paired with -1, which no name has.
            F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
        )
        pairs = staged(pairs.withColumn("blocks", F.ceil(F.col("blocks") / 2).cast("int")), "pairs")
        rows = named(pairs, ["left", "right"])
        discard(spark, pairs)
        identities = identities.unionByName(rows.where("blocks = 1").select("row", F.lit(number).alias("round"), "name"))
        most = (most + 1) // 2
    return identities


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", normalise=lower_ascii, block: int = BLOCK) -> DataFrame:
    """One row for each row of ``docs``: id, keep_id (the largest of equal texts), group_size, kept, text_sha256.

    Where rows of a group share the largest id, all of those rows are marked as kept.
    """
    key = ["size", "head"]
    texts = docs.select(F.col(id_col).alias("id"), normalise(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))
    texts = texts.withColumns({"size": F.octet_length("text"), "head": F.substring("text", 1, HEAD), "text_sha256": F.sha2(F.col("text"), 256)})
    heads = staged(texts.drop("text"), "heads")
    first = staged(heads.groupBy(*key).agg(F.count("*").alias("n")), "first")
    alone = heads.join(first.where("n = 1"), key).select(
        "id", F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    # The row number is fixed once it is written.
    open_rows = staged(texts.join(first.where("n > 1"), key).select(F.monotonically_increasing_id().alias("row"), "id", "text_sha256", "text"), "open")
    members = staged(open_rows.select("row", "id", "text_sha256").join(block_names(open_rows.select("row", "text"), block), "row").drop("row"), "members")
    discard(docs.sparkSession, open_rows)
    groups = staged(members.groupBy("round", "name").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    same = members.join(groups, ["round", "name"]).select(
        "id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )
    return alone.unionByName(same).withColumnRenamed("id", id_col)
