"""Mixing sources to target weights by subset-sum budget fitting.

A source's target is its weighted share of all words, at most ``MOST`` times what it has;
the excess goes to the others by weight. Each source is taken whole as often as its target
allows; what remains is a budget smaller than the source, fitted over its documents:

1. Documents are counted by source and exact length (a table of lengths, not of documents).
2. Of each length the budget's share of its documents is taken, rounded down; the longest
   lengths then fill up until at most ``DP_WORDS`` words remain.
3. A bounded knapsack over the remaining counts of the lengths, a reachable-sum bit set with
   powers of two of each length's copies, takes the sum nearest to what remains.
4. Within a length, that many documents are chosen by a seeded hash.

Step 4 needs no sort of a whole length: its documents are dealt into cells of about
``CELL`` by their hash, cells are counted, the counts are summed up in ranges, and only the
cell at the border is ordered. Rows that share id, source and size share a hash; a cell that
they overfill is dealt again by the row number.

Sources are ranked and levelled as a table too; the driver gets the level alone. The table of
lengths of one source is the unit of step 3 (at most as many rows as the longest text has
words).

Defined results: a null or empty text has size 0, and is taken zero times; a very long text is
a length like any other; null is the last source, apart from the empty string; null ids, ties
and repeated rows are documents like any other, equal ones are interchangeable; an empty table
gives an empty result; other columns, of any name, are ignored unless kept.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranges import running_total
from .common import discard, staged

WEIGHTS = (1, 2, 3)
MOST = 3
SEED = 77
CELL = 128
DP_WORDS = 1 << 16
WORD = r"[^\x20\x09-\x0D]+"


def levelled(lengths: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size, n); staged.

    Targets are the words times ``share`` by weight, none above ``most`` times its source; the
    excess is shared again by weight. So a source gets its weight times one common level, or
    its most if that is less, and the level rises until no more sources are at their most.
    """
    sums = staged(lengths.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.lit(1).alias("one")), "sums")
    ranked = running_total(sums, [F.col("source").isNull(), F.col("source")], "one", "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = staged(ranked.select("source", "source_size", (F.col("source_size") * most).alias("cap"), weight.alias("weight")), "sources")
    having = ranked.where("source_size > 0")
    words, free = having.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.sum("weight")).first()
    total, level, seen = words * share, 0.0, 0
    while free:
        level = total / free if not seen else (total - taken) / free
        full = F.col("weight") * level > F.col("cap")
        n, taken, free = having.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("cap"))), F.lit(0)), F.sum(F.when(~full, F.col("weight")))).first()
        if n == seen:
            break
        seen = n
    target = F.when(F.col("source_size") > 0, F.least(F.col("weight") * F.lit(level), F.col("cap").cast("double"))).otherwise(0.0)
    return ranked.select("source", "source_size", target.alias("target"))


def nearest_sum(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many of each length to take, at most ``counts``, for the sum nearest to ``budget``."""
    room = budget + int(lengths[counts > 0].max(initial=0)) + 1
    mask, reached = (1 << room) - 1, 1
    by, pieces = np.full(room, -1, np.int64), []
    for i in np.argsort(-lengths, kind="stable"):
        length, have, copies = int(lengths[i]), int(counts[i]), 1
        while have > 0 and length > 0:
            take = min(copies, have)
            if length * take >= room:
                break
            new = (reached << (length * take)) & mask & ~reached
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(room // 8 + 1, "little"), np.uint8), bitorder="little")[:room]
                by[np.flatnonzero(bits)] = len(pieces)
                reached |= new
            pieces.append((i, take))
            have, copies = have - take, copies * 2
        if reached >> budget & 1:
            break
    hit = np.flatnonzero((by >= 0) | (np.arange(room) == 0))
    at = int(hit[np.argmin(np.abs(hit - budget))])
    taken = np.zeros(len(lengths), np.int64)
    while at > 0:
        i, take = pieces[by[at]]
        taken[i] += take
        at -= int(lengths[i]) * take
    return taken


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """Documents of each length whose sizes sum to about ``budget``."""
    have = int((lengths * counts).sum())
    if budget <= 0 or not have:
        return np.zeros(len(lengths), np.int64)
    if budget >= have:
        return np.where(lengths > 0, counts, 0).astype(np.int64)
    if budget <= DP_WORDS:
        return nearest_sum(lengths, np.where(lengths > 0, counts, 0), budget)
    taken = np.array([int(c) * budget // have for c in counts], np.int64)
    taken[lengths <= 0] = 0
    rest = budget - int((lengths * taken).sum())
    for i in np.argsort(-lengths, kind="stable"):
        if rest <= DP_WORDS:
            break
        if lengths[i] > 0:
            more = min(int(counts[i] - taken[i]), (rest - DP_WORDS // 2) // int(lengths[i]))
            taken[i] += max(0, more)
            rest -= max(0, more) * int(lengths[i])
    return taken + nearest_sum(lengths, np.where(lengths > 0, counts - taken, 0), rest)


def fitted(lengths: pd.DataFrame) -> pd.DataFrame:
    lengths = lengths.sort_values("size", kind="stable")
    lengths["extra"] = fit(lengths["size"].to_numpy(), lengths["n"].to_numpy(), int(lengths["budget"].iloc[0]))
    return lengths[["source", "size", "n", "rounds", "source_size", "target", "extra"]]


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, most: int = MOST, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row for each row of ``docs``: id, size, source_size, target, taken, copies, source, and ``keep`` columns.

    ``taken`` counts the words the mix takes from the row, repeats included: size x copies.
    """
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    kept = [F.col(c).alias(f"keep{i}") for i, c in enumerate(keep)]
    sized = staged(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(source_col).alias("source"), size.alias("size"), *kept), "sized")
    counted = staged(sized.groupBy("source", "size").agg(F.count("*").alias("n")), "lengths")
    plan = levelled(counted, weights, share, most)
    words = F.least(F.round("target").cast("long"), F.col("source_size") * most)
    rounds = F.coalesce(F.try_divide(words, F.col("source_size")), F.lit(0.0)).cast("long")
    plan = plan.select("source", "source_size", "target", rounds.alias("rounds"), (words - rounds * F.col("source_size")).alias("budget"))

    same = lambda a, b, *cols: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols]
    joined = counted.alias("l").join(plan.alias("p"), same("l", "p", "source")).select("l.*", "p.source_size", "p.target", "p.rounds", "p.budget")
    lengths = staged(
        joined.groupBy("source").applyInPandas(fitted, "source string, size long, n long, rounds long, source_size long, target double, extra long"), "fitted"
    )
    # Deal the documents of each length into cells by hash, then take whole cells and part of one.
    cell = F.floor(F.shiftrightunsigned(F.col("h"), 11) / float(1 << 53) * F.ceil(F.col("n") / CELL))
    dealt = staged(
        sized.withColumn("h", F.xxhash64(F.lit(seed), "id", "source", "size")).alias("d")
        .join(lengths.alias("l"), same("d", "l", "source", "size"))
        .select("d.*", "l.source_size", "l.target", "l.rounds", "l.extra", cell.alias("cell"), F.lit(0).cast("long").alias("sub")),
        "dealt",
    )
    place = ["source", "size", "cell"]
    # Only repeated hashes fill a cell this far.
    hot = staged(dealt.where("extra > 0").groupBy(*place).agg(F.count("*").alias("n")).where(F.col("n") > 8 * CELL), "hot-cells")
    if not hot.isEmpty():
        sub = F.when(F.col("c.n").isNotNull(), F.pmod(F.xxhash64(F.lit(seed), "d.row"), F.ceil(F.col("c.n") / CELL))).otherwise(0).cast("long")
        old, dealt = dealt, staged(dealt.drop("sub").alias("d").join(hot.alias("c"), same("d", "c", *place), "left").select("d.*", sub.alias("sub")), "dealt")
        discard(spark, old)
    discard(spark, sized, hot, counted, lengths)
    cells = staged(dealt.where("extra > 0").groupBy(*place, "sub").agg(F.count("*").alias("n"), F.first("extra").alias("extra")), "cell-sizes")
    upto = running_total(cells, [F.col("source").isNull(), F.col("source"), F.col("size"), F.col("cell"), F.col("sub")], "n", "upto").withColumn("begin", F.col("upto") - F.col("n"))
    begins = upto.groupBy("source", "size").agg(F.min("begin").alias("first"))
    quota = F.greatest(F.lit(0), F.col("u.extra") - (F.col("u.begin") - F.col("b.first")))
    quotas = staged(upto.alias("u").join(begins.alias("b"), same("u", "b", "source", "size")).select("u.source", "u.size", "u.cell", "u.sub", quota.alias("quota")), "cells")
    placed = dealt.alias("d").join(quotas.alias("c"), same("d", "c", *place, "sub"), "left").select("d.*", F.coalesce("c.quota", F.lit(0)).alias("quota"))
    nth = F.row_number().over(Window.partitionBy(*place, "sub").orderBy("h", "id", "row"))
    copies = F.when(F.col("size") > 0, F.col("rounds") + F.when(nth <= F.col("quota"), 1).otherwise(0)).otherwise(0)
    return placed.select(
        F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.cast("int").alias("copies"), F.col("source").alias(source_col),
        *[F.col(f"keep{i}").alias(c) for i, c in enumerate(keep)],
    )
