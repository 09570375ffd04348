"""Benchmark decontamination by training suffix arrays.

Each shard of training text (a run of whole documents of about two megabytes) gets an array
of its word suffixes, sorted by prefix doubling as deep as the longest test item. Every
suffix of every test item is looked up by binary search, one word deeper at a time, which
leaves the range of training suffixes that start with the same words. A range at full depth
gives the locations; each is widened to its longest verbatim match. A match is reported
once, from its first word, with item, place in item, place in document and length.

Documents are never shuffled. Test items go to the executors with the task, in blocks of at
most ``BLOCK_BYTES`` of text, one pass over the documents for each block.

Defined results: null and empty texts have no words and no matches; a very long text is a shard
of its own; items without words match nothing; an item shorter than the window matches as a
whole; an item with a null id hits words and counts as one item, but has no id to list; of
items with equal texts each is matched; repeated rows are each searched; a null id is kept; an
empty table of either kind gives no matches; other columns, also of clashing names, are
ignored, and a kept column that is named like a result gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words

WINDOW = 10
BLOCK_BYTES = 16 << 20
MATCH = "array<struct<item: string, item_pos: int, doc_pos: int, length: int>>"


def hashed_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with a zero after each text, and where each text begins (one more than texts)."""
    data = words.LOWER[data]
    starts, ends, before = words.spans(data, offsets, words.ALNUM)
    texts = len(before) - 1
    out = np.zeros(len(starts) + texts, np.uint64)
    out[np.arange(len(starts)) + words.rows_of(before)] = np.maximum(words.hashes(data, starts, ends), 1)
    return out, before + np.arange(texts + 1)


def suffix_array(w: np.ndarray, depth: int) -> np.ndarray:
    """Places in ``w`` in the order of the words that follow, ``depth`` words deep at least."""
    order = np.argsort(w, kind="stable")
    rank = np.empty(len(w), np.int64)
    key, at, k = w[order], np.arange(len(w)), 1
    while True:
        # Places ``at`` of the order were sorted anew by ``key``; equal keys share the first one's place.
        first = np.ones(len(at), bool)
        first[1:] = key[1:] != key[:-1]
        group = at[np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))]
        rank[order[at]] = group
        tied = np.ones(len(at) + 1, bool)
        tied[:-1] = first
        again = ~(tied[:-1] & tied[1:])
        at = at[again]
        if k >= depth or not len(at):
            return order
        suffix = order[at]
        after = suffix + k
        second = np.where(after < len(w), rank[np.minimum(after, len(w) - 1)] + 1, 0)
        key = rank[suffix] << 32 | second
        turn = np.argsort(key, kind="stable")
        order[at], key = suffix[turn], key[turn]
        k *= 2


def narrowed(w: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The part of each range [lo, hi) whose suffixes have ``word`` at ``depth``."""

    def bound(strict: bool) -> np.ndarray:
        a, b = lo.copy(), hi.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            got = w[np.minimum(order[np.minimum(mid, len(w) - 1)] + depth, len(w) - 1)]
            right = open_ & ((got <= word) if strict else (got < word))
            a = np.where(right, mid + 1, a)
            b = np.where(open_ & ~right, mid, b)
        return a

    return bound(False), bound(True)


def search(w: np.ndarray, begins: np.ndarray, test: np.ndarray, test_begins: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Longest matches as (place in test, place in w, length), each from its first word."""
    lengths = np.diff(test_begins) - 1
    item = np.repeat(np.arange(len(lengths)), lengths + 1)
    inside = np.arange(len(test)) - test_begins[item]
    need = np.minimum(lengths[item], window)
    at = np.flatnonzero((inside + need <= lengths[item]) & (need > 0))
    none = (np.zeros(0, np.int64),) * 3
    if not len(at) or not len(w):
        return none
    order = suffix_array(w, int(lengths.max()))
    first = w[order]
    lo, hi, depth, done = np.searchsorted(first, test[at], "left"), np.searchsorted(first, test[at], "right"), 1, []
    while len(at):
        live = lo < hi
        full = live & (need[at] == depth)
        done.append((at[full], lo[full], hi[full]))
        live &= ~full
        at, lo, hi = at[live], lo[live], hi[live]
        if len(at):
            lo, hi = narrowed(w, order, lo, hi, depth, test[at + depth])
        depth += 1
    at, lo, hi = (np.concatenate(x) for x in zip(*done, strict=True))
    many = hi - lo
    p = np.repeat(at, many)
    loc = order[np.arange(many.sum()) + np.repeat(lo - (np.cumsum(many) - many), many)]
    # A match that could start a word earlier was found there.
    earlier = (p > test_begins[item[p]]) & (loc > 0)
    earlier &= (test[p - 1] == w[loc - 1]) & (test[p - 1] > 0)
    p, loc = p[~earlier], loc[~earlier]
    length = need[p]
    live = np.arange(len(p))
    while len(live):
        a, b = test[p[live] + length[live]], w[np.minimum(loc[live] + length[live], len(w) - 1)]
        live = live[(a == b) & (a > 0)]
        length[live] += 1
    return p, loc, length


def matches_in(batches: Iterator[pa.RecordBatch], ids: list[str], test: np.ndarray, test_begins: np.ndarray, window: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    names, kind = pa.array(ids, pa.string()), schema.field("matches").type
    for rows, data, offsets in words.chunks(batches, "text"):
        w, begins = hashed_words(data, offsets)
        p, loc, length = search(w, begins, test, test_begins, window)
        row = np.searchsorted(begins, loc, "right") - 1
        turn = np.lexsort((p, loc, row))
        p, loc, length, row = p[turn], loc[turn], length[turn], row[turn]
        item = np.searchsorted(test_begins, p, "right") - 1
        found = pa.StructArray.from_arrays(
            [names.take(pa.array(item)), *(pa.array(x, pa.int32()) for x in (p - test_begins[item], loc - begins[row], length))], fields=list(kind.value_type)
        )
        cuts = pa.array(np.searchsorted(row, np.arange(len(rows) + 1)), pa.int32())
        here = pa.ListArray.from_arrays(cuts, found, type=kind)
        out = {"n_words": pa.array(np.diff(begins) - 1, pa.int64()), "matches": here, "text": rows.column("text")}
        if "matches" in rows.schema.names:
            old = rows.column("matches")
            out["matches"] = pa.array([a + b for a, b in zip(old.to_pylist(), here.to_pylist(), strict=True)], kind)
        yield pa.RecordBatch.from_arrays([out[f.name] if f.name in out else rows.column(f.name) for f in schema], schema=schema)


def with_matches(docs: DataFrame, tests: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns of ``docs`` with n_words and all longest matches with test items."""
    tests = tests.select(F.col(item_col).cast("string").alias("item"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))
    total = tests.agg(F.sum(F.octet_length("text") + F.octet_length(F.coalesce("item", F.lit(""))))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_BYTES))
    # Names of kept columns never meet the ones used here.
    kept = {c: f"_keep{i}" for i, c in enumerate(keep)}
    out = docs.select(*[F.col(c).alias(n) for c, n in kept.items() if c != text_col], F.col(text_col).alias("text"))
    for b in range(blocks):
        part = tests.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()
        data, offsets = words.buffer_of(pa.array([r["text"] for r in part], pa.string()))
        test, begins = hashed_words(data, offsets)
        last = b == blocks - 1
        fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema if f.name not in ("text", "matches", "n_words")]
        ddl = ", ".join([*fields, "n_words long", f"matches {MATCH}", *(["text string"] if not last or text_col in keep else [])])
        out = searched(out, [r["item"] for r in part], test, begins, window, ddl)
    names = [F.col("text" if c == text_col else n).alias(c) for c, n in kept.items() if c not in ("n_words", "matches")]
    return out.select(*names, "n_words", "matches")


def searched(docs: DataFrame, ids: list[str], test: np.ndarray, begins: np.ndarray, window: int, ddl: str) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(ddl))

    def run(batches):
        return matches_in(batches, ids, test, begins, window, schema)

    return docs.mapInArrow(run, ddl)


def contamination(found: DataFrame) -> DataFrame:
    """n_hit (words inside a match), n_items, items_sha256 and contaminated, from ``matches``."""
    step = lambda acc, m: F.struct(
        (acc["hit"] + F.greatest(F.lit(0), m["doc_pos"] + m["length"] - F.greatest(m["doc_pos"], acc["to"]))).alias("hit"),
        F.greatest(acc["to"], m["doc_pos"] + m["length"]).alias("to"),
    )
    by_place = F.array_sort("matches", lambda a, b: a["doc_pos"] - b["doc_pos"])
    hit = F.aggregate(by_place, F.struct(F.lit(0).alias("hit"), F.lit(0).alias("to")), step)["hit"]
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item"])))
    return found.withColumns(
        {
            "n_hit": hit.cast("long"),
            "n_items": F.size(items).cast("long"),
            "items_sha256": F.sha2(F.concat_ws(",", items), 256),
            "contaminated": F.size("matches") > 0,
        }
    )
