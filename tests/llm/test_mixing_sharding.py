"""Mixing and sharding laws."""

import re
import zlib
from collections import defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import common, mixing, sharding


def targets(sizes, weights, total, most=3):
    """By bisection of the common level: each gets its weight times it, at most ``most`` times its size."""
    low, high = 0.0, float(most * max(sizes, default=0) + 1)
    at = lambda level: sum(min(w * level, most * s) for s, w in zip(sizes, weights, strict=True))
    for _ in range(200):
        low, high = ((low + high) / 2, high) if at((low + high) / 2) < total else (low, (low + high) / 2)
    return [min(w * high, most * s) for s, w in zip(sizes, weights, strict=True)]


def check_mix(rows, docs):
    words = [len(re.findall(rb"[^\x20\x09-\x0D]+", (r["text"] or "").encode())) for r in docs]
    sums = defaultdict(int)
    for r, n in zip(docs, words, strict=True):
        sums[r["source"]] += n
    order = sorted(sums, key=lambda s: (s is None, s or ""))
    want = dict(zip(order, targets([sums[s] for s in order], [(1, 2, 3)[i % 3] for i in range(len(order))], sum(words)), strict=True))
    assert sorted((repr(r["doc_id"]), r["size"], r["source_size"]) for r in rows) == sorted((repr(d["doc_id"]), n, sums[d["source"]]) for d, n in zip(docs, words, strict=True))
    assert all(abs(r["target"] - want[r["source"]]) < 1e-6 * max(1, want[r["source"]]) for r in rows)
    taken = defaultdict(int)
    for r in rows:
        taken[r["source"]] += r["taken"]
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
    return {s: abs(taken[s] - want[s]) for s in order}


def test_mix_meets_targets(documents):
    off = check_mix(mixing.mix(documents).collect(), documents.collect())
    assert max(off.values()) <= 60  # ten documents a source leave few sums


def test_mix_of_odd_rows(odd, nothing):
    rows = mixing.mix(odd).collect()
    check_mix(rows, odd.collect())
    assert len(rows) == odd.count() and mixing.mix(nothing).count() == 0


def test_mix_reruns_agree(documents):
    plain = lambda df: sorted(map(tuple, mixing.mix(df).collect()))
    assert plain(documents) == plain(documents.repartition(7))


def test_mix_takes_whole_cells_of_a_hot_length(spark):
    docs = spark.createDataFrame([(i, "a b c", "hot" if i < 4000 else "z") for i in range(5000)], "doc_id long, text string, source string")
    rows = mixing.mix(docs).collect()
    taken = sum(r["taken"] for r in rows if r["source"] == "hot")
    assert taken > 0 and max(check_mix(rows, docs.collect()).values()) <= 3


def levels(spark, sizes, weights=(1, 2, 3), share=1.0):
    lengths = spark.createDataFrame([(name, size, 1) for name, size in sizes], "source string, size long, n long")
    return {r["source"]: r["target"] for r in mixing.levelled(lengths, weights, share).collect()}


def test_targets(spark):
    assert levels(spark, [("a", 100), ("b", 100)], (1, 3)) == {"a": 50, "b": 150}
    assert levels(spark, [("a", 1000), ("b", 10)], (1, 3)) == {"a": 980, "b": 30}
    assert levels(spark, [("a", 0), ("b", 10)], (1, 2)) == {"a": 0, "b": 10}
    assert levels(spark, []) == {}
    rng = np.random.default_rng(7)
    sizes = [(f"s{i:04d}", int(n)) for i, n in enumerate(rng.pareto(0.6, 400) * 50)] + [(None, 40)]
    for share in (1.0, 2.5):
        want = targets([n for _, n in sizes], [(1, 2, 3)[i % 3] for i in range(len(sizes))], share * sum(n for _, n in sizes))
        got = levels(spark, sizes, share=share)
        assert all(abs(got[s] - t) < 1e-6 * max(1, t) for (s, _), t in zip(sizes, want, strict=True))


def test_repeated_rows_fill_no_cell(spark):
    docs = spark.range(6000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("hot").alias("source"))
    docs = docs.union(spark.range(2000).select("id", F.lit("a b c"), F.lit("z")))
    rows = mixing.mix(docs).collect()
    assert len(rows) == 8000 and max(check_mix(rows, docs.collect()).values()) <= 3


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 5), min_size=1, max_size=8), st.floats(0, 1))
def test_fit_is_nearest(counts, share):
    lengths, have = np.array(list(counts)), np.array(list(counts.values()))
    budget = int(share * (lengths * have).sum())
    sums = {0}
    for length, n in counts.items():
        sums = {s + length * j for s in sums for j in range(n + 1)}
    got = mixing.nearest_sum(lengths, have, budget)
    assert (got <= have).all() and abs(int((got * lengths).sum()) - budget) == min(abs(s - budget) for s in sums)
    whole = mixing.fit(lengths, have, budget)
    assert (whole <= have).all() and abs(int((whole * lengths).sum()) - budget) <= lengths.max()


def test_fit_of_large_budgets():
    rng = np.random.default_rng(1)
    lengths = np.unique(rng.integers(1, 20_000, 3000))
    have = rng.integers(1, 50, len(lengths))
    budget = int((lengths * have).sum() * 0.37)
    got = mixing.fit(lengths, have, budget)
    assert (got <= have).all() and (got * lengths).sum() == budget


def check_shards(rows, docs, shards):
    raw = [(d["text"] or "").encode() for d in docs]
    want = sorted((repr(d["doc_id"]), len(t) + 16, zlib.crc32(t)) for d, t in zip(docs, raw, strict=True))
    assert sorted((repr(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == want
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    counts = [len(slots.get(i, [])) for i in range(shards)]
    assert max(counts) - min(counts) <= 1 and set(slots) <= set(range(shards))


def dealt(docs, **how):
    return sharding.sharded(docs, **how).select("doc.doc_id", "size", "text_crc32", "shard", "slot")


def test_shards(odd, documents, nothing):
    for docs, size in ((odd, 4096), (documents, 20_000), (documents, 1 << 30)):
        check_shards(dealt(docs, bucket_bytes=size).collect(), docs.collect(), 40)
    assert dealt(nothing).count() == 0


def test_shards_rerun_agrees_and_seeds_differ(spark, data):
    documents = spark.read.parquet(f"{data}/documents.parquet")
    plain = lambda df, **k: sorted(map(tuple, dealt(df, bucket_bytes=30_000, **k).select("doc_id", "shard", "slot").collect()))
    assert plain(documents) == plain(documents) != plain(documents, seed=1)


def test_order_is_mixed(documents):
    rows = dealt(documents, shards=1).orderBy("slot").collect()
    ids = np.array([r["doc_id"] for r in rows])
    assert abs(np.corrcoef(ids, np.arange(len(ids)))[0, 1]) < 0.3


def test_repeated_rows_are_spread_over_buckets(spark):
    docs = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    check_shards(dealt(docs, bucket_bytes=4000).collect(), docs.collect(), 40)
    key = F.pmod(F.xxhash64(F.lit(1), *common.ROW_KEY), F.lit(16))
    counts = [r["count"] for r in common.keyed(docs).groupBy(key).count().collect()]
    assert len(counts) == 16 and max(counts) < 400


def test_written_shards_hold_whole_records_of_any_names(spark, odd, tmp_path):
    docs = odd.withColumns({c: odd["row"] for c in ("shard", "slot", "doc", "p", "text_crc32", "_bucket", "_file")})
    sharding.write_shards(docs, str(tmp_path / "out"), shards=3, bucket_bytes=2000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(repr, back.select("doc.*").collect())) == sorted(map(repr, docs.collect()))
    check_shards(back.select("doc.doc_id", "doc.text", "shard", "slot", F.expr("octet_length(coalesce(doc.text, '')) + 16 AS size"), F.expr("crc32(coalesce(doc.text, '')) AS text_crc32")).collect(), docs.collect(), 3)


def test_files_are_in_slot_order(spark, documents, tmp_path):
    sharding.write_shards(documents, str(tmp_path / "out"), shards=3, bucket_bytes=20_000)
    for file in (tmp_path / "out").glob("shard=*/*.parquet"):
        slots = [r["slot"] for r in spark.read.parquet(str(file)).collect()]
        assert slots == sorted(slots)
