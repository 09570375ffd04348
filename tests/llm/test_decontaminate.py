"""Suffix-array decontamination against a plain search."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import decontaminate as de
from lodestone.llm import words

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(docs, tests, window=10):
    items = [(str(t["item_id"]), WORD.findall((t["text"] or "").encode().lower())) for t in tests]
    out = []
    for d in docs:
        w = WORD.findall((d["text"] or "").encode().lower())
        hit, found = set(), set()
        for name, item in items:
            n = min(len(item), window)
            windows = {tuple(item[i : i + n]) for i in range(len(item) - n + 1)} if n else set()
            for i in range(len(w) - n + 1):
                if n and tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found.add(name)
        out.append((d["doc_id"], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def table(found):
    return sorted(map(tuple, de.contamination(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()), key=repr)


def test_windows_and_short_items(spark, odd, nothing):
    tests = spark.createDataFrame(
        [(1, "same text here"), (2, "word5 word6 word7 word8 word9 word10 word11 word12 word13 word14 word15"), (3, ""), (4, None), (5, "12345 67890"), (6, "not there at all")],
        "item_id long, text string",
    )
    assert table(de.with_matches(odd, tests)) == plain(odd.collect(), tests.collect())
    assert table(de.with_matches(nothing, tests)) == []
    assert all(not r[-1] for r in table(de.with_matches(odd, tests.limit(0))))


def test_documents(spark, data, documents):
    tests = spark.read.parquet(f"{data}/benchmark.parquet")
    got = table(de.with_matches(documents, tests))
    assert got == plain(documents.collect(), tests.collect()) and any(r[-1] for r in got)


def test_blocks_of_items_give_the_same(spark, data, documents, monkeypatch):
    tests = spark.read.parquet(f"{data}/benchmark.parquet")
    one = table(de.with_matches(documents, tests))
    monkeypatch.setattr(de, "BLOCK_BYTES", 4000)
    assert table(de.with_matches(documents, tests)) == one


def test_longest_matches_and_places(spark):
    item = " ".join(f"t{i}" for i in range(15))
    docs = spark.createDataFrame([(1, f"a b {item} c"), (2, " ".join(item.split()[2:14])), (3, " ".join(item.split()[:9]))], "doc_id long, text string")
    found = de.with_matches(docs, spark.createDataFrame([("x", item)], "item_id string, text string"))
    got = {r["doc_id"]: [tuple(m) for m in r["matches"]] for r in found.collect()}
    assert got == {1: [("x", 0, 2, 15)], 2: [("x", 2, 0, 12)], 3: []}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=40), st.integers(1, 40))
def test_suffix_array(w, depth):
    w = np.array(w, np.uint64)
    order = de.suffix_array(w, depth)
    assert sorted(order.tolist()) == list(range(len(w)))
    cut = [tuple(w[i : i + depth].tolist()) for i in order]
    assert cut == sorted(cut)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=14), min_size=1, max_size=4), st.lists(st.lists(st.sampled_from("ab"), max_size=9), min_size=1, max_size=3))
def test_search_equals_scan(docs, tests):
    arrays = [de.hashed_words(*words.buffer_of(pa.array([" ".join(x) for x in y]))) for y in (docs, tests)]
    (w, begins), (t, t_begins) = arrays
    got = set(zip(*(x.tolist() for x in de.search(w, begins, t, t_begins, 3)), strict=True))
    want = set()
    for i, item in enumerate(tests):
        need = min(3, len(item))
        for p in range(len(item) - need + 1 if need else 0):
            for j, doc in enumerate(docs):
                for q in range(len(doc)):
                    n = 0
                    while p + n < len(item) and q + n < len(doc) and item[p + n] == doc[q + n]:
                        n += 1
                    if n >= need and not (p and q and item[p - 1] == doc[q - 1]):
                        want.add((int(t_begins[i]) + p, int(begins[j]) + q, n))
    assert got == want


def test_random_shards_agree(spark, monkeypatch):
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(rng.choice("abc") for _ in range(60))) for i in range(40)], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(rng.choice("abc") for _ in range(14))) for i in range(30)], "item_id long, text string")
    assert table(de.with_matches(docs, tests, window=6)) == plain(docs.collect(), tests.collect(), 6)


def test_items_without_an_id_hit_words(spark):
    passage = " ".join(f"w{i}" for i in range(12))
    docs = spark.createDataFrame([(1, f"a {passage} b"), (2, "nothing here")], "doc_id long, text string")
    tests = spark.createDataFrame([(None, passage), (4, passage + " w99")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in de.contamination(de.with_matches(docs, tests)).collect()}
    assert (rows[1]["n_hit"], rows[1]["n_items"], rows[1]["contaminated"]) == (12, 2, True) and not rows[2]["contaminated"]
    assert rows[1]["items_sha256"] == hashlib.sha256(b"4").hexdigest()
    alone = de.contamination(de.with_matches(docs, tests.where("item_id is null"))).where("doc_id = 1").first()
    assert (alone["n_hit"], alone["n_items"], alone["items_sha256"]) == (12, 1, hashlib.sha256(b"").hexdigest())
