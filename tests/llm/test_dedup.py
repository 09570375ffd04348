"""Exact and near dedup against plain Python."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import near_dedup, words
from lodestone.llm.exact_dedup import exact_groups


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def check_exact(docs, got):
    groups = defaultdict(list)
    for r in docs:
        groups[lowered(r["text"])].append(r["doc_id"])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_exact_groups(odd, documents, nothing):
    for docs, block in ((odd, 2048), (odd, 7), (documents, 100)):
        out = exact_groups(docs, block=block).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()
        check_exact(docs.collect(), out)
    assert exact_groups(nothing).count() == 0


def test_texts_that_differ_in_one_place_only(spark):
    base = "ab" * 3000
    texts = [base, base[:5999] + "x", base[:2500] + "y" + base[2501:], base, base + "a", base[:4096]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_exact(docs.collect(), exact_groups(docs, block=512).select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20), st.integers(0, 10))
def test_banded_alignment(a, b, most):
    got = near_dedup.banded_distance(np.array(a, np.uint64), np.array(b, np.uint64), most)
    assert got == min(distance(a, b), most + 1)


def tokens(texts):
    data, offsets = words.buffer_of(pa.array(texts, pa.string()))
    h, before = near_dedup.token_hashes(data, offsets)
    return [h[before[i] : before[i + 1]] for i in range(len(texts))]


def brute_classes(rows):
    seq = tokens([r["text"] for r in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if near_dedup.similar(seq[i], seq[j]):
                parent[find(i)] = find(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows):
        classes[find(i)].append(r["doc_id"])
    return sorted((i, min((x for x in ids if x is not None), default=None), len(ids)) for ids in classes.values() for i in ids if i is not None)


def near(docs):
    return near_dedup.near_classes(docs).select("doc_id", "class_id", "class_size", "kept").collect()


def test_near_classes_equal_brute_force(odd, documents, nothing):
    for docs in (odd, documents):
        got = near(docs)
        assert sorted((r[0], r[1], r[2]) for r in got if r[0] is not None) == brute_classes(docs.collect())
        assert sum(r["kept"] for r in got) == len({r["class_id"] for r in got if r["class_id"] is not None}) + len([r for r in got if r["class_id"] is None and r["kept"]])
    assert near(nothing) == []


def test_order_counts(spark):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    texts = [base, base[150:] + base[:150], [*base[:100], "new", *base[101:]]]
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    assert {r["doc_id"]: r["class_id"] for r in near(docs)} == {0: 0, 1: 1, 2: 0}


def test_texts_that_share_a_passage_stay_apart_and_near_copies_inside_are_found(spark):
    rng = random.Random(3)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(60)
    texts = [fresh(20) + passage + fresh(20) for _ in range(150)]
    for i in range(0, 150, 10):
        copy = list(texts[i])
        copy[5] = "changed"
        texts.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    want = {i: i for i in range(150)} | {150 + i: i * 10 for i in range(15)}
    assert {r["doc_id"]: r["class_id"] for r in near(docs)} == want
    assert sum(r["kept"] for r in near(docs)) == 150


def two_tuples(texts, bands=near_dedup.BANDS):
    return near_dedup.sketch(*near_dedup.runs(*near_dedup.token_hashes(*words.buffer_of(pa.array(texts, pa.string())))), bands=bands)[:, :, 0]


def test_scattered_edits_inside_a_large_group_are_found(spark):
    rng = random.Random(5)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    passage = fresh(70)
    texts = [fresh(15) + passage + fresh(15) for _ in range(300)]
    for i in range(150, 190):
        copy = list(texts[i])
        for at in rng.sample(range(100), rng.randrange(5, 14)):
            copy[at] = fresh(1)[0]
        texts.append(copy)
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    class_of = {r["doc_id"]: r["class_id"] for r in near(docs)}
    keys = two_tuples([" ".join(t) for t in texts])
    pairs = [(150 + i, 300 + i) for i in range(40)]
    sharing = [(a, b) for a, b in pairs if (keys[a] == keys[b]).any()]
    assert len(sharing) > 30 and all(class_of[a] == class_of[b] for a, b in sharing)
    assert len(set(class_of.values())) == 300 + 40 - len([1 for a, b in pairs if class_of[a] == class_of[b]])


def test_prefixes_keep_all_similar_pairs():
    rng = np.random.default_rng(4)
    often, hub = rng.integers(2, 50, 1 << near_dedup.RARITY_BITS), rng.integers(0, 40, 60).astype(np.uint64)
    for _ in range(500):
        a = rng.integers(0, 60, rng.integers(1, 60)).astype(np.uint64)
        b = a[rng.random(len(a)) > 0.08]
        b = np.insert(b, rng.integers(0, len(b) + 1, len(a) // 12), 77).astype(np.uint64)
        if near_dedup.similar(a, b):
            assert np.isin(near_dedup.prefix(a, hub, often)[0], near_dedup.prefix(b, hub, often)[0]).any()


def test_words_of_one_text_alone_pair_nothing():
    rng = np.random.default_rng(5)
    size = 1 << near_dedup.RARITY_BITS
    a = rng.integers(0, 2**63, 100).astype(np.uint64)
    b = a.copy()
    b[::9] = rng.integers(0, 2**63, len(b[::9])).astype(np.uint64)
    often = np.bincount((np.concatenate([a, b]) & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint16)
    (x, at), (y, _) = (near_dedup.prefix(t, np.zeros(0, np.uint64), often) for t in (a, b))
    assert near_dedup.similar(a, b) and np.isin(x, y).any() and len(x) < 21 and at.max() <= 20


def test_a_text_near_the_hub_still_meets_those_that_are_not(spark):
    rng = random.Random(6)
    fresh = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(60):
        hub = fresh(100)
        x = fresh(19) + hub[19:]
        texts += [hub, x, [*x[:19], *fresh(5), *x[24:]]]
    texts = [" ".join(t) for t in texts]
    keys = two_tuples(texts, bands=1)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    class_of = {r["doc_id"]: r["class_id"] for r in near_dedup.near_classes(docs, bands=1).collect()}
    sharing = [i for i in range(0, 180, 3) if (keys[i] == keys[i + 1]).all() and (keys[i] == keys[i + 2]).all()]
    assert len(sharing) > 10 and all(class_of[j] == i for i in sharing for j in (i, i + 1, i + 2))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "u long, v long")
    got = {r["v"]: r["root"] for r in near_dedup.components(links).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100}


def test_pairs_of_a_hot_group_grow_with_its_texts(spark, monkeypatch):
    seen, verified = [], near_dedup.verified

    def counted(pairs, *rest):
        seen[-1] += pairs.count()
        return verified(pairs, *rest)

    monkeypatch.setattr(near_dedup, "verified", counted)
    rng = random.Random(8)
    fresh = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    passage = fresh(300)
    texts = [" ".join(fresh(45) + passage + fresh(45)) for _ in range(600)]
    for n in (300, 600):
        seen.append(0)
        docs = spark.createDataFrame(list(enumerate(texts[:n])), "doc_id long, text string")
        assert sum(r["kept"] for r in near(docs)) == n
    assert seen[1] <= 2.2 * seen[0]
