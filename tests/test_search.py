"""Hand-computed goldens and properties of sparse and dense search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import params_control, strategy
from lodestone.functions.vectors import densify, dot, half_precision, sparse_dot
from lodestone.operators import dense, evaluate, hnsw, ivf, profile, sparse, topk
from lodestone.plans import search
from lodestone.sources import vectors
from lodestone.sources.staging import new_folder, staged


@pytest.fixture(scope="module")
def micro(spark):
    corpus = vectors.csr_to_triples(spark, [0, 2, 3, 5, 5, 7], [0, 2, 1, 0, 2, 2, 4], [1, 2, 3, 1, 2, 1, 0.5], vectors.Shape(5, 5)).withColumnRenamed("row_id", "doc_id")
    queries = vectors.csr_to_triples(spark, [0, 2, 3, 5], [0, 2, 3, 1, 7], [2, 1, 1, 1, 9], vectors.Shape(3, 5)).withColumnRenamed("row_id", "query_id")
    ids = lambda n, name: spark.range(n).withColumnRenamed("id", name)
    return corpus.persist(), vectors.known_terms(queries, 5).persist(), ids(5, "doc_id"), ids(3, "query_id")


def listed(results):
    out = {}
    for r in results.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["doc_id"], r["score"]))
    return out


def brute_of(inputs, k):
    corpus, queries, doc_ids, query_ids = inputs
    return sparse.brute_topk(staged(sparse.scores(corpus, queries), "touched"), doc_ids, query_ids, k)


def test_inverted_ties_go_to_the_smaller_id(micro):
    assert listed(sparse.inverted_topk(micro[0], micro[1], 3)) == {0: [(0, 4), (2, 4), (4, 1)], 2: [(1, 3)]}
    assert listed(sparse.inverted_topk(micro[0], micro[1], 1))[0] == [(0, 4)]


def test_brute_fills_with_zero_scores(micro):
    found = listed(brute_of(micro, 3))
    assert found == {0: [(0, 4), (2, 4), (4, 1)], 1: [(0, 0), (1, 0), (2, 0)], 2: [(1, 3), (0, 0), (2, 0)]}


def test_brute_puts_negative_scores_last(spark):
    corpus = spark.createDataFrame([(0, 0, -1.0), (1, 0, 2.0)], "doc_id long, term int, weight double")
    query = spark.createDataFrame([(9, 0, 1.0)], "query_id long, term int, weight double")
    found = listed(brute_of((corpus, query, spark.range(3).toDF("doc_id"), spark.createDataFrame([(9,)], "query_id long")), 3))
    assert found[9] == [(1, 2.0), (2, 0.0), (0, -1.0)]


def test_padding_and_one_based_ids(micro):
    rows = {r["query_id"]: (r["knns"], r["dists"]) for r in topk.padded(sparse.inverted_topk(micro[0], micro[1], 3), micro[3], 3).collect()}
    assert rows == {0: ([1, 3, 5], [4, 4, 1]), 1: ([0, 0, 0], [0, 0, 0]), 2: ([2, 0, 0], [3, 0, 0])}


def test_shuffle_join_equals_broadcast(micro):
    plain = lambda n: sorted(map(tuple, sparse.scores(micro[0], micro[1], n).collect()))
    assert plain(0) == plain(10**6)


def test_statistics(micro):
    per = sparse.search_stats_per_query(sparse.scores(micro[0], micro[1]), micro[3])
    assert sorted(map(tuple, per.collect())) == [(0, 5, 3), (1, 0, 0), (2, 1, 1)]
    s = sparse.search_stats(per, 5).first()
    assert (s["total_postings"], s["avg_postings"], s["total_touched"], s["max_touched"], round(s["touched_percent"], 2)) == (6, 2, 4, 3, 26.67)


def test_recall(spark, micro):
    inverted, brute = sparse.inverted_topk(micro[0], micro[1], 3), brute_of(micro, 3)
    assert evaluate.recall_at_k(inverted, brute, 3, micro[3]).first()[0] == pytest.approx(4 / 9)
    wide = topk.padded(inverted, micro[3], 3)
    assert evaluate.wide_recall(wide, topk.padded(brute, micro[3], 3), 3).first()[0] == pytest.approx(4 / 9)
    with pytest.raises(ValueError):
        evaluate.wide_recall(wide, wide, 4)
    with pytest.raises(ValueError):
        evaluate.wide_recall(wide, wide.limit(1), 3)
    twice = spark.createDataFrame([(0, [1, 1, 3])], "query_id long, knns array<long>")
    truth = spark.createDataFrame([(0, [1, 3, 5])], "query_id long, knns array<long>")
    assert evaluate.wide_recall(twice, truth, 3).first()[0] == pytest.approx(2 / 3)


def test_term_frequencies_and_offsets(spark, micro):
    terms = spark.range(5).select(F.col("id").cast("int").alias("term"))
    assert sorted(map(tuple, profile.term_offsets(sparse.term_df(micro[0]), terms).collect())) == [(0, 2), (1, 3), (2, 6), (3, 6), (4, 7)]


def test_offsets_do_not_depend_on_reused_exchanges(spark):
    words = spark.range(5000).select(F.concat(F.lit("w"), F.sha2(F.col("id").cast("string"), 256)).alias("term"), (F.col("id") % 7).alias("df"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        got = {r["term"]: r["offset_end"] for r in profile.term_offsets(words, words.select("term"), range_rows=400).collect()}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
    total = 0
    for r in sorted(words.collect(), key=lambda r: r["term"]):
        total += r["df"]
        assert got[r["term"]] == total


def test_terms_outside_the_corpus_are_errors(spark):
    bad = spark.createDataFrame([(0, 5, 1.0)], "row_id long, term int, weight double")
    with pytest.raises(Exception, match="term outside"):
        vectors.validate_terms(bad, 5).collect()
    with pytest.raises(ValueError):
        vectors.csr_to_triples(spark, [0, 1], [0], [1.0], vectors.Shape(5, 5))
    with pytest.raises(ValueError):
        vectors.same_width(vectors.Shape(1, 2), vectors.Shape(1, 3))


def test_repeated_terms_are_summed(spark):
    rows = spark.createDataFrame([(0, [0, 0, 2], [0.5, 0.5, 2.0])], "row_id long, indices array<int>, data array<double>")
    assert sorted(map(tuple, vectors.csr_table_to_triples(rows).collect())) == [(0, 0, 1.0), (0, 2, 2.0)]


@pytest.fixture(scope="module")
def dense_set(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 16))
    v = (centres[np.arange(600) % 12] + rng.normal(size=(600, 16)) * 0.4).astype(np.float32)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v[i].tolist()) for i in range(600)], "id long, embedding array<float>").persist()
    return v.astype(np.float64), df, df.where("id % 20 = 0")


def test_exact_dense_search(dense_set):
    v, df, queries = dense_set
    found = listed(dense.exact_topk(df, queries, 10))
    for rows in (7, 100, 1000):
        assert listed(dense.exact_topk(df, queries, 10, query_bytes=0, block_rows=rows)) == found
    for q, rows in found.items():
        s = v @ v[q]
        assert [d for d, _ in rows] == np.lexsort((np.arange(600), -s))[:10].tolist()


def test_equal_vectors_tie_by_id_whatever_the_blocks(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(5, 33)).astype(np.float32)
    df = spark.createDataFrame([(i, v[i % 5].tolist()) for i in range(400)], "id long, embedding array<float>").persist()
    queries = df.where("id < 5")
    found = listed(dense.exact_topk(df, queries, 12))
    assert all([d for d, _ in rows[:12]] == sorted(d for d, _ in rows) and len({s for _, s in rows}) == 1 for rows in found.values())
    for rows in (3, 50, 1000):
        assert listed(dense.exact_topk(df, queries, 12, query_bytes=0, block_rows=rows)) == found
    others = listed(dense.exact_topk(df, df, 3, exclude_self=True, query_bytes=0, block_rows=64))
    assert len(others) == 400 and all(q not in [d for d, _ in rows] for q, rows in others.items())


def test_vectors_of_other_lengths_are_errors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0]), (2, [1.0, 2.0, 3.0])], "id long, embedding array<float>").coalesce(1)
    with pytest.raises(Exception, match="differ in length"):
        dense.exact_topk(df, df.where("id = 0"), 2).collect()


def test_the_index_scores_as_the_corpus_does(spark, micro):
    path = new_folder(spark, "test-index")
    sparse.write_index(micro[0], 5, path)
    index = spark.read.parquet(path)
    want = sorted(map(tuple, sparse.scores(micro[0], micro[1]).collect()))
    for size in (0, 10**6):
        got = sparse.index_scores(index, micro[1], size).select("query_id", "doc_id", "score", "postings")
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, sparse.index_scores(index, micro[1].limit(0)).collect())) == []


def test_compressed_rows_round_trip_and_checks(spark, micro):
    path = new_folder(spark, "test-csr")
    vectors.write_csr(micro[0], vectors.Shape(5, 5), path, "doc_id")
    assert sorted(map(tuple, vectors.read_csr(spark, path).collect())) == sorted((r["doc_id"], r["term"], r["weight"]) for r in micro[0].collect())
    assert vectors.read_shape(spark, path) == (5, 5)
    indptr = spark.read.parquet(f"{path}/indptr").collect()
    for broken in (indptr[1:], [(r["i"], 0) for r in indptr], [(r["i"], r["value"] + 1) for r in indptr]):
        spark.createDataFrame(broken, "i long, value long").write.mode("overwrite").parquet(f"{path}/indptr")
        with pytest.raises(ValueError):
            vectors.read_csr(spark, path)


def test_all_knn_with_and_without_self(dense_set):
    _, df, _ = dense_set
    own = listed(dense.all_knn(df, 5))
    assert all(len(r) == 6 and r[0][0] == q for q, r in own.items()) and len(own) == 600
    others = listed(dense.all_knn_exclude_self(df, 5))
    assert all([d for d, _ in others[q]] == [d for d, _ in own[q][1:]] for q in own)


def test_ivf_reaches_recall_and_equals_exact_with_all_lists(dense_set):
    _, df, queries = dense_set
    exact, ids = dense.exact_topk(df, queries, 10), queries.select(F.col("id").alias("query_id"))
    index = ivf.build(df, nlist=12)
    recall = lambda r: evaluate.recall_at_k(r, exact, 10, ids).first()[0]
    assert recall(ivf.search(index, queries, 10, 4)) >= 0.9
    full = ivf.search(ivf.build(df, nlist=12, half=False), queries, 10, 12)
    assert {q: [d for d, _ in r] for q, r in listed(full).items()} == {q: [d for d, _ in r] for q, r in listed(exact).items()}


def test_hnsw_reaches_recall(dense_set):
    _, df, queries = dense_set
    exact, ids = dense.exact_topk(df, queries, 10), queries.select(F.col("id").alias("query_id"))
    for shards in (600, 250):
        index = hnsw.build(df, degree=24, beam=100, shard_rows=shards)
        assert max(r["n"] for r in index.collect()) <= shards
        found = listed(hnsw.search(index, queries, 10, 100))
        assert listed(hnsw.search(index, queries, 10, 100, query_bytes=0)) == found
        assert evaluate.recall_at_k(hnsw.search(index, queries, 10, 100), exact, 10, ids).first()[0] >= 0.9


def test_hnsw_over_sparse_rows(spark):
    rng = np.random.default_rng(4)
    rows = [(d, f"t{t}", float(rng.integers(1, 4))) for d in range(300) for t in set(rng.integers(0, 60, 12)) | {60 + d % 10}]
    corpus = spark.createDataFrame(rows, "doc_id long, term string, weight double").persist()
    queries = corpus.where("doc_id % 25 = 0").select(F.col("doc_id").alias("query_id"), "term", "weight")
    exact, ids = sparse.inverted_topk(corpus, queries, 5), queries.select("query_id").distinct()
    found = hnsw.search_sparse(hnsw.build_sparse(corpus, degree=12, beam=60, shard_rows=150), queries, 5)
    assert evaluate.recall_at_k(found, exact, 5, ids).first()[0] >= 0.9
    want = {(q, d): s for q, r in listed(sparse.inverted_topk(corpus, queries, 300)).items() for d, s in r}
    assert all(want[q, d] == pytest.approx(s) for q, r in listed(found).items() for d, s in r)


def test_sparse_graphs_reach_all_vocabularies_and_copies(spark):
    rng = np.random.default_rng(9)
    texts = [(d, d % 8, rng.integers(0, 30, 4 if d % 8 else 400)) for d in range(400)]
    texts += [(d, 3, texts[3][2]) for d in range(400, 440)]  # equal rows
    rows = [(d, f"{v}-{t}", float(n)) for d, v, ts in texts for t, n in zip(*np.unique(ts, return_counts=True), strict=True)]
    corpus = spark.createDataFrame([(int(d), t, n) for d, t, n in rows], "doc_id long, term string, weight double").persist()
    queries = corpus.where("doc_id < 40").select(F.col("doc_id").alias("query_id"), "term", "weight")
    exact, ids = sparse.inverted_topk(corpus, queries, 10), queries.select("query_id").distinct()
    index = hnsw.build_sparse(corpus, degree=4, beam=8)
    assert sum(r["n"] for r in index.collect()) == 440
    found = hnsw.search_sparse(index, queries, 10, beam=20)
    assert evaluate.recall_at_k(found, exact, 10, ids).first()[0] >= 0.9
    assert listed(hnsw.search_sparse(index, queries, 10, beam=20, query_bytes=0)) == listed(found)
    assert listed(hnsw.search_sparse(index, queries.where("query_id = 3"), 10, beam=20)) == listed(exact.where("query_id = 3"))


def test_every_node_of_a_sparse_graph_is_reached():
    rng = np.random.default_rng(2)
    blocks = [(40 * v + np.unique(rng.integers(0, 40, 6 + 300 * (v == 0))), 6 + 300 * (v == 0)) for v in np.repeat(np.arange(6), 50)]
    terms, size = np.concatenate([t for t, _ in blocks]), np.array([len(t) for t, _ in blocks])
    rows = hnsw.SparseRows(np.concatenate([[0], np.cumsum(size)]), terms, np.ones(len(terms)), 240)
    graph = hnsw.SparseGraph.built(rows, 4, 42)
    for at, links in enumerate(graph.layers):
        nodes = np.flatnonzero(graph.level >= at).tolist()
        line = {x: y[y >= 0].tolist() for x, y in zip(nodes, links, strict=True)}
        reached = set(np.flatnonzero(graph.level > at).tolist()) or {nodes[0]}
        todo = list(reached)
        while todo:
            todo += (fresh := set(line[todo.pop()]) - reached)
            reached |= fresh
        assert reached == set(nodes)


def test_a_long_term_does_not_widen_a_stored_graph(spark):
    rows = [(d, f"t{d}-{t}", 1.0) for d in range(20) for t in range(20)] + [(0, "x" * 20_000, 1.0)]
    index = hnsw.build_sparse(spark.createDataFrame(rows, "doc_id long, term string, weight double"), degree=4, beam=8)
    assert sum(len(r["graph"]) for r in index.collect()) < 300_000
    found = hnsw.search_sparse(index, spark.createDataFrame([(0, "x" * 20_000, 2.0), (0, "unknown", 1.0), (1, "t7-3", 1.0)], "query_id long, term string, weight double"), 1)
    assert listed(found) == {0: [(0, 2.0)], 1: [(7, 1.0)]}


def test_a_stored_graph_is_the_graph():
    rows = hnsw.DenseRows(np.random.default_rng(1).normal(size=(200, 8)))
    graph = hnsw.Graph(rows, 6, 30).built()
    again = hnsw.Graph.unpacked(rows, hnsw.thawed(hnsw.frozen(graph.packed())))
    assert again.links == graph.links and again.entry == graph.entry
    assert all(len(near) <= (12 if level == 0 else 6) for node in graph.links for level, near in enumerate(node))
    for bad in ((0, 10), (4, 0)):
        with pytest.raises(ValueError):
            hnsw.Graph(rows, *bad)


def test_probes_follow_measured_recall(dense_set):
    _, df, queries = dense_set
    index = ivf.build(df, nlist=12)
    curve = [r["recall"] for r in ivf.probe_recall(index, df, queries, 10).orderBy("nprobe").collect()]
    assert curve == sorted(curve) and curve[-1] == pytest.approx(1) and len(curve) == 12
    n = ivf.tuned_nprobe(index, df, queries, 10, 0.9)
    assert curve[n - 1] >= 0.9 and (n == 1 or curve[n - 2] < 0.9)


def test_expressions(spark):
    row = spark.createDataFrame([([1.0, 2.0], [3.0, 4.0], {0: 1.0, 2: 2.0}, {2: 5.0, 3: 1.0})], "a array<float>, b array<float>, m map<int,double>, n map<int,double>")
    got = row.select(dot(F.col("a"), F.col("b")), sparse_dot(F.col("m"), F.col("n")), densify(F.col("m"), 4), half_precision(F.array(F.lit(0.1)).cast("array<float>"))).first()
    assert got[0] == 11 and got[1] == 10 and got[2] == [1, 0, 2, 0] and got[3] == [pytest.approx(0.0999756)]
    params = spark.createDataFrame([("index=(A),query=(nprobe=5)",), ("TBD",)], "p string").select(params_control(F.col("p")))
    assert [r[0] for r in params.collect()] == ["(nprobe=5)", "TBD"]


def test_strategies_and_tasks(micro, dense_set):
    assert strategy("bruteforce") == "brute" and strategy("inverted-index") == "inverted"
    with pytest.raises(ValueError):
        strategy("wand")
    assert listed(search.sparse_task("index", micro[0], micro[1], 3)) == listed(sparse.inverted_topk(micro[0], micro[1], 3))
    assert listed(search.sparse_task("brute", micro[0], micro[1], 3, micro[2], micro[3])) == listed(brute_of(micro, 3))
    assert len(listed(search.sparse_task("hnsw", micro[0], micro[1], 3))[0]) == 3
    assert len(listed(search.dense_task("task1", dense_set[2], None, 2))[0]) == 3
    with pytest.raises(ValueError):
        search.dense_task("task9", dense_set[1], None, 2)
