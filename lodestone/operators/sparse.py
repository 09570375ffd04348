"""Exact search by inner product over sparse triples, from a stored inverted index or without one.

The index holds a row for each segment and term, with the term's postings in document order. A
segment is a bounded share of the documents, chosen by a hash of their id, so a frequent term
is many rows of bounded size and a segment's scores are summed in one partition. It is
written once, sorted by term, and searched as often as one likes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.staging import staged
from .ranges import running_total
from .topk import topk

BROADCAST_BYTES = 64 << 20
SEGMENT_DOCS = 1 << 16
LEAST_SEGMENTS = 32
PUSHED_TERMS = 10  # Parquet's readers skip row groups by so many literals at most


def fits(triples: DataFrame, most: int) -> bool:
    """Whether triples take ``most`` bytes or less."""
    size = triples.agg(F.sum(F.lit(48) + F.length(F.col("term").cast("string")))).first()[0] or 0
    return size <= most


def segment_count(n_docs: int) -> int:
    return max(LEAST_SEGMENTS, -(-n_docs // SEGMENT_DOCS))


def segment_of(doc_id, segments: int):
    return F.pmod(F.xxhash64(doc_id), F.lit(segments)).cast("int")


def index_rows(corpus: DataFrame, segments: int) -> DataFrame:
    """(segment, term, n, postings) from (doc_id, term, weight)."""
    dealt = corpus.withColumn("segment", segment_of(F.col("doc_id"), segments)).repartition(segments, "segment")
    postings = F.array_sort(F.collect_list(F.struct("doc_id", F.col("weight").cast("double").alias("weight"))))
    return dealt.groupBy("segment", "term").agg(F.count("*").alias("n"), postings.alias("postings"))


def write_index(corpus: DataFrame, n_docs: int, path: str) -> None:
    index_rows(corpus, segment_count(n_docs)).sortWithinPartitions("term", "segment").write.parquet(path)


def index_scores(index: DataFrame, queries: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(segment, query_id, doc_id, score, postings) of all pairs that share a term, from the index.

    Only the queries' terms leave the index. Queries that fit in ``broadcast_bytes`` are broadcast:
    postings are then dealt by segment, packed as they are stored, and sums need no shuffle of
    their own. More queries meet the postings by a join on the term.
    """
    q = staged(queries.select("query_id", "term", F.col("weight").cast("double").alias("qw")), "query-triples")
    few = fits(q, broadcast_bytes)
    maybe = F.broadcast if few else lambda df: df
    terms = q.select("term").distinct()
    first = terms.limit(PUSHED_TERMS + 1).collect()
    if len(first) <= PUSHED_TERMS:
        asked = index.where(F.col("term").isin([r["term"] for r in first]))
    else:
        asked = index.join(maybe(terms), "term", "left_semi")
    asked = asked.select("segment", "term", "postings")
    asked = asked.repartition("segment") if few else asked
    joined = asked.select("segment", "term", F.inline("postings")).join(maybe(q), "term")
    return joined.groupBy("segment", "query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight")).alias("score"), F.count("*").alias("postings"))


def scores(corpus: DataFrame, queries: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(query_id, doc_id, score, postings) of all pairs that share a term, without an index.

    Query triples that fit in ``broadcast_bytes`` are broadcast: the corpus then stays where it
    is, dealt by doc_id, and the sums need no shuffle. More are joined by shuffle; Spark splits
    hot terms.
    """
    q = queries.select("query_id", "term", F.col("weight").alias("qw"))
    joined = corpus.select("doc_id", "term", "weight").join(F.broadcast(q) if fits(queries, broadcast_bytes) else q, "term")
    return joined.groupBy("query_id", "doc_id").agg(F.sum(F.col("qw") * F.col("weight").cast("double")).alias("score"), F.count("*").alias("postings"))


def inverted_topk(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """The k best of the documents that share a term with the query."""
    return topk(scores(corpus, queries), k)


def brute_topk(touched: DataFrame, doc_ids: DataFrame, query_ids: DataFrame, k: int) -> DataFrame:
    """The k best of all documents, from ``touched`` scores (staged, as they are read twice); the others score 0.

    Only a query with fewer than k touched documents of score 0 or more can need untouched ones,
    and then the smallest ids: at most k beyond as many as it touched. Such a query is joined
    to those ids by their place in order, and to no others.
    """
    counts = touched.groupBy("query_id").agg(F.sum(F.when(F.col("score") >= 0, 1).otherwise(0)).alias("good"), F.count("*").alias("n"))
    needy = query_ids.select("query_id").join(counts, "query_id", "left").where(F.coalesce("good", F.lit(0)) < k)
    needy = staged(needy.select("query_id", (F.coalesce("n", F.lit(0)) + k).alias("upto")), "needy")
    most = needy.agg(F.max("upto")).first()[0] or 0
    found = touched.select("query_id", "doc_id", "score")
    if most:
        pool = staged(doc_ids.select("doc_id", F.lit(1).alias("one")).orderBy("doc_id").limit(most), "smallest")
        places = running_total(pool, ["doc_id"], "one", "place").select("doc_id", "place")
        pairs = needy.select("query_id", F.explode(F.sequence(F.lit(1), F.col("upto").cast("long"))).alias("place")).join(places, "place")
        zero = pairs.select("query_id", "doc_id").join(touched.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
        found = found.unionByName(zero.withColumn("score", F.lit(0.0)))
    return topk(found, k)


def search_stats_per_query(touched: DataFrame, query_ids: DataFrame) -> DataFrame:
    """(query_id, postings, touched) for all queries, those that touch nothing too."""
    s = touched.groupBy("query_id").agg(F.sum("postings").alias("postings"), F.count("*").alias("touched"))
    return query_ids.select("query_id").join(s, "query_id", "left").na.fill(0, ["postings", "touched"])


def search_stats(per_query: DataFrame, n_docs: int) -> DataFrame:
    share = F.when(F.lit(n_docs) > 0, F.avg("touched") * 100 / n_docs).otherwise(0.0)
    return per_query.agg(
        F.count("*").alias("queries"),
        F.sum("postings").alias("total_postings"),
        F.avg("postings").alias("avg_postings"),
        F.sum("touched").alias("total_touched"),
        F.avg("touched").alias("avg_touched"),
        F.max("touched").alias("max_touched"),
        share.alias("touched_percent"),
    )


def term_df(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("term").agg(F.count("*").alias("df"))


def shared_terms(touched: DataFrame) -> DataFrame:
    """(query_id, doc_id, shared): how many terms a query and a document have in common."""
    return touched.select("query_id", "doc_id", F.col("postings").alias("shared"))
