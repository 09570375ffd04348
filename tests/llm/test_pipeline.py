"""The pipeline's stages, each against its operator on its own input."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from lodestone.llm import decontaminate, langid, mixing, near_dedup  # noqa: E402
from lodestone.llm.common import staged  # noqa: E402


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for (name, stage), check in zip(corpus_pipeline.STAGES, (language, near, clean, mixed, dealt), strict=True):
        out = staged(stage(spark, docs, data), "test")
        if check is not dealt:
            assert out.columns == columns
        check(spark, data, docs, out)
        docs = out
    assert corpus_pipeline.run(spark, data).count() == docs.count()


def test_stages_take_awkward_rows_and_names(spark, data, odd, nothing):
    for docs in (odd, nothing):
        docs = docs.withColumns({c: docs["row"] for c in ("score", "lang_pred", "matches", "n_words", "copies", "copy", "id", "_text", "kept")})
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = staged(stage(spark, docs, data), "test")
            assert out.columns == docs.columns and out.count() <= 3 * docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, data).count() == docs.count()


SAME = "the very same words of a text that is long enough to be cut into several runs"


@pytest.fixture(scope="module")
def repeated(spark):
    """Equal ids with different texts, equal rows, null ids and copies under other ids."""
    other = "nothing in this line has to do with any of the other lines in this small table"
    rows = [(1, SAME, "en", "a"), (5, SAME, "en", "a"), (5, other, "en", "a"), (9, "z " + other[::-1], "en", "b"), (9, "z " + other[::-1], "en", "b"), (None, "z " + other[::-1], "en", "b")]
    rows += [(None, f"{i} " * 20, "en", "c") for i in range(20)] + [(None, f"{i} " * 20, "en", "c") for i in range(20)] + [(7, None, None, None)] * 3
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars int")
    return staged(docs.repartition(3), "repeated")


def test_near_dedup_keeps_one_row_of_each_text(spark, data, repeated):
    out = staged(corpus_pipeline.near_dedup_stage(spark, repeated, data), "test")
    kept, first = [(r["doc_id"], r["text"]) for r in out.collect()], {}
    for r in repeated.collect():
        first.setdefault(r["text"], []).append(r["doc_id"])
    want = [(min((i for i in ids if i is not None), default=None), t) for t, ids in first.items()]
    assert sorted(kept, key=repr) == sorted(want, key=repr)


def test_mixing_takes_each_row_by_itself(spark, data, repeated):
    out = staged(corpus_pipeline.mixing_stage(spark, repeated, data), "test")
    key = lambda d, t: (repr(d), len((t or "").split()))
    want = sorted(key for r in mixing.mix(repeated).collect() for key in [(repr(r["doc_id"]), r["size"])] * r["copies"])
    assert sorted(key(r["doc_id"], r["text"]) for r in out.collect()) == want
    assert not out.where("text is null").count()


def test_the_last_stage_returns_the_records(spark, data, repeated):
    out = staged(corpus_pipeline.sharding_stage(spark, repeated, data), "test")
    assert sorted(map(repr, out.select(*repeated.columns).collect())) == sorted(map(repr, repeated.collect()))
    assert {"size", "text_crc32", "law", "shard", "slot"} < set(out.columns)


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def language(spark, data, docs, out):
    found = langid.predict(docs, langid.fit(docs))
    assert ids(out) == ids(found.where(f"lang_pred <> 'und' and score >= {corpus_pipeline.LEAST_SCORE}"))
    assert len(ids(out)) >= 0.97 * docs.count()


def near(spark, data, docs, out):
    assert ids(out) == ids(near_dedup.near_classes(docs).where("kept"))


def clean(spark, data, docs, out):
    found = decontaminate.contamination(decontaminate.with_matches(docs, spark.read.parquet(f"{data}/benchmark.parquet")))
    assert ids(out) == ids(found.where("not contaminated"))


def mixed(spark, data, docs, out):
    taken = mixing.mix(docs).collect()
    assert ids(out) == sorted(r["doc_id"] for r in taken for _ in range(r["copies"]))


def dealt(spark, data, docs, out):
    counts = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert sum(counts) == docs.count() and max(counts) - min(counts) <= 1
