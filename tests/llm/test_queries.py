"""The registered queries: with SQL against DuckDB, without against brute force."""

import os
import zlib

import duckdb
import numpy as np
import pytest
from test_dedup import brute_classes
from test_files import PATH, check_files
from test_mixing_sharding import check_mix, check_shards
from test_models import check_scores
from tokenizers import Tokenizer

from lodestone.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_oracle(spark, data, name):
    con = duckdb.connect()
    for t in os.listdir(data):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{data}/{t}'")
    df, want = QUERIES[name](spark, data), con.sql(ORACLE_SQL[name])
    at = [want.columns.index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect()), key=repr) == sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=repr)


def test_every_operator_has_one_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


@pytest.fixture(scope="module")
def found(spark, data):
    return lambda name: QUERIES[name](spark, data).collect()


@pytest.fixture(scope="module")
def docs(documents):
    return documents.collect()


def test_source_mix(found, docs):
    source = {d["doc_id"]: d["source"] for d in docs}
    rows = [r.asDict() | {"source": source[r["doc_id"]]} for r in found("op1_source_mix")]
    assert max(check_mix(rows, docs).values()) <= 60  # ten documents a source leave few sums


def test_shards(found, docs):
    rows = found("op4_shards")
    check_shards(rows, docs, 40)
    assert {(r["law"], r["grown_shard"]) for r in rows} == {("rows", None)}


def test_near_dedup(found, docs):
    rows = found("op5_near_dedup")
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in rows) == brute_classes(docs)


def test_token_files(found, docs):
    check_files(Tokenizer.from_file(PATH), docs, found("op6_token_files"))


def test_language_id(found, docs):
    lang = {d["doc_id"]: d["lang"] for d in docs}
    rows = found("op9_language_id")
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 for r in rows)
    held = [r["lang_pred"] == lang[r["doc_id"]] for r in rows if r["held_out"] and lang[r["doc_id"]] is not None]
    assert len(rows) == len(docs) and np.mean(held) >= 0.9


def test_hmm_scores(found, docs):
    rows = found("op10_hmm_scores")
    check_scores(docs, rows)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
