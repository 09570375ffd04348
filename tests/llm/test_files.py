"""Token files and archives: round trips and damage."""

import base64
import gzip
import hashlib
import io
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestone.llm import token_files as tf
from lodestone.llm import warc, words
from lodestone.llm.common import new_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def encoder():
    return tf.Encoder(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aB 's,.\n  　é1", max_size=40)), min_size=1, max_size=5))
def test_pieces_give_the_tokenizers_ids(tokenizer, encoder, texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    ids, counts = encoder.encode(*words.buffer_of(pa.array(texts, pa.string())))
    assert ids.tolist() == [i for t in texts for i in ids_of(tokenizer, t)] and counts.tolist() == [len(ids_of(tokenizer, t)) for t in texts]


SPECIAL = "<|endoftext|>"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([SPECIAL, SPECIAL[:5], SPECIAL[5:], " ", "  ", "a", "be", "'s", ".", "\n", "é", "|>"]), max_size=8).map("".join), min_size=1, max_size=4))
def test_special_tokens_in_texts(tokenizer, encoder, texts):
    ids, counts = encoder.encode(*words.buffer_of(pa.array(texts, pa.string())))
    assert ids.tolist() == [i for t in texts for i in ids_of(tokenizer, t)] and counts.tolist() == [len(ids_of(tokenizer, t)) for t in texts]


def test_a_special_token_is_its_id(encoder):
    ids, _ = encoder.encode(*words.buffer_of(pa.array([f"hello {SPECIAL} world", SPECIAL[:4], SPECIAL[4:], SPECIAL * 2])))
    assert ids.tolist().count(50256) == 3


def test_a_full_memory_of_pieces_begins_anew(tokenizer, monkeypatch):
    monkeypatch.setattr(tf, "KNOWN_PIECES", 6)
    encoder = tf.Encoder(PATH)
    for text in ("one two three four", "one two three nine ten", "one two three four five six seven eight nine"):
        assert encoder.encode(*words.buffer_of(pa.array([text])))[0].tolist() == ids_of(tokenizer, text)


def check_files(tokenizer, docs, rows):
    start, want = 0, []
    for d in sorted(docs, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0)):
        ids = np.array(ids_of(tokenizer, d["text"]), "<u4")
        want.append((d["doc_id"], len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = sorted(rows, key=lambda r: r["start"])
    assert sorted(((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got), key=repr) == sorted(want, key=repr)
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got)])[:-1].tolist()
    assert [r["doc_id"] for r in got] == sorted((r["doc_id"] for r in got), key=lambda i: (i is not None, i or 0))


def test_round_trip(tokenizer, odd, documents, nothing):
    for docs in (odd, documents):
        check_files(tokenizer, docs.collect(), tf.token_round_trip(docs, PATH).collect())
    assert tf.token_round_trip(nothing, PATH).count() == 0


def test_bit_planes_and_small_files(spark, tokenizer, documents):
    folder = new_folder(spark, "test-planes")
    index = tf.write_token_files(documents, PATH, folder, bits=True, file_ids=1)
    check_files(tokenizer, documents.collect(), tf.read_token_files(index, folder).collect())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=50), st.booleans())
def test_planes(ids, bits):
    ids = np.array(ids, np.uint32)
    assert tf.from_planes(tf.to_planes(ids, bits), len(ids)).tolist() == ids.tolist()


def test_reader_seeks_and_checks():
    class Kept(io.BytesIO):
        def close(self):
            self.kept = self.getvalue()

    rng, out = np.random.default_rng(1), Kept()
    ids = rng.integers(0, 50_000, 150_000, dtype=np.uint32)
    writer = tf.PlaneWriter(out)
    writer.add(np.array([5, 6]), np.array([False, False]), np.array([100_000, 50_000]), ids)
    assert writer.close() == (2, 150_000)
    source = lambda raw: pa.PythonFile(io.BytesIO(raw), "r")
    reader = tf.PlaneReader(source(out.kept))
    assert len(reader.index) == 3 and reader.ids(65_000, 1_000).tolist() == ids[65_000:66_000].tolist()
    assert reader.docs.tolist() == [5, 6] and reader.ids(100_000, 50_000).tolist() == ids[100_000:].tolist()
    assert len(out.kept) < 4 * len(ids) * 0.6
    damaged = bytearray(out.kept)
    damaged[reader.index[1][0] + 20_000] ^= 1
    with pytest.raises((ValueError, tf.zstandard.ZstdError)):
        tf.PlaneReader(source(bytes(damaged))).chunk(1)
    with pytest.raises(ValueError):
        tf.PlaneReader(source(out.kept[:-1]))


# ---------------------------------------------------------------- WARC


def archive(n=12, zipped=True):
    out = []
    for i in range(n):
        payload = f"<html>page {i} ".encode() * (5 + i)
        raw = warc.record(i, f"http://h/{i}", payload, hashlib.sha256(payload).hexdigest(), None)
        out.append(warc.member(raw) if zipped else raw)
    return out


def found(data):
    out = list(warc.salvaged(data))
    return [int(x.headers["page-id"]) for x in out if isinstance(x, warc.Record) and "page-id" in x.headers], [x for x in out if isinstance(x, warc.Gap)]


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_after_each_kind_of_damage(zipped):
    parts = archive(zipped=zipped)
    data, at = b"".join(parts), np.cumsum([0, *map(len, parts)])
    assert found(data) == (list(range(12)), [])
    for i in (0, 4, 11):
        for place in (at[i] + 12, (at[i] + at[i + 1]) // 2, at[i + 1] - 3):
            broken = bytearray(data)
            broken[place] ^= 0x55
            ids, gaps = found(bytes(broken))
            assert set(range(12)) - {i} <= set(ids)
            assert not zipped or i in ids or [(g.start, g.end) for g in gaps] == [(at[i], at[i + 1])]
    ids, gaps = found(data[: at[5] + 9] + data[at[6] + 3 :])  # a cut through two records
    assert ids == [0, 1, 2, 3, 4, 7, 8, 9, 10, 11] and len(gaps) == 1 and gaps[0].reason
    ids, gaps = found(b"junk" + data[:-7])
    assert ids == list(range(11)) and len(gaps) == 2
    assert found(b"") == ([], []) and found(b"nothing here")[1] == [warc.Gap(0, 12, "no version line")]


def test_a_wrong_digest_is_a_gap():
    bad = warc.member(warc.record(1, None, b"payload", "0" * 64, None))
    good = archive(1)[0]
    ids, gaps = found(bad + good)
    assert ids == [0] and "digest" in gaps[0].reason


def test_members_are_plain_gzip():
    raw = gzip.decompress(archive(1)[0])
    assert raw.startswith(b"WARC/1.1\r\n") and b"Content-Length" in raw


def check_pages(pages, rows):
    first, want = {}, []
    digest = lambda p: hashlib.sha256((p["html"] or "").encode()).hexdigest()
    size = lambda p: len((p["html"] or "").encode())
    for p in sorted(pages, key=lambda p: (p["page_id"] is None, p["page_id"] or 0)):
        again = size(p) >= 100 and digest(p) in first
        first.setdefault(digest(p), p["page_id"])
        want.append((p["page_id"], size(p), digest(p), "revisit" if again else "response", first[digest(p)] if again else None))
    assert sorted(map(tuple, rows), key=repr) == sorted(want, key=repr)


def test_pages_round_trip(spark, data):
    same = "<p>" + "same " * 50
    odd = [(1, "u", None), (2, None, ""), (3, "u", same), (4, "u\r\nx: y", same), (5, "u", same[:90]), (6, "u", same[:90]), (None, "u", same), (7, "u", same + "é\r\n\r\nWARC/1.1\r\n"), (4, "u", same)]
    pages = spark.createDataFrame(odd, "page_id long, url string, html string")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    check_pages(pages.collect(), warc.archive_round_trip(pages).select(columns).collect())
    whole = spark.read.parquet(f"{data}/pages.parquet")
    check_pages(whole.collect(), warc.archive_round_trip(whole).select(columns).collect())
    assert warc.archive_round_trip(pages.limit(0)).count() == 0


def test_gaps_are_logged(spark, data):
    import pyarrow.fs

    pages = spark.read.parquet(f"{data}/pages.parquet")
    folder = new_folder(spark, "test-warc")
    files = warc.write_archives(pages, folder, file_bytes=50_000)
    path = files.first()["path"]
    store, _ = pyarrow.fs.FileSystem.from_uri(folder)
    with store.open_input_file(path) as f:
        raw = bytearray(f.read())
    raw[len(raw) // 2] ^= 0xFF
    with store.open_output_stream(path, compression=None) as f:
        f.write(bytes(raw))
    found = warc.salvage(files, folder).persist()
    gaps = warc.gaps_of(found).collect()
    assert len(gaps) == 1 and gaps[0]["path"] == path and gaps[0]["start"] < gaps[0]["end"] and warc.records_of(found).count() == pages.count() - 1


def test_other_digests_are_checked():
    payload = b"some payload"
    sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    for told in (f"sha1:{sha1}", f"sha1:{hashlib.sha1(payload).hexdigest()}", f"md5:{hashlib.md5(payload).hexdigest()}", "blake3:unknown", ""):
        assert warc.digest_fits(told, payload)
    for told in (f"sha1:{sha1[::-1]}", "md5:0", "sha256:"):
        assert not warc.digest_fits(told, payload)


def test_many_damages_are_searched_once(monkeypatch):
    tried, begins = [], warc.begins_record
    monkeypatch.setattr(warc, "begins_record", lambda data, at: tried.append(at) or begins(data, at))
    parts = archive(60)
    broken = b"".join(p[:-9] + bytes(9) if i % 2 else p for i, p in enumerate(parts))
    ids, gaps = found(broken)
    assert ids == list(range(0, 60, 2)) and len(gaps) == 30
    assert len(tried) == len(set(tried)) <= broken.count(warc.MAGIC)


def test_long_payloads_and_clashing_names(spark):
    rows = [(i, "u", ("<p>" + str(i)) * 400_000, "x") for i in range(3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, x string").withColumns({c: F.lit("x") for c in ("row", "id", "refers_to", "path", "reason")})
    got = warc.archive_round_trip(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    check_pages(pages.collect(), got)
