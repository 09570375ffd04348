"""Token totals, language ID and the hidden Markov model."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import hmm, langid
from lodestone.llm.common import new_folder
from lodestone.llm.token_counts import VERSIONS, TokenLedger, bpe_counts, changes, counts_of, word_counts

# ---------------------------------------------------------------- totals


def tokens(text, version):
    raw = (text or "").encode()
    return len(re.findall(rb"[^\x20\x09-\x0D]+" if version == "words-1" else rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", raw.lower() if version == "words-2" else raw))


def sums(rows):
    out = defaultdict(lambda: [0, 0])
    for r in rows:
        for v in VERSIONS:
            out[(r["source"], r["lang"], v)][0] += 1
            out[(r["source"], r["lang"], v)][1] += tokens(r["text"], v)
    return {k: tuple(v) for k, v in out.items()}


def totals(ledger):
    return {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in ledger.totals().collect()}


def test_ledger(spark, odd):
    docs = odd.dropDuplicates(["doc_id", "text"])
    rows = docs.collect()
    ledger = TokenLedger(spark, new_folder(spark, "test-ledger"))
    new = lambda df, **k: changes(df, counts_of(F.col("text")), **k)
    assert totals(ledger) == {}
    assert ledger.commit("a", new(docs)) and totals(ledger) == sums(rows)
    assert not ledger.commit("a", new(docs)) and totals(ledger) == sums(rows)
    gone = docs.where("doc_id in (1, 3)").select("doc_id").union(spark.createDataFrame([(999,)], "doc_id long"))
    ledger.commit("b", changes(gone, None))
    left = [r.asDict() for r in rows if r["doc_id"] not in (1, 3)]
    assert totals(ledger) == sums(left)
    moved = docs.where("doc_id in (1, 2)").withColumns({"text": F.lit("two words"), "source": F.lit("new")})
    ledger.commit("c", new(moved).union(changes(docs.where("doc_id = 2"), None, seq=-1)))
    left = [r for r in left if r["doc_id"] != 2] + [r.asDict() for r in moved.collect()]
    assert totals(ledger) == sums(left)
    ledger.commit("d", new(docs.limit(0)))
    assert totals(TokenLedger(spark, ledger.folder)) == sums(left) and ledger.batches() == ["a", "b", "c", "d"]


@pytest.mark.parametrize("least_bytes", [0, 1 << 30])
def test_compaction_changes_no_total(spark, documents, least_bytes):
    folder, rng = new_folder(spark, "test-ledger"), np.random.default_rng(1)
    counts = counts_of(F.col("text"))
    texts = {r["doc_id"]: r.asDict() for r in documents.select("doc_id", "source", "lang", "text").collect()}
    live, buckets = dict(texts), set()
    ledger = TokenLedger(spark, folder, buckets=8, least_bytes=least_bytes)
    ledger.commit("0", changes(documents, counts))
    for n in range(1, 5):
        some = [int(i) for i in rng.choice(list(texts), 12, replace=False)]
        part = documents.where(F.col("doc_id").isin(some))
        if n % 2:
            ledger.commit(str(n), changes(part, None))
            live = {i: r for i, r in live.items() if i not in some}
        else:
            ledger.commit(str(n), changes(part.withColumn("text", F.concat("text", F.lit(" more words"))), counts))
            live |= {i: texts[i] | {"text": texts[i]["text"] + " more words"} for i in some}
        assert totals(TokenLedger(spark, folder, buckets=8)) == sums(live.values())
    states = ledger._names("states")
    assert bool(states) == (least_bytes == 0)
    ledger.compact()
    before, since = ledger._logs()
    assert not since and ledger._read(before, "doc_id long, bucket int").count() == len(live)
    assert not ledger.commit("3", changes(documents, None)) and totals(ledger) == sums(live.values())


def test_repeated_rows_of_a_batch_count_once(spark):
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (None, "c", "s", "en"), (None, "c", "s", "en")]
    ledger = TokenLedger(spark, new_folder(spark, "test-ledger"))
    ledger.commit("a", changes(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"), counts_of(F.col("text"))))
    assert totals(ledger) == {("s", "en", v): (3, 4) for v in VERSIONS}


def test_counting_many_texts_at_once(odd, documents):
    for docs in (odd, documents):
        bare = F.replace(F.col("text"), F.lit("|"), F.lit(" "))
        want = docs.select("doc_id", counts_of(F.col("text")).alias("counts"), counts_of(bare).alias("bare"))
        assert sorted(map(repr, word_counts(docs, ("doc_id",), blank="|").collect())) == sorted(map(repr, want.collect()))
    names = ("counts", "bare", "n0", "k0", "_n0")
    found = word_counts(odd.withColumns({c: odd["row"] for c in names}), ("doc_id", *names))
    assert set(found.columns) == {"doc_id", *names} and found.count() == odd.count()


def test_a_batch_cut_short_leaves_nothing(spark, odd, monkeypatch):
    ledger = TokenLedger(spark, new_folder(spark, "test-ledger"))
    batch = changes(odd, counts_of(F.col("text")))
    with monkeypatch.context() as m:
        m.setattr(ledger, "_fs", type("Broken", (), {"exists": ledger._fs.exists, "delete": ledger._fs.delete, "listStatus": ledger._fs.listStatus, "mkdirs": ledger._fs.mkdirs, "rename": lambda *a: 1 / 0})())
        with pytest.raises(ZeroDivisionError):
            ledger.commit("a", batch)
    assert totals(ledger) == {} and ledger.commit("a", batch) and totals(ledger)


def test_bpe_counts(odd):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = sorted(((r["row"], r["n_tokens"]) for r in bpe_counts(odd, path, ("row",)).collect()), key=repr)
    assert got == sorted(((r["row"], len(t.encode(r["text"] or "", add_special_tokens=False).ids)) for r in odd.collect()), key=repr)


def test_bpe_counts_keep_columns_of_any_name(odd):
    docs = odd.withColumns({c: odd["row"] for c in ("n_tokens", "_text", "k0")})
    found = bpe_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), tuple(docs.columns))
    assert set(found.columns) == set(docs.columns) and dict(found.dtypes)["n_tokens"] == "bigint" and found.count() == docs.count()


# ---------------------------------------------------------------- language ID


def test_predictions_keep_columns_of_any_name(odd, nothing):
    docs = odd.withColumns({c: odd["row"] for c in ("score", "lang_pred", "_text", "k0")})
    found = langid.predict(docs, langid.fit(docs), keep=tuple(docs.columns))
    assert set(found.columns) == set(docs.columns) and dict(found.dtypes)["score"] == "double" and found.count() == docs.count()
    assert {r["lang_pred"] for r in langid.predict(odd, langid.fit(nothing)).collect()} == {"und"}


def test_language_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.fit(docs, per_language=400)
    got = langid.predict(docs, model, keep=("doc_id", "lang")).withColumn("held", langid.held_out()).where("held").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) >= 0.97 and all(0 <= r["score"] <= 1 for r in got)


def test_language_of_odd_rows(odd, nothing, documents):
    model = langid.fit(documents, per_language=50)
    got = {r["doc_id"]: r for r in langid.predict(odd, model, keep=("doc_id", "text", "row")).collect()}
    assert all((got[i]["lang_pred"], got[i]["score"]) == ("und", 0) for i in (3, 4, 8, 9)) and got[7]["lang_pred"] != "und"
    assert langid.predict(nothing, model).count() == 0
    untaught = langid.fit(nothing)
    assert {r["lang_pred"] for r in langid.predict(odd, untaught).collect()} == {"und"}


def test_held_out_labels_and_ids_do_not_matter(documents):
    base = langid.fit(documents, per_language=40)
    other = langid.fit(documents.withColumn("lang", F.when(langid.held_out(), F.lit("xx")).otherwise(F.col("lang"))), per_language=40)
    assert base.languages == other.languages and all((a == b).all() for a, b in zip(base.filters, other.filters, strict=True))


def test_responses_equal_a_plain_convolution():
    rng = np.random.default_rng(0)
    filters = [rng.normal(size=(w, 256, langid.FILTERS)).astype(np.float32) for w in langid.WIDTHS]
    windows = rng.integers(0, 256, (3, langid.WINDOW), dtype=np.uint8)
    bias = rng.normal(size=len(langid.WIDTHS) * langid.FILTERS).astype(np.float32)
    want = []
    for b in windows:
        best = [np.max([sum(f[j][b[t + j]] for j in range(len(f))) for t in range(langid.WINDOW - len(f) + 1)], 0) for f in filters]
        want.append(np.maximum(np.concatenate(best) + bias, 0))
    assert np.allclose(langid.largest_responses(filters, bias, windows), want, atol=1e-4)


def test_a_text_has_the_mean_of_its_windows(documents):
    """Window by window in plain Python, weighted by bytes."""
    model = langid.fit(documents, per_language=30)
    rows = langid.predict(documents, model, keep=("doc_id", "text")).collect()
    for r in rows[:60]:
        raw = (r["text"] or "").encode()
        total = np.zeros(len(model.languages))
        for at in range(0, len(raw), langid.WINDOW):
            part = raw[at : at + langid.WINDOW]
            window = np.frombuffer(part.ljust(langid.WINDOW, b"\0"), np.uint8)[None]
            x = langid.largest_responses(model.filters, model.bias, window)[0] @ model.weights + model.offset
            e = np.exp(x - x.max())
            total += e / e.sum() * len(part)
        if any(c.isalpha() for c in raw.decode()):
            assert r["lang_pred"] == model.languages[int(total.argmax())] and r["score"] == pytest.approx(total.max() / len(raw), abs=1e-5)
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0)


# ---------------------------------------------------------------- hidden Markov model


def test_expected_counts_and_likelihood_equal_enumeration():
    rng = np.random.default_rng(2)
    k, s, n = 2, 3, 4
    unit = lambda x: x / x.sum(-1, keepdims=True)
    model = hmm.Model(unit(rng.random(k)), unit(rng.random((k, k))), unit(rng.random((k, s))), np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(1), np.zeros(1), 1, 1)
    seqs = [[0, 2, 1, 1], [2, 2], [1]]
    starts, steps, emits, total = np.zeros(k), np.zeros((k, k)), np.zeros((k, s)), 0.0
    for seq in seqs:
        paths = [(p, math.prod([model.start[p[0]] * model.emit[p[0], seq[0]], *(model.step[a, b] * model.emit[b, x] for a, b, x in zip(p, p[1:], seq[1:], strict=False))])) for p in np.ndindex(*[k] * len(seq))]
        whole = sum(w for _, w in paths)
        total += math.log(whole)
        for p, w in paths:
            starts[p[0]] += w / whole
            for a, b in zip(p, p[1:], strict=False):
                steps[a, b] += w / whole
            for a, x in zip(p, seq, strict=True):
                emits[a, x] += w / whole
    grid = np.array([q + [0] * (n - len(q)) for q in seqs])
    got = hmm.expected(model, grid, np.array([len(q) for q in seqs]))
    for a, b in zip(got, (starts, steps, emits, total), strict=True):
        assert np.allclose(a, b, atol=1e-5)
    flat = np.array([x for q in seqs[::-1] for x in q])
    assert hmm.log_forward(model, model.emit.T, flat, np.array([1, 2, 4])).sum() == pytest.approx(total / math.log(10))


def check_scores(docs, rows):
    seqs = [(d["doc_id"], [*re.findall(rb"[^\x20\x09-\x0D]+", (d["text"] or "").encode().lower()), None]) for d in docs]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = Counter(w for i, q in seqs if not held(i) for w in q)
    n, v = sum(c.values()), len(c)
    want = sorted(((repr(i), held(i), len(q), sum(c[w] > 0 for w in q), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in q), 4)) for i, q in seqs))
    assert sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows) == want


def test_scores(documents, odd, nothing):
    rows = hmm.scores(documents).collect()
    check_scores(documents.collect(), rows)
    assert sum(r["score"] for r in rows if r["held_out"]) > sum(r["base_score"] for r in rows if r["held_out"])
    got = hmm.scores(odd, rounds=2).collect()
    check_scores(odd.collect(), got)
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert hmm.scores(nothing).count() == 0
    check_scores(documents.where(hmm.held_out()).collect(), hmm.scores(documents.where(hmm.held_out())).collect())


@pytest.fixture(scope="module")
def trained(documents):
    blocks = hmm.packed(documents, "doc_id", "text")
    vocabulary = hmm.vocabulary_of(blocks)
    model = hmm.fit(blocks, vocabulary, states=5, rounds=1)
    table = hmm.emissions(model, blocks)
    return blocks, vocabulary, hmm.with_words(model, table), table


def all_words(vocabulary, model, table):
    """Hashes, endings, counts and shares of all training words, and a word of each class that training never saw."""
    rows = vocabulary.join(table.drop("c"), "word").collect()
    c = np.array([r["c"] for r in rows] + [0] * hmm.ENDINGS, float)
    parts = [np.array([r[n] for r in rows] + [0] * hmm.ENDINGS) for n in table.columns[2:]]
    hashes = np.append(np.array([r["word"] for r in rows], np.int64).view(np.uint64), np.arange(hmm.ENDINGS, dtype=np.uint64))
    return hashes, np.append([r["ending"] for r in rows], np.arange(hmm.ENDINGS)), c, hmm.unpacked_shares(parts, len(model.start))


def test_words_of_the_model_sum_to_one(trained):
    _, vocabulary, model, table = trained
    assert np.allclose(model.emit.sum(1), 1) and np.allclose(model.step.sum(1), 1)
    hashes, endings, c, share = all_words(vocabulary, model, table)
    assert len(hashes) == vocabulary.count() + hmm.ENDINGS == model.distinct + hmm.ENDINGS and len(model.frequent) == min(hmm.FREQUENT, model.distinct)
    assert np.allclose(hmm.emits_of(model, c, share, hashes, endings).sum(0), 1)


def test_emissions_are_expected_counts_of_every_word(trained):
    blocks, vocabulary, model, table = trained
    want, c = {}, {}
    for batch in blocks.drop("block").toArrow().to_batches():
        for i in range(len(batch)):
            row = hmm.cells(batch, i)
            got = hmm.expected_in(model, row, by_word=True)[2].T
            for j in np.flatnonzero(row["counts"]):
                h = int(row["hashes"][j].view(np.int64))
                want[h], c[h] = want.get(h, 0) + got[j], c.get(h, 0) + row["counts"][j]
    rows = table.collect()
    assert {r["word"]: r["c"] for r in rows} == c and len(rows) == model.distinct
    shares = hmm.unpacked_shares([np.array([r[n] for r in rows]) for n in table.columns[2:]], 5)
    for r, s in zip(rows, shares, strict=True):
        assert np.allclose(r["c"] * s, want[r["word"]], atol=1.1 / hmm.SHARE * r["c"])
    assert np.allclose(model.state_n, sum(r["c"] * s for r, s in zip(rows, shares, strict=True)))


def test_scores_are_the_models_forward_probabilities(trained, documents):
    """Plain forward recursion over each text's words with the table of all words."""
    blocks, vocabulary, model, table = trained
    hashes, endings, c, share = all_words(vocabulary, model, table)
    emits = hmm.emits_of(model, c, share, hashes, endings)
    at = {int(h): i for i, h in enumerate(hashes[: -hmm.ENDINGS])}
    found = {r["doc_id"]: r["score"] for r in hmm.scores(documents, states=5, rounds=1).collect()}
    checked = 0
    for batch in blocks.drop("block").toArrow().to_batches():
        for i in range(len(batch)):
            row = hmm.cells(batch, i)
            ends = np.cumsum(row["sizes"])
            for doc, size, end in list(zip(row["ids"].to_pylist(), row["sizes"], ends, strict=True))[:40]:
                state, total = model.start, 0.0
                for t, w in enumerate(row["tokens"][end - size : end]):
                    j = at.get(int(row["hashes"][w]), len(at) + int(row["endings"][w]))
                    state = (state if t == 0 else state @ model.step) * emits[j]
                    total += math.log10(state.sum())
                    state = state / state.sum()
                assert found[doc] == pytest.approx(total, rel=1e-9)
                checked += 1
    assert checked >= 40


def test_what_scoring_gathers_grows_with_the_corpus(documents):
    half = documents.where("doc_id % 2 = 0")
    sizes = []
    for docs in (half, documents):
        blocks = hmm.packed(docs, "doc_id", "text")
        vocabulary = hmm.vocabulary_of(blocks)
        sizes.append(hmm.emissions(hmm.fit(blocks, vocabulary, states=2, rounds=0), blocks).count())
    assert sizes[1] > 1.3 * sizes[0]


def test_rounds_of_training_raise_the_likelihood(documents):
    blocks = hmm.packed(documents, "doc_id", "text")
    vocabulary = hmm.vocabulary_of(blocks)
    likelihood = [hmm.counted(hmm.fit(blocks, vocabulary, states=4, rounds=n), blocks)[-1] for n in (0, 1, 3)]
    assert likelihood[0] < likelihood[1] < likelihood[2]
