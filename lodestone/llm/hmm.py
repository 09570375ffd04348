"""Scoring texts with a hidden Markov language model.

Tokens are lower-cased (A-Z) words and one end for each text. Training has two steps.

* Tied rounds. The model's states emit symbols: each of the ``FREQUENT`` most frequent words is a
  symbol of its own, every other word falls into one of ``ENDINGS`` classes by its last three
  bytes, where it has the class's smoothed share of the counts. ``ROUNDS`` rounds of Baum-Welch
  fit these few parameters.
* Words. One more pass gathers the expected emissions of every training word in every state, as
  a table with a row for each word that grows with the corpus. The model's emissions are

      P(word | state) = (E(word, state) + K x tied P(word | state)) / (E(state) + K)

  with K the number of distinct words for each state, so classes only smooth them, and a word
  that training never saw has the class's share.

Training is over all training tokens, cut into segments of ``SEGMENT``; a segment that doesn't
begin a text starts from the states' stationary distribution and counts no start. Each
partition runs forward and backward passes over its segments in numpy; Spark sums the expected
counts by parameter, or by word. The driver gets one sum for each tied parameter, which the
model bounds, and no word beyond the frequent ones. Scoring runs the scaled forward recursion
over whole texts, so the likelihood is exact under the model.

The table of words (named by 64-bit hashes) is never broadcast: texts are packed into blocks of
about ``BLOCK_BYTES`` with a vocabulary each, and blocks' vocabularies are joined to the table, so
a block gets the rows of its own words only. Frequent words, which all blocks have, go with
the model instead and are no hot keys. A word's emissions are its count and its share in each
state in ``BITS`` bits; the states' totals are sums of just these, so that words sum to one.

Defined results: null and empty texts are one end token; a very long text is scored whole;
repeated rows count and score each; of equally frequent words the one with the smaller hash
comes first; a null id isn't held out; with no training texts every token is unknown; an
empty table gives an empty result; other columns, of any name, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import discard, staged

STATES = 8
FREQUENT = 2000
ENDINGS = 512
SEGMENT = 128
SLICE = 4096  # segments at once
BITS = 8  # of a word's share in a state
SHARE = (1 << BITS) - 1
PACKED = 64 // BITS  # shares in one number
PLACE_BITS = 26
ROUNDS = 5
SMOOTH = 0.1
SEED = 3
END = np.array([2**64 - 1], np.uint64)  # stands for a hash


class Model(NamedTuple):
    start: np.ndarray  # (states)
    step: np.ndarray  # (states, states)
    emit: np.ndarray  # (states, symbols)
    frequent: np.ndarray  # hashes of the frequent words, sorted
    symbol: np.ndarray  # their symbols
    ending_n: np.ndarray  # training tokens of each class
    ending_v: np.ndarray  # distinct training words of each class
    total: int  # training tokens
    distinct: int
    state_n: np.ndarray | None = None  # expected emissions of each state; None in the tied rounds
    frequent_c: np.ndarray | None = None  # training counts of the frequent words
    frequent_share: np.ndarray | None = None  # (frequent, states): their packed shares, unpacked

    @property
    def prior(self) -> float:
        return max(1.0, self.distinct / len(self.start))


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(10)) == 0, F.lit(False))


# ---------------------------------------------------------------- blocks

BLOCK = "ids array<long>, held array<boolean>, sizes array<int>, tokens binary, hashes array<long>, counts array<long>, endings array<smallint>"
BLOCK_BYTES = 4 << 20


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Blocks of whole texts: tokens as numbers of the block's own vocabulary, with its training counts. Staged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1)
        for rows, data, offsets in words.chunks(batches, "text", BLOCK_BYTES):
            data = words.LOWER[data]
            starts, ends, before = words.spans(data, offsets, words.NOT_SPACE)
            h = words.hashes(data, starts, ends)
            keys, first, local, often = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            # The most frequent words get the smallest numbers, which compress best.
            turn = np.argsort(-often, kind="stable")
            keys, first, local = keys[turn], first[turn], np.argsort(turn)[local]
            sizes = np.diff(before) + 1
            tokens = np.full(len(h) + len(rows), len(keys), np.uint32)  # the end is the last word
            tokens[np.arange(len(h)) + words.rows_of(before)] = local
            held = rows.column("held").to_numpy(zero_copy_only=False)
            counts = np.bincount(tokens[~np.repeat(held, sizes)], minlength=len(keys) + 1)
            s, e = starts[first], ends[first]
            del h, local, starts, ends
            tail = [np.where(e - s > j, data[np.maximum(e - 1 - j, 0)], 0).astype(np.int64) for j in range(3)]
            ending = np.append((tail[0] * 40_503 + tail[1] * 509 + tail[2] * 131) % ENDINGS, 0)
            one = lambda x, kind: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, kind) if not isinstance(x, pa.Array) else x)
            hashes = np.append(keys, END).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [one(rows.column("id"), None), one(held, pa.bool_()), one(sizes, pa.int32()), pa.array([pack.compress(np.ascontiguousarray(tokens.view(np.uint8).reshape(-1, 4).T).tobytes())]), one(hashes, pa.int64()), one(counts, pa.int64()), one(ending, pa.int16())],
                names=["ids", "held", "sizes", "tokens", "hashes", "counts", "endings"],
            )

    texts = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held"), F.col(text_col).alias("text"))
    # 15 bits for the blocks of a task, 22 for its number; a word of a block takes PLACE_BITS more.
    number = F.monotonically_increasing_id()
    return staged(texts.mapInArrow(run, BLOCK).withColumn("block", F.shiftleft(F.shiftright(number, 33), 15) + number.bitwiseAND((1 << 33) - 1)), "blocks")


def cells(batch: pa.RecordBatch, i: int) -> dict:
    """The lists of one row as numpy arrays (ids as Arrow, for its nulls), and its tokens."""
    out = {}
    for name, column in zip(batch.schema.names, batch.columns, strict=True):
        if name == "tokens":
            planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(column[i].as_py()), np.uint8)
            out[name] = np.ascontiguousarray(planes.reshape(4, -1).T).view(np.uint32).reshape(-1)
        else:
            flat = column.slice(i, 1).flatten()
            out[name] = flat if name == "ids" else flat.to_numpy(zero_copy_only=False)
    if "hashes" in out:
        out["hashes"] = out["hashes"].view(np.uint64)
    return out


def symbols_of(model: Model, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
    """The symbol of each word of a vocabulary."""
    out = len(model.frequent) + endings
    if len(model.frequent):
        at = np.minimum(np.searchsorted(model.frequent, hashes), len(model.frequent) - 1)
        out = np.where(model.frequent[at] == hashes, model.symbol[at], out)
    return out


# ---------------------------------------------------------------- training


def stationary(step: np.ndarray) -> np.ndarray:
    """Long-run shares of the states."""
    out = np.full(len(step), 1 / len(step))
    for _ in range(200):
        out = out @ step
    return out / out.sum()


def expected(model: Model, segments: np.ndarray, size: np.ndarray, first: np.ndarray | None = None, names: np.ndarray | None = None, n_names: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected starts, steps and emissions over segments (padded with any symbol), and their log likelihood.

    Segments are ordered by falling size, so at each place the live ones are a prefix. Those that
    aren't ``first`` in their text count no start. Emissions are counted by symbol, or by ``names``
    of the tokens.
    """
    n, length = segments.shape
    states = len(model.start)
    first = np.ones(n, bool) if first is None else first
    begin = np.where(first[:, None], model.start, stationary(model.step)).astype(np.float32)
    by_symbol, step = np.ascontiguousarray(model.emit.T.astype(np.float32)), model.step.astype(np.float32)
    live = np.searchsorted(-size, -np.arange(1, length + 1), "right")
    alpha, scale = np.zeros((length, n, states), np.float32), np.ones((length, n), np.float32)
    for t in range(length):
        m = live[t]
        a = (begin if t == 0 else alpha[t - 1, :m] @ step) * by_symbol[segments[:m, t]]
        scale[t, :m] = a.sum(1)
        alpha[t, :m] = a / scale[t, :m, None]
    steps, beta = np.zeros((states, states)), np.ones((n, states), np.float32)
    for t in range(length - 1, 0, -1):
        m = live[t]
        back = beta[:m] * by_symbol[segments[:m, t]] / scale[t, :m, None]
        steps += alpha[t - 1, :m].T @ back
        alpha[t, :m] *= beta[:m]  # now the state's probability
        beta[:m] = back @ step.T
    alpha[0] *= beta
    inside = np.arange(length)[None, :] < size[:, None]
    names, n_names = (segments, model.emit.shape[1]) if names is None else (names, n_names)
    flat, weights = names[inside], alpha.transpose(1, 0, 2)[inside]
    emits = np.stack([np.bincount(flat, weights[:, k], n_names) for k in range(states)])
    return alpha[0][first].sum(0).astype(float), steps * model.step, emits, float(np.log(scale[inside.T]).sum())


def cut_segments(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of the tokens, sizes, whether first in the text) of segments of consecutive texts, longest first."""
    many = -(-sizes // SEGMENT)
    text = np.repeat(np.arange(len(sizes)), many)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    begin = (np.cumsum(sizes) - sizes)[text] + nth * SEGMENT
    size = np.minimum(sizes[text] - nth * SEGMENT, SEGMENT)
    turn = np.argsort(-size, kind="stable")
    begin, size = begin[turn], size[turn]
    return np.minimum(begin[:, None] + np.arange(SEGMENT)[None, :], max(0, int(sizes.sum()) - 1)), size, nth[turn] == 0


def expected_in(model: Model, row: dict, by_word: bool = False) -> list[np.ndarray] | None:
    """Expected starts, steps, emissions (by symbol, or by word of the block) and log likelihood of a block's training texts."""
    held, sizes = row["held"].astype(bool), row["sizes"].astype(np.int64)
    if held.all():
        return None
    local = row["tokens"][~np.repeat(held, sizes)]
    symbols = symbols_of(model, row["hashes"], row["endings"])[local]
    places, size, first = cut_segments(sizes[~held])
    total = None
    for at in range(0, len(size), SLICE):
        p = slice(at, at + SLICE)
        names = (local[places[p]], len(row["hashes"])) if by_word else (None, 0)
        got = expected(model, symbols[places[p]], size[p], first[p], *names)
        if total is None:
            total = list(got)
        else:
            for x, y in zip(total[:3], got[:3], strict=True):
                x += y
            total[3] += got[3]
    return total


def counted(model: Model, blocks: DataFrame) -> np.ndarray:
    """Expected counts of all parameters over all training tokens: starts, steps, emissions, log likelihood."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for i in range(len(batch)):
                got = expected_in(model, cells(batch, i))
                if got:
                    flat = np.concatenate([np.ravel(x) for x in got])
                    total = flat if total is None else total + flat
        if total is not None:
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], names=["at", "value"])

    sums = blocks.select("held", "sizes", "tokens", "endings", "hashes").mapInArrow(run, "at int, value double").groupBy("at").agg(F.sum("value").alias("value"))
    k, s = model.emit.shape
    out = np.zeros(k + k * k + k * s + 1)
    for r in sums.collect():
        out[r["at"]] = r["value"]
    return out


def reestimated(model: Model, sums: np.ndarray, share: np.ndarray) -> Model:
    """The next parameters from expected counts; ``share`` of the symbols smooths emissions."""
    k, s = model.emit.shape
    start, step, emit = sums[:k] + 1, sums[k : k + k * k].reshape(k, k) + 1, sums[k + k * k : -1].reshape(k, s) + 10 * share
    return model._replace(start=start / start.sum(), step=step / step.sum(1, keepdims=True), emit=emit / emit.sum(1, keepdims=True))


def vocabulary_of(blocks: DataFrame) -> DataFrame:
    """(word, c, ending) for the training words, which are named by their hash. Staged."""
    each = blocks.select(F.explode(F.arrays_zip("hashes", "counts", "endings")).alias("w")).where("w.counts > 0")
    return staged(each.groupBy(F.col("w.hashes").alias("word")).agg(F.sum("w.counts").alias("c"), F.min("w.endings").alias("ending")), "vocabulary")


def fit(blocks: DataFrame, vocabulary: DataFrame, states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> Model:
    total, distinct = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = vocabulary.orderBy(F.desc("c"), "word").limit(FREQUENT).collect()
    endings_n, endings_v = np.zeros(ENDINGS), np.zeros(ENDINGS)
    for r in vocabulary.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("v")).collect():
        endings_n[r["ending"]], endings_v[r["ending"]] = r["c"], r["v"]
    for r in top:
        endings_n[r["ending"]] -= r["c"]
        endings_v[r["ending"]] -= 1
    hashes = np.array([r["word"] for r in top], np.int64).view(np.uint64)
    turn = np.argsort(hashes)
    share = np.concatenate([[r["c"] for r in top], endings_n + SMOOTH]) if top else endings_n + SMOOTH
    share = share / share.sum()
    rng = np.random.default_rng(seed)
    emit = share * np.exp(rng.normal(0, 0.7, (states, len(share))))
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)), emit / emit.sum(1, keepdims=True), hashes[turn], turn, endings_n, endings_v, int(total), int(distinct))
    model = model._replace(step=model.step / model.step.sum(1, keepdims=True))
    for _ in range(rounds if total else 0):
        model = reestimated(model, counted(model, blocks), share)
    return model


def packed_shares(shares: np.ndarray) -> list[np.ndarray]:
    """Shares (words, states) in ``BITS`` bits each, several states in one 64-bit number."""
    q = np.rint(shares * SHARE).astype(np.int64)
    parts = np.zeros((len(q), -(-q.shape[1] // PACKED)), np.int64)
    for k in range(q.shape[1]):
        parts[:, k // PACKED] |= q[:, k] << BITS * (k % PACKED)
    return list(parts.T)


def unpacked_shares(parts: list[np.ndarray], states: int) -> np.ndarray:
    return np.stack([(parts[k // PACKED] >> BITS * (k % PACKED) & SHARE) for k in range(states)], 1) / SHARE


def emissions(model: Model, blocks: DataFrame) -> DataFrame:
    """(word, c, s0, s1...): the count of every training word and its packed shares in the states. Staged."""
    states = len(model.start)
    parts = [f"s{i}" for i in range(-(-states // PACKED))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = cells(batch, i)
                got = expected_in(model, row, by_word=True)
                if got:
                    live = np.flatnonzero(row["counts"])
                    by_state = got[2].T[live]
                    columns = [row["hashes"][live].view(np.int64), row["counts"][live], *packed_shares(by_state / by_state.sum(1, keepdims=True))]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["word", "c", *parts])

    each = blocks.select("held", "sizes", "tokens", "endings", "hashes", "counts").mapInArrow(run, ", ".join(f"{n} long" for n in ("word", "c", *parts)))
    share = lambda k: F.shiftright(F.col(parts[k // PACKED]), BITS * (k % PACKED)).bitwiseAND(F.lit(SHARE))
    # Whole numbers, so the order of the sums doesn't matter.
    sums = each.groupBy("word").agg(F.sum("c").alias("c"), *[F.sum(F.col("c") * share(k)).alias(f"e{k}") for k in range(states)])

    def pack(i: int) -> Column:
        out = F.lit(0).cast("long")
        for k in range(PACKED * i, min(PACKED * (i + 1), states)):
            out = out.bitwiseOR(F.shiftleft(F.round(F.col(f"e{k}") / F.col("c")).cast("long"), BITS * (k % PACKED)))
        return out

    return staged(sums.select("word", "c", *[pack(i).alias(n) for i, n in enumerate(parts)]), "emissions")


def with_words(model: Model, table: DataFrame) -> Model:
    """The model with the states' totals over the table of words, and the frequent words' own rows."""
    states, parts = len(model.start), table.columns[2:]
    share = lambda k: F.shiftright(F.col(parts[k // PACKED]), BITS * (k % PACKED)).bitwiseAND(F.lit(SHARE))
    sums = table.agg(*[F.coalesce(F.sum((F.col("c") * share(k)).cast("decimal(38,0)")), F.lit(0)) for k in range(states)]).first()
    rows = table.join(F.broadcast(frequent_words(table, model)), "word").collect()  # the frequent words alone
    at = {h: i for i, h in enumerate(model.frequent.view(np.int64).tolist())}
    c, q = np.zeros(len(at)), [np.zeros(len(at), np.int64) for _ in parts]
    for r in rows:
        c[at[r["word"]]] = r["c"]
        for part, name in zip(q, parts, strict=True):
            part[at[r["word"]]] = r[name]
    return model._replace(state_n=np.array([float(x) for x in sums]) / SHARE, frequent_c=c, frequent_share=unpacked_shares(q, states))


def frequent_words(table: DataFrame, model: Model) -> DataFrame:
    return table.sparkSession.createDataFrame([(x,) for x in model.frequent.view(np.int64).tolist()], "word long")


# ---------------------------------------------------------------- scoring


def log_forward(model: Model, emits: np.ndarray, tokens: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Log10 likelihood of each text by the scaled forward recursion; ``emits`` has a row of the states' probabilities for each token."""
    order = np.argsort(-sizes, kind="stable")
    begin, longest = (np.cumsum(sizes) - sizes)[order], int(sizes.max(initial=0))
    live = np.searchsorted(-sizes[order], -np.arange(1, longest + 1), "right")
    alpha, out = np.tile(model.start, (len(sizes), 1)), np.zeros(len(sizes))
    for t in range(longest):
        m = live[t]
        a = (alpha[:m] if t == 0 else alpha[:m] @ model.step) * emits[tokens[begin[:m] + t]]
        total = a.sum(1)
        out[:m] += np.log10(total)
        alpha = a / total[:, None]
    result = np.empty(len(sizes))
    result[order] = out
    return result


SCORES = "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def word_rows(model: Model, row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Training counts and states' shares of a block's words, from the model and the rows joined to the block."""
    c, share = np.zeros(len(row["hashes"])), np.zeros((len(row["hashes"]), len(model.start)))
    c[row["at"]] = row["c"]
    share[row["at"]] = unpacked_shares([row[f"s{i}"] for i in range(-(-len(model.start) // PACKED))], len(model.start))
    if len(model.frequent):
        near = np.minimum(np.searchsorted(model.frequent, row["hashes"]), len(model.frequent) - 1)
        own = model.frequent[near] == row["hashes"]
        c[own], share[own] = model.frequent_c[near[own]], model.frequent_share[near[own]]
    return c, share


def emits_of(model: Model, c: np.ndarray, share: np.ndarray, hashes: np.ndarray, endings: np.ndarray) -> np.ndarray:
    """(words, states): the probability of each word in each state."""
    symbols = symbols_of(model, hashes, endings)
    inside = (c + SMOOTH) / (model.ending_n[endings] + SMOOTH * (model.ending_v[endings] + 1))
    out = model.emit.T[symbols]
    out *= (np.where(symbols < len(model.frequent), 1.0, inside) * model.prior)[:, None]
    out += share * c[:, None]
    out /= model.state_n + model.prior
    return out


def scored_block(model: Model, row: dict) -> list[np.ndarray]:
    sizes, local = row["sizes"].astype(np.int64), row["tokens"]
    c, share = word_rows(model, row)
    base = np.log10((c + SMOOTH) / (model.total + SMOOTH * (model.distinct + 1)))
    cut = np.cumsum(sizes) - sizes
    by_text = lambda x: np.add.reduceat(x[local], cut) if len(cut) else np.zeros(0)
    return [sizes, by_text((c > 0).astype(np.int64)), by_text(base), log_forward(model, emits_of(model, c, share, row["hashes"], row["endings"]), local, sizes)]


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", states: int = STATES, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """One row for each row of ``docs``: id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    blocks = packed(docs, id_col, text_col)
    vocabulary = vocabulary_of(blocks)
    model = fit(blocks, vocabulary, states, rounds, seed)
    discard(docs.sparkSession, vocabulary)
    table = emissions(model, blocks)
    model = with_words(model, table)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = cells(batch, i)
                n, known, base, score = scored_block(model, row)
                yield pa.RecordBatch.from_arrays(
                    [row["ids"], pa.array(row["held"].astype(bool)), pa.array(n), pa.array(known), pa.array(np.full(len(n), model.total)), pa.array(base), pa.array(score)],
                    names=[c.split()[0] for c in SCORES.split(", ")],
                )

    lists = ["at", *table.columns[1:]]
    # Where a word stands: the block's number (part and place in it) and the word's in the block, as one number.
    at = F.shiftleft(F.col("block"), PLACE_BITS) + F.col("at")
    each = blocks.select("block", F.posexplode("hashes").alias("at", "word")).select("word", at.alias("where"))
    each = each.join(F.broadcast(frequent_words(table, model)), "word", "left_anti")
    # One row for each word of a block: bounded by the block's text.
    place = [F.shiftright("where", PLACE_BITS).alias("block"), F.col("where").bitwiseAND((1 << PLACE_BITS) - 1).cast("int").alias("at")]
    known = each.join(table, "word").select(*place, *table.columns[1:]).groupBy("block").agg(*[F.collect_list(x).alias(x) for x in lists])
    ready = blocks.drop("counts").join(known, "block", "left").withColumns({x: F.coalesce(x, F.array().cast(f"array<{'int' if x == 'at' else 'long'}>")) for x in lists})
    return ready.drop("block").mapInArrow(run, SCORES).withColumnRenamed("id", id_col)
