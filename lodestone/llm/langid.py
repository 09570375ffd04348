"""Language identification with a byte convolutional network in numpy.

Filters of several widths slide over the raw bytes of a window; a filter's response is the
sum of one learned number for each byte under it, so a convolution is a table lookup. The
largest response of each filter in the window, after a rectifier, feeds a softmax layer.
A text's probabilities are the mean over all its windows, weighted by their bytes.

Training runs in numpy on the driver over a bounded sample: about ``PER_LANGUAGE`` texts of
each language, fewer where there are so many languages that they would exceed ``SAMPLE_TEXTS``
in all, chosen by a seeded hash of the id, and ``WINDOWS_PER_TEXT`` windows at hashed places of
each. Prediction reads every byte of every text, without a shuffle.

Defined results: a text that is null or has no letter is ``und`` with score 0; texts with a
null language are predicted but never learned from; with nothing to learn from (an empty
table, no labels), all texts are ``und``; a very long text is read in windows, all of it; of
languages with equal probability the first by name is taken; repeated rows and null ids are
predicted like any other row; columns of any name can be kept, but for those that are named
like a result, which give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import words

WIDTHS = (2, 3, 4)
FILTERS = 16
WINDOW = 256
PER_LANGUAGE = 1500
SAMPLE_TEXTS = 200_000
WINDOWS_PER_TEXT = 2
EPOCHS = 6
LEAST_STEPS = 600  # a small sample is gone over more often
SEED = 5
UNKNOWN = "und"


class Model(NamedTuple):
    languages: list[str]
    filters: list[np.ndarray]  # for each width: (width, 256, FILTERS)
    bias: np.ndarray  # (widths x FILTERS)
    weights: np.ndarray  # (widths x FILTERS, languages)
    offset: np.ndarray  # (languages)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fixed-length windows padded with zeros, the row of each, and the bytes in it."""
    size = np.diff(offsets)
    many = -(-size // WINDOW)
    row = np.repeat(np.arange(len(size)), many)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    start = offsets[row] + nth * WINDOW
    held = np.minimum(offsets[row + 1] - start, WINDOW)
    out = np.zeros((len(row), WINDOW), np.uint8)
    full = held == WINDOW
    view = np.lib.stride_tricks.sliding_window_view(data, WINDOW) if len(data) >= WINDOW else None
    if full.any():
        out[full] = view[start[full]]
    for i in np.flatnonzero(~full):
        out[i, : held[i]] = data[start[i] : start[i] + held[i]]
    return out, row, held


def largest_responses(filters: list[np.ndarray], bias: np.ndarray, windows: np.ndarray) -> np.ndarray:
    """(windows, widths x FILTERS): the rectified largest response of each filter."""
    out = []
    pairs = [f[0][:, None, :] + f[1][None, :, :] for f in filters]
    pairs = [p.reshape(65536, -1) for p in pairs]
    later = [(f[2][:, None, :] + f[3][None, :, :]).reshape(65536, -1) if len(f) == 4 else f[2] if len(f) == 3 else None for f in filters]
    for at in range(0, len(windows), 256):
        b = windows[at : at + 256].astype(np.int32)
        two, parts = b[:, :-1] << 8 | b[:, 1:], []
        for f, first, rest in zip(filters, pairs, later, strict=True):
            n = WINDOW - len(f) + 1
            x = first[two[:, :n]]
            if len(f) == 3:
                x += rest[b[:, 2:]]
            elif len(f) == 4:
                x += rest[two[:, 2 : 2 + n]]
            while x.shape[1] > 1:
                half = x.shape[1] // 2
                x = np.concatenate([np.maximum(x[:, :half], x[:, half : 2 * half]), x[:, 2 * half :]], 1) if x.shape[1] % 2 else np.maximum(x[:, :half], x[:, half:])
            parts.append(x[:, 0])
        out.append(np.maximum(np.concatenate(parts, 1) + bias, 0))
    return np.concatenate(out) if out else np.zeros((0, len(bias)), np.float32)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """Fit filters and the softmax layer by Adam on the cross entropy."""
    rng = np.random.default_rng(seed)
    filters = [rng.normal(0, 0.3, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    model = [*filters, np.zeros(len(WIDTHS) * FILTERS, np.float32), rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    first, second, step = [np.zeros_like(p) for p in model], [np.zeros_like(p) for p in model], 0
    batches = max(1, len(windows) // 64)
    epochs = max(epochs, -(-LEAST_STEPS // batches))
    for epoch in range(epochs):
        for part in np.array_split(rng.permutation(len(windows)), batches):
            b, y, grads, top, where = windows[part], labels[part], [np.zeros_like(p) for p in model], [], []
            for f in model[: len(WIDTHS)]:
                x = sum(f[j][b[:, j : WINDOW - len(f) + 1 + j]] for j in range(len(f)))
                where.append(x.argmax(1))
                top.append(np.take_along_axis(x, where[-1][:, None], 1)[:, 0])
            raw = np.concatenate(top, 1) + model[-3]
            act = np.maximum(raw, 0)
            p = softmax(act @ model[-2] + model[-1])
            p[np.arange(len(y)), y] -= 1
            p /= len(y)
            grads[-2], grads[-1] = act.T @ p, p.sum(0)
            back = (p @ model[-2].T) * (raw > 0)
            grads[-3] = back.sum(0)
            for i, w in enumerate(where):
                g = back[:, i * FILTERS : (i + 1) * FILTERS]
                for j in range(WIDTHS[i]):
                    byte = np.take_along_axis(b, w + j, 1)
                    np.add.at(grads[i][j], (byte, np.arange(FILTERS)[None, :]), g)
            step += 1
            rate = 0.01 * (1 - epoch / epochs)
            for k, g in enumerate(grads):
                first[k] += 0.1 * (g - first[k])
                second[k] += 0.001 * (g * g - second[k])
                model[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return Model(languages, model[: len(WIDTHS)], model[-3], model[-2], model[-1])


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, mod 4, is 2. A null id isn't held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = PER_LANGUAGE, seed: int = SEED) -> Model:
    known = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & (F.length(text_col) > 0))
    counts = known.groupBy(F.col(lang_col).alias("lang")).count().collect()
    languages = sorted(r["lang"] for r in counts)
    if not languages:
        return Model([], [], np.zeros(0), np.zeros((0, 0)), np.zeros(0))
    per_language = min(per_language, max(1, SAMPLE_TEXTS // len(languages)))
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(1.0, per_language / r["count"])))])
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), id_col), 11) / float(1 << 53)
    place = lambda i: F.lit(1) + F.pmod(F.xxhash64(F.lit(seed + i), id_col), F.greatest(F.lit(1), F.length(text_col) - WINDOW // 2)).cast("int")
    cut = F.array(*[F.substring(F.col(text_col), place(i), F.lit(WINDOW)) for i in range(1, WINDOWS_PER_TEXT + 1)])
    sample = known.where(chance < share[F.col(lang_col)]).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), cut.alias("parts")).collect()
    sample.sort(key=lambda r: (r["id"] is None, r["id"], r["lang"]))
    texts = [p.encode()[:WINDOW] for r in sample for p in r["parts"]]
    windows = np.frombuffer(b"".join(t.ljust(WINDOW, b"\0") for t in texts), np.uint8).reshape(-1, WINDOW)
    at = {x: i for i, x in enumerate(languages)}
    return train(windows, np.array([at[r["lang"]] for r in sample for _ in r["parts"]]), languages, seed=seed)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    plain = np.zeros(256, np.int64)
    plain[65:91] = plain[97:123] = 1
    here = np.concatenate([[0], np.cumsum(plain[data[:-8]])])
    out = here[offsets[1:]] > here[offsets[:-1]]
    for i in np.flatnonzero(~out & (np.diff(offsets) > 0)):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with lang_pred and score (the mean probability of that language)."""
    # Inside, columns are named by place, so that none clashes.
    keep = tuple(c for c in keep if c not in ("lang_pred", "score"))
    kept = [f"k{i}" for i in range(len(keep))]
    plan = docs.select(*[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(text_col).alias("text"))
    result = StructType([*plan.select(*kept).schema.fields]).add("lang_pred", "string").add("score", "double")
    schema = to_arrow_schema(result)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*model.languages, UNKNOWN], object)
        for rows, data, offsets in words.chunks(batches, "text"):
            best, score = np.full(len(rows), len(model.languages)), np.zeros(len(rows))
            known = has_letter(data, offsets)
            if model.languages and known.any():
                windows, row, held = windows_of(data, offsets)
                p = softmax(largest_responses(model.filters, model.bias, windows) @ model.weights + model.offset)
                total = np.stack([np.bincount(row, p[:, j] * held, len(rows)) for j in range(len(model.languages))], 1)
                total = total[known] / np.bincount(row, held, len(rows))[known, None]
                best[known], score[known] = total.argmax(1), np.minimum(total.max(1), 1.0)
            columns = [rows.column(k) for k in kept] + [pa.array(names[best], pa.string()), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return plan.mapInArrow(run, result).toDF(*keep, "lang_pred", "score")
