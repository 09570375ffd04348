"""The word kernel against Python's own splitting."""

import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestone.llm import words

TEXTS = ["", None, "a", " a  bc ", "A,b;C9é", "x" * 3000 + " y", "über\tstraße\n", "a" * 8 + " " + "a" * 9, " "]


def cut(texts, letters):
    data, offsets = words.buffer_of(pa.array(texts, pa.string()))
    data = words.LOWER[data]
    starts, ends, before = words.spans(data, offsets, letters)
    return data, starts, ends, before


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aB 9\n,é", max_size=30)), max_size=8))
def test_words_equal_the_regular_expression(texts):
    for letters, pattern in ((words.ALNUM, rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), (words.NOT_SPACE, rb"[^\x20\x09-\x0D]+")):
        data, starts, ends, before = cut(texts, letters)
        for i, t in enumerate(texts):
            want = re.findall(pattern, (t or "").encode().lower())
            assert [data[s:e].tobytes() for s, e in zip(starts[before[i] : before[i + 1]], ends[before[i] : before[i + 1]], strict=True)] == want


def test_hashes_depend_on_the_bytes_alone():
    data, starts, ends, _ = cut(TEXTS + TEXTS, words.NOT_SPACE)
    h, spelled = words.hashes(data, starts, ends), [data[s:e].tobytes() for s, e in zip(starts, ends, strict=True)]
    assert len(set(h.tolist())) == len(set(spelled)) and len({*zip(spelled, h.tolist(), strict=True)}) == len(set(spelled))


def test_chunks_hold_whole_texts():
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["abc", None, "defgh" * 10, "", "xy"]), "n": [0, 1, 2, 3, 4]})
    parts = list(words.chunks([batch.slice(1, 4)], "text", 10))
    assert [n for p in parts for n in p.rows.column("n").to_pylist()] == [1, 2, 3, 4]
    assert [p.data[a:b].tobytes() for p in parts for a, b in zip(p.offsets[:-1], p.offsets[1:], strict=True)] == [b"", b"defgh" * 10, b"", b"xy"]


def test_gather():
    data, starts, ends, _ = cut(["ab c", "def"], words.NOT_SPACE)
    assert words.gather(data, starts[np.array([2, 0])], ends[np.array([2, 0])]).to_pylist() == [b"def", b"ab"]
