"""What scoring a chunk takes of memory, and what finished passes leave on the shared disk."""

import os
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fidelis.llm import suffix_lm as s
from fidelis.llm._util import shared_dir


def chunk_rows(rows, texts, words):
    """A chunk of rows of texts, whose words are each after the one before, and what it is told of pairs."""
    y = np.tile(np.arange(words) + 1, texts * 100)
    lengths, flags = np.full(texts, 100 * words), np.ones(texts, np.int64)
    for i in range(rows):
        yield {"kind": 2, "a": [s.pack(y)], "b": s.pack(lengths), "c": s.pack(flags), "ids": [*range(i * texts, (i + 1) * texts)]}
    yield {"kind": 3, "a": [*s.pack_runs([np.arange(words)]), s.pack(np.full(words, 100))]}
    one, two = [np.arange(words)], [np.arange(words - 1), np.arange(1, words)]
    yield {"kind": 0, "level": 1, "a": s.pack_runs(one), "b": s.pack(0 * one[0]), "c": s.pack(0 * one[0] + 100), "d": s.pack(np.full(words, 0.25, np.float32))}
    yield {"kind": 0, "level": 2, "a": s.pack_runs(two), "b": s.pack(0 * two[0] + 80), "c": s.pack(0 * two[0]), "d": s.pack(np.full(words - 1, np.nan, np.float32))}


def test_a_chunk_is_scored_within_few_bytes_a_token():
    rows, texts, words = 16, 10, 100
    n, whole = rows * texts * words * 100, 1e6
    tracemalloc.start()
    chunk = s._Chunk(chunk_rows(rows, texts, words))
    gains = s._gains(chunk, whole, 5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * n
    root = 100.1 / whole
    after, last = np.log10((0.25 * root + (80 - s.DISCOUNT) / 100) / root), np.log10(0.25)  # of the word after; of the first, after the last
    assert len(gains) == rows * texts
    assert gains == pytest.approx(np.full(rows * texts, 100 * (words - 1) * after + 99 * last))


def test_counts_by_shares():
    key = np.random.default_rng(1).integers(0, 5000, 40_000)
    train = key % 3 > 0
    of, known, n = s._counted(key, train)
    assert np.array_equal(known[of], key) and len(set(known.tolist())) == len(known)
    assert n.tolist() == [int(train[key == k].sum()) for k in known]


def test_tables_go_with_their_last_reader(spark):
    at = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(at))
    words = [f"w{i % 7} x{i % 5} y{i % 3}" for i in range(40)]
    got = s.score(spark.createDataFrame([(i, " ".join(words[: 1 + i % 40])) for i in range(80)], "doc_id long, text string"), F.lit(True))
    held = {p.split("-")[1]: sum(f.endswith(".parquet") for _, _, files in os.walk(f"{at}/{p}") for f in files) for p in set(os.listdir(at)) - before}
    assert {name for name, files in held.items() if files > 0} == {"pairs", "said"}
    assert got.count() == 80
