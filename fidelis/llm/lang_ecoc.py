"""Language identification by error-correcting output codes.

Every language gets a codeword of bits that lies far from the others. One binary logistic classifier
over hashed byte n-grams (orders 1 to 3, lower-cased) predicts each bit; decoding sums every bit's
logistic loss, weighted by the bit's training accuracy, and chooses the codeword of least loss. A text
whose two best codewords lie close is flagged ambiguous.

Fitting takes at most about `per_lang` training rows of each language and `ROWS` of all (chosen by a hash of the id and
the text, so alike at every size); everything is predicted on whole texts.

Defined results: null text, or one without a letter, gets `und`, score 0 and ambiguous; with one
learned language all else gets it; with none, everything is `und`; extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.llm._util import slices, trimmed

#: Hashed n-gram buckets, training rows of each language and of all at most (in expectation).
BUCKETS, PER_LANG, ROWS = 1 << 13, 600, 8000
#: Two best codewords whose probabilities differ by less are ambiguous.
MARGIN = 0.2
_LOWER = np.arange(256, dtype=np.uint32)
_LOWER[65:91] += 32
_BLOCK = 1 << 20


def grams(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Square roots of the n-gram shares of the whole text, counted block by block."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    total = np.zeros(buckets, np.float64)
    shift = np.uint32(32 - int(buckets).bit_length() + 1)
    for at in range(0, len(raw), _BLOCK):
        b = _LOWER[raw[max(0, at - 2) : at + _BLOCK]]
        new = min(at, 2)  # bytes of the block before: their own grams are counted already
        for n in (1, 2, 3):
            if len(b) < n:
                continue
            h = b[n - 1 :].copy()
            for k in range(1, n):
                h += b[n - 1 - k : len(b) - k] << np.uint32(8 * k)
            h = h[max(0, new - n + 1) :] + np.uint32(n << 24)
            h = (h * np.uint32(2654435761)) ^ (h >> np.uint32(15))
            total += np.bincount((h * np.uint32(2246822519)) >> shift, minlength=buckets)
    n = total.sum()
    return np.sqrt(total / n).astype(np.float32) if n else total.astype(np.float32)


def codewords(langs: int, seed: int = 7) -> np.ndarray:
    """langs x bits of 0 and 1: all splits of up to 5 languages, beyond that the best of random codes."""
    if langs < 2:
        return np.zeros((langs, 0), np.int8)
    if langs <= 5:
        bits = range(1, 1 << (langs - 1))
        return np.array([[(b >> i) & 1 if i < langs - 1 else 0 for b in bits] for i in range(langs)], np.int8)
    rng, bits = np.random.default_rng(seed), int(np.ceil(10 * np.log2(langs)))
    best, far = None, -1
    for _ in range(300):
        code = rng.integers(0, 2, (langs, bits)).astype(np.int8)
        gap = (code[:, None] != code[None]).sum(2) + bits * np.eye(langs, dtype=int)
        split = code.sum(0)
        if gap.min() > far and split.min() > 0 and split.max() < langs:
            best, far = code, gap.min()
    return best


def fit_bits(x: np.ndarray, y: np.ndarray, code: np.ndarray, rounds: int = 300, decay: float = 2e-5) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic classifiers of all bits at once (accelerated gradient); each bit's weight is its training accuracy above chance."""
    want = code[y].astype(np.float32)
    share = np.bincount(y, minlength=len(code)).astype(np.float64)
    row = (1 / share[y] / len(code)).astype(np.float32)[:, None]
    w = np.zeros((x.shape[1], code.shape[1]), np.float32)
    b = np.zeros(code.shape[1], np.float32)
    pw, pb, step = w.copy(), b.copy(), np.float32(16.0)
    for t in range(rounds):
        m = np.float32(t / (t + 3))
        vw, vb = w + m * (w - pw), b + m * (b - pb)
        e = (1 / (1 + np.exp(-(x @ vw + vb))) - want) * row
        pw, pb = w, b
        w, b = vw - step * (x.T @ e + decay * vw), vb - step * e.sum(0) * np.float32(0.2)
    right = (((x @ w + b) > 0) == (want > 0.5)) * row
    return w, b, np.maximum(2 * right.sum(0) - 1, 0.05)


def decode(margins: np.ndarray, code: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probabilities of the codewords: softmax of the weighted logistic losses."""
    sign = 2.0 * code - 1
    loss = (np.logaddexp(0, -margins[:, None, :] * sign[None]) * weight).sum(2)
    scaled = -loss * (2 / max(weight.sum(), 1e-9)) * code.shape[1] / 2
    p = np.exp(scaled - scaled.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


class Model:
    """Languages, code, classifiers; small: buckets x bits numbers."""

    def __init__(self, langs: list[str], code=None, w=None, b=None, weight=None):
        self.langs, self.code, self.w, self.b, self.weight = langs, code, w, b, weight

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.langs or not any(map(str.isalpha, text)):
            return "und", 0.0, True
        if len(self.langs) == 1:
            return self.langs[0], 1.0, False
        p = decode((grams(text) @ self.w + self.b)[None].astype(np.float64), self.code, self.weight)[0]
        first, second = np.argsort(-p, kind="stable")[:2]
        return self.langs[first], float(p[first]), bool(p[first] - p[second] < MARGIN)


def fit(df: DataFrame, train: Column, text: str = "text", lang: str = "lang", key: str = "doc_id", per_lang: int = PER_LANG) -> Model:
    """Learns from rows where train holds, text has characters and lang is not null."""
    rows = df.where(train & F.col(lang).isNotNull() & (F.length(F.col(text)) > 0))
    counts = {r[0]: r[1] for r in df.where(train & F.col(lang).isNotNull()).groupBy(lang).count().collect()}
    if not counts:
        return Model([])
    pick, base, per_lang = F.lit(False), 1 << 30, max(1, min(per_lang, ROWS // len(counts)))
    for name, n in counts.items():
        pick = pick | ((F.col(lang) == name) & (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("lang")), F.lit(base)) < min(base, base * per_lang // n)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, t in ((str(n), t.as_py()) for n, t in zip(batch.column(0), batch.column(1), strict=True)):
                x = grams(t)
                at = np.flatnonzero(x).astype(np.uint16)
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([at.tobytes()]), pa.array([x[at].tobytes()])], names=["lang", "at", "x"])

    got = rows.where(pick).select(F.col(lang).cast("string"), F.col(text)).mapInArrow(features, "lang string, at binary, x binary").collect()
    got = sorted(got, key=lambda r: (r.lang, bytes(r.at), bytes(r.x)))
    langs = sorted({r.lang for r in got})
    if len(langs) < 2:
        return Model(langs)
    x, y = np.zeros((len(got), BUCKETS), np.float32), np.array([langs.index(r.lang) for r in got])
    for i, r in enumerate(got):
        x[i, np.frombuffer(r.at, np.uint16)] = np.frombuffer(r.x, np.float32)
    code = codewords(len(langs))
    return Model(langs, code, *fit_bits(x, y, code))


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds lang_pred, score (0 to 1) and ambiguous."""
    sent = df.sparkSession.sparkContext.broadcast((model.langs, model.code, model.w, model.b, model.weight))
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())]
    names = {f.name for f in added}
    keep = [f for f in df.schema.fields if f.name not in names]

    place = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*sent.value)
        for batch in (part for whole in batches for part in slices(whole, place)):
            out = [m.predict(t) for t in batch.column(place).to_pylist()]
            new = [pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.float64()), pa.array([o[2] for o in out], pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + new, names=[f.name for f in keep] + [f.name for f in added])

    return df.mapInArrow(lambda batches: trimmed(run(batches)), T.StructType(keep + added))
