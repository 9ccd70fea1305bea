"""Toxicity by compression distance.

Two zstandard dictionaries are made from labelled text. The ordinary one is trained on ordinary words.
The toxic one adds the byte runs that toxic texts repeat and ordinary texts lack (evidence), laid out as
raw content because the trainer drops rare runs; the ordinary one gets the same bytes reversed instead,
so both are equally long. A text is cut into windows at word ends; the gain of a window is what the toxic
dictionary saves over the ordinary one. Windows of some gain are looked at again word by word, each word
(of a long one the best of its overlapping pieces) after one fixed context. Text without spaces is cut into
windows that overlap. A logistic model over the counts of gains gives the score; its intercept is set
so that the best threshold on all labelled training rows falls on 0.3.

Dictionaries and weights are fitted on at most about `toxic_rows` and `other_rows` labelled rows (by hash of
the id) of up to `LONGEST` characters. The threshold is chosen from all labelled rows of any length, scored in
Spark (those of the sample by dictionaries of its other half) and counted by label in bins of `BIN`. Scoring
reads whole texts, window by window.

Defined results: null and empty texts score like a text without windows; without labelled rows of both
kinds every score is 0; several labels of a document count as toxic if one is; extra columns stay.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

THRESHOLD = 0.3
TOXIC_ROWS, OTHER_ROWS, LONGEST = 1500, 3500, 100_000
#: Bytes of a window before its last word ends (also of a word's piece, and of the overlap of cuts inside words), of an evidence run at least, of the ordinary dictionary.
WINDOW, GRAM, ORDINARY = 64, 5, 16384
#: Words that the ordinary dictionary is trained on at most, from all texts of the sample alike.
TRAINED = 1_200_000
#: Width of the bins in which labelled rows are counted for the threshold, labelled ids broadcast at most.
BIN, SENT = 0.01, 1_000_000
#: Word gains kept in a worker at most.
KEPT = 200_000
_WORD = re.compile(rb"[a-z\x80-\xff]+")


def words(low: bytes) -> list[bytes]:
    return [b" " + w + b" " for w in _WORD.findall(low)]


def windows(low: bytes) -> Iterator[bytes]:
    at, n = 0, len(low)
    while at < n:
        end = low.find(b" ", at + WINDOW)
        end = n if end < 0 else end
        inside = end > at + 4 * WINDOW
        end = min(end, at + 4 * WINDOW)
        yield low[at : end + 1]
        at = end - WINDOW * inside if end > at else end + 1


def compressor(content: bytes):
    params = zstd.ZstdCompressionParameters(
        format=zstd.FORMAT_ZSTD1_MAGICLESS, write_content_size=0, write_checksum=0, write_dict_id=0, strategy=zstd.STRATEGY_BTLAZY2,
        min_match=GRAM, window_log=17, hash_log=15, chain_log=16, search_log=6, target_length=64,
    )
    return zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(content, dict_type=zstd.DICT_TYPE_RAWCONTENT), compression_params=params).compress


def evidence(toxic: list[bytes], other: list[bytes]) -> bytes:
    """Runs of grams inside words that toxic texts hold far more often than ordinary ones, weakest first."""
    in_toxic, in_other = Counter(), Counter()
    for texts, count in ((toxic, in_toxic), (other, in_other)):
        for t in texts:
            count.update({w[i : i + GRAM] for w in set(words(t)) for i in range(len(w) - GRAM + 1)})
    least = max(3, 0.004 * len(toxic))
    new = {g for g, n in in_toxic.items() if n >= least and n / len(toxic) >= 20 * (in_other[g] + 0.5) / len(other)}
    runs: Counter[bytes] = Counter()
    for t in toxic:
        here = set()
        for w in set(words(t)):
            start = None
            for i in range(len(w) - GRAM + 2):
                fits = w[i : i + GRAM] in new and i <= len(w) - GRAM
                if fits and start is None:
                    start = i
                elif not fits and start is not None:
                    here.add(w[start : i - 1 + GRAM])
                    start = None
        runs.update(here)
    out = b""
    for run, n in sorted(runs.items(), key=lambda x: (-x[1], x[0])):
        if n >= least and run not in out and len(out) < ORDINARY:
            out = run + out
    return out


def ordinary_content(other: list[bytes]) -> bytes:
    samples = [w for t in other for w in dict.fromkeys(words(t))]
    samples = samples[:: -(-len(samples) // TRAINED) or 1]
    samples = [b"".join(samples[i : i + 8]) for i in range(0, len(samples), 8)]
    try:
        return zstd.train_dictionary(ORDINARY, samples, k=16, d=6).as_bytes()
    except (zstd.ZstdError, ValueError):  # too little text to train on
        return b"".join(samples)[-ORDINARY:]


class Gains:
    """Counts of gains of a text's windows and words."""

    SIZE = 13

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.toxic = compressor(ordinary + toxic[::-1]), compressor(ordinary + toxic)
        self.context, self.known = ordinary[-96:-32], {}

    def word(self, w: bytes) -> int:
        got = self.known.get(w)
        if got is None:
            if len(self.known) > KEPT:
                self.known.clear()
            pieces = [w[i : i + WINDOW] for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]
            got = self.known[w] = max(len(self.plain(x)) - len(self.toxic(x)) for x in (self.context + p for p in pieces))
        return got

    def of(self, text: str | None) -> np.ndarray:
        low = (text or "").lower().encode("utf-8", "replace")
        out, n, plain, toxic = np.zeros(self.SIZE), 0, self.plain, self.toxic
        for x in windows(low):
            n += 1
            gain = len(plain(x)) - len(toxic(x))
            if gain > 0:
                out[min(gain, 6) - 1] += 1
                for w in words(x):
                    if (g := self.word(w)) > 0:
                        out[5 + min(g, 6)] += 1
        out[:6], out[6:12] = out[:6][::-1].cumsum()[::-1], out[6:12][::-1].cumsum()[::-1]
        out[12] = n
        return np.log1p(out)


def logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-3) -> np.ndarray:
    """Newton's method on standardised columns; the last weight is the intercept on raw columns."""
    mean, sd = x.mean(0), x.std(0) + 1e-9
    z = np.c_[(x - mean) / sd, np.ones(len(x))]
    w, ridge = np.zeros(z.shape[1]), decay * len(x) * np.r_[np.ones(x.shape[1]), 1e-6]
    for _ in range(40):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge + 1e-9), z.T @ (p - y) + ridge * w)
        w -= step
        if abs(step).max() < 1e-8:
            break
    return np.r_[w[:-1] / sd, w[-1] - (w[:-1] * mean / sd).sum()]


def fit(df: DataFrame, labels: DataFrame, train: Column, text: str = "text", key: str = "doc_id", label: str = "toxic", toxic_rows: int = TOXIC_ROWS, other_rows: int = OTHER_ROWS):
    """(ordinary content, toxic content, weights), or None without rows of both kinds."""
    one = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).alias("_y")).where(train)
    counts = {r[0]: r[1] for r in one.groupBy("_y").count().collect()}
    if not counts.get(1) or not counts.get(0):
        return None
    base = 1 << 30
    share = {y: min(base, base * rows // counts[y]) for y, rows in ((1, toxic_rows), (0, other_rows))}
    draw = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("toxic")), F.lit(base))
    some = one.where(((F.col("_y") == 1) & (draw < share[1])) | ((F.col("_y") == 0) & (draw < share[0])))
    rows = df.where(F.length(F.col(text)).between(1, LONGEST)).join(F.broadcast(some), key).select(F.col(text).alias("t"), "_y", draw.alias("d")).collect()
    rows = sorted({(r.d, r._y, r.t) for r in rows})
    low = [(y, t.lower().encode("utf-8", "replace"), t) for _, y, t in rows]

    def taught(part):
        toxic, other = [b for y, b, _ in part if y == 1], [b for y, b, _ in part if y == 0]
        return (ordinary_content(other), evidence(toxic, other)) if toxic and other else None

    # the model learns from gains under dictionaries of the other half; scoring uses those of all rows
    halves, xs, ys = (low[::2], low[1::2]), [], []
    for own, rest in (halves, halves[::-1]):
        if not (half := taught(own)):
            return None
        gains = Gains(*half)
        xs += [gains.of(t) for _, _, t in rest]
        ys += [y for y, *_ in rest]
    contents, w = taught(low), logistic(np.array(xs), np.array(ys, float))
    own = {(d, _digest(t)): i % 2 for i, (d, _, t) in enumerate(rows)}
    used = (contents, taught(halves[1]), taught(halves[0]))
    texts = df.select(F.col(key).alias("_k"), F.col(text).alias("_t"), draw.alias("_d"))
    names = one.select(F.col(key).alias("_k"), "_y")
    if sum(counts.values()) <= SENT:
        texts = texts.join(F.broadcast(names.select("_k")), "_k", "left_semi")
    bins = margins(texts, used, w, own).join(names, "_k").groupBy(F.floor(F.col("_z") / BIN).alias("bin"))
    bins = bins.agg(F.min("_z").alias("least"), F.max("_z").alias("most"), F.count(F.when(F.col("_y") == 1, 1)).alias("toxic"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()
    w[-1] += np.log(THRESHOLD / (1 - THRESHOLD)) - cut(bins)
    return (*contents, w)


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=16).digest()


def margins(texts: DataFrame, contents, w: np.ndarray, own: dict[tuple[int, bytes], int]) -> DataFrame:
    """texts: _k, _t, _d. _k, _z: the model's log odds, for rows of the sample (own: half of draw and text) by the
    dictionaries of its other half. Texts aren't shuffled."""
    sent = texts.sparkSession.sparkContext.broadcast((contents, w, own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        contents, w, own = sent.value
        gains, drawn = [Gains(*c) for c in contents], {d for d, _ in own}
        for batch in batches:
            z = []
            for t, d in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                half = own.get((d, _digest(t))) if t and d in drawn else None
                z.append(float(gains[0 if half is None else half + 1].of(t) @ w[:-1] + w[-1]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.float64())], names=["_k", "_z"])

    return texts.mapInArrow(run, T.StructType([texts.schema["_k"], T.StructField("_z", T.DoubleType())]))


def cut(bins) -> float:
    """The best threshold by F1 between bins (least, most, toxic, n) in order; among equals the nearest to 0."""
    if not bins:
        return 0.0
    least, most, toxic, n = (np.array([b[c] for b in bins], float) for c in ("least", "most", "toxic", "n"))
    at = np.r_[least[0] - 1, (least[1:] + most[:-1]) / 2] if len(bins) > 1 else least
    caught, taken = toxic[::-1].cumsum()[::-1], n[::-1].cumsum()[::-1]
    f1 = np.round(2 * caught / np.maximum(1, taken + toxic.sum()), 4)
    return float(max(zip(f1, -abs(at), at, strict=True))[2])


def score(df: DataFrame, model, text: str = "text") -> DataFrame:
    """Adds score (0 to 1) and predicted (1 from the threshold on)."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    added = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    keep = [f for f in df.schema.fields if f.name not in ("score", "predicted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sent.value
        gains = Gains(got[0], got[1]) if got else None
        for batch in batches:
            p = [float(1 / (1 + np.exp(-np.clip(gains.of(t) @ got[2][:-1] + got[2][-1], -500, 500)))) if got else 0.0 for t in batch.column(text).to_pylist()]
            new = [pa.array(p, pa.float64()), pa.array([int(s >= THRESHOLD) for s in p], pa.int32())]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in keep] + new, names=[f.name for f in keep] + ["score", "predicted"])

    return df.mapInArrow(run, T.StructType(keep + added))
