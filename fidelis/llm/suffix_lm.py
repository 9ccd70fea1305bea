"""Language-model scores from a probabilistic suffix tree over words.

Tokens are lower-cased (A-Z) words between ASCII white space and one end a text. The root is the unigram
model with 0.1 added to every count. Runs of up to `depth` words and a next one, all seen `LEAST` times in
the training texts, are the candidates: an absolute count, so the tree grows with the corpus. A context is
retained when its next-word distribution diverges from its longest retained suffix's by more than the cost
of its parameters. Distributions are smoothed by absolute discounting into the suffix's, and every token is
scored by the longest retained suffix of the words before it.

Counts cover all training texts. Texts are read once and coded in chunks of about `CHUNK` bytes. What a chunk
counts goes, packed, to as many parts as there are tasks (by word or by run), is summed there, and what is frequent
goes back, packed, to the chunks that hold it. So nothing that grows with the corpus is collected or broadcast, no
task holds the vocabulary or the tree, and rows stand for packs, not for words. A chunk's tokens are held as 32-bit
numbers and scored a row of texts at a time; tables go as soon as the last pass that reads them has ended.

Defined results: null text counts as empty (one token, the end); without training texts N and V are 0
and every token is unknown; repeated rows count each; extra columns stay out.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard as zstd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from fidelis.llm._util import dropped, released, slices, trimmed, written

#: Least count of a candidate, the discount, words of a context at most, bytes of a chunk, tokens of a row.
LEAST, DISCOUNT, DEPTH, CHUNK, ROW = 8, 0.75, 5, 14_000_000, 250_000
END = b""
#: Parts and chunks for each partition of the input.
PARTS = 2
#: Shares in which distinct keys are counted, one after another.
SHARES = 8


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text or b"").lower().split(), END]


class _Places(dict):
    """Numbers words as they come."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def pack(x: np.ndarray) -> bytes:
    """Integers or floats, byte planes compressed: high bytes of small numbers cost next to nothing."""
    x = np.ascontiguousarray(x, x.dtype if x.dtype.kind == "f" else np.int64)
    return zstd.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(-1, x.itemsize).T).tobytes())


def unpack(raw: bytes, kind=np.int64) -> np.ndarray:
    planes = np.frombuffer(zstd.ZstdDecompressor().decompress(raw), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def pack_runs(columns: list[np.ndarray]) -> list[bytes]:
    """Runs in order of their numbers, each column as steps from the run before while the columns before it are alike."""
    new, out = np.zeros(len(columns[0]), bool), []
    new[:1] = True
    for x in columns:
        step = np.diff(x, prepend=0)
        out.append(pack(np.where(new, x, step)))
        new[1:] |= step[1:] != 0
    return out


def unpack_runs(raw: list[bytes]) -> list[np.ndarray]:
    new, out = None, []
    for r in raw:
        step = unpack(r)
        if new is None:
            new = np.zeros(len(step), bool)
            new[:1] = True
        first, total = np.flatnonzero(new), np.cumsum(step)
        x = total - np.repeat((total - step)[first], np.diff(np.r_[first, len(step)]))
        out.append(x)
        new[1:] |= x[1:] != x[:-1]
    return out


def name_of(numbers: list[np.ndarray]) -> np.ndarray:
    """64-bit names of runs, from the numbers of their words."""
    h = np.full(len(numbers[0]), 0xD6E8FEB86659FD93 - len(numbers), np.uint64)
    for x in numbers:
        h = (h ^ x.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


#: A row of what is dealt. kind 0: a part's news to a chunk; 1: a chunk's news to a part; 2: its texts; 3: its dictionary;
#: 4: frequent words or runs; 5: totals; 6: the tree's values. level: words of its runs. a: numbers by column, b, c, d: more by kind.
ROWS = "kind int, chunk bigint, part bigint, level int, a array<binary>, b binary, c binary, d binary, n bigint, v bigint, ids array<{}>"
NAMES = [f.split()[0] for f in ROWS.split(", ")]


class _Out:
    """Makes batches of ROWS."""

    def __init__(self, id_type: pa.DataType):
        self.kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.list_(id_type)]

    def row(self, **values) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([values.get(n)], k) for n, k in zip(NAMES, self.kinds, strict=True)], names=NAMES)


def _each(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """Rows by runs of equal keys; a run must be read before the next."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            step = max(1, min(256, batch.num_rows * (4 << 20) // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                yield from batch.slice(at, step).to_pylist()

    return itertools.groupby(rows(), key=lambda r: r[key])


def _by_part(of: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """Each part that occurs and where, in order."""
    of = of.astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(of, kind="stable")
    dealt = of[order]
    cuts = [*np.flatnonzero(np.r_[True, dealt[1:] != dealt[:-1]]).tolist(), len(dealt)] if len(dealt) else []
    for a, b in itertools.pairwise(cuts):
        yield int(dealt[a]), order[a:b]


def part_of(numbers: list[np.ndarray], times: np.ndarray, total: int, parts: int) -> np.ndarray:
    """The part that sums a run: that of its first word, of a common word (times of total) dealt further by the second."""
    wide = 1 + np.minimum(times * (2 * parts) // max(1, total), parts)
    return (numbers[0] + numbers[1] % wide * 13) % parts


def _named(columns: list[np.ndarray]) -> list[bytes]:
    """The names of runs, of their contexts, of what follows their first word, and of their last word."""
    none = np.zeros(len(columns[0]), np.int64)
    return [pack(x) for x in (name_of(columns), *((name_of(columns[:-1]), name_of(columns[1:]), name_of(columns[-1:])) if len(columns) > 1 else (none,) * 3))]


def coded(df: DataFrame, train: Column, key: str, text: str, parts: int) -> DataFrame:
    """Texts coded by each chunk's own dictionary (kind 2; a: places, b: lengths, c: train) and its words (kind 1; a:
    places in order, b: words, c: training counts)."""
    rows = df.select(F.col(key).alias("id"), F.coalesce(train, F.lit(False)).alias("train"), F.col(text).cast("binary").alias("text"))
    id_type = to_arrow_type(rows.schema["id"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, base = _Out(id_type), TaskContext.get().partitionId() << 24

        def flushed(chunk: int) -> Iterator[pa.RecordBatch]:
            x = np.concatenate(xs)  # 32 bits
            flags, lengths = np.array(trains, bool), np.array([len(y) for y in xs], np.int64)
            rank = np.empty(len(place), np.int32)
            rank[np.argsort(-np.bincount(x, minlength=len(place)), kind="stable")] = np.arange(len(place), dtype=np.int32)
            x = rank[x]
            counts = np.bincount(x[np.repeat(flags, lengths)], minlength=len(place))
            ends = np.cumsum(lengths)
            at = 0
            while at < len(ids):
                below = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, below + ROW, "right")))
                yield out.row(kind=2, chunk=chunk, a=[pack(x[below : ends[to - 1]])], b=pack(lengths[at:to]), c=pack(flags[at:to]), ids=ids[at:to])
                at = to
            words = list(place)
            of = np.array([xxhash.xxh32_intdigest(w) % parts for w in words], np.int64)
            for part, where in _by_part(of, parts):
                where = where[np.argsort(rank[where])]
                mine = rank[where].astype(np.int64)
                yield out.row(kind=1, chunk=chunk, part=part, a=pack_runs([mine]), b=zstd.compress(b" ".join([words[i] for i in where]), 1), c=pack(counts[mine]))

        chunk = size = 0
        place, xs, ids, trains = _Places(), [], [], []
        for batch in batches:
            for some in slices(batch, 2):
                for doc, flag, t in zip(*(c.to_pylist() for c in some.columns), strict=True):
                    if size and size + len(t or b"") > CHUNK:
                        yield from flushed(base + chunk)
                        chunk, size = chunk + 1, 0
                        place, xs, ids, trains = _Places(), [], [], []
                    size += len(t or b"")
                    xs.append(np.fromiter(map(place.__getitem__, tokens(t)), np.int32))
                    ids.append(doc)
                    trains.append(flag)
        if ids:
            yield from flushed(base + chunk)

    return rows.mapInArrow(lambda batches: trimmed(run(batches)), ROWS.format(rows.schema["id"].dataType.simpleString()))


def _pass(rows: DataFrame, by: str, slots: int, work, schema: str | None = None) -> DataFrame:
    """work(key, rows of that chunk or part, _Out) -> batches; each chunk or part meets in one task, and they are dealt
    to tasks in turn."""
    id_type = to_arrow_type(rows.schema["ids"].dataType.elementType)
    slot = F.col("part") if by == "part" else F.pmod(F.shiftright("chunk", 24) + F.col("chunk").bitwiseAND((1 << 24) - 1) * (slots // 2 + 1), F.lit(slots))
    dealt = rows.repartitionById(slots, slot.cast("int")).sortWithinPartitions(by, "level", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(id_type)
        for key, own in _each(batches, by):
            yield from work(key, own, out)

    return dealt.mapInArrow(lambda batches: trimmed(run(batches)), schema or rows.schema)


def whole_number(number: np.ndarray, part: int, parts: int) -> np.ndarray:
    """The numbers among all words, from 0, of words numbered within a part from 1."""
    return (number - 1) * parts + part


def _word_parts(parts: int):
    """Sums words: what their chunks must know (a: places in order, numbers in the part + 1 or 0; c: counts), frequent words, totals."""

    def work(part: int, rows: Iterator[dict], out: _Out) -> Iterator[pa.RecordBatch]:
        place, held = _Places(), []
        for r in rows:
            at = np.fromiter(map(place.__getitem__, zstd.decompress(r["b"]).split(b" ")), np.int64)
            held.append((r["chunk"], r["a"][0], at, unpack(r["c"])))
        c = np.zeros(len(place), np.int64)
        for _, _, at, n in held:
            c[at] += n
        often = c >= LEAST
        number = np.zeros(len(c), np.int64)
        # common words get small numbers, which pack well
        number[np.flatnonzero(often)[np.argsort(-c[often], kind="stable")]] = np.arange(1, often.sum() + 1)
        for chunk, where, at, n in held:
            (where,) = unpack_runs([where])
            tell = np.flatnonzero((c[at] != n) | often[at])
            if len(tell):
                yield out.row(kind=0, chunk=chunk, part=part, level=1, a=[*pack_runs([where[tell]]), pack(number[at[tell]])], c=pack(c[at[tell]]))
        if often.any():
            yield out.row(kind=4, part=part, level=1, a=_named([whole_number(number[often], part, parts)]), c=pack(c[often]))
        yield out.row(kind=5, n=int(c.sum()), v=int((c > 0).sum()))

    return work


def _counted(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The number of each key's distinct value, the distinct keys, and their training counts."""
    of, known, n, at = np.empty(len(key), np.int32), [key[:0]], [np.zeros(0, np.int64)], 0
    share = (key % SHARES).astype(np.uint8)
    for i in range(SHARES):
        on = np.flatnonzero(share == i)
        own, names = pd.factorize(key[on])
        of[on] = own + at
        known.append(names)
        n.append(np.bincount(own, train[on], len(names)).astype(np.int64))
        at += len(names)
    return of, np.concatenate(known), np.concatenate(n)


def _sent_runs(out: _Out, chunk: int, numbers: list[np.ndarray], times: np.ndarray, n: np.ndarray, parts: int, total: int) -> Iterator[pa.RecordBatch]:
    """Packs of runs for the parts. times: counts of their first words."""
    for part, where in _by_part(part_of(numbers, times, total, parts), parts):
        where = where[np.lexsort([x[where] for x in numbers[::-1]])]
        yield out.row(kind=1, chunk=chunk, part=part, level=len(numbers), a=pack_runs([x[where] for x in numbers]), c=pack(n[where]))


def _pair_chunks(parts: int, total: int, whole: float):
    """Texts coded anew by frequent words (kind 2; a: places + 1 or 0; b: lengths; c: train; d: base scores and known
    tokens), the dictionary (kind 3; a: numbers in order, counts) and pairs of frequent words (kind 1)."""

    def work(chunk: int, rows: Iterator[dict], out: _Out) -> Iterator[pa.RecordBatch]:
        told, texts = [], []
        for r in rows:
            (told if r["kind"] == 0 else texts).append(r)
        if not texts:
            return
        xs, flags = [unpack(r["a"][0]).astype(np.int32) for r in texts], [unpack(r["c"]) > 0 for r in texts]
        lengths = [unpack(r["b"]) for r in texts]
        m = 1 + max(int(x.max()) for x in xs)
        c, number = np.zeros(m, np.int64), np.zeros(m, np.int64)
        for x, f, n in zip(xs, flags, lengths, strict=True):
            c += np.bincount(x[np.repeat(f, n)], minlength=m)
        for r in told:
            (at,), given = unpack_runs(r["a"][:1]), unpack(r["a"][1])
            c[at], number[at] = unpack(r["c"]), np.where(given > 0, whole_number(given, r["part"], parts) + 1, 0)
        del told
        often = np.flatnonzero(number)
        often = often[np.argsort(number[often])]
        code = np.zeros(m, np.int64)
        code[often] = np.arange(1, len(often) + 1)
        root, known = np.log10((c + 0.1) / whole), (c > 0).astype(np.int64)
        size = max(1, len(often))
        keys, trains = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        for r, x, f, n in zip(texts, xs, flags, lengths, strict=True):
            starts, y = np.r_[0, np.cumsum(n)[:-1]], code[x]
            yield out.row(kind=2, chunk=chunk, a=[pack(y)], b=r["b"], c=r["c"], d=pack(np.r_[np.add.reduceat(root[x], starts), np.add.reduceat(known[x], starts).astype(float)]), ids=r["ids"])
            on = (y[:-1] > 0) & (y[1:] > 0)
            on[np.cumsum(n)[:-1] - 1] = False
            keys.append((y[:-1][on] - 1) * size + y[1:][on] - 1)
            trains.append(np.repeat(f, n)[1:][on])
        yield out.row(kind=3, chunk=chunk, a=[*pack_runs([number[often] - 1]), pack(c[often])])
        del texts, xs
        keys, trains = np.concatenate(keys), np.concatenate(trains)
        _, key, n = _counted(keys, trains)
        names = number[often] - 1
        if len(key):
            yield from _sent_runs(out, chunk, [names[key // size], names[key % size]], c[often][key // size], n, parts, total)

    return work


def _run_parts(part: int, rows: Iterator[dict], out: _Out) -> Iterator[pa.RecordBatch]:
    """Sums runs of each length: the frequent ones of each chunk (kind 0) and all frequent ones (kind 4)."""
    for level, some in itertools.groupby(rows, key=lambda r: r["level"]):
        held = [(r["chunk"], unpack_runs(r["a"]), unpack(r["c"])) for r in some]
        chunks, cuts = [h[0] for h in held], np.cumsum([0, *(len(h[2]) for h in held)])
        columns = [np.concatenate([h[1][i] for h in held]) for i in range(level)]
        n = np.concatenate([h[2] for h in held])
        del held
        of, names = pd.factorize(columns[0])
        for x in columns[1:]:
            x, own = pd.factorize(x)
            of, names = pd.factorize(of * len(own) + x)
        total = np.bincount(of, n, len(names)).astype(np.int64)
        often = total >= LEAST
        keep = often[of]
        # one row of each frequent run
        first = np.full(len(names), -1, np.int64)
        first[of[::-1]] = np.arange(len(of))[::-1]
        for i, chunk in enumerate(chunks):
            where = np.flatnonzero(keep[cuts[i] : cuts[i + 1]]) + cuts[i]
            if len(where):
                yield out.row(kind=0, chunk=chunk, part=part, level=level, a=pack_runs([x[where] for x in columns]))
        if often.any():
            yield out.row(kind=4, part=part, level=level, a=_named([x[first[often]] for x in columns]), c=pack(total[often]))


class _Chunk:
    """A chunk's frequent words, its texts end to end (0: any other word) and what it is told of runs."""

    def __init__(self, rows: Iterator[dict]):
        self.told, self.texts = [], []
        self.numbers = self.counts = np.zeros(0, np.int64)
        for r in rows:
            if r["kind"] == 0:
                self.told.append(r)
            elif r["kind"] == 2:
                self.texts.append(r)
            else:
                (self.numbers,), self.counts = unpack_runs(r["a"][:1]), unpack(r["a"][1])
        self.m = max(1, len(self.numbers))
        self.lengths = np.concatenate([unpack(r["b"]) for r in self.texts]) if self.texts else np.zeros(0, np.int64)
        self.x = np.concatenate([(unpack(r["a"][0]) - 1).astype(np.int32) for r in self.texts]) if self.texts else np.zeros(0, np.int32)
        self.first = np.zeros(len(self.x), bool)
        self.first[np.r_[0, np.cumsum(self.lengths)[:-1]]] = len(self.lengths) > 0

    def runs(self, level: int) -> list[np.ndarray]:
        """The told runs of a length: columns of places in the dictionary."""
        mine = [unpack_runs(r["a"]) for r in self.told if r["level"] == level]
        columns = [np.concatenate([m[i] for m in mine]) if mine else np.zeros(0, np.int64) for i in range(level)]
        return [np.searchsorted(self.numbers, x) for x in columns]

    def pieces(self) -> Iterator[slice]:
        """The tokens of each row of texts."""
        ends = np.cumsum(self.lengths)
        at = below = 0
        for r in self.texts:
            at += len(r["ids"])
            yield slice(below, int(ends[at - 1]))
            below = int(ends[at - 1])


def follows(before: np.ndarray, x: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Places whose word (in x) is frequent, in the text of the word before, whose run (in before) is known too."""
    return np.flatnonzero((before[:-1] >= 0) & (x[1:] >= 0) & ~first[1:]) + 1


def _found(known: np.ndarray | pd.Index, key: np.ndarray) -> np.ndarray:
    """Places of keys among known ones, which are distinct; -1 for others."""
    known = known if isinstance(known, pd.Index) else pd.Index(known)
    return known.get_indexer(pd.Index(key)) if len(known) and len(key) else np.full(len(key), -1, np.int64)


def _long_chunks(parts: int, total: int, lower: int, upper: int):
    """Runs of lower + 1 to upper words (kind 1) all of whose runs of lower words are told, that is frequent."""

    def work(chunk: int, rows: Iterator[dict], out: _Out) -> Iterator[pa.RecordBatch]:
        a = _Chunk(rows)
        if not a.texts:
            return
        train = np.repeat(np.concatenate([unpack(r["c"]) for r in a.texts]) > 0, a.lengths)
        words, pieces = a.runs(lower), [*a.pieces()]
        a.told = a.texts = None
        of, run = words[0], a.x
        for x in words[1:]:
            of, known = pd.factorize(of * a.m + x)
            known, before = pd.Index(known), run
            run = np.full(len(a.x), -1, np.int32)
            for piece in pieces:
                at = follows(before[piece], a.x[piece], a.first[piece]) + piece.start
                run[at] = _found(known, before[at - 1].astype(np.int64) * a.m + a.x[at])
        told = run  # where a told run ends, and which
        del before, known, of
        for _ in range(lower, upper):
            on = np.flatnonzero((run[:-1] >= 0) & (told[1:] >= 0) & ~a.first[1:]) + 1
            if not len(on):
                break
            of, key, n = _counted(run[on - 1].astype(np.int64) * a.m + a.x[on], train[on])
            words = [*(x[key // a.m] for x in words), key % a.m]
            yield from _sent_runs(out, chunk, [a.numbers[x] for x in words], a.counts[words[0]], n, parts, total)
            run = np.full(len(a.x), -1, np.int32)
            run[on] = of

    return work


def _valued_parts(part: int, rows: Iterator[dict], out: _Out, parts: int = 1) -> Iterator[pa.RecordBatch]:
    """To each chunk its runs that the tree knows, and what it says of them (b: its count, after a retained
    context; c, d: of a retained context its count and the mass left to the suffix; 0 and NaN for others)."""
    for level, some in itertools.groupby(rows, key=lambda r: r["level"]):
        told, held = [], []
        for r in some:
            if r["kind"] == 0:
                told.append(r)
            else:
                held.append((np.frombuffer(r["b"], np.int64), unpack(r["c"]), unpack(r["a"][0]), np.frombuffer(r["d"], np.float64)))
        if not held:
            continue
        names, count, total, back = (np.concatenate(x) for x in zip(*held, strict=True))
        adds, backs = np.flatnonzero(count > 0), np.flatnonzero(~np.isnan(back))
        count, total, back = np.r_[count[adds], 0], np.r_[total[backs], 0], np.r_[back[backs], np.nan].astype(np.float32)
        for r in told:
            if level == 1:
                number = unpack(r["a"][-1])
                mine = [whole_number(np.sort(number[number > 0]), part, parts)]
            else:
                mine = unpack_runs(r["a"])
            own = name_of(mine)
            x, y = _found(names[adds], own), _found(names[backs], own)
            on = (x >= 0) | (y >= 0)
            if on.any():
                yield out.row(kind=0, chunk=r["chunk"], level=level, a=pack_runs([v[on] for v in mine]), b=pack(count[x[on]]), c=pack(total[y[on]]), d=pack(back[y[on]]))


def _runs(told: DataFrame) -> DataFrame:
    """part, level, h, p, s, w (names of the run, its context, what follows its first word, its last word), c."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, level, a, c in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                count = unpack(c)
                columns = [np.full(len(count), part), np.full(len(count), level, np.int32), *(unpack(x) for x in a), count]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=["part", "level", "h", "p", "s", "w", "c"])

    return told.where(F.col("kind") == 4).select("part", "level", "a", "c").mapInArrow(run, "part bigint, level int, h bigint, p bigint, s bigint, w bigint, c bigint")


def grown(runs: DataFrame, whole: float, depth: int = DEPTH) -> DataFrame:
    """part, level, h, c, total, back: of runs after a retained context their count, and of retained contexts their own
    (total, which thus is sent once and not with each run) and the mass left to the suffix; 0 and NaN for the other.
    It stands on tables that dropped() deletes; others are gone."""
    rows = runs.where("level > 1").select("part", "level", "h", "p", "s", "w", "c")
    states = rows.groupBy("p").agg(F.sum("c").alias("seen"), F.count(F.lit(1)).alias("kinds"))
    own = runs.select(F.col("h").alias("p"), F.col("c").alias("total"), F.col("part").alias("home"), F.col("level").alias("words"))
    back = F.greatest(1 - (F.col("seen") - DISCOUNT * F.col("kinds")) / F.col("total"), F.lit(1e-12))
    states = written(states.join(own, "p").withColumn("back", back), "states")
    under = runs.where("level = 1").select("h", ((F.col("c") + 0.1) / whole).alias("under"))
    add, out = (F.col("c") - DISCOUNT) / F.col("total"), []
    for level in range(2, depth + 2):
        mine = rows.where(F.col("level") == level).select("part", "h", "p", F.col("w" if level == 2 else "s").alias("s"), "c")
        mine = mine.join(under.withColumnRenamed("h", "s"), "s").drop("s")
        of = states.where(F.col("words") == level - 1)
        # the test and what it decides need a context's runs together: one exchange by context serves both
        mine = tests = written(mine.join(of.select("p", "total", "back"), "p"), "level")
        gain = mine.groupBy("p").agg(F.sum(F.col("c") * F.log((add + F.col("back") * F.col("under")) / F.col("under"))).alias("gain"))
        gain = gain.join(of, "p").withColumn("gain", F.col("gain") + F.greatest(F.col("total") - F.col("seen"), F.lit(0)) * F.log("back"))
        kept = written(gain.where(F.col("gain") > 0.5 * F.col("kinds") * F.log(F.greatest("total", F.lit(2)))).select("p", "home", "total", "back"), "kept")
        mine = mine.join(kept.select("p", F.lit(True).alias("on")), "p", "left")
        released(runs.sparkSession)
        now = written(mine.select("part", "h", "c", F.when(F.col("on"), F.col("total")).alias("total"), F.when(F.col("on"), add + F.col("back") * F.col("under")).otherwise(F.col("under")).alias("under")), "probabilities")
        dropped(tests)
        under = now.select("h", "under")
        zero = F.lit(0).cast("bigint")
        out.append(now.where("total IS NOT NULL").select("part", F.lit(level).alias("level"), "h", "c", zero.alias("total"), F.lit(float("nan")).alias("back")))
        out.append(kept.select(F.col("home").alias("part"), F.lit(level - 1).alias("level"), F.col("p").alias("h"), zero.alias("c"), "total", "back"))
    dropped(states)
    tree = out[0]
    for other in out[1:]:
        tree = tree.unionByName(other)
    return tree


def _gains(a: _Chunk, whole: float, depth: int) -> np.ndarray:
    """Of each text of a chunk the sum of log10 of its tokens' probabilities by the longest retained contexts over those at
    the root. The tree is made of what the chunk is told, then rows of texts go through it one by one."""
    mine = {level: [r for r in a.told if r["level"] == level] for level in range(1, depth + 2)}
    columns = {level: a.runs(level) for level in mine}
    joined = lambda rows, c, kind: np.concatenate([unpack(r[c], kind) for r in rows]).astype(float) if rows else np.zeros(0)
    values = {level: (joined(rows, "b", np.int64), joined(rows, "c", np.int64), joined(rows, "d", np.float32)) for level, rows in mine.items()}
    a.told = mine = None
    # states of one word are its place in the dictionary; one more at the end, for -1: nothing is known
    mass, weight = np.full(a.m + 1, np.nan), np.zeros(a.m + 1)
    mass[columns[1][0]], weight[columns[1][0]] = values[1][2], values[1][1]
    node, tree = {level: c[0] for level, c in columns.items() if level > 1}, [(None, None, weight, mass)]
    for level in range(2, depth + 2):
        # nodes of this length: all told runs' starts
        names = {k: n * a.m + columns[k][level - 1] for k, n in node.items() if k >= level}
        known, of = np.unique(np.concatenate(list(names.values())), return_inverse=True)
        cuts = np.cumsum([0, *map(len, names.values())])
        node = {k: of[cuts[i] : cuts[i + 1]] for i, k in enumerate(names)}
        times, totals, back = np.zeros(len(known) + 1), np.zeros(len(known) + 1), np.full(len(known) + 1, np.nan)
        times[node[level]], totals[node[level]], back[node[level]] = values.pop(level)
        tree.append((pd.Index(known), times, totals, back))
    del node, columns
    gains, starts = [np.zeros(0)], np.flatnonzero(a.first)
    for piece in a.pieces():
        x, first = a.x[piece].astype(np.int64), a.first[piece]
        root = np.where(x >= 0, (a.counts[np.maximum(x, 0)] + 0.1) / whole if len(a.counts) else 1.0, 1.0)
        # the probability is keep * root + own; a word without a number is in no run, so its own part is 0
        keep, own, run = np.ones(len(x)), np.zeros(len(x)), x
        for (_, _, weight, mass), (known, times, _, _) in itertools.pairwise(tree):
            at, before = follows(run, x, first), run
            run = np.full(len(x), -1, np.int64)
            run[at] = _found(known, before[at - 1] * a.m + x[at])
            state = np.r_[-1, before[:-1]]
            state[first] = -1
            left = mass[state]
            on = ~np.isnan(left)
            keep[on] *= left[on]
            seen = times[run[on]]
            own[on] = own[on] * left[on] + np.where(seen > 0, (seen - DISCOUNT) / np.maximum(weight[state[on]], 1), 0)
        gains.append(np.add.reduceat(np.log10(keep + own / root), starts[np.searchsorted(starts, piece.start) : np.searchsorted(starts, piece.stop)] - piece.start))
    return np.concatenate(gains)


def score(df: DataFrame, train: Column, key: str = "doc_id", text: str = "text", depth: int = DEPTH) -> DataFrame:
    """key, train, n_tokens, n_known, train_tokens, base_score, score (log10 probabilities of whole texts)."""
    slots = max(1, df.rdd.getNumPartitions())
    parts = PARTS * slots
    kind = F.col("kind")
    # by kind, so that what is summed can go at once
    first = written(coded(df, train, key, text, parts), "coded", by="kind")
    first = first.select(*NAMES)
    words = written(_pass(first.where(kind == 1), "part", parts, _word_parts(parts)), "words")
    dropped(first, only="kind=1")
    released(df.sparkSession)
    size = words.where(kind == 5).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    n, v = size[0], size[1]
    whole = n + 0.1 * (v + 1)

    second = written(_pass(first.where(kind == 2).unionByName(words.where(kind == 0)), "chunk", slots, _pair_chunks(parts, n, whole)), "pairs", by="kind").select(*NAMES)
    dropped(first)
    released(df.sparkSession)
    pairs = written(_pass(second.where(kind == 1), "part", parts, _run_parts), "frequent", by="kind").select(*NAMES)
    dropped(second, only="kind=1")
    released(df.sparkSession)
    texts = second.where(kind.isin(2, 3))
    told, known = [words, pairs], pairs
    # triples first: longer runs hold frequent ones only
    for lower, upper in ((2, 3), (3, depth + 1)):
        if depth >= lower:
            sent = _pass(texts.unionByName(known.where(kind == 0)), "chunk", slots, _long_chunks(parts, n, lower, upper))
            known = written(_pass(sent, "part", parts, _run_parts), "longer", by="kind").select(*NAMES)
            released(df.sparkSession)
            told.append(known)
    grams = written(_runs(functools.reduce(DataFrame.unionByName, told)), "grams")
    dropped(*told[1:], only="kind=4")
    tree = grown(grams, whole, depth)
    values = written(_packed(tree, first.schema), "values")
    dropped(grams, tree)
    released(df.sparkSession)
    # of words their numbers only
    news = [words.where(kind == 0).withColumns({"a": F.slice("a", 2, 1), "c": F.lit(None).cast("binary")}), *(x.where(kind == 0) for x in told[1:])]
    said = written(_pass(functools.reduce(DataFrame.unionByName, [*news, values]), "part", parts, functools.partial(_valued_parts, parts=parts)), "said")
    dropped(*told, values)
    released(df.sparkSession)
    last = texts.unionByName(said.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name == "part" else F.col(f.name) for f in said.schema.fields]))
    id_type = to_arrow_type(first.schema["ids"].dataType.elementType)

    def run(chunk: int, rows: Iterator[dict], out: _Out) -> Iterator[pa.RecordBatch]:
        a = _Chunk(rows)
        if not a.texts:
            return
        gains = _gains(a, whole, depth)
        at = 0
        for r in a.texts:
            size = len(r["ids"])
            base, known = unpack(r["d"], np.float64).reshape(2, -1)
            columns = [pa.array(r["ids"], id_type), pa.array(unpack(r["c"]) > 0), pa.array(a.lengths[at : at + size]), pa.array(known.astype(np.int64)), pa.array([n] * size, pa.int64()), pa.array(base), pa.array(base + gains[at : at + size])]
            yield pa.RecordBatch.from_arrays(columns, names=[key, "train", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            at += size

    kind_ = first.schema["ids"].dataType.elementType.simpleString()
    return _pass(last, "chunk", slots, run, f"`{key}` {kind_}, train boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def _packed(values: DataFrame, schema) -> DataFrame:
    """The tree's values in the columns of ROWS (kind 6; a: counts of contexts, b: names, c: counts, d: back), rows of a part and length together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, level, name = (batch.column(i).to_numpy() for i in (0, 1, 2))
            count, total, back = (batch.column(i).to_numpy() for i in (3, 4, 5))
            of = part * 64 + level
            order = np.argsort(of, kind="stable")
            cuts = [0, *(np.flatnonzero(np.diff(of[order])) + 1).tolist(), len(of)]
            packs = [(int(part[i[0]]), int(level[i[0]]), [pack(total[i])], name[i].tobytes(), pack(count[i]), back[i].tobytes()) for i in (order[a:b] for a, b in itertools.pairwise(cuts) if b > a)]
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.binary()), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in packs], k) for i, k in enumerate(kinds)], names=["part", "level", "a", "b", "c", "d"])

    rows = values.mapInArrow(run, "part bigint, level int, a array<binary>, b binary, c binary, d binary")
    return rows.select(*[F.lit(6).alias("kind") if f.name == "kind" else F.col(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
