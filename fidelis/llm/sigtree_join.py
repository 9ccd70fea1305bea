"""N-gram Jaccard join with signature trees.

A document's set holds its distinct k-word shingles (64-bit hashes). Documents of equal sets form a class;
one member stands for it. Two sets that reach the similarity share one of their first few shingles in any
common order, so classes meet in buckets by those (shingles that very many documents hold come last in the
order, rarer ones by hash); buckets with the same members (by number and 64-bit hash) count once. In a bucket, cut into blocks, each
set is an OR-combined bitmap of its shingles; a tree over them, by size, holds each node's OR, size range
and most collisions. Dual traversal prunes a pair of nodes whose largest possible overlap is too small.

Linking takes two rounds, and no pairs within a group of copies are made beyond need: first every set is
verified against its likeliest partners, which joins most of each component; then the trees are walked
again, skipping node pairs that lie in one component, and name the sets that have any candidate left, each
candidate in the first bucket that its two sets share. Those meet once more, with their whole sets, where every
remaining candidate is verified unless links found there have already joined its two components. So no link
between components is lost, at any bucket size, no step makes more rows than the members that it is given, and a
whole set goes only where a candidate of its own is verified.

Defined results: null or blank texts have an empty set and are linked with nothing; a null id gets no
component; rows that repeat an id are one vertex; extra columns stay out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm._util import slices, trimmed, written
from fidelis.llm.graph import components

#: Members of a block, items of a leaf, children of a node; rows of ids or keys that are sent whole to
#: executors at most (8 MB and little more).
BLOCK, LEAF, FAN, SENT_IDS = 1024, 32, 4, 1_000_000
#: A shingle that the batches count more often comes last in the order; at most HOT of them, the commonest.
OFTEN, HOT = 30, 100_000
#: Word hashes kept in a worker, shingles of a block at most (a larger set stands in a block with few others).
WORDS, BLOCK_SIZE = 150_000, 8_000_000
#: Buckets of a member, by key, that tell where its candidates are named; candidates that share none of these are named in
#: each bucket that they share.
FIRST = 64
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0xD6E8FEB86659FD93)]


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, k: int, known: dict) -> np.ndarray:
    """Sorted distinct hashes of the k-word shingles; with fewer words, the whole sequence as one."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.array(list(map(known.__getitem__, words)), np.uint64)
    n = max(1, len(h) - k + 1)
    mix = np.full(n, np.uint64(min(k, len(h))), np.uint64)
    for i in range(min(k, len(h))):
        mix += h[i : i + n] * _ODD[i % 8] + np.uint64(i)
        mix = _mixed(mix) if i % 8 == 7 else mix
    return np.unique(_mixed(mix))


def bitmap(sets: np.ndarray) -> np.ndarray:
    """A power of two of bits: four or more for each member of a small set, one or more for large ones; sets
    that can reach a similarity of a half differ by one doubling at most."""
    n = len(sets)
    wanted = 4 * n if n <= 256 else 2 * n if n <= 1024 else n
    width = max(64, 1 << int(max(1, wanted) - 1).bit_length())
    bits = np.zeros(width, np.uint8)
    bits[(sets & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def least_overlap(a, b, num: int, den: int):
    """Smallest overlap of sets of sizes a and b with den * overlap >= num * union."""
    return -(-num * (a + b) // (num + den))


class Tree:
    """Bitmaps of one width in order of size; levels[0] are leaves, each level a dict of arrays by node."""

    def __init__(self, ids, sizes, bits, comp):
        order = np.lexsort((ids, sizes))
        self.ids, self.sizes, self.bits, self.comp = ids[order], sizes[order], bits[order], comp[order]
        self.extra = self.sizes - np.bitwise_count(self.bits).sum(1).astype(np.int64)
        cuts = np.arange(0, len(ids), LEAF)
        level = {"or": np.bitwise_or.reduceat(self.bits, cuts, 0), "lo": self.sizes[cuts], "hi": np.maximum.reduceat(self.sizes, cuts), "extra": np.maximum.reduceat(self.extra, cuts), "cmin": np.minimum.reduceat(self.comp, cuts), "cmax": np.maximum.reduceat(self.comp, cuts)}
        self.levels = [level]
        while len(level["lo"]) > 1:
            cuts = np.arange(0, len(level["lo"]), FAN)
            level = {"or": np.bitwise_or.reduceat(level["or"], cuts, 0), "lo": level["lo"][cuts], "hi": np.maximum.reduceat(level["hi"], cuts), "extra": np.maximum.reduceat(level["extra"], cuts), "cmin": np.minimum.reduceat(level["cmin"], cuts), "cmax": np.maximum.reduceat(level["cmax"], cuts)}
            self.levels.append(level)


def candidates(x: Tree, y: Tree, num: int, den: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Dual traversal: positions in x and y of pairs of different components that may reach the similarity, and their largest possible overlap."""
    same = x is y
    stack = [(len(x.levels) - 1, 0, len(y.levels) - 1, 0)]
    while stack:
        lx, i, ly, j = stack.pop()
        a, b = x.levels[lx], y.levels[ly]
        if den * a["hi"][i] < num * b["lo"][j] or den * b["hi"][j] < num * a["lo"][i]:
            continue
        if a["cmin"][i] == a["cmax"][i] == b["cmin"][j] == b["cmax"][j]:
            continue
        most = int(np.bitwise_count(a["or"][i] & b["or"][j]).sum()) + min(a["extra"][i], b["extra"][j])
        if most < least_overlap(int(a["lo"][i]), int(b["lo"][j]), num, den):
            continue
        if lx or ly:
            if lx >= ly:
                kids = [(lx - 1, c, ly, j) for c in range(i * FAN, min((i + 1) * FAN, len(x.levels[lx - 1]["lo"])))]
            else:
                kids = [(lx, i, ly - 1, c) for c in range(j * FAN, min((j + 1) * FAN, len(y.levels[ly - 1]["lo"])))]
            if same:  # one order of each node pair is enough: nodes cover runs of positions
                kids = [k for k in kids if (k[1] + 1) * FAN ** k[0] > k[3] * FAN ** k[2]]
            stack += kids
            continue
        p, q = slice(i * LEAF, (i + 1) * LEAF), slice(j * LEAF, (j + 1) * LEAF)
        sa, sb = x.sizes[p][:, None], y.sizes[q][None]
        top = np.bitwise_count(x.bits[p][:, None] & y.bits[q][None]).sum(2).astype(np.int64) + np.minimum(x.extra[p][:, None], y.extra[q][None])
        top = np.minimum(top, np.minimum(sa, sb))
        fits = (top >= least_overlap(sa, sb, num, den)) & (x.comp[p][:, None] != y.comp[q][None])
        if same and i == j:
            fits &= np.tri(*fits.shape, -1, dtype=bool)
        r, c = np.nonzero(fits)
        if len(r):
            yield r + i * LEAF, c + j * LEAF, top[r, c]


def _folded(bits: np.ndarray) -> np.ndarray:
    half = bits.shape[1] // 2
    return bits[:, :half] | bits[:, half:]


def block_pairs(left, right, num: int, den: int, best: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """left, right: (ids, sizes, list of bitmaps, components); right None: within left. Candidate id pairs.

    best=True keeps for each set only the partner of largest possible similarity."""

    def by_width(part):
        ids, sizes, raw, comp = part
        widths = np.array([len(b) for b in raw])
        out = {}
        for w in np.unique(widths):
            at = np.flatnonzero(widths == w)
            out[int(w)] = (ids[at], sizes[at], np.frombuffer(b"".join(raw[i] for i in at), np.uint64).reshape(len(at), -1), comp[at])
        return out

    lw = by_width(left)
    rw = by_width(right) if right else lw
    found = []

    def walk(x, y):
        for r, c, top in candidates(x, y, num, den):
            found.append((x.ids[r], y.ids[c], top / (x.sizes[r] + y.sizes[c] - top)))

    trees = {w: Tree(*p) for w, p in lw.items()}
    others = {w: Tree(*p) for w, p in rw.items()} if right else trees
    for w, tree in trees.items():
        if w in others:
            walk(tree, others[w])
        if 2 * w in rw and w >= 8:
            i, s, b, c = rw[2 * w]
            walk(tree, Tree(i, s, _folded(b), c))
    if right:
        for w, tree in others.items():
            if 2 * w in lw:
                i, s, b, c = lw[2 * w]
                walk(tree, Tree(i, s, _folded(b), c))
    if not found:
        return []
    a, b, sim = (np.concatenate(x) for x in zip(*found, strict=True))
    if best:
        who, other, sim = np.r_[a, b], np.r_[b, a], np.r_[sim, sim]
        order = np.lexsort((other, -sim, who))
        first = order[np.r_[True, who[order][1:] != who[order][:-1]]]
        a, b = who[first], other[first]
    return [(np.minimum(a, b), np.maximum(a, b))]


def _surveyed(rows: DataFrame, k: int) -> DataFrame:
    """Written table of id, n, digest of every row, and (with n null) key, often: shingles that a batch holds
    often. Only the order of shingles depends on the latter, no result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, names = _Words(), ["id", "n", "digest", "key", "often"]
        for batch in batches:
            for part in slices(batch, 1, 4096, 1 << 23):
                sets = [shingles(t, k, known) for t in part.column(1).to_pylist()]
                digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in sets]
                none = pa.nulls(len(sets), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest, pa.binary()), none, none], names=names)
                keys, n = np.unique(np.concatenate(sets), return_counts=True)
                often = n >= 2
                keys, n = keys[often].view(np.int64), n[often].astype(np.int64)
                none = pa.nulls(len(keys), pa.int64())
                yield pa.RecordBatch.from_arrays([none, none, pa.nulls(len(keys), pa.binary()), pa.array(keys), pa.array(n)], names=names)

    return written(rows.mapInArrow(lambda batches: trimmed(run(batches)), "id bigint, n bigint, digest binary, key bigint, often bigint"), "survey")


def _hot(survey: DataFrame) -> np.ndarray:
    """Shingles of very many documents, sorted."""
    counts = survey.where("n IS NULL").groupBy("key").agg(F.sum("often").alias("n"))
    often = counts.where(F.col("n") > OFTEN).orderBy(F.desc("n"), "key").limit(HOT)
    return np.sort(np.array([r.key for r in often.collect()], np.int64).view(np.uint64))


def features(docs: DataFrame, hot: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """id, n, digest, prefix (shingles that come first), bits (bitmap)."""
    sent = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hot = _Words(), sent.value
        for batch in batches:
            for part in slices(batch, 1):
                n, digest, prefix, bits = [], [], [], []
                for text in part.column(1).to_pylist():
                    s = shingles(text, k, known)
                    n.append(len(s))
                    digest.append(xxhash.xxh3_128_digest(s.tobytes()))
                    bits.append(bitmap(s).tobytes())
                    first = len(s) + (num * len(s) // -den) + 1 if len(s) else 0
                    if len(hot) and first:
                        where = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
                        last = hot[where] == s
                        s = np.r_[s[~last], s[last]]
                    prefix.append(s[:first].view(np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.binary())], names=["id", "n", "digest", "prefix", "bits"])

    return docs.mapInArrow(lambda batches: trimmed(run(batches)), "id bigint, n bigint, digest binary, prefix array<bigint>, bits binary")


def _sent(df: DataFrame) -> DataFrame:
    """A narrow table, broadcast only if its counted rows are few enough; else joined by shuffle."""
    return F.broadcast(df) if df.count() <= SENT_IDS else df


def _grouped(groups: DataFrame, names: list[str], large: int, schema: str, work) -> DataFrame:
    """work(rows of one key, i, j) -> batches: names begin with these three, and a group's rows follow each other;
    large: place of the column of bytes. Groups of one row give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for batch in batches:
            for row in (r for part in slices(batch, large) for r in zip(*(c.to_pylist() for c in part.columns), strict=True)):
                if row[:3] != now:
                    if len(rows) > 1:
                        yield from work(rows)
                    rows, now = [], row[:3]
                rows.append(row)
        if len(rows) > 1:
            yield from work(rows)

    dealt = groups.select(*names).repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(lambda batches: trimmed(run(batches)), schema)


def _sides(rows: list[tuple]) -> list[tuple | None]:
    """The two sides of a group (key, i, j, side, id, n, bits, comp) as block_pairs takes them; none where it has no pair."""
    sides = []
    for side in (0, 1):
        own = [r for r in rows if r[3] == side]
        sides.append((np.array([r[4] for r in own], np.int64), np.array([r[5] for r in own], np.int64), [r[6] for r in own], np.array([r[7] for r in own], np.int64)) if own else None)
    return sides if sides[0] and (rows[0][1] == rows[0][2] or sides[1]) else [None, None]


def _walked(groups: DataFrame, num: int, den: int, best: bool) -> DataFrame:
    """groups: key, i, j (blocks), side, id, n, bits, comp. Returns candidate pairs key, a, b."""

    def pairs(rows):
        left, right = _sides(rows)
        for a, b in block_pairs(left, right, num, den, best) if left else ():
            for at in range(0, len(a), 50_000):
                x, y = a[at : at + 50_000], b[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), rows[0][0])), pa.array(x), pa.array(y)], names=["key", "a", "b"])

    return _grouped(groups, ["key", "i", "j", "side", "id", "n", "bits", "comp"], 6, "key bigint, a bigint, b bigint", pairs)


def _named(groups: DataFrame, num: int, den: int) -> DataFrame:
    """key, i, j, side, id, comp of those members of groups (see _walked; where they have a column first: a member's first
    buckets) that have a candidate of another component which no bucket before this one, a first one of both, names."""
    names = ["key", "i", "j", "side", "id", "n", "bits", "comp", *[c for c in groups.columns if c == "first"]]

    def members(rows):
        left, right = _sides(rows)
        of, before = {r[4]: r for r in rows}, {r[4]: frozenset(x for own in r[8:] for x in own if x < r[0]) for r in rows}
        for a, b in block_pairs(left, right, num, den, False) if left else ():
            ids = {x for p in zip(a.tolist(), b.tolist(), strict=True) if before[p[0]].isdisjoint(before[p[1]]) for x in p}
            own = [of[x] for x in sorted(ids)]
            if own:
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in own], k) for c, k in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32()), (3, pa.int32()), (4, pa.int64()), (7, pa.int64()))], names=["key", "i", "j", "side", "id", "comp"])

    return _grouped(groups, names, 6, "key bigint, i int, j int, side int, id bigint, comp bigint", members)


def reaches(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    """Whether two sorted sets reach the similarity."""
    if not len(p) or not len(q):
        return False
    common = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return den * common >= num * (len(p) + len(q) - common)


def _joined(named: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """u, v: links that tell components of named (see _named) together, fewer in a group than it has members. Every
    candidate of a group is verified on whole sets, save where links found in it have joined the two components."""

    def links(rows):
        held: dict[int, dict[bytes, np.ndarray]] = {}  # rows that repeat an id may have several sets
        for r in rows:
            held.setdefault(r[4], {})[r[6]] = np.frombuffer(r[6], np.uint64)
        sets, comp = {x: list(s.values()) for x, s in held.items()}, {r[4]: r[5] for r in rows}
        one_row = {r[4]: r for r in rows}
        left, right = _sides([(*one_row[x][:5], len(s), bitmap(s).tobytes(), comp[x]) for x, own in sets.items() for s in own if len(s)])
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = up.get(y, y)
                x = y
            return x

        found = []
        for a, b in block_pairs(left, right, num, den, False) if left else ():
            for x, y in zip(a.tolist(), b.tolist(), strict=True):
                one, two = root(comp[x]), root(comp[y])
                if one != two and any(reaches(p, q, num, den) for p in sets[x] for q in sets[y]):
                    up[max(one, two)] = min(one, two)
                    found.append((x, y))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array([x[c] for x in found], pa.int64()) for c in (0, 1)], names=["u", "v"])

    named = written(named, "named")
    groups = named.join(_whole(docs, named.select("id").distinct(), k), "id")
    return _grouped(groups, ["key", "i", "j", "side", "id", "comp", "s"], 6, "u bigint, v bigint", links)


def _whole(docs: DataFrame, ids: DataFrame, k: int) -> DataFrame:
    """Written table of id, s: whole sets."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for batch in batches:
            for part in slices(batch, 1):
                got = pa.array([shingles(t, k, known).tobytes() for t in part.column(1).to_pylist()], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), got], names=["id", "s"])

    return written(docs.join(_sent(ids), "id", "left_semi").select("id", "text").mapInArrow(lambda batches: trimmed(sets(batches)), "id bigint, s binary"), "sets")


def _verified(pairs: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs whose whole sets reach the similarity."""
    pairs = written(pairs.select("a", "b").distinct(), "pairs")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column(2), batch.column(3), strict=True)
            mask = pa.array([reaches(*(np.frombuffer(x.as_buffer(), np.uint64) for x in p), num, den) for p in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["u", "v"])

    whole = _whole(docs, ids, k)
    one = pairs.join(whole.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(whole.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    return two.select("a", "b", "sa", "sb").mapInArrow(lambda batches: trimmed(check(batches)), "u bigint, v bigint")


class _Buckets:
    """What both joins begin with: rows (seen: id, n, digest), their classes (digest, rep), classes that rows of one id
    fall into (same: u, v; None without such), and members of the chosen buckets (key, blocks, id, n, bits)."""

    def __init__(self, df: DataFrame, k: int, num: int, den: int, key: str, text: str):
        rows = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
        docs = rows.where(F.col("id").isNotNull())
        survey = _surveyed(rows, k)
        seen = survey.where("n IS NOT NULL").select("id", "n", "digest")
        some = seen.where("n > 0 AND id IS NOT NULL")
        classes = written(some.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
        # of each class only the representative's set goes on
        others = some.join(classes, "digest").where("id <> rep").select("id", "digest")
        same = None
        if some.groupBy("id").count().where("count > 1").limit(1).count():
            # the classes that rows of one id fall into are one vertex
            several = some.groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo <> hi").select("id")
            same = written(some.join(several, "id").join(classes, "digest").select(F.col("id").alias("u"), F.col("rep").alias("v")).distinct(), "same")
            reps = features(docs, _hot(survey), k, num, den).where("n > 0")
            reps = reps.join(written(others.distinct(), "others"), ["id", "digest"], "left_anti").dropDuplicates(["id", "digest"])
        else:
            reps = features(docs.join(_sent(written(others.select("id"), "others")), "id", "left_anti"), _hot(survey), k, num, den).where("n > 0")
        reps = written(reps, "reps")

        keys = reps.select("id", "n", F.xxhash64("id", "digest").alias("h"), F.explode("prefix").alias("key"))
        buckets = keys.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.bit_xor("h").alias("x"), F.sum("n").alias("size")).where("m > 1")
        blocks = F.ceil(F.greatest(F.col("m") / BLOCK, F.col("size") / BLOCK_SIZE)).cast("int").alias("blocks")
        chosen = written(buckets.groupBy("m", "x").agg(F.min("key").alias("key"), F.first("size").alias("size")).select("key", blocks), "buckets")
        members = keys.select("id", "key").join(_sent(chosen), "key")
        members = written(members.join(reps.select("id", "n", "bits"), "id"), "members")
        block = F.pmod(F.xxhash64("id"), "blocks").cast("int")
        self.docs, self.seen, self.classes, self.same, self.chosen, self.members, self.block = docs, seen, classes, same, chosen, members, block

    def dealt(self, known: DataFrame) -> DataFrame:
        """known: members with comp. Each member goes to the pair of its block with every block: once as the lower, once
        as the upper one."""
        known = known.withColumn("block", self.block)
        known = known.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return known.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), (F.col("block") > F.col("other")).cast("int").alias("side"), "id", "n", "bits", "comp", *[c for c in known.columns if c == "first"])


def join(df: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id: documents link when den * overlap >= num * union of their sets."""
    b = _Buckets(df, k, num, den, key, text)
    docs, seen, classes, same, chosen, members, block = b.docs, b.seen, b.classes, b.same, b.chosen, b.members, b.block

    first = members.select("key", block.alias("i"), block.alias("j"), F.lit(0).alias("side"), "id", "n", "bits", F.col("id").alias("comp"))
    likely = written(_walked(first, num, den, True), "likely")
    links = _verified(likely, docs, k, num, den)
    links = written(links if same is None else links.unionByName(same), "links")
    comps = written(components(links), "comps")

    # a bucket of one block that gave no candidate has none
    open_keys = likely.select("key").unionByName(chosen.where("blocks > 1").select("key")).distinct()
    known = members.join(_sent(written(open_keys, "open")), "key").join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")
    mixed = known.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi").select("key")
    known = written(known.join(_sent(written(mixed, "mixed")), "key"), "known")
    firsts = known.groupBy("id").agg(F.slice(F.sort_array(F.collect_set("key")), 1, FIRST).alias("first"))
    more = _joined(_named(b.dealt(known.join(firsts, "id")), num, den), docs, k, num, den)
    comps = components(links.unionByName(more))

    named = classes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    out = seen.select("id", "n", "digest").join(named, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id"))


def links(df: DataFrame, k: int = 5, num: int = 4, den: int = 5, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """All links, where join() only needs those that tell components apart: doc_id, class_id, n_links (how many other
    rows each links with; equal sets link), and the links between classes (a, b), each once. Ids must not repeat.

    Every candidate pair of different sets is verified, so a group of many near copies costs its pairs."""
    b = _Buckets(df, k, num, den, key, text)
    pairs = written(_verified(_walked(b.dealt(b.members.withColumn("comp", F.col("id"))), num, den, False), b.docs, k, num, den).distinct(), "links")
    some = b.seen.where("n > 0 AND id IS NOT NULL")
    sizes = written(some.groupBy("digest").agg(F.count(F.lit(1)).alias("size")).join(b.classes, "digest"), "sizes")
    both = pairs.select("u", "v").unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    beyond = both.join(sizes.select(F.col("rep").alias("v"), "size"), "v").groupBy(F.col("u").alias("rep")).agg(F.sum("size").alias("beyond"))
    named = sizes.join(beyond, "rep", "left").select("digest", "rep", (F.col("size") - 1 + F.coalesce("beyond", F.lit(0))).alias("n_links"))
    rows = b.seen.where("id IS NOT NULL").join(named, "digest", "left")
    out = rows.select(F.col("id").alias(key), F.when(F.col("n") > 0, F.col("rep")).otherwise(F.col("id")).alias("class_id"), F.when(F.col("n") > 0, F.col("n_links")).otherwise(0).alias("n_links"))
    return out, pairs.select(F.col("u").alias("a"), F.col("v").alias("b"))
