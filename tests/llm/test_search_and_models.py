import math
import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from fidelis.llm import ann_tree, cover_topk, lang_ecoc, suffix_lm, zdict_toxicity
from fidelis.llm._util import remainder

VECTORS = "vec_id long, embedding array<float>, label int, score string"


def vectors(spark, n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = (rng.normal(size=(n, 8)) + 3 * rng.normal(size=(10, 8))[rng.integers(0, 10, n)]).astype(np.float32)
    x[50:120] = x[50]  # copies
    rows = [(i, [float(v) for v in x[i]], 0, "a") for i in range(n)]
    odd = [(n, None, 0, "a"), (n + 1, [float("nan")] * 8, 0, "a"), (n + 2, [float("inf")] * 8, 0, "a"), (n + 3, [1.0, None] + [0.0] * 6, 0, "a"), (n + 4, [0.0] * 8, 0, "a"), (n + 5, [], 0, "a"), (None, rows[0][1], 0, "a"), rows[3]]
    return x, spark.createDataFrame(rows + odd, VECTORS)


def test_nearest(spark):
    x, df = vectors(spark)
    got = ann_tree.search(df, F.col("id") % 5 == 0, k=5).collect()
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(range(0, 400, 5))
    hits = 0
    for q, rows in by.items():
        s = u @ u[q]
        s[q] = -9
        true = np.lexsort((np.arange(400), -np.round(s, 12)))[:5]
        rows = sorted(rows, key=lambda r: r.rank)
        assert [r.rank for r in rows] == [1, 2, 3, 4, 5]
        assert all(abs(r.score - s[r.vec_id]) < 1e-9 for r in rows)
        hits += len(set(true) & {r.vec_id for r in rows})
    assert hits / (5 * len(by)) >= 0.9
    assert [r.vec_id for r in sorted(by[50], key=lambda r: r.rank)] == [51, 52, 53, 54, 55]


def test_exact_top(spark):
    x, df = vectors(spark)
    whole = np.vstack([np.floor(64 * x.astype(float)), np.zeros((1, 8))]).astype(int)
    ids = np.array([*range(400), 404])
    got = {}
    for r in cover_topk.search(df, F.col("id") % 4 == 0, k=7).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert set(got) == {i for i in ids.tolist() if i % 4 == 0}
    for q, ranks in got.items():
        at = int(np.flatnonzero(ids == q)[0])
        s, keep = whole @ whole[at], ids != q
        order = np.lexsort((ids[keep], -s[keep]))[:7]
        assert [ranks[i + 1] for i in range(7)] == [(int(ids[keep][o]), int(s[keep][o])) for o in order]


def test_trees_prune_clusters():
    """Exact, and few products are made where vectors lie in clusters."""
    rng = np.random.default_rng(0)
    middle = rng.normal(size=(64, 64)) * 8
    x = np.floor(8 * (middle[rng.integers(0, 64, 6000)] + 0.3 * rng.normal(size=(6000, 64))))
    x[5] = x[77] = 0
    q, k = x[::20], 21
    score, found = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    made = cover_topk.dual(cover_topk.CoverTree(q), cover_topk.CoverTree(x), np.arange(len(x)), score, found, np.full(len(q), -np.inf))
    all_ = q @ x.T
    order = np.lexsort((np.broadcast_to(np.arange(len(x)), all_.shape), -all_), axis=-1)[:, :k]
    assert (found == order).all() and (score == np.take_along_axis(all_, order, 1)).all()
    assert made < 0.15 * all_.size


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 0, "a"), (1, [0.0, 1.0], 0, "a")], VECTORS)
    for search in (ann_tree.search, cover_topk.search):
        assert [(r.query_id, r.vec_id) for r in search(few, F.col("id") >= 0, k=3).orderBy("query_id").collect()] == [(0, 1), (1, 0)]
        assert search(few.limit(0), F.col("id") >= 0, k=3).count() == 0


DOCS = "doc_id long, text string, lang string, source string, score string"
SAY = {"en": "the house and the river were of that", "de": "das haus und der fluss waren nicht schön", "fr": "la maison et la rivière étaient très belles", "es": "la casa y el río eran muy señor niño"}


def spoken(spark, n=160):
    rows = [(i, " ".join(np.random.default_rng(i).permutation(SAY[lang].split()).tolist() * (1 + i % 4)), lang, "s", "x") for i, lang in ((i, list(SAY)[i % 4]) for i in range(n))]
    return rows, spark.createDataFrame(rows + [(n, None, "en", "s", "x"), (n + 1, "", "en", "s", "x"), (n + 2, "123 !!", "en", "s", "x"), (n + 3, "the river " * 40_000, None, "s", "x"), (n + 4, SAY["de"], None, "s", "x")], DOCS)


def test_vectors_of_two_lengths(spark):
    """Of lengths that are equally common the longest takes part."""
    rows = [(i, [float(i), 1.0]) for i in range(6)] + [(10 + i, [float(i), 1.0, 2.0]) for i in range(6)] + [(20, [1.0]), (21, []), (22, None), (23, [1.0, float("nan"), 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = cover_topk.search(df, F.col("id") % 2 == 0, k=3, scale=1.0).collect()
    assert {r.query_id for r in got} == {10, 12, 14} and {r.vec_id for r in got} <= set(range(10, 16)) and len(got) == 9
    near = ann_tree.search(df, F.col("id") % 2 == 0, k=2).collect()
    assert {r.query_id for r in near} == {10, 12, 14} and {r.vec_id for r in near} <= set(range(10, 16))


def test_written_tables_are_cleared(spark):
    from fidelis.llm import _util

    kept = _util.written(spark.range(5), "x")
    gone = _util.written(spark.range(5), "y")
    _util.dropped(gone)
    assert kept.count() == 5 and not os.path.isdir(_util._MADE[-1].removeprefix("file://"))
    assert _util.cleared(spark) >= 2 and not _util._MADE


def test_languages(spark):
    rows, df = spoken(spark)
    model = lang_ecoc.fit(df, remainder("doc_id", 4) != 2)
    got = {r.doc_id: r for r in lang_ecoc.identify(df, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert held and all(got[r[0]].lang_pred == r[2] for r in held)
    assert [got[160 + i].lang_pred for i in range(5)] == ["und", "und", "und", "en", "de"]
    assert all(0 <= r.score <= 1 for r in got.values()) and got[160].source == "s"
    assert {r.lang_pred for r in lang_ecoc.identify(df, lang_ecoc.fit(df.limit(0), F.lit(True))).collect()} == {"und"}


def test_codewords_stay_apart():
    for n in (2, 4, 7, 12):
        code = lang_ecoc.codewords(n)
        gap = (code[:, None] != code[None]).sum(2)
        assert gap[np.triu_indices(n, 1)].min() >= code.shape[1] // 4


def test_grams_do_not_depend_on_blocks(monkeypatch):
    text = "Grüße an die Welt, " * 50
    whole = lang_ecoc.grams(text)
    monkeypatch.setattr(lang_ecoc, "_BLOCK", 17)
    assert np.allclose(whole, lang_ecoc.grams(text))


def test_suffix_tree(spark):
    base = [(i, " ".join(["New York is big and", "old London was small but", "New York is far"][(i + j) % 3] for j in range(1 + i % 5)), "en", "s", "x") for i in range(120)]
    rows = base + [(120, None, "en", "s", "x"), (121, "", "en", "s", "x"), (122, "unseen word \x0b x", "en", "s", "x"), base[0]]
    got = suffix_lm.score(spark.createDataFrame(rows, DOCS), remainder("doc_id", 10) != 0).collect()
    toks = {r[0]: [*(r[1] or "").encode().lower().split(), b""] for r in rows}
    counts = {}
    for r in rows:
        if zlib.crc32(str(r[0]).encode()) % 10:
            for t in toks[r[0]]:
                counts[t] = counts.get(t, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for r in got:
        own = toks[r.doc_id]
        assert r.n_tokens == len(own) and r.train_tokens == n and r.n_known == sum(t in counts for t in own)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (v + 1))) for t in own))
    assert len(got) == len(rows)
    assert sum(r.score for r in got) > sum(r.base_score for r in got) / 2  # contexts tell most of the next words


def test_finished_shuffles_leave_the_disk(spark, tmp_path):
    import time

    from fidelis.llm._util import released

    files = lambda: spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    spark.range(1000).repartition(7, "id").write.parquet(str(tmp_path / "t"))
    before = files()
    for _ in range(20):
        released(spark)
        time.sleep(0.2)
        if files() < before:
            break
    assert files() < before


def test_no_texts_to_score(spark):
    none = spark.createDataFrame([], DOCS)
    assert suffix_lm.score(none, F.lit(True)).count() == 0
    alone = spark.createDataFrame([(1, "a b", "en", "s", "x")], DOCS)
    got = suffix_lm.score(alone, F.lit(False)).first()
    assert got.train_tokens == 0 and got.n_known == 0 and got.score == pytest.approx(3 * math.log10(0.1 / 0.1))


def test_toxicity(spark):
    rng = np.random.default_rng(3)
    words = ["".join(p) for p in rng.choice(["ta", "re", "mi", "no", "lu", "ke", "so", "pi"], (300, 3))]
    rows, labels = [], []
    for i in range(400):
        body = rng.choice(words, 60).tolist()
        toxic = i % 4 == 0
        if toxic:
            body[10 + i % 40] = ["grumbledork", "snotwaffle"][i % 8 // 4]
            body[5] = ["grumbledork", "snotwaffle"][i % 8 // 4]
        rows.append((i, " ".join(body), "en", "s", "x"))
        labels.append((i, int(toxic), 1))
    df = spark.createDataFrame(rows + [(400, None, "en", "s", "x"), (401, "", "en", "s", "x")], DOCS)
    names = spark.createDataFrame(labels + [(0, 1, 1), (None, 1, 1), (7, None, 1)], "doc_id long, toxic int, quality int")
    model = zdict_toxicity.fit(df, names, remainder("doc_id", 4) != 2)
    got = {r.doc_id: r for r in zdict_toxicity.score(df, model).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([got[i].predicted == (i % 4 == 0) for i in held]) >= 0.95
    assert got[400].score == got[401].score and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got.values())
    assert {r.score for r in zdict_toxicity.score(df, zdict_toxicity.fit(df, names.limit(0), F.lit(True))).collect()} == {0.0}


def test_toxicity_threshold_of_all_labels(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = ["".join(p) for p in rng.choice(["ta", "re", "mi", "no", "lu", "ke", "so", "pi"], (300, 3))]
    kinds = []
    for i in range(2000):  # the word once: a toxic text of the sample, but mostly an ordinary one of the corpus
        toxic = i % 20 == 0
        times = (1 if i % 140 == 0 else 4) if toxic else int(rng.random() < 0.025)
        body = rng.choice(words, 100).tolist()
        for j in range(times):
            body[10 + 25 * j] = "grumbledork"
        kinds.append((i, toxic, times, " ".join(body)))
    # a label of a text that is longer than those of the sample counts for the threshold, too
    long = zdict_toxicity.LONGEST // 5
    df = spark.createDataFrame([(i, t) for i, _, _, t in kinds] + [(2000, " ".join(rng.choice(words, long)))], "doc_id long, text string")
    names = spark.createDataFrame([(i, int(toxic)) for i, toxic, _, _ in kinds] + [(2000, 0)], "doc_id long, toxic int")
    counted, own = [], zdict_toxicity.cut
    monkeypatch.setattr(zdict_toxicity, "cut", lambda bins: counted.append(sum(b["n"] for b in bins)) or own(bins))
    model = zdict_toxicity.fit(df, names, F.lit(True), toxic_rows=100, other_rows=100)
    assert counted == [2001]
    monkeypatch.setattr(zdict_toxicity, "SENT", 0)  # as with more labels than are broadcast
    assert zdict_toxicity.fit(df, names, F.lit(True), toxic_rows=100, other_rows=100)[2].tolist() == model[2].tolist()
    got = {r.doc_id: r.predicted for r in zdict_toxicity.score(df, model).collect()}
    assert np.mean([got[i] for i, toxic, times, _ in kinds if not toxic and times]) < 0.2
    assert np.mean([got[i] for i, toxic, times, _ in kinds if toxic and times > 1]) > 0.9


def test_toxicity_in_text_without_spaces():
    rng = np.random.default_rng(7)
    plain = "".join(chr(c) for c in rng.integers(0x4E00, 0x5E00, 400))
    bad = "坏得很的词语"
    gains = zdict_toxicity.Gains(("好 话 " * 200).encode(), bad.encode())
    for at in range(0, 300, 7):
        text = (plain[:at] + bad + plain[at:]).encode()
        assert any(bad.encode() in x for x in zdict_toxicity.windows(text)), at
        assert max(gains.word(w) for x in zdict_toxicity.windows(text) for w in zdict_toxicity.words(x)) > 3, at
    assert b"".join(zdict_toxicity.windows(b"ab " * 100)).replace(b" ", b"") == b"ab" * 100


def suffix_brute(rows, depth, least):
    """log10 scores by the definition, all in dictionaries."""
    toks = {i: [*t.encode().lower().split(), b""] for i, t in rows}
    counts = {}
    for i, x in toks.items():
        if zlib.crc32(str(i).encode()) % 10:
            for size in range(1, depth + 2):
                for j in range(len(x) - size + 1):
                    g = tuple(x[j : j + size])
                    counts[g] = counts.get(g, 0) + 1
    n, v = sum(c for g, c in counts.items() if len(g) == 1), sum(len(g) == 1 for g in counts)
    after = {}
    for g, c in counts.items():
        if len(g) > 1 and c >= least:
            after.setdefault(g[:-1], {})[g[-1]] = c
    kept = {}

    def prob(ctx, w):
        while ctx and ctx not in kept:
            ctx = ctx[1:]
        if not ctx:
            return (counts.get((w,), 0) + 0.1) / (n + 0.1 * (v + 1))
        add, back = kept[ctx]
        return back * prob(ctx[1:], w) + add.get(w, 0)

    for size in range(1, depth + 1):
        new = {}
        for ctx, following in after.items():
            if len(ctx) == size:
                total = counts[ctx]
                add = {w: (c - suffix_lm.DISCOUNT) / total for w, c in following.items()}
                back = max(1 - sum(add.values()), 1e-12)
                under = {w: prob(ctx[1:], w) for w in following}
                gain = sum(c * math.log((add[w] + back * under[w]) / under[w]) for w, c in following.items()) + (total - sum(following.values())) * math.log(back)
                if gain > 0.5 * len(following) * math.log(max(total, 2)):
                    new[ctx] = (add, back)
        kept.update(new)
    return {i: sum(math.log10(prob(tuple(x[max(0, j - depth) : j]), w)) for j, w in enumerate(x)) for i, x in toks.items()}, kept


def test_suffix_tree_grows_with_the_corpus(spark, monkeypatch):
    rng = np.random.default_rng(3)
    monkeypatch.setattr(suffix_lm, "CHUNK", 400_000)  # several chunks
    monkeypatch.setattr(suffix_lm, "ROW", 5_000)
    rows = []
    for i in range(700):  # 1.1 million tokens: 1e-5 of them is more than the least count
        rows.append((i, " ".join(f"w{k}" for k in rng.integers(0, 20_000, 1600)) + (" alpha beta gamma delta epsilon" if i % 50 == 0 else " delta x" if i % 3 else " beta gamma y")))
    df = spark.createDataFrame([(*r, "en", "s", "x") for r in rows], DOCS).repartition(3)
    got = {r.doc_id: r.score for r in suffix_lm.score(df, remainder("doc_id", 10) != 0).collect()}
    want, kept = suffix_brute(rows, suffix_lm.DEPTH, suffix_lm.LEAST)
    assert max(map(len, kept)) > 2 and (b"alpha",) in kept  # 13 of 1.0 million training tokens, and contexts of over two words
    assert got == {i: pytest.approx(w) for i, w in want.items()}
