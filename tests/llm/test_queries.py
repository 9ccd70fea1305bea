"""The registered queries on whole small tables, against brute force."""

import hashlib
import math
import os
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from fidelis.llm import byte_bpe, queries, secret_links, suffix_lm, zdict_toxicity
from fidelis.llm._util import remainder
from test_search_and_models import suffix_brute
from test_text_operators import base_spans, brute

SF, SF10 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
RUN = queries.queries()


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def vectors(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    return {r.vec_id: np.array(r.embedding, float) for r in rows if r.embedding and all(v is not None and math.isfinite(v) for v in r.embedding)}


def held(doc_id, mod, rest):
    return zlib.crc32(str(doc_id).encode()) % mod == rest


def test_op1(spark, vectors):
    got = {}
    for r in RUN["op1_kmeans_tree"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    own = {i: v for i, v in vectors.items() if v.any()}
    asked, hit = [i for i in own if i % 50 == 0], 0
    assert set(got) == set(asked)
    for i in asked:
        cos = {j: float(own[i] @ v / np.sqrt(own[i] @ own[i]) / np.sqrt(v @ v)) for j, v in own.items() if j != i}
        mine = sorted(got[i])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(m[2] == pytest.approx(cos[m[1]], abs=1e-12) for m in mine)
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        hit += len({m[1] for m in mine} & set(sorted(cos, key=lambda j: (-cos[j], j))[:5]))
    assert hit >= 0.9 * 5 * len(asked)


def test_op2(spark, docs):
    got = {r.doc_id: r for r in RUN["op2_language_codes"](spark, SF).collect()}
    assert set(got) == set(docs)
    right = total = 0
    for i, r in got.items():
        assert r.held_out == held(i, 4, 2) and 0 <= r.score <= 1
        if not any(map(str.isalpha, docs[i].text or "")):
            assert r.lang_pred == "und"
        elif r.held_out and docs[i].lang:
            total += 1
            right += r.lang_pred == docs[i].lang
    assert total > 10 and right >= 0.9 * total


def test_op3(spark, vectors):
    got = {}
    for r in RUN["op3_cover_trees"](spark, SF).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    whole = {i: np.floor(64 * v).astype(np.int64) for i, v in vectors.items()}
    asked = [i for i in whole if i % 20 == 0]
    assert set(got) == set(asked)
    for i in asked:
        near = sorted((-int(whole[i] @ v), j) for j, v in whole.items() if j != i)[:20]
        assert sorted(got[i]) == [(n + 1, j, -s) for n, (s, j) in enumerate(near)]


def test_op4(spark, docs, monkeypatch):
    got = {r.doc_id: r for r in RUN["op4_suffix_tree"](spark, SF).collect()}
    want, kept = suffix_brute([(i, d.text or "") for i, d in docs.items()], suffix_lm.DEPTH, suffix_lm.LEAST)
    toks = {i: [*(d.text or "").encode().lower().split(), b""] for i, d in docs.items()}
    counts = {}
    for i, x in toks.items():
        for t in x if not held(i, 10, 0) else ():
            counts[t] = counts.get(t, 0) + 1
    n = sum(counts.values())
    assert kept and set(got) == set(docs)
    for i, r in got.items():
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(i, 10, 0), len(toks[i]), sum(t in counts for t in toks[i]), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts.get(t, 0) + 0.1) / (n + 0.1 * (len(counts) + 1))) for t in toks[i]))
        assert r.score == pytest.approx(want[i])


def test_op6_of_all_kinds(spark, tmp_path):
    texts = ["AKIA" + "A" * 16 + " then token=abcdefg and " + "0a" * 12, "secret=abcdefg secret=hijklmn", "0a" * 13 + " AKIA" + "B" * 17, None, "login: amy pwd=hunter22 AKIA" + "C" * 16]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex) for r in RUN["op6_secret_links"](spark, str(tmp_path)).collect()}
    assert got == {0: (1, 1, 1), 1: (2, 0, 0), 2: (0, 1, 1), 3: (0, 0, 0), 4: (0, 1, 0)}


@pytest.mark.skipif(not os.path.isdir(SF10), reason="no test data")
def test_op6(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF10}/documents.parquet").collect()}
    got = {r.doc_id: r for r in RUN["op6_secret_links"](spark, SF10).collect()}
    assert set(got) == set(docs) and any(r.n_assign for r in got.values()) and not all(r.n_access for r in got.values())
    for i, r in got.items():
        spans = base_spans(docs[i].text)
        kinds = [s.split(":")[0] for s in spans.split(",") if s]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(spans.encode()).hexdigest()
        mine = [s for s in r.spans.split(",") if s]
        assert [s for s in mine if s.split(":")[0] in secret_links.BASE] == [s for s in spans.split(",") if s]
        # a weak span stands only where a part that completes it lies in its scope
        weak = linked_brute(docs[i].text or "")
        assert [s for s in mine if s.split(":")[0] not in secret_links.BASE] == weak


def linked_brute(text):
    flat = []
    for order, (kind, (role, pattern)) in enumerate(secret_links.KINDS.items()):
        for m in re.finditer(pattern, text, re.ASCII):
            if kind != "assign" or len(m[2]) >= 6:
                flat.append((m.start(), order, m.end(), kind, role))
    out = []
    for a, order, b, kind, role in sorted(flat):
        near = any(other in secret_links.COMPLETES[role] and x <= b + secret_links.SCOPE and y >= a - secret_links.SCOPE for x, _, y, _, other in flat)
        if order >= len(secret_links.BASE) and near:
            out.append(f"{kind}:{a}:{b}")
    return out


def test_op7(spark, docs):
    ids = sorted(docs)
    want = brute([docs[i].text for i in ids], 4, 85, 100)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in RUN["op7_signature_trees"](spark, SF).collect()}
    assert got == {ids[i]: (n, ids[c]) for i, (n, c) in want.items()}


def test_op8(spark, docs):
    got = RUN["op8_soft_mixing"](spark, SF).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    names = [c for c in got[0].asDict() if c.startswith("p_")]
    p, n, rate = np.array([[r[c] for c in names] for r in got]), np.array([r.n_tokens for r in got]), np.array([r.rate for r in got])
    assert all(r.n_tokens == len(re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id].text or "")) for r in got)
    assert np.allclose(p.sum(1), 1) and (rate >= 0).all() and names
    # no other nonnegative rates come closer: the gap is nil, or the projected gradient is
    from fidelis.llm.soft_mix import TARGETS

    share = np.array([TARGETS[c[2:]] for c in names])
    gap = (n * rate) @ p - share / share.sum() * n.sum()
    slope = n * (p @ gap)
    assert abs(gap).max() <= 1e-3 * n.sum() or (slope[rate == 0] >= -1e-6 * abs(slope).max()).all()


@pytest.mark.skipif(not os.path.isdir(SF10), reason="no test data")
def test_op9(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF10}/documents.parquet").collect()}
    labels = {}
    for r in spark.read.parquet(f"{SF10}/labels.parquet").collect():
        if r.toxic is not None:
            labels[r.doc_id] = max(r.toxic, labels.get(r.doc_id, 0))
    got = {r.doc_id: r for r in RUN["op9_zdict_toxicity"](spark, SF10).collect()}
    assert set(got) == set(texts)
    for i, r in got.items():
        assert r.held_out == held(i, 4, 2) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    known = {i: y for i, y in labels.items() if i in got and got[i].held_out}
    right = [got[i].predicted == y for i, y in known.items()]
    taken = [y for i, y in known.items() if got[i].predicted]
    assert len(known) > 50 and np.mean(right) >= 0.9 and np.mean(taken) >= 0.8
    # scores by plain compression of every window and word, one after another
    rows = spark.read.parquet(f"{SF10}/documents.parquet").select("doc_id", "text")
    model = zdict_toxicity.fit(rows, spark.read.parquet(f"{SF10}/labels.parquet").select("doc_id", "toxic"), remainder("doc_id", 4) != 2)
    ordinary, toxic, w = model
    size = lambda content, x: len(zdict_toxicity.compressor(content)(x))
    gain = lambda x: size(ordinary + toxic[::-1], x) - size(ordinary + toxic, x)
    for i in sorted(texts)[:25]:
        low = (texts[i] or "").lower().encode("utf-8", "replace")[:4000]
        counts, n = [0] * 12, 0
        for x in zdict_toxicity.windows(low):
            n += 1
            if (g := gain(x)) > 0:
                counts[: min(g, 6)] = [c + 1 for c in counts[: min(g, 6)]]
                for word in zdict_toxicity.words(x):
                    pieces = [word[k : k + 64] for k in range(0, max(1, len(word) - 32), 32)]
                    if (h := max(gain(ordinary[-96:-32] + p) for p in pieces)) > 0:
                        counts[6 : 6 + min(h, 6)] = [c + 1 for c in counts[6 : 6 + min(h, 6)]]
        assert np.allclose(zdict_toxicity.Gains(ordinary, toxic).of(low.decode("utf-8", "ignore")), np.log1p([*counts, n])) or low.decode("utf-8", "ignore").encode() != low


def test_op10(spark, docs):
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    got = {r.doc_id: r for r in RUN["op10_byte_bpe"](spark, SF).collect()}
    assert set(got) == set(docs)
    for i, r in got.items():
        ids = own.encode_ordinary(docs[i].text or "")
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((docs[i].text or "").encode()).hexdigest()


def test_pipeline(spark, docs):
    """All stages over whole documents: who stays, what is masked, what is encoded."""
    got = corpus_pipeline.run(spark, SF).collect()
    langs = {r.doc_id: r for r in RUN["op2_language_codes"](spark, SF).collect()}
    ids = sorted(i for i, r in langs.items() if r.lang_pred != "und" and not r.ambiguous)
    groups = brute([docs[i].text for i in ids], 5, 4, 5)
    kept = {ids[i] for i, (_, c) in groups.items() if c == i}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    assert {r.doc_id for r in got} <= kept and len({r.doc_id for r in got}) >= 0.8 * len(kept)
    for r in got:
        text = own.decode(r.ids)
        assert r.n_tokens == len(r.ids) and (r.lang, r.source) == (docs[r.doc_id].lang, docs[r.doc_id].source)
        assert base_spans(text) == "" and ("[REDACTED]" in text or text == docs[r.doc_id].text)
