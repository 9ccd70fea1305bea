"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm import ann_tree, byte_bpe, cover_topk, host_paths, lang_ecoc, secret_links, sigtree_join, soft_mix, suffix_lm, zdict_toxicity
from fidelis.llm._util import remainder, table


def bpe_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_kmeans_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann_tree.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


def op2_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_ecoc.fit(docs, remainder("doc_id", 4) != 2)
    got = lang_ecoc.identify(docs.select("doc_id", "text"), model)
    return got.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score", "ambiguous")


def op3_cover_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cover_topk.search(table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0, k=20)


def op4_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = suffix_lm.score(docs, remainder("doc_id", 10) != 0)
    return got.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op5_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = host_paths.extract(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op6_secret_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = secret_links.scan(docs, keep_text=False)

    def count(order: int) -> F.Column:
        return F.size(F.filter("spans", lambda s: s["ord"] == order)).cast("long")

    n = {k: count(i).alias(f"n_{k}") for i, k in enumerate(secret_links.BASE)}
    base = F.sha2(secret_links.as_text(secret_links.base_only(F.col("spans"))), 256).alias("base_sha256")
    return got.select("doc_id", *n.values(), base, secret_links.as_text(F.col("spans")).alias("spans"))


def op7_signature_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sigtree_join.join(docs, k=4, num=85, den=100)


def op8_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    mix, rows = soft_mix.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic"))
    shares = [F.col("_p")[i].alias(f"p_{d}") for i, d in enumerate(mix.domains)]
    return rows.select("doc_id", F.col("_n").alias("n_tokens"), *shares, soft_mix.rate(mix.steps).alias("rate"))


def op9_zdict_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = zdict_toxicity.fit(docs, labels, remainder("doc_id", 4) != 2)
    got = zdict_toxicity.score(docs, model)
    return got.select("doc_id", (remainder("doc_id", 4) == 2).alias("held_out"), "score", "predicted")


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    got = byte_bpe.round_trip(docs, bpe_path())
    return got.select("doc_id", "n_tokens", F.sha2("ids_le", 256).alias("ids_sha256"), "decoded_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_kmeans_tree, op2_language_codes, op3_cover_trees, op4_suffix_tree, op5_host_paths, op6_secret_links, op7_signature_trees, op8_soft_mixing, op9_zdict_toxicity, op10_byte_bpe)}


#: Brute force: all pairs of a query and a vector.
OP3_SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.e, v.e)::BIGINT AS score FROM v q JOIN v ON q.vec_id % 20 = 0 AND q.vec_id <> v.vec_id
)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20
"""

#: All pairs of different sets that share a shingle, then the smallest id that links reach.
OP7_SQL = """
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS l FROM documents
), s AS (
    SELECT DISTINCT doc_id, array_to_string(l[i:i + 3], ' ') AS g FROM (SELECT doc_id, l, unnest(range(1, greatest(len(l) - 3, 1) + 1)) AS i FROM w WHERE len(l) > 0)
), d AS (
    SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM s GROUP BY doc_id
), c AS (
    SELECT doc_id, n, min(doc_id) OVER (PARTITION BY h) AS rep FROM d
), r AS (
    SELECT s.doc_id, g, n FROM s JOIN c ON s.doc_id = c.rep AND c.doc_id = c.rep
), o AS (
    SELECT a.doc_id AS u, b.doc_id AS v, a.n AS nu, b.n AS nv, count(*) AS k FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL
), e AS (
    SELECT u, v FROM o WHERE 100 * k >= 85 * (nu + nv - k)
), f AS (
    SELECT u, v FROM e UNION ALL SELECT v, u FROM e
), t AS (
    SELECT rep AS u, rep AS root FROM c GROUP BY rep UNION SELECT f.v, t.root FROM t JOIN f ON f.u = t.u
), m AS (
    SELECT u, min(root) AS root FROM t GROUP BY u
)
SELECT documents.doc_id, coalesce(c.n, 0)::BIGINT AS n_shingles, coalesce(m.root, documents.doc_id) AS component_id FROM documents LEFT JOIN c ON c.doc_id = documents.doc_id LEFT JOIN m ON m.u = c.rep
"""


def op6_sql() -> str:
    """Matches and what lies between them by kind, then weak spans that a completing part stands near."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    one = "SELECT doc_id, {o} AS ord, {k} AS kind, {r} AS role, regexp_extract_all(text, {p}, 0) AS hits, string_split_regex(text, {p}) AS gaps, {p} AS pattern FROM t"
    kinds = " UNION ALL ".join(one.format(o=o, k=quoted(k), r=quoted(role), p=quoted(p)) for o, (k, (role, p)) in enumerate(secret_links.KINDS.items()))
    pairs = ", ".join(f"({quoted(r)}, {quoted(o)})" for r, others in secret_links.COMPLETES.items() for o in others)
    base, scope = len(secret_links.BASE), secret_links.SCOPE
    counts = ", ".join(f"count(*) FILTER (ord = {i}) AS n_{k}" for i, k in enumerate(secret_links.BASE))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), k AS ({kinds}), h AS (
    SELECT doc_id, ord, kind, role, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM k WHERE len(hits) > 0
), m AS (
    SELECT *, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, ord ORDER BY i)::BIGINT AS b FROM h
), p AS (
    SELECT doc_id, ord, kind, role, b - length(hit) AS a, b, kind || ':' || (b - length(hit)) || ':' || b AS span FROM m
    WHERE ord > 0 OR length(regexp_extract(hit, {quoted(secret_links.ASSIGN)}, 2)) >= 6
), f AS (
    SELECT * FROM p WHERE ord < {base} OR EXISTS (SELECT 1 FROM p q WHERE q.doc_id = p.doc_id AND (p.role, q.role) IN ({pairs}) AND q.a <= p.b + {scope} AND q.b >= p.a - {scope})
), g AS (
    SELECT doc_id, {counts}, string_agg(span, ',' ORDER BY a, ord) FILTER (ord < {base}) AS base, string_agg(span, ',' ORDER BY a, ord) AS spans FROM f GROUP BY doc_id
)
SELECT t.doc_id, {", ".join(f"coalesce(n_{k}, 0)::BIGINT AS n_{k}" for k in secret_links.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN g USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_cover_trees": OP3_SQL, "op6_secret_links": op6_sql(), "op7_signature_trees": OP7_SQL}
