"""From raw documents to token ids: language, near copies, secrets, mixture, encoding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm import byte_bpe, lang_ecoc, secret_links, sigtree_join, soft_mix
from fidelis.llm._util import dropped, remainder, table, written
from fidelis.llm.queries import bpe_path

#: Expected token totals of the mixture, as shares of 1.05 times the tokens that there are.
MIXTURE, GROWTH = {"clean": 0.93, "low": 0.05, "toxic": 0.02}, 1.05


def _given(docs: DataFrame) -> DataFrame:
    """given (all columns but the text), doc_id, text: whatever an operator adds clashes with no column."""
    return docs.select(F.struct(*[c for c in docs.columns if c != "text"]).alias("given"), "doc_id", "text")


def _back(docs: DataFrame, **new: Column) -> list[Column]:
    """The columns of documents again, with new values of some."""
    return [new.get(c, F.col("text") if c == "text" else F.col("given")[c]).alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose two best languages are too close, go."""
    model = lang_ecoc.fit(docs.select("doc_id", "text", "lang"), remainder("doc_id", 4) != 2)
    got = lang_ecoc.identify(_given(docs), model)
    return got.where((F.col("lang_pred") != "und") & ~F.col("ambiguous")).select(*_back(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word similarity 0.8 stays: that of the smallest id (rows without an id come
    last, rows that repeat an id in an order of their own); documents without words all stay."""
    odd = docs.where("doc_id IS NULL").limit(1).count() or docs.groupBy("doc_id").count().where("count > 1").limit(1).count()
    if not odd:
        found = sigtree_join.join(docs.select("doc_id", "text"), k=5, num=4, den=5)
        gone = written(found.where("component_id <> doc_id").select("doc_id"), "gone")
        return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    # ids that don't tell rows apart: each row gets a number, kept in a table
    rows = written(docs.select(F.struct(*docs.columns).alias("given"), F.monotonically_increasing_id().alias("row")), "rows")
    found = written(sigtree_join.join(rows.select("row", "given.text"), k=5, num=4, den=5, key="row"), "groups")
    place = F.struct(F.col("given.doc_id").isNull().alias("none"), F.col("given.doc_id").alias("id"), "row")
    first = rows.join(found, "row").where("n_shingles > 0").groupBy("component_id").agg(F.min(place)["row"].alias("row")).select("row")
    return rows.join(first.unionByName(found.where("n_shingles = 0").select("row")), "row", "left_semi").select("given.*")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span found is masked in the text; no document goes."""
    got = secret_links.scan(_given(docs))
    found = F.size("spans") > 0
    text = F.when(found, secret_links.redacted(F.col("text"), F.col("spans"))).otherwise(F.col("text"))
    return got.select(*_back(docs, text=text, n_chars=F.when(found, F.length(text).cast("long")).otherwise(F.col("given.n_chars"))))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as its fitted rate says; one that is likelier clean than not at least once."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    words = docs.select(F.sum(F.size(soft_mix.tokens("text"))).alias("n")).first().n or 0
    mix, _ = soft_mix.fit(docs, labels, MIXTURE, total=GROWTH * words)
    got = soft_mix.rates(_given(docs), mix)
    least = F.lit(1)
    if "clean" in mix.domains:
        least = F.when(F.col("posteriors")[mix.domains.index("clean")] >= 0.5, 1).otherwise(0)
    n = soft_mix.copies(F.col("rate"), "doc_id", least)
    each = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return got.select("given", "text", F.explode(each)).select(*_back(docs))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens and ids of the whole text."""
    got = byte_bpe.encode(docs.select("doc_id", "lang", "source", "text"), bpe_path())
    return got.select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [("language ID", language), ("n-gram Jaccard join", near_copies), ("secret scans", secrets), ("mixing to target weights", mixture), ("byte-level BPE", token_ids)]

#: Language codes, set joins over hashes and BPE are beyond SQL: tests hold the pipeline against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs, f"stage{i}")
            if before is not None:
                dropped(before)
            before = docs
    return docs
