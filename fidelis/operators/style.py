"""Style statistics of documents: rhythm, templates, chains, connectives, openings, a style level."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions import text as tx
from fidelis.functions.registry import MARKERS


def rhythm(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, more columns of docs, language, chars, n_sentences, sentence_mean, sentence_sd, sentence_cv, n_paragraphs, paragraph_mean."""
    rows = docs.select("doc_id", *more, F.coalesce("text", F.lit("")).alias("text"))
    sizes = F.transform(tx.prose_sentences(F.col("text")), lambda s: F.length(s))
    paras = F.transform(tx.paragraphs(F.col("text")), lambda p: F.length(p))
    rows = rows.select("doc_id", *more, tx.language(F.col("text")).alias("language"), F.length("text").alias("chars"), sizes.alias("s"), paras.alias("p"))

    def total(column: str, of) -> Column:
        return F.aggregate(column, F.lit(0.0), lambda a, x: a + of(x.cast("double")))

    n, m = F.size("s"), F.size("p")
    rows = rows.withColumn("mean", F.when(n > 0, total("s", lambda x: x) / n).otherwise(0.0))
    rows = rows.withColumn("sd", F.when(n > 0, F.sqrt(total("s", lambda x: (x - F.col("mean")) * (x - F.col("mean"))) / n)).otherwise(0.0))
    cv = F.when(F.col("mean") > 0, F.col("sd") / F.col("mean")).otherwise(0.0)
    return rows.select("doc_id", *more, "language", "chars", n.alias("n_sentences"), F.col("mean").alias("sentence_mean"), F.col("sd").alias("sentence_sd"), cv.alias("sentence_cv"), m.alias("n_paragraphs"), F.when(m > 0, total("p", lambda x: x) / m).otherwise(0.0).alias("paragraph_mean"))


def _listed(family: str) -> list[tuple[str, str]]:
    return [(lang, p) for lang in MARKERS for p in MARKERS[lang][family]]


def _phrases(family: str) -> Column:
    return F.array(*[F.struct(F.lit(lang).alias("lang"), F.lit(i).alias("ord"), F.lit(p).alias("phrase")) for i, (lang, p) in enumerate(_listed(family))])


def template_hits(low: Column) -> Column:
    """Occurrences of the template phrases in a lower-cased text: one expression a phrase, so all is compiled."""
    return sum((tx.occurrences(low, F.lit(p.lower())) for _, p in _listed("template")), F.lit(0).cast("long"))


def hits(docs: DataFrame, family: str) -> DataFrame:
    """doc_id, lang, phrase, n, ord: occurrences of a family's phrases, in any letter case; ord is their order."""
    rows = docs.select("doc_id", F.lower("text").alias("low"))
    found = [F.struct(F.lit(lang).alias("lang"), F.lit(p).alias("phrase"), tx.occurrences(F.col("low"), F.lit(p.lower())).alias("n"), F.lit(i).alias("ord")) for i, (lang, p) in enumerate(_listed(family))]
    return rows.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x["n"] > 0)).alias("m")).select("doc_id", "m.*")


def density(docs: DataFrame) -> DataFrame:
    """doc_id, language, template_hits, template_density (per 1000 characters in zh, 1000 words in en), unit."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    rows = rows.select("doc_id", tx.language(F.col("text")).alias("language"), template_hits(F.col("low")).alias("template_hits"), F.length("text").alias("chars"), F.regexp_count("text", F.lit("[A-Za-z]+")).alias("words"))
    zh = F.col("language") == "zh"
    per = F.greatest(F.when(zh, F.col("chars")).otherwise(F.col("words")), F.lit(1))
    return rows.select("doc_id", "language", "template_hits", (F.col("template_hits") / per * 1000).alias("template_density"), F.when(zh, "1k_chars").otherwise("1k_words").alias("unit"))


def chains(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (from 1), markers: paragraphs that hold two chain markers or more (case as written)."""
    rows = docs.select("doc_id", F.posexplode(tx.paragraphs(F.coalesce("text", F.lit("")))).alias("i", "p"))
    words = F.array_sort(F.transform(_phrases("chain"), lambda m: m["phrase"]))
    got = F.filter(words, lambda w: F.contains(F.col("p"), w))
    return rows.select("doc_id", (F.col("i") + 1).alias("paragraph"), got.alias("markers")).where(F.size("markers") >= 2)


def connectives(docs: DataFrame) -> DataFrame:
    """doc_id, connective_top_share: the commonest connective's share of all; 0 without any."""
    found = hits(docs, "connective").groupBy("doc_id", "phrase").agg(F.sum("n").alias("n")).groupBy("doc_id").agg((F.max("n") / F.sum("n")).alias("share"))
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.coalesce("share", F.lit(0.0)).alias("connective_top_share"))


def openings(docs: DataFrame) -> DataFrame:
    """doc_id, opening_top_share (commonest opening over distinct openings), opening_share_true (over paragraphs)."""
    rows = docs.select("doc_id", F.explode(F.transform(tx.paragraphs(F.coalesce("text", F.lit(""))), tx.stripped)).alias("p")).where(F.length("p") >= 10)
    each = rows.groupBy("doc_id", F.substring("p", 1, 6).alias("o")).count()
    one = each.groupBy("doc_id").agg((F.max("count") / F.count(F.lit(1))).alias("a"), (F.max("count") / F.sum("count")).alias("b"))
    out = docs.select("doc_id").join(one, "doc_id", "left")
    return out.select("doc_id", F.coalesce("a", F.lit(0.0)).alias("opening_top_share"), F.coalesce("b", F.lit(0.0)).alias("opening_share_true"))


def level(density_: Column, cv: Column, language: Column) -> Column:
    high, middle = F.when(language == "zh", 5.0).otherwise(10.0), F.when(language == "zh", 2.5).otherwise(4.0)
    return F.when((density_ >= high) | ((density_ >= middle) & (cv < 0.35)), "high").when((density_ >= middle) | (cv < 0.35), "medium").otherwise("low")


def stats(docs: DataFrame) -> DataFrame:
    """All scalars of a document's style and its ai_style_level."""
    out = rhythm(docs).join(density(docs).drop("language"), "doc_id").join(connectives(docs), "doc_id").join(openings(docs), "doc_id")
    return out.withColumn("ai_style_level", level(F.col("template_density"), F.col("sentence_cv"), F.col("language")))


def diagnosis(docs: DataFrame) -> DataFrame:
    """doc_id, report: the rendered summary, rounded for reading, with the eight commonest template phrases."""
    top = hits(docs, "template").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "ord", "phrase", "n"))).alias("t"))
    rows = stats(docs).join(top, "doc_id", "left")
    listed = F.array_join(F.transform(F.slice(F.coalesce("t", F.array().cast(top.schema["t"].dataType)), 1, 8), lambda x: F.concat(x["phrase"], F.lit(" x"), x["n"].cast("string"))), ", ")
    return rows.select("doc_id", F.concat_ws("\n", F.concat(F.lit("style level: "), "ai_style_level"), F.format_string("sentences: %d, mean %.2f, sd %.2f, cv %.3f", "n_sentences", "sentence_mean", "sentence_sd", "sentence_cv"), F.format_string("templates: %d, %.2f per %s", "template_hits", "template_density", "unit"), F.concat(F.lit("phrases: "), listed)).alias("report"))
