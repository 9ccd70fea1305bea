"""Texts, sidecars, JSON sources and artifact sinks."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.functions.registry import MARKERS

#: Limits of requests: characters of a text, terms of a glossary, characters of a term.
TEXT_MOST, TERMS_MOST, TERM_MOST = 2 * 1024 * 1024, 200, 200


def _stem(path: Column, ending: str) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), ending, "")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (file stem), text of whole .md, .markdown and .txt files, glossary and revision files left out."""
    rows = spark.read.option("pathGlobFilter", "*.{md,markdown,txt}").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    rows = rows.where(~F.col("path").rlike(r"\.(glossary\.txt|humanized\.md)$"))
    return rows.select(_stem(F.col("path"), r"\.(md|markdown|txt)$").alias("doc_id"), "text")


def glossaries(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, glossary: terms of <stem>.glossary.txt in file order, without blank lines and # comments."""
    rows = spark.read.option("pathGlobFilter", "*.glossary.txt").text(folder, wholetext=True).select(_stem(F.col("_metadata.file_path"), r"\.glossary\.txt$").alias("doc_id"), "value")
    terms = F.transform(F.split("value", "\r?\n"), lambda t: F.trim(t))
    return rows.select("doc_id", F.filter(terms, lambda t: (t != "") & ~t.startswith("#")).alias("glossary"))


def revisions(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text of <stem>.humanized.md."""
    rows = spark.read.option("pathGlobFilter", "*.humanized.md").text(folder, wholetext=True)
    return rows.select(_stem(F.col("_metadata.file_path"), r"\.humanized\.md$").alias("doc_id"), F.col("value").alias("text"))


def corpus(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, text, glossary (null without a sidecar)."""
    return texts(spark, folder).join(glossaries(spark, folder), "doc_id", "left")


def markers(spark: SparkSession, path: str | None = None) -> DataFrame:
    """lang, family, ord, phrase: the built-in phrases, or those of a JSON file of the same shape."""
    data = MARKERS
    if path:
        data = json.loads(spark.read.text(path, wholetext=True).first().value)
    rows = [(lang, family, i, p) for lang, groups in data.items() if isinstance(groups, dict) for family, phrases in groups.items() for i, p in enumerate(phrases)]
    return spark.createDataFrame(rows, "lang string, family string, ord int, phrase string")


def prompts(spark: SparkSession, folder: str) -> DataFrame:
    """name, version, body of <name>.prompt.md files; the version stands in a block of --- lines at the start ("0" without)."""
    rows = spark.read.option("pathGlobFilter", "*.prompt.md").text(folder, wholetext=True).select(_stem(F.col("_metadata.file_path"), r"\.prompt\.md$").alias("name"), "value")
    front = F.regexp_extract("value", r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*\n", 1)
    version = F.trim(F.regexp_extract(front, r"(?m)^version:(.*)$", 1))
    return rows.select("name", F.when(version == "", "0").otherwise(version).alias("version"), F.regexp_replace("value", r"(?s)\A---[ \t]*\n.*?\n---[ \t]*\n", "").alias("body"))


def requests(rows: DataFrame) -> DataFrame:
    """rows: body (JSON text). Adds text, revised, glossary and error (null: valid): an object with a text that is
    not blank or too long, and a short enough glossary."""
    got = rows.withColumn("r", F.from_json("body", "text string, original string, revised string, glossary array<string>"))
    text = F.coalesce("r.text", "r.original")
    terms = F.coalesce("r.glossary", F.array().cast("array<string>"))
    object_ = F.trim("body").startswith("{") & F.col("r").isNotNull() & F.call_function("try_parse_json", F.col("body")).isNotNull()
    error = (
        F.when(F.octet_length("body") > TEXT_MOST, "body too large").when(~F.coalesce(object_, F.lit(False)), "not a JSON object").when(F.coalesce(F.trim(text), F.lit("")) == "", "no text")
        .when(F.length(text) > TEXT_MOST, "text too long").when(F.size(terms) > TERMS_MOST, "too many terms").when(F.exists(terms, lambda t: F.length(t) > TERM_MOST), "term too long")
    )
    return got.select(*rows.columns, text.alias("text"), F.col("r.revised").alias("revised"), terms.alias("glossary"), error.alias("error"))


def quarantine(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows and rejected ones."""
    return checked.where("error IS NULL").drop("error"), checked.where("error IS NOT NULL")


def write_artifacts(df: DataFrame, folder: str, name: str, run_id: str, kind: str = "json") -> None:
    """One artifact table of a run, in a partition of its own; run ids are unique, so runs never overwrite."""
    df.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").format(kind).save(f"{folder}/{name}")


REPORT = "# Report for {doc_id}\n\nstatus: {status}\nhard violations: {hard}\nsoft violations: {soft}\npreserved: {rate}\n"


def reports(gate: DataFrame) -> DataFrame:
    """doc_id, report: a short markdown report of each gate row."""
    status = F.when(F.col("passed"), "passed").otherwise("failed")
    text = F.lit(REPORT)
    for name, value in (("doc_id", F.col("doc_id").cast("string")), ("status", status), ("hard", F.col("hard").cast("string")), ("soft", F.col("soft").cast("string")), ("rate", F.format_string("%.1f%%", F.col("preserved_rate") * 100))):
        text = F.replace(text, F.lit("{" + name + "}"), value)
    return gate.select("doc_id", text.alias("report"))
