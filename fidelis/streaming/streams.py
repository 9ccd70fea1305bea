"""The same operators on streams: style per document, drift over windows, and the gate on two joined streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.functions import text as tx
from fidelis.operators import style


def scored(stream: DataFrame) -> DataFrame:
    """Stateless: doc_id, ts, language, n_sentences, template_hits, template_density of each document."""
    rows = stream.select("doc_id", "ts", F.coalesce("text", F.lit("")).alias("text")).withColumn("low", F.lower("text"))
    text = F.col("text")
    rows = rows.select("doc_id", "ts", text, tx.language(text).alias("language"), style.template_hits(F.col("low")).alias("template_hits"))
    size = F.greatest(F.when(F.col("language") == "zh", F.length(text)).otherwise(F.regexp_count(text, F.lit("[A-Za-z]+"))), F.lit(1))
    return rows.select("doc_id", "ts", "language", F.size(tx.prose_sentences(text)).alias("n_sentences"), "template_hits", (F.col("template_hits") / size * 1000).alias("template_density"))


def drift(stream: DataFrame, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Documents, hits and mean density by language in event-time windows; later rows than the watermark go."""
    rows = scored(stream).withWatermark("ts", late)
    return rows.groupBy(F.window("ts", window, slide), "language").agg(F.count(F.lit(1)).alias("documents"), F.sum("template_hits").alias("template_hits"), F.avg("template_density").alias("template_density"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Revisions of an author in sessions: author, session, documents."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("session"), "author").agg(F.count(F.lit(1)).alias("documents"))


def paired(originals: DataFrame, revisions: DataFrame, within: str = "1 day", late: str = "1 day") -> DataFrame:
    """Originals (doc_id, ts, text) with the revisions that come within a time after them."""
    a = originals.withWatermark("ts", late).alias("a")
    b = revisions.withWatermark("ts", late).alias("b")
    near = (F.col("b.ts") >= F.col("a.ts")) & (F.col("b.ts") <= F.col("a.ts") + F.expr(f"interval {within}"))
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & near).select(F.col("a.doc_id"), F.col("a.ts").alias("ts"), F.col("a.text").alias("original"), F.col("b.text").alias("revised"))


def gated(pairs: DataFrame, sink: str, checkpoint: str):
    """Starts a query that validates each micro-batch of pairs and appends its gate rows to a Parquet folder."""
    from fidelis.operators.fidelity import Check

    def validate(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        Check(rows.select("doc_id", F.col("original").alias("text")), rows.select("doc_id", F.col("revised").alias("text"))).gate().write.mode("append").parquet(sink)
        rows.unpersist()

    return pairs.writeStream.foreachBatch(validate).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
