"""Typed, canonical facts ("atoms") of documents.

Extraction reads each text once, inside Arrow batches (see reading): the passes claim characters, which no built-in
expression can carry from one pass to the next without copying what was found before. Nothing is shuffled or joined,
so rows that repeat an id, or have none, keep their own facts. All that follows are expressions over a row's arrays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.functions import arrow
from fidelis.functions import text as tx
from fidelis.operators import reading

_PLACE = "seq:int,atom_id:string,kind:string,surface:string,canonical:string,context:string,start:int,end:int"
ATOMS = f"array<struct<{_PLACE}>>"
_IDS = [f"a{i:03d}" for i in range(100)]


def normal_documents(docs: DataFrame) -> DataFrame:
    """doc_id, text (normalised), glossary."""
    glossary = F.col("glossary") if "glossary" in docs.columns else F.array().cast("array<string>")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), glossary.alias("glossary"))
    return tx.nfc(rows).withColumn("text", tx.normalized(F.col("text")))


def numbered(text: str, parsed: list[reading.Line], glossary: list | None, context: bool = True, every: bool = False) -> list[tuple]:
    """The atoms of a normalised text: seq, atom_id, kind, surface, canonical, context, start, end."""
    found = reading.facts(reading.masked(parsed), glossary or (), every)
    said = reading.contexts(text, [(f[3] + f[4]) // 2 for f in found]) if found and context else [""] * len(found)
    return [(i, _IDS[i] if i < len(_IDS) else f"a{i:03d}", kind, surface, form, sentence, start, end) for i, ((kind, surface, form, start, end), sentence) in enumerate(zip(found, said, strict=True), 1)]


def listed(docs: DataFrame, context: bool = True, every: bool = False) -> DataFrame:
    """Normalised documents with atoms: array of a document's distinct facts in order."""
    return arrow.added(normal_documents(docs), f"atoms {ATOMS}", ["text", "glossary"], lambda t, g: (numbered(t, reading.lines(t), g, context, every),))


def extract(docs: DataFrame, context: bool = True, every: bool = False) -> DataFrame:
    """doc_id, atom_id, seq, kind, surface, canonical, context, start, end: a document's distinct facts in order (every:
    facts of equal kind and form too, as their surfaces may differ).
    docs: doc_id, text, and optionally glossary (array of string). Null texts count as empty."""
    one = listed(docs, context, every).select("doc_id", F.explode("atoms").alias("a")).select("doc_id", "a.*")
    return one.select("doc_id", "atom_id", "seq", "kind", "surface", "canonical", "context", "start", "end")
