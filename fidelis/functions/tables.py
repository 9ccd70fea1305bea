"""SQL table functions: register(spark), then

    SELECT d.doc_id, a.* FROM documents d, LATERAL extract_atoms(d.text, d.glossary) a
    SELECT d.doc_id, b.* FROM documents d, LATERAL text_blocks(d.text) b
    SELECT d.doc_id, s.* FROM documents d, LATERAL text_sections(d.text) s

Texts are normalised first; null counts as empty.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from fidelis.operators import atoms, reading
from fidelis.plans import segment


def normalized(text: str | None) -> str:
    """One document as functions.text.nfc and normalized make it."""
    lines = re.split("\r\n|\r|\n", unicodedata.normalize("NFC", text or ""))
    body = "\n".join([*(x.rstrip(" \t") for x in lines[:-1]), lines[-1]])
    return re.sub("\n{3,}", "\n\n", body).strip("\n") + "\n" if text else ""


class ExtractAtoms:
    def eval(self, text: str, glossary: list):
        body = normalized(text)
        yield from atoms.numbered(body, reading.lines(body), glossary)


class TextBlocks:
    def eval(self, text: str):
        yield from segment._blocks(normalized(text))


class TextSections:
    def eval(self, text: str):
        yield from segment._sections(normalized(text))


FUNCTIONS = {
    "extract_atoms": (ExtractAtoms, atoms._PLACE.replace(":", " ")),
    "text_blocks": (TextBlocks, "sec int, block int, kind string, start int, text string"),
    "text_sections": (TextSections, "sec int, title string, level int, frozen boolean, start int, end int"),
}


def register(spark: SparkSession) -> None:
    for name, (of, schema) in FUNCTIONS.items():
        spark.udtf.register(name, udtf(of, returnType=schema.replace(",", ", ")))
