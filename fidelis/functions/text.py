"""Value and document normalisation, numerals, language and sentences, as Column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.registry import BIG, DIGITS, NARROW, UNITS, WIDE

_NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)$"


def nfc(df: DataFrame, column: str = "text") -> DataFrame:
    """Replaces the column by its NFC form. Spark has no such function: texts that are not plain ASCII go
    through Arrow batches, the others pass."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [t if t is None or t.isascii() else unicodedata.normalize("NFC", t) for t in batch.column(at).to_pylist()]
            yield batch.set_column(at, batch.schema.field(at), pa.array(new, batch.schema.field(at).type))

    return df.mapInArrow(run, df.schema)


def normalized(text: Column) -> Column:
    """One newline form, no blanks before it, one empty line at most, no outer empty lines, one newline last."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n|\r", "\n"), "[ \t]+\n", "\n")
    body = F.regexp_replace(F.regexp_replace(lines, "\n{3,}", "\n\n"), r"^\n+|\n+\z", "")
    return F.when(F.length(text) > 0, F.concat(body, F.lit("\n"))).otherwise(text)


def narrow(value: Column) -> Column:
    return F.translate(value, WIDE, NARROW)


def number(value: Column, places: int = 0) -> Column:
    """A number in text (thousands separators dropped) with its point moved right by so many places, in its shortest
    plain notation: exact at any length, null if it is none."""
    digits = F.trim(F.replace(narrow(value), F.lit(","), F.lit("")))
    whole, part = F.regexp_extract(digits, r"^[+-]?([0-9]*)", 1), F.regexp_extract(digits, r"\.([0-9]*)$", 1)
    if places > 0:
        long = F.rpad(part, F.greatest(F.length(part), F.lit(places)), "0")
        whole, part = F.concat(whole, F.substring(long, 1, places)), F.substring(long, F.lit(places + 1), F.length(long))
    elif places < 0:
        wide = F.concat(F.lit("0" * -places), whole)
        whole, part = F.left(wide, F.length(wide) + places), F.concat(F.right(wide, F.lit(-places)), part)
    whole, part = F.regexp_replace(whole, "^0+", ""), F.regexp_replace(part, "0+$", "")
    sign = F.when(digits.startswith("-"), "-").otherwise("")
    shown = F.concat(sign, F.when(whole == "", "0").otherwise(whole), F.when(part == "", "").otherwise(F.concat(F.lit("."), part)))
    return F.when(digits.rlike(_NUMBER), F.when((whole == "") & (part == ""), "0").otherwise(shown))


def zh_number(value: Column) -> Column:
    """Value of a Chinese numeral; null when any other character occurs or there is none."""

    def lookup(table: dict[str, int]) -> Column:
        return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])

    digits, units, big = lookup(DIGITS), lookup(UNITS), lookup(BIG)
    zero = F.lit(0).cast("long")
    begin = F.struct(zero.alias("total"), zero.alias("section"), zero.alias("current"), F.lit(True).alias("pure"))

    def step(a: Column, c: Column) -> Column:
        d, u, b = (F.try_element_at(t, c).cast("long") for t in (digits, units, big))
        one = F.when(a["current"] == 0, 1).otherwise(a["current"])
        return F.struct(
            F.when(b.isNotNull(), a["total"] + (a["section"] + a["current"]) * b).otherwise(a["total"]).alias("total"),
            F.when(b.isNotNull(), zero).when(u.isNotNull(), a["section"] + one * u).otherwise(a["section"]).alias("section"),
            F.when(d.isNotNull(), d).otherwise(zero).alias("current"),
            (a["pure"] & (d.isNotNull() | u.isNotNull() | b.isNotNull())).alias("pure"),
        )

    end = lambda a: F.when(a["pure"], a["total"] + a["section"] + a["current"])
    return F.when(F.length(value) > 0, F.aggregate(F.split(value, ""), begin, step, end))


def squeezed(value: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(value, r"(?U)\s+", "")


def cell(value: Column) -> Column:
    """White space as single spaces, trimmed."""
    return F.trim(F.regexp_replace(value, r"(?U)\s+", " "))


def stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")


def language(text: Column) -> Column:
    """zh if at least a tenth of the characters are Han (U+4E00 to U+9FFF), else en."""
    han = F.length(F.regexp_replace(text, "[^一-鿿]", ""))
    return F.when(han / F.greatest(F.length(text), F.lit(1)) >= 0.1, "zh").otherwise("en")


def sentences(text: Column) -> Column:
    """Pieces after sentence marks, newlines, and full stops between a letter and white space; offsets need all
    pieces, so blank ones stay: see prose_sentences()."""
    return F.split(text, "(?<=[。！？；!?;\n])|(?<=\\p{L}\\.)(?=[ \n])", -1)


def prose_sentences(text: Column) -> Column:
    return F.filter(sentences(text), lambda s: F.length(stripped(s)) > 0)


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, "\n{2,}", -1), lambda p: F.length(stripped(p)) > 0)


def occurrences(text: Column, phrase: Column) -> Column:
    """Non-overlapping occurrences of a phrase."""
    return ((F.length(text) - F.length(F.replace(text, phrase, F.lit("")))) / F.length(phrase)).cast("long")


def located(pieces: Column) -> Column:
    """Pieces laid end to end as (start, end, text)."""
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out"))

    def step(a: Column, p: Column) -> Column:
        end = a["at"] + F.length(p)
        return F.struct(end.alias("at"), F.concat(a["out"], F.array(F.struct(a["at"].alias("start"), end.alias("end"), p.alias("text")))).alias("out"))

    return F.aggregate(pieces, begin, step, lambda a: a["out"])
