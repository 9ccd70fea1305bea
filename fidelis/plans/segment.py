"""Segmentation: lines, headings, fences, tables, references, sections, blocks, masks.

A document's lines become one array in its row (see reading); everything else is an expression over that array, so
nothing is shuffled and rows that repeat an id stay apart. Only assembling rewritten blocks groups by a key, which
holds the id and a hash of the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions import arrow
from fidelis.functions import text as tx
from fidelis.functions.registry import SECTIONS
from fidelis.operators import reading

LINES = "array<struct<n:int,start:int,line:string,kind:string,part:int,level:int,title:string,sec:int,refs:boolean>>"
BLOCKS = "array<struct<sec:int,block:int,kind:string,start:int,text:string>>"
#: Frozen shape of a text: what must not change.
SHAPE = "struct<headings:array<string>,tables:array<array<array<string>>>,codes:array<string>,refs:string>"


def section_type(title: Column) -> Column:
    lower, out = F.lower(F.trim(title)), None
    for name, words in SECTIONS:
        hit = F.lit(False)
        for w in words:
            hit = hit | lower.contains(w)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("general")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def parsed(docs: DataFrame) -> DataFrame:
    """doc_id, text, lines (see LINES)."""
    return arrow.added(_texts(docs), f"lines {LINES}", ["text"], lambda t: ([(n, *x) for n, x in enumerate(reading.lines(t))],))


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, n (line number), start, line, kind (code, table, references, heading, prose), part (number of the
    code block or table), level, title, sec (section number, 0 before the first heading), refs."""
    return parsed(docs).select("doc_id", F.explode("lines").alias("l")).select("doc_id", "l.*")


def masked(docs: DataFrame) -> DataFrame:
    """doc_id, text: frozen lines and headings blanked at equal length."""
    return arrow.added(_texts(docs), "masked string", ["text"], lambda t: (reading.masked(reading.lines(t)),)).select("doc_id", F.col("masked").alias("text"))


def headings(docs: DataFrame) -> DataFrame:
    """doc_id, n, level, title, heading."""
    return lines(docs).where("kind = 'heading'").select("doc_id", "n", "level", "title", F.concat_ws(" ", F.repeat(F.lit("#"), "level"), "title").alias("heading"))


def _shape_of(text: str) -> dict:
    heads, tables, codes, refs = reading.shape(reading.lines(text))
    return {"headings": heads, "tables": tables, "codes": codes, "refs": refs}


def shapes(docs: DataFrame) -> DataFrame:
    """doc_id, shape (see SHAPE)."""
    return arrow.added(_texts(docs), f"shape {SHAPE}", ["text"], lambda t: (_shape_of(t),)).select("doc_id", "shape")


def codes(docs: DataFrame) -> DataFrame:
    """doc_id, part, text of each fenced block."""
    return shapes(docs).select("doc_id", F.posexplode("shape.codes").alias("part", "text")).withColumn("part", F.col("part") + 1)


def table_rows(docs: DataFrame) -> DataFrame:
    """doc_id, part, n, cells of each table row that is no ruler and not blank."""
    rows = lines(docs).where("kind = 'table'")
    inner = F.regexp_replace(tx.stripped(F.col("line")), r"^\|+|\|+$", "")
    cells = F.transform(F.split(inner, r"\|", -1), tx.stripped)
    return rows.select("doc_id", "part", "n", cells.alias("cells")).where(F.exists("cells", lambda c: (c != "") & ~c.rlike(r"^:?-{2,}:?$")))


def tables(docs: DataFrame) -> DataFrame:
    """doc_id, part, rows (array of arrays of normalised cells)."""
    return shapes(docs).select("doc_id", F.posexplode("shape.tables").alias("part", "rows")).withColumn("part", F.col("part") + 1)


def references(docs: DataFrame) -> DataFrame:
    """doc_id, text of the references section with its heading."""
    refs = F.transform(F.filter("lines", lambda x: x["refs"]), lambda x: x["line"])
    return parsed(docs).select("doc_id", refs.alias("r")).where(F.size("r") > 0).select("doc_id", F.array_join("r", "\n").alias("text"))


def _sections(text: str) -> list[tuple]:
    out: list[tuple] = []
    for x in reading.lines(text):
        end = x.start + len(x.text)
        if out and out[-1][0] == x.sec:
            out[-1] = (*out[-1][:5], end)
        else:
            out.append((x.sec, x.title or "", x.level or 0, x.refs, x.start, end))
    return out


def sections(docs: DataFrame) -> DataFrame:
    """doc_id, sec, sec_id, title, level, section_type, frozen, start, end (code points)."""
    rows = arrow.added(_texts(docs), "s array<struct<sec:int,title:string,level:int,frozen:boolean,start:int,end:int>>", ["text"], lambda t: (_sections(t),))
    one = rows.select("doc_id", F.posexplode("s").alias("i", "s")).select("doc_id", (F.col("i") + 1).alias("i"), "s.*")
    return one.select("doc_id", "sec", F.format_string("sec-%03d", "i").alias("sec_id"), "title", "level", section_type(F.col("title")).alias("section_type"), "frozen", "start", "end")


def _blocks(text: str) -> list[tuple]:
    out: list[tuple] = []
    held: list[str] = []
    last = None
    for x in reading.lines(text):
        kind = x.kind if x.kind in ("prose", "heading") else "frozen"
        run = (x.sec, kind, (x.kind, x.part) if kind == "frozen" else None)
        if run != last:
            if held:
                out[-1] = (*out[-1], "\n".join(held))
            out.append((x.sec, len(out) + 1, kind, x.start))
            held, last = [], run
        held.append(x.text)
    return [*out[:-1], (*out[-1], "\n".join(held))]


def blocks(docs: DataFrame) -> DataFrame:
    """doc_id, row, sec, block, kind (heading, prose, frozen), start, text: runs of lines whose join by newlines is the
    document. row is a hash of the text: it tells documents of one id apart."""
    rows = arrow.added(_texts(docs), f"b {BLOCKS}", ["text"], lambda t: (_blocks(t),))
    return rows.select("doc_id", F.xxhash64("text").alias("row"), F.explode("b").alias("b")).select("doc_id", "row", "b.*")


def assembled(parts: DataFrame, replacements: DataFrame | None = None) -> DataFrame:
    """doc_id, text: the blocks put together, prose ones replaced where replacements (doc_id, row, block, text) has
    them. Documents that are equal in id and text give one row."""
    rows = parts.select("doc_id", "row", "block", "kind", "text")
    if replacements is not None:
        new = replacements.select(F.col("doc_id").alias("of"), F.col("row").alias("in"), F.col("block").alias("at"), F.col("text").alias("new"))
        rows = rows.join(new, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("row") == F.col("in")) & (F.col("block") == F.col("at")), "left")
        rows = rows.withColumn("text", F.when(F.col("kind") == "prose", F.coalesce("new", "text")).otherwise(F.col("text")))
    one = F.array_sort(F.array_distinct(F.collect_list(F.struct("block", "text"))))
    return rows.groupBy("doc_id", "row").agg(F.array_join(F.transform(one, lambda x: x["text"]), "\n").alias("text")).select("doc_id", "text")


def units(parts: DataFrame, least: int = 40) -> DataFrame:
    """Blocks worth rewriting: prose of some length."""
    return parts.where((F.col("kind") == "prose") & (F.length(tx.stripped(F.col("text"))) >= least))
