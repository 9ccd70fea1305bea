"""What a language model adds: merging its lock, mapping its review, and the fields of its replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis.functions import arrow
from fidelis.functions import text as tx
from fidelis.functions.registry import NUMERIC, VERDICT_RULES
from fidelis.operators import atoms, reading

# Kinds that a model may name for an atom (any other is a phrase), kinds and strengths of claims.
KINDS = {
    "number": "number", "percent": "percent", "amount": "amount", "date": "date", "range": "range", "count": "count", "p_value": "p_value", "significance": "significance",
    "coefficient": "coefficient", "citation": "citation_numbered", "citation_ay": "citation_ay", "url": "url", "doi": "doi", "term": "term", "variable": "variable",
    "method": "phrase", "condition": "phrase", "source": "phrase", "phrase": "phrase",
}
CLAIM_KINDS = ["finding", "conclusion", "causal", "attribution", "stance"]
STRENGTHS = ["strong", "moderate", "hedged", "neutral"]
LOCK_REPLY = "atoms array<struct<type:string,surface:string,context:string>>, claims array<struct<kind:string,strength:string,text:string>>"
REVIEW_REPLY = "claims array<struct<id:string,verdict:string,evidence:string>>, naturalness double, academic double, decision string"


def object_text(reply: Column) -> Column:
    """The reply without a code fence, from its first brace to its last."""
    bare = F.regexp_replace(reply, r"(?s)^\s*```[a-zA-Z]*\s*|\s*```\s*$", "")
    return F.regexp_extract(bare, r"(?s)\{.*\}", 0)


def parsed(replies: DataFrame, schema: str) -> DataFrame:
    """doc_id, reply (struct; null fields where the text is no such object), ok."""
    got = replies.withColumn("reply", F.from_json(object_text(F.col("reply")), schema))
    return got.withColumn("ok", F.col("reply").isNotNull() & (F.length(object_text(F.lit("{}"))) > 0))


def form_of(kind: str, surface: str) -> str:
    """The canonical form that extraction finds in a surface: of the same kind, else of any numeric kind where a numeric
    one is meant, else the surface itself."""
    found = reading.facts(surface)
    near = [f for f in found if f.kind == kind] or [f for f in found if kind in NUMERIC and f.kind in NUMERIC]
    return near[0].canonical if near else f"{kind.upper()}({surface})"


def added(text: str, locked: list[tuple], items: list | None) -> tuple[list[tuple], int]:
    """New atoms of a reply, and how many items were dropped for a surface that the text lacks. locked: seq, kind, surface
    and form of each atom so far."""
    squeezed = lambda x: "".join(x.split())
    flat = squeezed(text or "")
    surfaces, forms = {squeezed(a[2]) for a in locked}, {(a[1], a[3]) for a in locked}
    out, dropped, seq = [], 0, max([0, *(a[0] for a in locked)])
    for item in items or []:
        surface = ((item or {}).get("surface") or "").strip()
        if not surface or squeezed(surface) not in flat:
            dropped += 1
            continue
        kind = KINDS.get((item["type"] or "phrase").lower().strip(), "phrase")
        form = form_of(kind, surface)
        if squeezed(surface) in surfaces or (kind, form) in forms:
            continue
        seq += 1
        out.append((seq, f"a{seq:03d}", kind, surface, form, (surface if item["context"] is None else item["context"])[:200], -1, -1))
        surfaces.add(squeezed(surface))
        forms.add((kind, form))
    return out, dropped


def _proposed(text: str, locked: list | None, items: list | None) -> tuple[list[tuple], int]:
    return added(text, [(a["seq"], a["kind"], a["surface"], a["canonical"]) for a in locked or []], items)


def proposed(lock: DataFrame, replies: DataFrame, originals: DataFrame) -> DataFrame:
    """doc_id, new (atoms), dropped: what each reply (doc_id, reply parsed by LOCK_REPLY) adds to a document's lock."""
    one = lock.groupBy(F.col("doc_id").alias("in")).agg(F.collect_list(F.struct("seq", "kind", "surface", "canonical")).alias("locked"))
    rows = replies.select(F.col("doc_id").alias("of"), F.col("reply.atoms").alias("items"))
    # texts and locks grow with the corpus, however small the files are that they come from: never broadcast
    rows = originals.select("doc_id", "text").join(rows.hint("merge"), F.col("doc_id") == F.col("of")).join(one.hint("merge"), F.col("doc_id") == F.col("in"), "left")
    return arrow.added(rows, f"new {atoms.ATOMS}, dropped int", ["text", "locked", "items"], _proposed).select("doc_id", "new", "dropped")


def merged(lock: DataFrame, replies: DataFrame, originals: DataFrame) -> DataFrame:
    """The lock with a model's atoms appended: those whose surface stands in the original (white space apart) and that
    are not locked yet, by surface or by kind and form. Their places are -1; what extraction doesn't find of them is
    verified by containment."""
    new = proposed(lock, replies, originals).select("doc_id", F.explode("new").alias("a")).select("doc_id", "a.*")
    return lock.unionByName(new.select(*lock.columns))


def claims(replies: DataFrame) -> DataFrame:
    """doc_id, claim_id, kind (finding where none is given), strength (hedged unless known), text: claims of a known kind."""
    rows = replies.select("doc_id", F.posexplode("reply.claims").alias("i", "c"))
    kind, text = F.lower(tx.stripped(F.coalesce("c.kind", F.lit("finding")))), tx.stripped(F.coalesce("c.text", F.lit("")))
    rows = rows.select("doc_id", "i", kind.alias("kind"), F.lower(tx.stripped(F.col("c.strength"))).alias("strength"), text.alias("text")).where(F.col("kind").isin(CLAIM_KINDS) & (F.length("text") > 0))
    strength = F.when(F.col("strength").isin(STRENGTHS), F.col("strength")).otherwise("hedged")
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("i"))
    return rows.select("doc_id", F.format_string("c%03d", place).alias("claim_id"), "kind", strength.alias("strength"), "text")


def review_violations(reviews: DataFrame) -> DataFrame:
    """doc_id, rule, claim_id, evidence: hard rules of a judge's verdicts. reviews: doc_id, claim_id, verdict, evidence."""
    rules = F.create_map(*[F.lit(x) for pair in VERDICT_RULES.items() for x in pair])
    return reviews.withColumn("rule", F.try_element_at(rules, F.col("verdict"))).where("rule IS NOT NULL").select("doc_id", "rule", "claim_id", F.substring(F.coalesce("evidence", F.lit("")), 1, 160).alias("evidence"))


def unreviewed(registered: DataFrame, reviews: DataFrame) -> DataFrame:
    """doc_id, claim_id: registered claims that no verdict mentions."""
    return registered.select("doc_id", "claim_id").distinct().join(reviews.select("doc_id", "claim_id"), ["doc_id", "claim_id"], "left_anti")
