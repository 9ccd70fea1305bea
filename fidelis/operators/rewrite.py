"""Rewriting with a language model behind a small protocol: prompts, replies, the bounded repair loop.

A provider (see providers) has complete(prompt) -> str. It is asked for each document's lock (atoms and claims) and a diagnosis, for
each unit's new text, and for a review of each revision that passes the gate, whose verdicts on claims are hard
violations. Units are rewritten in parallel; a unit whose calls all fail keeps its text, a lock, diagnosis or review
that fails is left out, and a document whose revision fails gate or review after the repairs is given back as it was.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fidelis.functions import text as tx
from fidelis.operators import atoms, claims, style
from fidelis.operators.fidelity import Check
from fidelis.operators.providers import ConfigError, ProviderError
from fidelis.plans import segment
from fidelis.plans.durable import durable
from fidelis.sources import files


def fill(template: str, **values: str) -> str:
    """{{name}} places filled; a place without a value is an error."""
    places = set(re.findall(r"\{\{(\w+)\}\}", template))
    if lacking := places - set(values):
        raise ConfigError(f"no value for {sorted(lacking)}")
    return re.sub(r"\{\{(\w+)\}\}", lambda m: str(values[m[1]]), template)


def first_object(reply: str) -> dict:
    """The first JSON object in a reply, code fences and talk around it aside."""
    decoder = json.JSONDecoder()
    for m in re.finditer(r"\{", reply):
        try:
            got, _ = decoder.raw_decode(reply, m.start())
        except ValueError:
            continue
        if isinstance(got, dict):
            return got
    raise ProviderError("the reply holds no JSON object")


def ask(provider, prompt: str, attempts: int = 2) -> dict:
    """A reply's object; a reply without one is asked for again."""
    for left in range(attempts - 1, -1, -1):
        try:
            return first_object(provider.complete(prompt))
        except ProviderError:
            if not left:
                raise
    raise ProviderError("no attempt was allowed")


def asked(rows: DataFrame, provider: Callable[[], object], column: str = "prompt") -> DataFrame:
    """Adds reply (JSON text, null if every attempt failed) and error, calling the provider inside the tasks."""
    names = [*rows.columns, "reply", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = provider()
        for batch in batches:
            replies, errors = [], []
            for prompt in batch.column(column).to_pylist():
                try:
                    replies.append(json.dumps(ask(own, prompt or ""), ensure_ascii=False))
                    errors.append(None)
                except ProviderError as e:
                    replies.append(None)
                    errors.append(str(e))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=names)

    more = [T.StructField("reply", T.StringType()), T.StructField("error", T.StringType())]
    return rows.mapInArrow(run, T.StructType(rows.schema.fields + more))


PROMPT = (
    "Rewrite the text without changing any fact.\nlanguage: {{lang}}\nsection: {{section}}\nissues: {{issues}}\nlocked: {{locked}}\nclaims: {{claims}}\n"
    "instructions: {{instructions}}\ntext:\n{{text}}\nReply as JSON with rewritten_text."
)
LOCK_PROMPT = (
    "List what must survive a rewriting of the text unchanged and is not listed yet: quantities in words, terms, methods, conditions, sources, "
    "each as it stands in the text; and its claims, one statement each.\nlisted: {{locked}}\nglossary: {{glossary}}\ntext:\n{{text}}\n"
    f"Reply as JSON with atoms (type, surface, context) and claims (kind: {', '.join(claims.CLAIM_KINDS)}; strength: {', '.join(claims.STRENGTHS)}; text)."
)
DIAGNOSIS_PROMPT = "Diagnose what makes the text read unnaturally.\ntext:\n{{text}}\nReply as JSON with issues."
REVIEW_PROMPT = (
    "Judge whether the revised text keeps each claim of the original.\nclaims:\n{{claims}}\noriginal:\n{{original}}\nrevised:\n{{text}}\n"
    "Reply as JSON with claims (id, verdict: entailed, weakened, strengthened, contradicted, dropped or added_new; evidence), naturalness, academic, "
    "decision and repair_instructions."
)


#: The prompts by name; files.prompts() reads others of the same places.
PROMPTS = {"rewrite": PROMPT, "semantic-lock": LOCK_PROMPT, "diagnosis": DIAGNOSIS_PROMPT, "review": REVIEW_PROMPT}


def prompted(template: str, **values: Column) -> Column:
    """fill() by columns; nulls count as empty, and places that a value holds stay as they are."""
    parts = re.split(r"\{\{(\w+)\}\}", template)
    if lacking := set(parts[1::2]) - set(values):
        raise ConfigError(f"no value for {sorted(lacking)}")
    return F.concat(*[F.coalesce(values[x].cast("string"), F.lit("")) if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def enriched(normal: DataFrame, provider: Callable[[], object], prompts: dict[str, str] = PROMPTS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The lock with the model's atoms, its claims, and doc_id, locked (atoms), claims, issues for prompts."""
    lock = durable(atoms.extract(normal))
    listed = lock.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "surface"))), lambda x: x["surface"]).alias("surfaces"))
    rows = normal.join(listed, "doc_id", "left").where(F.length(F.trim("text")) > 0)
    told = prompted(prompts["semantic-lock"], locked=F.array_join("surfaces", "; "), glossary=F.array_join("glossary", "; "), text=F.col("text"))
    replies = durable(claims.parsed(asked(rows.select("doc_id", told.alias("prompt")), provider).select("doc_id", "reply"), claims.LOCK_REPLY))
    lock, registered = durable(claims.merged(lock, replies, normal)), durable(claims.claims(replies))
    found = durable(asked(rows.select("doc_id", prompted(prompts["diagnosis"], text=F.col("text")).alias("prompt")), provider).select("doc_id", F.get_json_object("reply", "$.issues").alias("issues")))
    held = lock.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("seq", "start", "kind", "surface"))).alias("locked"))
    lines = registered.groupBy("doc_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(" ", "claim_id", "kind", "strength", "text"))), "\n").alias("claims"))
    return lock, registered, durable(normal.select("doc_id").join(held, "doc_id", "left").join(lines, "doc_id", "left").join(found, "doc_id", "left"))


def reviewed(original: DataFrame, revised: DataFrame, notes: DataFrame, provider: Callable[[], object], prompts: dict[str, str] = PROMPTS) -> DataFrame:
    """doc_id, claim_id, verdict, evidence, advice: the judge's verdicts on the claims of the revised documents."""
    rows = revised.select("doc_id", "text").join(original.select("doc_id", F.col("text").alias("original")), "doc_id").join(notes.select("doc_id", "claims"), "doc_id", "left")
    told = prompted(prompts["review"], claims=F.col("claims"), original=F.col("original"), text=F.col("text"))
    # a text that is the original word for word keeps its claims
    replies = asked(rows.where("text <> original").select("doc_id", told.alias("prompt")), provider).select("doc_id", "reply")
    got = claims.parsed(replies, f"{claims.REVIEW_REPLY}, repair_instructions array<string>")
    one = got.select("doc_id", F.array_join("reply.repair_instructions", "; ").alias("advice"), F.explode("reply.claims").alias("c"))
    return one.select("doc_id", F.col("c.id").alias("claim_id"), F.lower(F.trim("c.verdict")).alias("verdict"), "c.evidence", "advice")


def claim_violations(verdicts: DataFrame) -> DataFrame:
    """The hard violations among verdicts, in the gate's columns."""
    rows = claims.review_violations(verdicts).join(verdicts.groupBy("doc_id").agg(F.max("advice").alias("advice")), "doc_id")
    detail = F.concat_ws(" ", "claim_id", "evidence", F.nullif("advice", F.lit("")))
    return rows.select("doc_id", "rule", F.lit("hard").alias("severity"), detail.alias("detail"), F.lit("").alias("before"), F.lit("").alias("after"))


def lock_slice() -> Column:
    """The locked facts that concern a unit: those that begin in its lines or, of a model's, stand in them, and terms,
    variables and phrases of the whole document."""
    end = F.col("start") + F.length("text")
    here = lambda x: F.when(x["start"] < 0, F.contains(F.col("text"), x["surface"])).otherwise((x["start"] >= F.col("start")) & (x["start"] < end))
    own = F.filter("locked", lambda x: here(x) | x["kind"].isin("term", "variable", "phrase"))
    return F.array_join(F.transform(own, lambda x: F.concat(x["kind"], F.lit(" "), x["surface"])), "; ")


def rewritten(units: DataFrame, provider: Callable[[], object], notes: DataFrame | None = None, prompts: dict[str, str] = PROMPTS) -> DataFrame:
    """units: doc_id, row, block, start, section_type, text, instructions; notes: doc_id, locked, claims, issues. New texts (doc_id, block, text)
    of units that got one; outer white space is the old text's."""
    none = F.lit("")
    known = {"issues": none, "locked": none, "claims": none}
    if notes is not None:
        units = units.join(notes, "doc_id", "left")
        known = {"issues": F.col("issues"), "locked": lock_slice(), "claims": F.col("claims")}
    prompt = prompted(prompts["rewrite"], lang=tx.language(F.col("text")), section=F.col("section_type"), instructions=F.col("instructions"), text=F.col("text"), **known)
    got = asked(units.select("doc_id", "row", "block", "text", prompt.alias("prompt")), provider).withColumn("new", F.from_json("reply", "rewritten_text string")["rewritten_text"])
    lead, trail = F.regexp_extract("text", r"^\s*", 0), F.regexp_extract("text", r"\s*$", 0)
    return got.where(F.length(F.trim("new")) > 0).select("doc_id", "row", "block", F.concat(lead, F.trim("new"), trail).alias("text"))


#: Ends every list of violations that a unit is sent back with.
FOOTER = "Change only what these violations call for, one by one; bring in no new number, citation or term."


def instructions(violations: DataFrame) -> DataFrame:
    """doc_id, instructions: one line for each hard violation, with excerpts of sixty characters, and FOOTER."""
    line = F.format_string("%s %s | %s | %s", "rule", "detail", F.substring("before", 1, 60), F.substring("after", 1, 60))
    rows = violations.where("severity = 'hard'").select("doc_id", line.alias("line"))
    return rows.groupBy("doc_id").agg(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n" + FOOTER)).alias("instructions"))


def affected(units: DataFrame, violations: DataFrame, current: DataFrame) -> DataFrame:
    """Units whose text, as it was or as it is now (current), holds the start of a hard violation's context on either
    side; all of a document where none does."""
    hard = violations.where("severity = 'hard'").select("doc_id", F.explode(F.array("before", "after")).alias("said")).select("doc_id", F.substring(tx.stripped(F.col("said")), 1, 40).alias("part"))
    quotes = hard.groupBy("doc_id").agg(F.collect_set(F.nullif("part", F.lit(""))).alias("parts"))
    now = current.select("doc_id", "row", "block", F.col("text").alias("now"))
    rows = units.join(quotes, "doc_id").join(now, ["doc_id", "row", "block"], "left")
    hit = F.exists("parts", lambda p: F.contains(F.col("text"), p) | F.contains(F.coalesce("now", F.lit("")), p))
    rows = rows.withColumn("hit", F.coalesce(hit, F.lit(False)))
    rows = rows.withColumn("some", F.bool_or("hit").over(Window.partitionBy("doc_id", "row")))
    return rows.where("hit OR NOT some").select(*units.columns)


def rewrite(docs: DataFrame, provider: Callable[[], object], repairs: int = 2, prompts: dict[str, str] | None = None, artifacts: tuple[str, str] | None = None) -> DataFrame:
    """doc_id, status (success, reverted), text, loops, unreviewed (claims of the lock that the last review names no
    verdict for). Each round is written, as a provider's replies may differ.

    prompts: in place of PROMPTS, by name. artifacts: a folder and a run's id, under which the run's tables are kept
    (original, lock, diagnosis, validation, review, revised_attempt, final, report)."""
    prompts = PROMPTS | (prompts or {})
    normal = atoms.normal_documents(docs)
    lock, registered, notes = enriched(normal, provider, prompts)
    parts = segment.blocks(normal)
    # a unit's section is that of the heading before it
    heads = segment.sections(normal).select("doc_id", "sec", "section_type").groupBy("doc_id", "sec").agg(F.first("section_type").alias("section_type"))
    units = segment.units(parts).join(heads, ["doc_id", "sec"], "left").select("doc_id", "row", "block", "start", "section_type", "text").withColumn("instructions", F.lit(""))
    current = durable(rewritten(units, provider, notes, prompts))
    loops = normal.select("doc_id", F.lit(0).alias("loops"))
    left = normal.select("doc_id")  # documents that changed since their last check
    verdicts = None
    for turn in range(repairs + 1):
        revised = durable(segment.assembled(parts, current))
        check = Check(docs, revised, lock)
        violations = durable(check.violations())
        failed = violations.where("severity = 'hard'").select("doc_id").distinct()
        asked_now = durable(reviewed(normal, revised.join(left, "doc_id", "left_semi").join(failed, "doc_id", "left_anti"), notes, provider, prompts))
        verdicts = asked_now if verdicts is None else durable(verdicts.join(left, "doc_id", "left_anti").unionByName(asked_now))
        violations = durable(violations.unionByName(claim_violations(asked_now)))
        bad = durable(violations.where("severity = 'hard'").select("doc_id").distinct())
        if turn == repairs or not bad.limit(1).count():
            break
        todo = affected(units.drop("instructions"), violations, current).join(instructions(violations), "doc_id")
        new = durable(rewritten(todo, provider, notes, prompts))
        old = current.join(new.select("doc_id", "row", "block"), ["doc_id", "row", "block"], "left_anti")
        current = durable(old.unionByName(new))
        loops = durable(loops.join(bad.withColumn("again", F.lit(1)), "doc_id", "left").select("doc_id", (F.col("loops") + F.coalesce("again", F.lit(0))).alias("loops")))
        left = bad
    silent = claims.unreviewed(registered, verdicts).groupBy("doc_id").agg(F.count(F.lit(1)).alias("unreviewed"))
    out = normal.select("doc_id", F.col("text").alias("original")).join(revised, "doc_id").join(bad.withColumn("bad", F.lit(True)), "doc_id", "left").join(loops, "doc_id").join(silent, "doc_id", "left")
    failed = F.coalesce("bad", F.lit(False))
    text = F.when(failed, F.col("original")).otherwise(F.col("text"))
    out = out.select("doc_id", F.when(failed, "reverted").otherwise("success").alias("status"), text.alias("text"), "loops", F.coalesce("unreviewed", F.lit(0)).alias("unreviewed"))
    if artifacts:
        out = durable(out)
        told = style.stats(normal).join(notes.select("doc_id", "issues"), "doc_id", "left")
        tables = {
            "original": normal.select("doc_id", "text"), "lock": lock, "claims": registered, "diagnosis": told, "validation": violations, "review": verdicts,
            "revised_attempt": revised, "final": out, "report": files.reports(check.gate()),
        }
        for name, table in tables.items():
            files.write_artifacts(table, artifacts[0], name, artifacts[1])
    return out
