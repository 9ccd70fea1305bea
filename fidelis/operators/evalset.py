"""Evaluation of revisions: thresholds, scores, dose response, coverage, regressions, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions import arrow, edits
from fidelis.functions import text as tx
from fidelis.functions.registry import HARD_RULES, THRESHOLDS
from fidelis.operators import style


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance over the longer length, 0 for two empty texts."""
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def block_distance(a: Column, b: Column) -> Column:
    """edit_distance() with each paragraph held against that of the same place: at most too large (where paragraphs moved),
    and for long texts the sum of small squares instead of one large one."""
    steps = F.zip_with(tx.paragraphs(a), tx.paragraphs(b), lambda x, y: F.levenshtein(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit(""))))
    return F.aggregate(steps, F.lit(0), lambda s, x: s + x) / F.greatest(F.length(a), F.length(b), F.lit(1))


def distances(rows: DataFrame, a: str, b: str) -> DataFrame:
    """rows with edit and blocks: edit_distance() and block_distance() of two columns (null: null), exact and made for many
    rows at once."""

    def work(xs: list, ys: list, ps: list, qs: list) -> list[tuple]:
        pairs, ends = [], [0]
        for x, y, p, q in zip(xs, ys, ps, qs, strict=True):
            if x is not None and y is not None:
                most = max(len(p), len(q))
                pairs += [(x, y), *zip([*p, *[""] * (most - len(p))], [*q, *[""] * (most - len(q))], strict=True)]
            ends.append(len(pairs))
        got, out = edits.levenshtein(pairs), []
        for x, y, at, end in zip(xs, ys, ends[:-1], ends[1:], strict=True):
            size = max(len(x or ""), len(y or ""), 1)
            out.append((got[at] / size, sum(got[at + 1 : end]) / size) if end > at else (None, None))
        return out

    split = rows.withColumns({"_p": tx.paragraphs(F.col(a)), "_q": tx.paragraphs(F.col(b))})
    return arrow.added(split, "edit double, blocks double", [a, b, "_p", "_q"], work, each=False).drop("_p", "_q")


def threshold(variant: Column, name: str) -> Column:
    out = F.lit(None).cast("double")
    for v, limits in THRESHOLDS.items():
        out = F.when(variant == v, F.lit(limits[name]).cast("double")).otherwise(out)
    return out


def thresholds(rows: DataFrame) -> DataFrame:
    """rows: case_id, variant, edit, density_before, density_after, cv_before, cv_after. Adds edit_ok, density_ok,
    cv_ok and over_edit (a control case edited beyond its band); with naturalness_before and naturalness_after also natural_ok."""
    v = F.col("variant")
    edit = F.col("edit").between(threshold(v, "edit_low"), threshold(v, "edit_high"))
    cut = F.when(F.col("density_before") > 0, 1 - F.col("density_after") / F.col("density_before")).otherwise(1.0)
    density = F.when(v == "C", F.col("density_after") <= F.col("density_before")).otherwise((F.col("density_after") <= threshold(v, "density_max")) & (cut >= threshold(v, "density_cut")))
    rhythm = F.col("cv_after") - F.col("cv_before") >= threshold(v, "cv_delta")
    over = (v == "C") & (F.col("edit") > threshold(v, "edit_high"))
    made = {"edit_ok": edit, "density_ok": density, "cv_ok": rhythm, "over_edit": over}
    if {"naturalness_before", "naturalness_after"} <= set(rows.columns):
        more = F.col("naturalness_after") - F.col("naturalness_before")
        made["natural_ok"] = F.when(v == "C", F.abs(more) <= threshold(v, "natural_delta")).otherwise((F.col("naturalness_after") >= threshold(v, "natural_min")) & (more >= threshold(v, "natural_delta")))
    return rows.withColumns(made)


def fidelity(rows: DataFrame) -> DataFrame:
    """rows: case_id, hard, claim, atom, citation, structure. Adds semantic_fidelity: their least, 0 on a hard failure."""
    return rows.withColumn("semantic_fidelity", F.when(F.col("hard") > 0, 0.0).otherwise(F.least("claim", "atom", "citation", "structure")))


def band(score: Column) -> Column:
    return F.when(score >= 4, "A").when(score >= 3, "B").when(score >= 2, "C").otherwise("D")


def scores(rows: DataFrame) -> DataFrame:
    """rows: case_id, naturalness, academic (a judge's, 1 to 5) and style_score (0 to 1; null: no author's profile).
    Adds naturalness_band, academic_band and style_band (the score on the same scale of 5)."""
    return rows.withColumns({"naturalness_band": band(F.col("naturalness")), "academic_band": band(F.col("academic")), "style_band": F.when(F.col("style_score").isNotNull(), band(5 * F.col("style_score")))})


def verdict(hard: Column, notes: Column) -> Column:
    return F.when(hard > 0, "FAIL").when(notes > 0, "PASS_WITH_NOTES").otherwise("PASS")


def dose_response(rows: DataFrame) -> DataFrame:
    """rows: variant, edit, naturalness_delta. One row: mean of each variant and whether the doses are in order."""
    means = [F.avg(F.when(F.col("variant") == v, F.col(c))).alias(f"{c}_{v.lower()}") for c in ("edit", "naturalness_delta") for v in "ABC"]
    edits = (F.col("edit_a") > F.col("edit_b")) & (F.col("edit_b") > F.col("edit_c"))
    natural = (F.col("naturalness_delta_a") >= F.col("naturalness_delta_b")) & (F.col("naturalness_delta_b") > F.col("naturalness_delta_c"))
    return rows.agg(*means).withColumns({"edit_ordered": edits, "naturalness_ordered": natural})


def coverage(expected: DataFrame, violations: DataFrame) -> DataFrame:
    """rule, mutations, caught: for each hard rule how many mutations expect it and met it. expected: doc_id, expect."""
    rules = expected.sparkSession.createDataFrame([(r,) for r in HARD_RULES], "rule string")
    met = violations.select("doc_id", F.col("rule").alias("expect")).distinct().withColumn("met", F.lit(1))
    rows = expected.where("expect IS NOT NULL").join(met, ["doc_id", "expect"], "left").groupBy(F.col("expect").alias("rule")).agg(F.count(F.lit(1)).alias("mutations"), F.count("met").alias("caught"))
    return rules.join(rows, "rule", "left").na.fill(0)


def lint(expected: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, kind, canonical of facts that must be preserved but cannot be extracted from the input."""
    return expected.join(found.select("doc_id", "kind", "canonical"), ["doc_id", "kind", "canonical"], "left_anti")


def anti_patterns(docs: DataFrame, patterns: DataFrame) -> DataFrame:
    """doc_id, phrase, n, exceeded. patterns (a case's few rules): phrase, max_count. A phrase with … in it is a chain:
    its parts in this order, whatever stands between."""
    rules = [(r.phrase, r.max_count, [x.lower() for x in r.phrase.split("…")]) for r in patterns.collect()]
    rows = docs.select("doc_id", F.lower("text").alias("low"))

    def count(parts: list[str]) -> Column:
        if len(parts) == 1:
            return ((F.length("low") - F.length(F.replace("low", F.lit(parts[0]), F.lit("")))) / max(1, len(parts[0]))).cast("long")
        return F.regexp_count("low", F.lit("(?s)" + ".*?".join(f"\\Q{x}\\E" for x in parts))).cast("long")

    found = [F.struct(F.lit(p).alias("phrase"), count(parts).alias("n"), (count(parts) > most).alias("exceeded")) for p, most, parts in rules]
    none = F.array().cast("array<struct<phrase:string,n:bigint,exceeded:boolean>>")
    one = rows.select("doc_id", F.explode(F.filter(F.array(*found), lambda x: x["n"] > 0) if found else none).alias("x"))
    return one.select("doc_id", "x.*")


#: Words that hedge a statement, by language; a parameter of fingerprints().
HEDGES = {"zh": ["可能", "或许", "似乎", "一定程度上", "数据支持"], "en": ["may", "might", "perhaps", "possibly", "appears", "suggests", "likely"]}


def fingerprints(docs: DataFrame, hedges: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, words (connectives used), mean, cv (of sentence lengths), hedging (hedging words a sentence)."""
    hedges = hedges or HEDGES
    low = F.lower(F.coalesce("text", F.lit("")))
    zh = sum((F.regexp_count(low, F.lit(f"\\Q{w}\\E")) for w in hedges["zh"]), F.lit(0))
    en = F.regexp_count(low, F.lit(r"\b(?:" + "|".join(hedges["en"]) + r")\b"))
    used = style.hits(docs, "connective").groupBy("doc_id").agg(F.array_sort(F.collect_set("phrase")).alias("words"))
    hedged = docs.select("doc_id", (zh + en).alias("hedges"))
    rows = style.rhythm(docs).join(hedged, "doc_id").join(used, "doc_id", "left")
    words = F.coalesce("words", F.array().cast("array<string>"))
    return rows.select("doc_id", words.alias("words"), F.col("sentence_mean").alias("mean"), F.col("sentence_cv").alias("cv"), (F.col("hedges") / F.greatest("n_sentences", F.lit(1))).alias("hedging"))


def fingerprint_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """author, other: id, words (array), mean, cv, hedging. Jaccard distance of words, differences of moments and of the
    hedging rate, and style_score (1 for equal fingerprints, towards 0)."""
    other = b.select("id", F.col("words").alias("w1"), F.col("mean").alias("m1"), F.col("cv").alias("c1"), F.col("hedging").alias("h1"))
    both = a.select("id", "words", "mean", "cv", "hedging").join(other, "id")
    union = F.size(F.array_union("words", "w1"))
    jaccard = F.when(union > 0, 1 - F.size(F.array_intersect("words", "w1")) / union).otherwise(0.0)
    gap = lambda x, y: F.abs(F.col(x) - F.col(y))
    apart = lambda x, y: F.when(F.greatest(x, y) > 0, gap(x, y) / F.greatest(x, y)).otherwise(0.0)
    score = 1 - (jaccard + apart("mean", "m1") + apart("cv", "c1") + apart("hedging", "h1")) / 4
    return both.select("id", jaccard.alias("word_distance"), gap("mean", "m1").alias("mean_distance"), gap("cv", "c1").alias("cv_distance"), gap("hedging", "h1").alias("hedging_distance"), score.alias("style_score"))


def regressions(before: DataFrame, after: DataFrame) -> DataFrame:
    """case_id, band_dropped, new_hard_fail, regressed. Both: case_id, band (A best), hard."""
    both = after.select("case_id", "band", "hard").join(before.select("case_id", F.col("band").alias("band0"), F.col("hard").alias("hard0")), "case_id")
    dropped, failed = F.col("band") > F.col("band0"), (F.col("hard") > 0) & (F.col("hard0") == 0)
    return both.select("case_id", dropped.alias("band_dropped"), failed.alias("new_hard_fail"), (dropped | failed).alias("regressed"))


def judged(rows: DataFrame) -> DataFrame:
    """The rules that thresholds() tells of a case, in the gate's columns: over_edit (hard) of a control case edited
    beyond its band, rhythm_residual (soft) of sentence lengths that vary too little. rows: doc_id and thresholds()' columns."""
    found = F.array(F.when(F.col("over_edit"), F.struct(F.lit("over_edit").alias("rule"), F.lit("hard").alias("severity"))), F.when(~F.col("cv_ok"), F.struct(F.lit("rhythm_residual").alias("rule"), F.lit("soft").alias("severity"))))
    one = rows.select("doc_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("x"))
    empty = F.lit("")
    return one.select("doc_id", "x.rule", "x.severity", empty.alias("detail"), empty.alias("before"), empty.alias("after"))


def baselines(stats: DataFrame, by: str) -> DataFrame:
    """Mean, deviation and tenths of sentence lengths and cv by a column, over a corpus."""
    return stats.groupBy(by).agg(F.count(F.lit(1)).alias("documents"), F.avg("sentence_mean").alias("mean"), F.stddev_pop("sentence_mean").alias("sd"), F.avg("sentence_cv").alias("cv"), F.percentile("sentence_mean", F.lit(0.1)).alias("p10"), F.percentile("sentence_mean", F.lit(0.9)).alias("p90"))
