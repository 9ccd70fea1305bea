"""Mixing documents to target domain weights by soft membership, in DataFrame expressions only.

A linear discriminant, fitted by one aggregation over all rows that the labelled table covers, gives each
document posteriors of the domains. Its features are native: token count, share of symbols, of capitals and
of distinct tokens, and per domain the document's share of tokens that a bounded labelled sample found
typical of it. Nonnegative rates are then fitted so that the expected token totals of the domains,
sum of tokens * posterior * rate, equal the targets: projected gradient steps on the least squares, in the
metric of the documents that are not at zero, each one aggregation over the posterior table. A document's
rate is a fold of the few steps' vectors over its posteriors, so nothing but that list is carried along.

Defined results: null text counts as no tokens; a document without labels still gets posteriors; domains
without labelled rows are left out and the targets of the others scaled to sum 1; without any domain each
rate is 1; a target that no rates can meet is met as closely as least squares can; extra columns stay.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm._util import written

#: Labelled rows of a domain that typical tokens are sought in (in expectation), tokens kept of a domain, how
#: many times their share elsewhere they need; steps at most, damping of a step, gap that is close enough.
SAMPLE, TYPICAL, RATIO, STEPS, DAMP, CLOSE = 1500, 200, 4, 30, 1e-3, 1e-6
#: White space of tokens, and the characters that count as symbols.
SPACE, SYMBOLS = r"[\x20\x09-\x0D]+", "!#$%&*@^~|<>{}[]=+_\\/"
TARGETS = {"clean": 0.85, "low": 0.12, "toxic": 0.03}


def domain(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, domain: toxic, low or clean of each labelled document; conflicting rows take the worst."""
    rows = labels.where(F.col(key).isNotNull() & (F.col("toxic").isNotNull() | F.col("quality").isNotNull()))
    one = rows.groupBy(key).agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    return one.select(key, F.when(F.col("t") == 1, "toxic").when(F.col("q") == 0, "low").otherwise("clean").alias("domain"))


def tokens(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), SPACE), "")


@dataclass
class Mix:
    """What the driver keeps: domains, typical tokens, the discriminant and the steps."""

    domains: list[str] = field(default_factory=list)
    typical: dict[str, list[str]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    steps: list[list[float]] = field(default_factory=list)


def typical_tokens(docs: DataFrame, named: DataFrame, domains: dict[str, int], key: str, text: str) -> dict[str, list[str]]:
    """Tokens whose document share in a domain's sample most exceeds that in the others'."""
    base, pick = 1 << 30, F.lit(False)
    for name, n in domains.items():
        pick = pick | ((F.col("domain") == name) & (F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("mix")), F.lit(base)) < min(base, base * SAMPLE // n)))
    some = docs.join(F.broadcast(named.where(pick)), key).select("domain", F.array_distinct(tokens(text)).alias("t"))
    some = written(some, "sample")
    sizes = {r.domain: r["count"] for r in some.groupBy("domain").count().collect()}
    counts = some.select("domain", F.explode("t").alias("w")).groupBy("w").pivot("domain", sorted(domains)).count().na.fill(0)
    out = {}
    for name in domains:
        if not sizes.get(name):
            out[name] = []
            continue
        rest = [d for d in domains if d != name and sizes.get(d)]
        other = sum((F.col(f"`{d}`") for d in rest), F.lit(0)) / F.lit(max(1, sum(sizes[d] for d in rest)))
        own = F.col(f"`{name}`") / F.lit(sizes[name])
        gain = (own - other) / F.sqrt((own + other) / 2 + F.lit(1.0 / sizes[name]))
        much = (F.col(f"`{name}`") >= 3) & (own >= RATIO * other)
        top = counts.where(much).select("w", gain.alias("g")).orderBy(F.desc("g"), "w").limit(TYPICAL).collect()
        out[name] = [r.w for r in top]
    return out


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """Adds columns behind a generator of one row, so that later expressions read them instead of computing them again."""
    kept = [c for c in df.columns if c not in columns]
    one = df.select(*kept, F.explode(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))).alias("_one"))
    return one.select(*kept, *[F.col(f"_one.{n}").alias(n) for n in columns])


def features(docs: DataFrame, mix: Mix, text: str) -> DataFrame:
    """Adds _n (tokens) and _x (array of numbers, the last 1)."""
    body = F.coalesce(F.col(text), F.lit(""))
    chars = F.greatest(F.length(body), F.lit(1))

    def share(characters: str) -> Column:
        return F.sqrt((F.length(body) - F.length(F.translate(body, characters, ""))) / chars)

    got = settled(docs, _t=tokens(text)).withColumn("_n", F.size("_t").cast("long"))
    n = F.greatest(F.col("_n"), F.lit(1))
    x = [F.log1p(F.col("_n").cast("double")), share(SYMBOLS), share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), F.size(F.array_distinct("_t")) / n]
    for name in mix.domains:
        words = mix.typical.get(name) or [""]
        x.append(F.log1p(F.size(F.array_intersect("_t", F.array(*[F.lit(w) for w in words]))).cast("double")))
    return settled(got, _x=F.array(*[c.cast("double") for c in x], F.lit(1.0))).drop("_t")


def posterior(rows: DataFrame, mix: Mix) -> DataFrame:
    """Adds _p, the array of the domains' posteriors: softmax of linear scores of _x."""
    size = len(mix.domains)
    if size < 2:
        return rows.withColumn("_p", F.array(*[F.lit(1.0)] * size).cast("array<double>"))
    z = [F.aggregate(F.zip_with("_x", F.array(*map(F.lit, map(float, w))), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v) for w in mix.weights]
    scored = settled(rows, _z=F.array(*z))
    each = [F.lit(1.0) / sum((F.exp(F.col("_z")[j] - F.col("_z")[i]) for j in range(size)), F.lit(0.0)) for i in range(size)]
    return settled(scored, _p=F.array(*each)).drop("_z")


def discriminant(rows: DataFrame, domains: list[str], size: int) -> np.ndarray:
    """Linear scores from each domain's mean and the common second moments; rows: domain, _x."""
    moments = [F.sum(F.col("_x")[i] * F.col("_x")[j]).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)]
    got = {r.domain: r for r in rows.groupBy("domain").agg(*moments).collect()}
    second = {d: np.array([[got[d][f"m{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], float) for d in domains}
    counts = np.array([second[d][-1, -1] for d in domains])
    means = np.array([second[d][-1, :-1] for d in domains]) / counts[:, None]
    within = sum(second[d][:-1, :-1] for d in domains) - (means.T * counts) @ means
    within = within / counts.sum()
    within += np.diag(np.diag(within) * 1e-3 + 1e-6)
    slopes = np.linalg.solve(within, means.T).T
    offset = -0.5 * (slopes * means).sum(1) + np.log(counts / counts.sum())
    return np.c_[slopes, offset]


def rate(steps: list[list[float]]) -> Column:
    """The rate after the steps: from 1, each moves against its gradient and is projected to zero or more."""
    if not steps:
        return F.lit(1.0)
    history = F.array(*[F.array(*map(F.lit, map(float, g))) for g in steps])
    return F.aggregate(history, F.lit(1.0), lambda r, g: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with("_p", g, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)))


def fit(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None, key: str = "doc_id", text: str = "text", total: float | None = None) -> tuple[Mix, DataFrame]:
    """The fitted mix, and the written table of key, _n, _p that it was fitted on. total: tokens that the
    targets share out; by default as many as there are."""
    targets = targets or TARGETS
    named = domain(labels, key).where(F.col("domain").isin(list(targets)))
    docs = docs.select(key, text)
    known = docs.where(F.col(key).isNotNull()).select(key).join(named, key)
    counts = {r.domain: r["count"] for r in known.groupBy("domain").count().collect()}
    mix = Mix([d for d in targets if counts.get(d)])
    if len(mix.domains) > 1:
        mix.typical = typical_tokens(docs, named, {d: counts[d] for d in mix.domains}, key, text)
    rows = written(features(docs, mix, text).select(key, "_n", "_x"), "features")
    if len(mix.domains) > 1:
        mix.weights = discriminant(rows.join(named, key).select("domain", "_x"), mix.domains, 5 + len(mix.domains))
    table = written(posterior(rows, mix).select(key, "_n", "_p"), "posteriors")
    if not mix.domains:
        return mix, table
    size, sums = len(mix.domains), None
    share = np.array([max(0.0, targets[d]) for d in mix.domains])
    share = share / share.sum() if share.sum() else np.full(size, 1 / size)
    for _ in range(STEPS):
        r, n = F.col("_r"), F.col("_n")
        p = [F.col("_p")[i] for i in range(size)]
        got = table.withColumn("_r", rate(mix.steps)).agg(
            F.sum("_n").alias("all"), *[F.sum(n * r * p[i]).alias(f"t{i}") for i in range(size)],
            *[F.sum(F.when((r > 0) | F.lit(not mix.steps), n * p[i] * p[j]).otherwise(0.0)).alias(f"m{i}_{j}") for i in range(size) for j in range(i, size)],
        ).first()
        if not got["all"]:
            break
        goal = share * (total or got["all"])
        gap = np.array([got[f"t{i}"] for i in range(size)], float) - goal
        if abs(gap).max() <= CLOSE * goal.sum() or (sums is not None and abs(gap).max() >= sums * (1 - 1e-6) and len(mix.steps) > 8):
            break
        sums = abs(gap).max()
        metric = np.array([[got[f"m{min(i, j)}_{max(i, j)}"] for j in range(size)] for i in range(size)], float)
        metric += np.eye(size) * max(1e-12, DAMP * np.trace(metric) / size)
        mix.steps.append(np.linalg.solve(metric, gap).tolist())
    return mix, table


def rates(docs: DataFrame, mix: Mix, text: str = "text") -> DataFrame:
    """Adds n_tokens, posteriors (array, in the order of mix.domains) and rate to whole rows; nothing is joined."""
    kept = [c for c in docs.columns if c not in ("n_tokens", "posteriors", "rate")]
    # own names stand beside one struct of the given columns, so none can clash
    rows = docs.select(F.struct(*kept).alias("_given"), F.col(text).alias("_text"))
    got = settled(posterior(features(rows, mix, "_text"), mix), rate=rate(mix.steps))
    return got.select("_given.*", F.col("_n").alias("n_tokens"), F.col("_p").alias("posteriors"), "rate")


def copies(rate: Column, key: str, least: Column | None = None) -> Column:
    """The rate as a whole number of copies: rounded up or down by a hash of the id, so expected copies are the rate."""
    u = F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("copies")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    n = F.floor(rate + u)
    return (F.greatest(n, least) if least is not None else n).cast("int")
