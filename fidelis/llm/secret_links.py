"""Secret scans with multipart credential linking, in DataFrame expressions only.

Base spans (assignments, access identifiers, hex strings) are reported always. Weak candidates - account
names, vague secrets and endpoints, each innocent alone - are reported only when a complementary part
lies within the same scope, `scope` code points around it: a name needs a secret, a vague secret a name or
an endpoint, an endpoint a secret. The link is an interval join: parts are dealt to (row, scope-wide bin)
and each weak part semi-joins its own and the two neighbouring bins, so no pairs are made and a bin holds
only what fits into its width.

Offsets are code points, end exclusive. Defined results: null text counts as empty; rows are keyed by
all of id and text, so repeated rows share their result; extra columns stay.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm._util import written

#: Width of a scope in code points.
SCOPE = 240
#: Kinds in the order of the span list, their roles, and patterns. The first three are the base.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
KINDS = {
    "assign": ("secret", ASSIGN),
    "access": ("name", r"AKIA[A-Z0-9]{16,}"),
    "hex": ("secret", r"[0-9a-f]{24,}"),
    "name": ("name", r"""\b(?i:client_?id|access_?id|user_?name|login|account_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@_.+-]{3,}"""),
    "vague": ("secret", r"""\b(?i:pwd|passphrase|credential|auth_?key|private_?key)["']?\x20*[:=]\x20*["']?[^\s"',;]{4,}"""),
    "endpoint": ("endpoint", r"""\b[a-z][a-z0-9+.]{1,15}://[^\s"'<>]+"""),
}
BASE = ["assign", "access", "hex"]
#: Roles that complete a weak candidate's role.
COMPLETES = {"name": ["secret"], "secret": ["name", "endpoint"], "endpoint": ["secret"]}
#: Elements that a fold gathers before they are put aside, code points of a text's blocks.
RUN, BLOCK = 128, 4096
_SPAN = "array<struct<start:int,ord:int,end:int>>"


def _runs(items: Column, size: int = RUN) -> Column:
    """The array as an array of runs, so that a fold copies a run's result only."""
    runs = F.ceil(F.size(items) / size).cast("int")
    return F.when(runs > 0, F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.slice(items, i * size + 1, size))).otherwise(F.array())


def _before(runs: Column, of, join, begin) -> Column:
    """For each run what join() makes of begin and of() all runs before it."""
    state = F.struct(begin.alias("at"), F.array().cast("array<int>").alias("out"))

    def step(acc: Column, run: Column) -> Column:
        return F.struct(join(acc["at"], of(run)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out"))

    return F.aggregate(runs, state, step, lambda a: a["out"])


def found(text: Column, kind: str) -> Column:
    """Spans of a kind in order: what lies between matches and the matches themselves give the offsets."""
    pattern = KINDS[kind][1]
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    order = list(KINDS).index(kind)

    def one(h: Column, g: Column) -> Column:
        keep = F.length(F.regexp_extract(h, pattern, 2)) >= 6 if kind == "assign" else F.lit(True)
        return F.struct(F.length(g).alias("gap"), F.length(h).alias("hit"), keep.alias("keep"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(order).alias("ord"), (start + x["hit"]).alias("end"))
        return F.struct((start + x["hit"]).alias("at"), F.when(x["keep"], F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    def placed(runs: Column) -> Column:
        total = lambda run: F.aggregate(run, F.lit(0), lambda a, x: a + x["gap"] + x["hit"])
        begin = _before(runs, total, lambda a, b: a + b, F.lit(0))
        none = F.array().cast(_SPAN)
        return F.flatten(F.zip_with(runs, begin, lambda run, at: F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))

    # a variable of one element, so that the runs are made once
    zipped = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), one)
    spans = F.transform(F.array(zipped), lambda z: placed(_runs(z)))[0]
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(_SPAN))


def parts(df: DataFrame, text: str = "text") -> Column:
    """All spans of all kinds of a row, by start, then kind."""
    body = F.coalesce(F.col(text), F.lit(""))
    return F.array_sort(F.concat(*[found(body, k) for k in KINDS]))


def _row(df: DataFrame, key: str, text: str) -> Column:
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col(key).cast("string"), F.lit("")), F.coalesce(F.col(text), F.lit(""))), 256)


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """rows: row_key, parts. Returns row_key, weak (spans of candidates that a complementary part completes)."""
    names, base = list(KINDS), len(BASE)
    one = rows.where(F.exists("parts", lambda p: p["ord"] >= base)).select("row_key", F.explode("parts").alias("p")).distinct()
    role = F.element_at(F.array(*[F.lit(KINDS[k][0]) for k in names]), F.col("p.ord") + 1)
    one = one.select("row_key", "p", role.alias("role"))
    # a part lies in every bin it touches; a weak one asks its own bins and those beside them
    bins = F.sequence((F.col("p.start") / scope).cast("int"), (F.col("p.end") / scope).cast("int"))
    near = F.sequence((F.col("p.start") / scope).cast("int") - 1, (F.col("p.end") / scope).cast("int") + 1)
    right = one.select("row_key", F.explode(bins).alias("bin"), F.col("p").alias("q"), F.col("role").alias("other"))
    left = one.where(F.col("p.ord") >= base).withColumn("bin", F.explode(near))
    completes = F.lit(False)
    for r, others in COMPLETES.items():
        completes = completes | ((F.col("role") == r) & F.col("other").isin(others))
    meets = (F.col("q.start") <= F.col("p.end") + scope) & (F.col("q.end") >= F.col("p.start") - scope)
    l, r = left.alias("l"), right.alias("r")
    hit = l.join(r, (F.col("l.row_key") == F.col("r.row_key")) & (F.col("l.bin") == F.col("r.bin")) & completes & meets, "left_semi")
    return hit.groupBy("row_key").agg(F.collect_set("p").alias("weak"))


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", scope: int = SCOPE, keep_text: bool = True) -> DataFrame:
    """Adds spans (in place of a column of that name): array of (start, ord, end), base and completed weak ones, ord
    as the order of KINDS.

    keep_text=False leaves the text out, so that nothing large is shuffled."""
    kept = [c for c in df.columns if c != "spans" and (keep_text or c != text)]
    # own names stand beside one struct of the given columns, so none can clash
    keyed = df.select(F.struct(*kept).alias("given"), _row(df, key, text).alias("row_key"), parts(df, text).alias("parts"))
    if keep_text:
        # only rows with weak candidates take part in the link; their spans come back by row key
        some = written(keyed.where(F.exists("parts", lambda p: p["ord"] >= len(BASE))).select("row_key", "parts").distinct(), "parts")
        rows, links = keyed, linked(some, scope)
    else:
        rows = written(keyed, "parts")
        links = linked(rows.select("row_key", "parts"), scope)
    base = F.filter("parts", lambda p: p["ord"] < len(BASE))
    spans = F.array_sort(F.concat(base, F.coalesce(F.col("weak"), F.array().cast(_SPAN))))
    return rows.join(links, "row_key", "left").select("given.*", spans.alias("spans"))


def as_text(spans: Column) -> Column:
    """kind:start:end, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["ord"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def base_only(spans: Column) -> Column:
    return F.filter(spans, lambda s: s["ord"] < len(BASE))


def redacted(text: Column, spans: Column, mask: str = "[REDACTED]") -> Column:
    """The text with every span replaced by the mask; overlapping spans become one. spans are in order of start."""

    def cuts(runs: Column) -> Column:
        """Where a kept piece begins and ends, at each span that touches none before it."""
        most = lambda run: F.aggregate(run, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
        begin = _before(runs, most, F.greatest, F.lit(0))
        none = F.array().cast("array<struct<a:int,b:int>>")

        def step(acc: Column, s: Column) -> Column:
            piece = F.array(F.struct(acc["at"].alias("a"), s["start"].alias("b")))
            more = F.when((s["start"] >= acc["at"]), F.concat(acc["out"], piece)).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), more.alias("out"))

        return F.flatten(F.zip_with(runs, begin, lambda run, at: F.aggregate(run, F.struct(at.alias("at"), none.alias("out")), step, lambda a: a["out"])))

    def piece(blocks: Column, a: Column, b: Column) -> Column:
        """Code points a to b, looked for in their blocks only."""
        first, last = F.floor(a / BLOCK).cast("int"), F.floor((b - 1) / BLOCK).cast("int")
        here = F.array_join(F.slice(blocks, first + 1, last - first + 1), "")
        return F.when(b > a, F.substring(here, a - first * BLOCK + 1, b - a)).otherwise("")

    end = F.aggregate(spans, F.lit(0), lambda a, s: F.greatest(a, s["end"]))
    blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))

    def rest(own: Column) -> Column:
        kept = F.transform(cuts(_runs(spans)), lambda c: F.concat(piece(own, c["a"], c["b"]), F.lit(mask)))
        return F.concat(F.array_join(kept, ""), piece(own, end, F.length(text)))

    return F.when(F.size(spans) > 0, F.transform(F.array(blocks), rest)[0]).otherwise(text)
